"""Token counts in a sentencepiece BPE vocabulary by rank-synchronous array merging.

A text, normalised by the library, is cut into pre-tokens at places that no piece spans. The
distinct pre-tokens of a batch are held as one ragged array of symbol ids. In every round each
sequence finds its own pair of lowest rank (the leftmost of equals) and all sequences merge
theirs at once; sequences without a pair leave. The symbols that survive are the tokens; a
character that isn't in the vocabulary counts its UTF-8 bytes (byte fallback).

One pair a sequence and round, so the result is that of merging pairs one by one in rank order.
Pre-tokens of more than LONG symbols, where rounds would be many, are merged by a heap in the same
order instead. Memory is bounded by the batch, and by a cache of CACHE pre-tokens a worker.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted one by
one. Other columns pass through; ``n_bytes`` and ``n_tokens`` replace columns of these names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import record_batches

SPACE = "▁"
LONG = 2048
CACHE = 1_000_000


class PieceRanks:
    """Ids of pieces, and the rank of each pair of ids whose concatenation is a piece."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        order = sorted(plain, key=lambda i: (-self.library.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        #: Merges as sorted pair codes with their result and its rank.
        made = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (rank[i], i)
        codes = sorted(made)
        self.made = made
        self.codes = np.array([*codes, np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([*(made[c][0] for c in codes), 0], np.int64)
        self.results = np.array([*(made[c][1] for c in codes), 0], np.int64)
        #: Pairs of neighbouring characters inside pieces: a place between two others is never merged over.
        self.inside = np.array(sorted({ord(p[i]) << 32 | ord(p[i + 1]) for p in self.ids for i in range(len(p) - 1)} | {1 << 62}), np.int64)
        letters = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.letters = np.array([*(c for c, _ in letters), 1 << 32], np.int64)
        self.letter_ids = np.array([*(i for _, i in letters), -1], np.int64)
        self.space_starts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cache: dict[str, int] = {}
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*")

    def pretokens(self, normal: str) -> list[str]:
        """Parts of a normalised text from its first word mark on, each without its own mark; no piece reaches over two."""
        if not self.space_starts:
            return [normal[1:]]
        return [x[1:] for x in self.cut.findall(normal)] if SPACE * 2 in normal else normal[1:].split(SPACE)

    def count(self, texts: list[str]) -> list[int]:
        normal = self.library.normalize(texts)
        heads = [x.partition(SPACE)[0] for x in normal]  # empty, if the vocabulary puts a mark before a text
        words = [self.pretokens(x[len(h) :]) if len(x) > len(h) else [] for x, h in zip(normal, heads)]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list({w for own in words for w in own if w not in cache})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            cache.update(zip(part, self._counts([SPACE + w for w in part])))
        first = self._counts(heads) if any(heads) else [0] * len(heads)
        return [n + sum(map(cache.__getitem__, own)) for n, own in zip(first, words)]

    def _counts(self, words: list[str]) -> list[int]:
        """Tokens of each word: byte fallbacks plus surviving symbols."""
        total = np.zeros(len(words), np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if not len(chars):
            return total.tolist()
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        at = np.searchsorted(self.letters, chars)
        known = self.letters[at] == chars
        np.add.at(total, word[~known], (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))[~known])
        pair = chars[:-1] << 32 | chars[1:]
        joined = known[:-1] & known[1:] & (word[:-1] == word[1:]) & (self.inside[np.searchsorted(self.inside, pair)] == pair)
        begins = np.r_[True, ~joined]
        ids, seq = self.letter_ids[at[known]], (np.cumsum(begins) - 1)[known]
        seq = np.unique(seq, return_inverse=True)[1]  # numbers without gaps
        owner = word[known][np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])] if len(seq) else word[:0]
        size = np.bincount(seq, minlength=len(owner))
        for k in np.flatnonzero(size > LONG).tolist():
            total[owner[k]] += self._heap(ids[seq == k].tolist())
        short = size[seq] <= LONG
        left = self._merge(ids[short], seq[short], len(owner))
        np.add.at(total, owner, left)
        return total.tolist()

    def _merge(self, ids: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """Symbols left of each of n sequences; seq is the sequence of each symbol, ascending."""
        left = np.bincount(seq, minlength=n)
        none = np.int64(1 << 62)
        while len(ids) > 1:
            pair = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.codes, pair)
            merges = (self.codes[at] == pair) & (seq[:-1] == seq[1:])
            # rank and place in one number: its minimum is a sequence's lowest rank, the leftmost of equals
            order = np.where(merges, self.ranks[at] << 32 | np.arange(len(pair)), none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(order, starts[starts < len(order)])
            hit = least[least < none] & ((1 << 32) - 1)
            if not len(hit):
                break
            ids = ids.copy()
            ids[hit] = self.results[at[hit]]
            np.subtract.at(left, seq[hit], 1)
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            alive = np.zeros(n, bool)
            alive[seq[hit]] = True
            keep &= alive[seq]
            ids, seq = ids[keep], seq[keep]
        return left

    def _heap(self, ids: list[int]) -> int:
        """Symbols left of one long sequence, merged pair by pair."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ids, n, made = list(ids), len(ids), self.made
        heap = [(*made[c], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (c := a << 32 | b) in made]
        heap = [(rank, i, a, b, out) for rank, out, i, a, b in heap]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, out = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = out, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := made.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return left


_READY: dict[str, PieceRanks] = {}


def ranks(model: str) -> PieceRanks:
    """The vocabulary, read once a worker."""
    if model not in _READY:
        _READY[model] = PieceRanks(model)
    return _READY[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, text: str = "text", *, model: str | None = None) -> DataFrame:
    """df with n_bytes and n_tokens; model is a path on the workers, by default the installed vocabulary's."""
    columns = [c for c in df.columns if c not in ("n_bytes", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ranks(model or default_model())
        for whole in batches:
            for batch in record_batches(whole, text, 4_000_000):
                texts = [x or "" for x in batch.column(text).to_pylist()]
                sizes = [len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(counter.count(texts), pa.int64())], [*kept, "n_bytes", "n_tokens"])

    kept = [c for c in columns if c != text]
    kind = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return df.select(*kept, text).mapInArrow(run, kind)
