"""Best-fit packing into sequences, after a dominance reduction in the manner of Martello and Toth.

Texts are tokenised and end with an end id; a text longer than a sequence is cut into full pieces
behind a first one that takes the rest. Only lengths matter for packing, so the instance is a
histogram with at most ``capacity`` lengths, whatever the number of documents. On it plan()

* fixes bins that dominate every other use of the longest length left: it fits with nothing; its
  largest partner fills the bin exactly; no two others fit beside it, so its largest partner is
  best; or no three fit and the largest partner with the largest third leave no better pair;
* packs what remains by best fit, longest first, for all bins alike at once.

The pieces of a length get ranks without a gap (counted by hashed buckets, so that a length that a
third of all pieces have is no single task), and a rank has its sequence and place in the plan.

Defined results: a null or empty text is the end id alone. Very long texts are encoded whole and cut.
Repeated rows are packed one by one; a row without doc_id is packed too. Of the columns doc_id alone
passes through. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, record_batches, tidy

END_ID = 2
#: Ranked rows of a bucket of one length, about.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 64, 4096


class Encoder:
    """Ids of the byte-level BPE vocabulary.

    tiktoken has the same vocabulary as ranks and gives the same ids at four times the speed; texts that
    hold the special token, which tokenizers reads as one id, go to tokenizers.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        import tiktoken

        self.vocabulary, self._exact = vocabulary, None
        with open(ranks, "rb") as lines:
            held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.vocabulary)
        return self._exact.encode(text, add_special_tokens=False).ids


_READY: list[Encoder] = []


def default_encoder() -> Encoder:
    """The installed vocabulary, read once a worker."""
    if not _READY:
        import public_tokenizers as P

        _READY.append(Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    return _READY[0]


def pieces(docs: DataFrame, capacity: int = 1024, encoder=default_encoder) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for whole in batches:
            for batch in record_batches(whole, "text"):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    starts = [0, *range(first, len(ids), capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, number of such bins) for all pieces of a histogram of lengths."""
    left = {n: k for n, k in histogram.items() if k > 0}
    fixed, rest = _reduce(left, capacity)
    return fixed + _best_fit(rest, capacity)


def _reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that dominate all others that hold the same longest piece, and the counts that remain."""
    left, bins = dict(counts), []
    sizes = sorted(left)

    def take(lengths: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        bins.append((lengths, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                sizes.remove(n)

    def largest(room: int, used: tuple[int, ...]) -> int | None:
        """The largest length within room that is left besides those used."""
        i = bisect.bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, used: int) -> int | None:
        """The sum of the k smallest pieces besides one of the length used."""
        total = 0
        for n in sizes:
            m = min(left[n] - (n == used), k)
            total, k = total + n * m, k - m
            if not k:
                return total
        return None

    skipped: list[int] = []
    for longest in sorted(left, reverse=True):
        while left.get(longest):
            room = capacity - longest
            partner = largest(room, (longest,))
            if partner is None:
                take((longest,))
                continue
            two, three = smallest(2, longest), smallest(3, longest)
            if partner == room or two is None or two > room:
                take((longest, partner))
                continue
            third = largest(room - partner, (longest, partner))
            if third is not None and (three is None or three > room):
                i = bisect.bisect_right(sizes, third)
                better = [n for n in sizes[i : i + 2] for _ in range(min(left[n] - (n == longest), 2))][:2]
                if len(better) < 2 or sum(better) > room:
                    take((longest, partner, third))
                    continue
            skipped.append(longest)
            break
    return bins, left


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: each piece goes where the least room is left; bins that hold the same count as one."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms: list[int] = []  # sorted

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = capacity - sum(lengths)
        if room not in groups:
            bisect.insort(rooms, room)
        groups[room].append((lengths, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                fits = min(capacity // n, todo)
                times = todo // fits
                put((n,) * fits, times)
                todo -= fits * times
                continue
            room = rooms[i]
            lengths, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = min(room // n, todo)
            used = min(times, todo // each)
            put(lengths + (n,) * each, used)
            if times > used:
                put(lengths, times - used)
            todo -= each * used
    return [g for same in groups.values() for g in same]


def _places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, runs of ranks: first rank, pieces a bin, first bin, first offset in the bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranked: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, times in bins:
        at = 0
        for n in sorted(set(lengths), reverse=True):
            k = lengths.count(n)
            runs[n].append((ranked[n], k, base, at))
            ranked[n] += k * times
            at += k * n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(docs: DataFrame, capacity: int = 1024, encoder=default_encoder) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.table(pieces(docs, capacity, encoder), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity))
    n_buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, sum(histogram.values()) // BUCKET_ROWS))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    counted = scratch.table(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    before = counted.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n).tolist():
                mine = n == size
                first, each, base, at = places[size]
                i = np.searchsorted(first, rank[mine], "right") - 1
                k = rank[mine] - first[i]
                sequence[mine], offset[mine] = base[i] + k // each[i], at[i] + k % each[i] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*kept, "rank").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
