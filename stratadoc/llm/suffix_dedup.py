"""Exact dedup of repeated byte strings by suffix sorting, over all documents.

A byte goes if a string of ``size`` bytes that covers it also starts earlier (in a document of
smaller doc_id, or earlier in the same one). Such strings are windows; a window's anchor is its
substring of ANCHOR bytes with the least hash, so equal windows have equal anchors at equal places,
and neighbouring windows with one anchor form a stretch of text, found by rolling arrays.

1. Stretches are collapsed by content (in a task, then over all): of equal stretches all but the
   first go. An anchor that occurs once, or in one content only, is settled.
2. The contents of the other anchors are fetched, and those of an anchor are sorted together by the
   linear suffix sorting of lyndon_sort: equal windows are neighbours in suffix order, all but the
   first of them go. An anchor with very many contents is sorted in several blocks, whose distinct
   windows then meet by hash; so no block grows with the data.
3. The marks of a document are cut from its text.

What a stage passes on are packed arrays by shard or bucket, not rows, and shards and buckets grow in
number with the input. A stretch that very many documents hold is one entry a task, a window that
does is one a shard. An anchor with many contents in one task has these spread over shards; its own
shard is told, and all its contents are then met as those of a split anchor.

Defined results: a null text is empty. Rows without doc_id take no part and stay whole. doc_id is a
key: rows that repeat it count as one document and should repeat its text. Matches don't cross
documents. A text of 2**28 bytes or more is refused with an error. Other columns don't pass through.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, record_batches
from .lyndon_sort import suffix_arrays
from .minhash import _mix

SIZE, ANCHOR = 100, 32
#: Text of a shard or bucket, about; and the least number of these.
SHARD_BYTES, LEAST_SHARDS = 12_000_000, 128
#: Text that is rolled over at once; its arrays take about a hundred times as much.
SLICE_BYTES = 1_500_000
#: Contents of an anchor that are sorted in one block, at most; bytes that are sorted in one call, about.
BLOCK_CONTENTS, CALL_BYTES = 24, 600_000
#: Contents of an anchor in one task from which they are spread over shards.
SPREAD_CONTENTS = 16
#: Stretches (32 bytes each) that a task holds before it collapses and passes them on, about.
HELD_STRETCHES = 2_000_000
_PLACE_BITS = 28

#: A stretch: anchor and content by hash, document, first window, number of windows.
STRETCH = np.dtype([("a", "<u8"), ("x", "<u8"), ("d", "<i8"), ("s", "<u4"), ("n", "<u2")])
#: Windows of a document that go.
MARK = np.dtype([("d", "<i8"), ("s", "<u4"), ("n", "<u2")])
#: A stretch to fetch, with the number of its anchor's block (0: the only one).
FETCH = np.dtype([("a", "<u8"), ("d", "<i8"), ("s", "<u4"), ("n", "<u2"), ("k", "<u8")])
#: A window by hash, and its first place in a block.
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("d", "<i8"), ("s", "<u4")])
_BLOBS = "kind int, part int, blob binary"
_MARKS, _FETCHES, _WINDOWS, _STRETCHES, _TEXTS, _SPREAD, _SPREAD_ANCHORS = range(7)


_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data) + 1)
    return np.r_[np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])], down


def stretches(data: np.ndarray, offsets: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Document numbers, first windows, numbers of windows, anchor and content hashes of all stretches of some texts."""
    windows, wide = len(data) - size + 1, size - anchor + 1
    if len(data) >> _PLACE_BITS:
        raise ValueError(f"a text of {len(data)} bytes; texts have fewer than {1 << _PLACE_BITS}")
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums, down = _rolling(data)
    grams = len(data) - anchor + 1
    hashes = _mix((sums[anchor:] - sums[:grams]) * down[:grams])
    keys = hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(grams, dtype=np.uint64)
    blocks = np.r_[keys, np.full(-grams % wide, ~np.uint64(0))].reshape(-1, wide)  # least of a window: of the end of one block and the start of the next
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[:windows] == doc[size - 1 :]
    turn = (at[1:] != at[:-1]) | (doc[1:windows] != doc[: windows - 1])
    first = np.flatnonzero(valid & np.r_[True, turn | ~valid[:-1]])
    last = np.flatnonzero(valid & np.r_[turn | ~valid[1:], True])
    length = last + size - first
    content = _mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64))
    return doc[first], first - offsets[doc[first]], last - first + 1, hashes[at[first]], content


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a batch's texts."""
    texts = batch.column(column).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def _blobs(kind: int, records: np.ndarray, part: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Records by part, one blob each."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    return [(kind, int(part[i]), records[i:j].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(part)])]


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds, parts, blobs = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "part", "blob"])


def _bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(doc_id), n) as Spark has it."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = five + np.uint64(50) ^ turn(np.ascontiguousarray(docs).view(np.uint64) * two, 31) * one
    h = turn(h, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return (h ^ h >> np.uint64(32)).view(np.int64) % n


def _later(records: np.ndarray, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns same, then place; and where in that order a record has one of its kind before it at an earlier place."""
    order = np.lexsort((records["s"], records["d"], *same[::-1]))
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in same:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    r = records[order]
    return order, (r["d"] != r["d"][lead]) | (r["s"] != r["s"][lead])


def _as_marks(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), MARK)
    for c in MARK.names:
        out[c] = records[c]
    return out


def _stretch_pass(size: int, anchor: int, n_shards: int):
    """Texts to stretches by shard, collapsed over what a task holds at once; the collapsed ones are marks already."""

    def collapsed(every: np.ndarray) -> list[pa.RecordBatch]:
        order, gone = _later(every, [every["a"], every["x"]])
        every = every[order]
        rows = _blobs(_MARKS, _as_marks(every[gone]), every["d"][gone] % n_shards)
        kept = every[~gone]
        fresh = np.flatnonzero(np.r_[True, kept["a"][1:] != kept["a"][:-1]]) if len(kept) else np.zeros(0, int)
        many = np.diff(np.r_[fresh, len(kept)])
        spread = np.repeat(many >= SPREAD_CONTENTS, many)
        home = (kept["a"] % np.uint64(n_shards)).astype(np.int64)
        rows += _blobs(_STRETCHES, kept[~spread], home[~spread])
        rows += _blobs(_SPREAD, kept[spread], (_mix(kept["a"] + _mix(kept["x"]))[spread] % np.uint64(n_shards)).astype(np.int64))
        named = fresh[many >= SPREAD_CONTENTS]
        rows += _blobs(_SPREAD_ANCHORS, kept["a"][named], home[named])
        return _table(rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for whole in batches:
            for batch in record_batches(whole, "text", SLICE_BYTES):
                if sum(map(len, held)) > HELD_STRETCHES:
                    yield from collapsed(np.concatenate(held))
                    held = []
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                data, offsets = _flat(batch, "text")
                doc, first, n, a, x = stretches(data, offsets, size, anchor)
                out = np.empty(len(doc), STRETCH)
                out["a"], out["x"], out["d"], out["s"], out["n"] = a, x, ids[doc] if len(doc) else 0, first, n
                held.append(out)
        if held:
            yield from collapsed(np.concatenate(held))

    return run


def _settle(n_buckets: int):
    """A shard's stretches: marks of repeated contents, by bucket, and what is to be fetched of anchors with several."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        marks = [np.frombuffer(b, MARK) for k, b in zip(kinds, blobs) if k == _MARKS]
        part = int(table.column("part")[0].as_py())
        wide = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, "<u8") for k, b in zip(kinds, blobs) if k == _SPREAD_ANCHORS)]))
        for kind in (_STRETCHES, _SPREAD):
            held = [np.frombuffer(b, STRETCH) for k, b in zip(kinds, blobs) if k == kind]
            if not held:
                continue
            every = np.concatenate(held)
            order, gone = _later(every, [every["a"], every["x"]])
            every = every[order]
            marks.append(_as_marks(every[gone]))
            kept = every[~gone]
            fresh = np.r_[True, kept["a"][1:] != kept["a"][:-1]]
            size = np.diff(np.r_[np.flatnonzero(fresh), len(kept)])
            within = np.arange(len(kept)) - np.repeat(np.flatnonzero(fresh), size)
            many = np.repeat(size, size)
            split = (many > BLOCK_CONTENTS) | np.isin(kept["a"], wide) | (kind == _SPREAD)
            out = np.empty(len(kept), FETCH)
            for c in ("a", "d", "s", "n"):
                out[c] = kept[c]
            out["k"] = np.where(split, (2 * part + (kind == _SPREAD) << 32) + within // BLOCK_CONTENTS + 1, 0)
            out = out[(many > 1) | split]
            rows += _blobs(_FETCHES, out, _bucket(out["d"], n_buckets))
        every = np.concatenate(marks) if marks else np.zeros(0, MARK)
        return _table(rows + _blobs(_MARKS, every, _bucket(every["d"], n_buckets)))

    return run


def _fetch(n_shards: int, size: int):
    """A bucket's documents and fetch lists to contents by shard; all of a block go to one."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        if not docs.num_rows or not lists.num_rows:
            return _table([])
        want = np.unique(np.concatenate([np.frombuffer(b, FETCH) for b in lists.column("blob").to_pylist()]))
        texts = {}
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).to_pylist()):
            if len(text or b"") > len(texts.get(doc, b"")):
                texts[doc] = text
        shard = (_mix(want["a"] + want["k"]) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        rows, want, shard = [], want[order], shard[order]
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for i, j in zip(cuts, [*cuts[1:], len(shard)]):
            part = want[i:j]
            held = b"".join(texts[d][s : s + n + size - 1] for d, s, n in zip(part["d"].tolist(), part["s"].tolist(), part["n"].tolist()))
            rows.append((_TEXTS, int(shard[i]), np.int64(len(part)).tobytes() + part.tobytes() + held))
        return _table(rows)

    return run


def _sort_contents(size: int, n_buckets: int, n_shards: int):
    """A shard's contents, block by block: marks of windows that repeat within a block, and the windows of blocks that share an anchor."""

    def run(table: pa.Table) -> pa.Table:
        lists, texts = [], []
        for blob in table.column("blob").to_pylist():
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            lists.append(np.frombuffer(blob, FETCH, n, 8))
            texts.append(np.frombuffer(blob, np.uint8, offset=8 + n * FETCH.itemsize))
        part, data = np.concatenate(lists), np.concatenate(texts)
        length = part["n"].astype(np.int64) + size - 1
        begin = np.cumsum(length) - length
        order = np.lexsort((part["s"], part["d"], part["k"], part["a"]))
        block = np.r_[True, (part["a"][order][1:] != part["a"][order][:-1]) | (part["k"][order][1:] != part["k"][order][:-1])]
        block = np.cumsum(block) - 1
        weight = np.bincount(block, length[order])
        call = np.cumsum(weight) // CALL_BYTES
        done = []
        for c in np.unique(call):
            mine = order[call[block] == c]
            done.append(_one_call(part[mine], block[call[block] == c], [data[b : b + n] for b, n in zip(begin[mine].tolist(), length[mine].tolist())], size))
        marks, windows = (np.concatenate(x) for x in zip(*done))
        # windows of split anchors meet within the shard first, so that a frequent one is one entry a shard
        more, windows = _first_windows(windows)
        marks = np.concatenate([marks, more])
        return _table(_blobs(_MARKS, marks, _bucket(marks["d"], n_buckets)) + _blobs(_WINDOWS, windows, (windows["h"] % np.uint64(n_shards)).astype(np.int64)))

    return run


def _one_call(part: np.ndarray, block: np.ndarray, texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and windows of some blocks, whose contents are sorted in step; block ascends."""
    # a block: its contents, each with a separator behind it, and an end symbol smaller than all
    ends = np.r_[block[1:] != block[:-1], True]
    length = np.array([len(t) for t in texts]) + 1
    at = np.cumsum(length + ends) - (length + ends)
    symbols = np.zeros(int((length + ends).sum()), np.int64)
    flat = np.repeat(at, length - 1) + np.concatenate([np.arange(n - 1) for n in length.tolist()])
    raw = np.concatenate(texts)
    symbols[flat] = raw.astype(np.int64) + 2
    symbols[at + length - 1] = 1
    bounds = np.r_[at[np.r_[True, ends[:-1]]], len(symbols)]
    order = suffix_arrays(symbols, bounds)
    n = part["n"].astype(np.int64)
    owner = np.full(len(symbols), -1)
    starts = np.repeat(at, n) + np.concatenate([np.arange(k) for k in n.tolist()])
    owner[starts] = np.repeat(np.arange(len(part)), n)
    order = order[owner[order] >= 0]  # windows in suffix order, block by block
    equal = np.repeat(block, n)  # by window start, to tell blocks apart
    of = np.empty(len(symbols), np.int64)
    of[starts] = equal
    same = of[order[1:]] == of[order[:-1]]
    padded = np.zeros(len(symbols) + 8, np.uint8)
    padded[flat] = raw
    eight = np.lib.stride_tricks.as_strided(padded, (len(symbols), 8), (1, 1))
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    for step in [*range(0, size - 7, 8), size - 8]:
        left = np.flatnonzero(same)
        same[left] = words[order[left] + step] == words[order[left + 1] + step]
    group = np.r_[0, np.cumsum(~same)] if len(order) else np.zeros(0, int)
    places = np.empty(len(order), MARK)
    mine = owner[order]
    places["d"], places["s"], places["n"] = part["d"][mine], part["s"][mine] + (order - at[mine]), 1
    sort, gone = _later(places, [group])
    marks = _merge(places[sort][gone])
    split = part["k"][mine[sort]] > 0
    lead = split & ~gone
    windows = np.empty(int(lead.sum()), WINDOW)
    if len(windows):
        data = padded[: len(symbols)]
        sums, down = _rolling(data)
        p = order[sort][lead]
        one = (sums[p + size] - sums[p]) * down[p]
        windows["h"], windows["g"] = _mix(one), _second(words, p, size)
        windows["d"], windows["s"] = places["d"][sort][lead], places["s"][sort][lead]
    return marks, windows


def _second(words: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A second hash of windows, chained over eight bytes at a time."""
    out = np.full(len(places), size, np.uint64)
    for step in [*range(0, size - 7, 8), size - 8]:
        out = _mix(out ^ words[places + step])
    return out


def _merge(marks: np.ndarray) -> np.ndarray:
    """Marks of single windows as runs."""
    marks = np.unique(marks)
    if not len(marks):
        return marks
    lead = np.flatnonzero(np.r_[True, (marks["d"][1:] != marks["d"][:-1]) | (marks["s"][1:].astype(np.int64) != marks["s"][:-1].astype(np.int64) + 1)])
    runs = np.diff(np.r_[lead, len(marks)])
    out = []
    for start in range(0, int(runs.max()), 65_535):  # a run's length has 16 bits
        long = runs > start
        piece = marks[lead[long]].copy()
        piece["s"] += np.uint32(start)
        piece["n"] = np.minimum(runs[long] - start, 65_535)
        out.append(piece)
    return np.concatenate(out)


def _first_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the windows that aren't the first of equal ones, and the first ones."""
    order, gone = _later(windows, [windows["h"], windows["g"]])
    every = windows[order]
    marks = np.empty(int(gone.sum()), MARK)
    marks["d"], marks["s"], marks["n"] = every["d"][gone], every["s"][gone], 1
    return _merge(marks), every[~gone]


def _meet(n_buckets: int):
    """A shard's windows of split anchors: all but the first of equal ones are marks."""

    def run(table: pa.Table) -> pa.Table:
        marks, _ = _first_windows(np.concatenate([np.frombuffer(b, WINDOW) for b in table.column("blob").to_pylist()]))
        return _table(_blobs(_MARKS, marks, _bucket(marks["d"], n_buckets)))

    return run


def _cut(size: int, schema: pa.Schema, keep: bool):
    """A bucket's documents without what its marks cover."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        by: dict[int, np.ndarray] = {}
        if lists.num_rows:
            marks = np.concatenate([np.frombuffer(b, MARK) for b in lists.column("blob").to_pylist()])
            marks = marks[np.lexsort((marks["s"], marks["d"]))]
            lead = np.flatnonzero(np.r_[True, marks["d"][1:] != marks["d"][:-1]]) if len(marks) else []
            by = {int(marks["d"][i]): marks[i:j] for i, j in zip(lead, [*lead[1:], len(marks)])}
        n_bytes, n_removed, n_spans, shas, kept = [], [], [], [], []
        for doc, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).to_pylist()):
            text = text or b""
            mine = by.get(doc)
            spans = 0
            rest = text
            if mine is not None and doc is not None:
                start = mine["s"].astype(np.int64)
                end = np.minimum(start + mine["n"] + size - 1, len(text))
                top = np.maximum.accumulate(end)
                open_ = np.flatnonzero(np.r_[True, start[1:] > top[:-1]])
                left, right = start[open_], np.r_[top[open_[1:] - 1], top[-1]]
                real = right > left
                left, right = left[real], right[real]
                spans = len(left)
                rest = b"".join(text[i:j] for i, j in zip([0, *right.tolist()], [*left.tolist(), len(text)]))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(rest))
            n_spans.append(spans)
            shas.append(hashlib.sha256(rest).hexdigest())
            if keep:
                kept.append(rest)
        columns = [docs.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
        return pa.table([*columns, *([pa.array(kept, pa.binary())] if keep else [])], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, *, size: int = SIZE, anchor: int = ANCHOR, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    stretched = docs.where("doc_id is not null").mapInArrow(_stretch_pass(size, anchor, n), _BLOBS)
    settled = scratch.table(stretched.groupBy("part").applyInArrow(_settle(n), _BLOBS), "settled")
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).groupBy("part")
    fetched = dealt.cogroup(settled.where(F.col("kind") == _FETCHES).groupBy("part")).applyInArrow(_fetch(n, size), _BLOBS)
    sorted_ = scratch.table(fetched.groupBy("part").applyInArrow(_sort_contents(size, n, n), _BLOBS), "sorted")
    met = scratch.table(sorted_.where(F.col("kind") == _WINDOWS).groupBy("part").applyInArrow(_meet(n), _BLOBS), "met")
    marks = settled.unionByName(sorted_).unionByName(met).where(F.col("kind") == _MARKS)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep
    kinds = [T.LongType()] * 4 + [T.StringType()] + [T.BinaryType()] * keep
    arrow = pa.schema([(c, {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(k)]) for c, k in zip(names, kinds)])
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, kinds)])
    return dealt.cogroup(marks.groupBy("part")).applyInArrow(_cut(size, arrow, keep), schema)
