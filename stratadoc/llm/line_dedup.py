"""Incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is a 128-bit hash of the line, stripped of ASCII white space and with A-Z lower-cased.
Keys are dealt to shards by their first bytes. A LineIndex is a version of three tables at a path
(open() finds the last one again, in another session as well):

* ``postings`` (shard, key, doc_id, seq): one row for each key of each document, exact;
* ``gone`` (doc_id, seq): documents that were deleted, which hides their earlier postings;
* ``log`` (shard, key, n_docs, first_doc, last_doc, kind, blob, seq): the references to a key, exact,
  and one cuckoo filter a shard over the keys that have references; the last row of a key or shard holds.

insert() probes and fills the filters of the shards that a batch has keys of: keys that a filter
doesn't know are new and go to the log as they are; only the others are looked up and merged with
their exact rows, and those that a filter took for known by mistake are added to it. delete()
recounts the keys of the documents that go, takes the fingerprints of keys without references out
of the filters, and fills a filter anew where layers leave it open whose fingerprint that is. So
both append rows of the batch's keys alone, and an insertion can be undone. A filter only ever spares
work: what it answers with "maybe" is settled by the exact tables. compact() writes each table as
one part.

Keys are counted before they are dealt to shards, so a line that a third of all documents hold is
one row a shard and map task. Joins on keys read written tables, so that adaptive execution can
split a key with very many rows.

Defined results: a null text is one empty line and stays null; rows without doc_id count for
nothing and keep all lines; rows that share a doc_id count as one document; a key found twice in
one document only stays. Texts of any length are split as a whole, one at a time. Other columns pass
through; ``text`` is replaced, ``n_lines`` and ``n_dropped`` are added and replace columns of these
names. An empty table gives an empty table. Documents whose doc_id the index holds must be deleted
before they are inserted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, Scratch, TableStore, record_batches, tidy

#: Documents whose lines go to a shard of the index, about.
DOCS_A_SHARD = 20_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None for one of fewer than min_chars code points."""
    line = line.strip(ASCII_SPACE)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


class CuckooFilter:
    """Buckets of four 16-bit fingerprints, in layers: a full layer gets a larger one beside it.

    A fingerprint that finds no place after MAX_KICKS moves gets a layer of its own, so there are
    no false negatives. A key may be added once; remove() takes one copy of its fingerprint away.
    """

    SLOTS, MAX_KICKS, LOAD = 4, 200, 0.8

    def __init__(self) -> None:
        self.layers: list[np.ndarray] = []
        self.used: list[int] = []

    @classmethod
    def loads(cls, blob: bytes | None) -> CuckooFilter:
        out = cls()
        if blob:
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            sizes, at = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(-1, 2), 8 + 16 * n
            for buckets, used in sizes.tolist():
                out.layers.append(np.frombuffer(blob, "<u2", buckets * cls.SLOTS, at).reshape(-1, cls.SLOTS).copy())
                out.used.append(used)
                at += 2 * buckets * cls.SLOTS
        return out

    def dumps(self) -> bytes:
        sizes = np.array([[len(x), n] for x, n in zip(self.layers, self.used)], "<i8").reshape(-1, 2)
        return b"".join([np.array([len(self.layers)], "<i8").tobytes(), sizes.tobytes(), *(x.tobytes() for x in self.layers)])

    @staticmethod
    def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and bucket hash of keys given as rows of two unsigned longs."""
        return np.maximum(keys[:, 1] >> np.uint64(48), 1).astype(np.uint16), (keys[:, 1] & np.uint64((1 << 40) - 1)).astype(np.int64)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
        return bucket ^ (prints.astype(np.int64) * 0x5BD1E995 & (size - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, places = self._parts(keys)
        found = np.zeros(len(keys), bool)
        for layer in self.layers:
            one = places & (len(layer) - 1)
            found |= (layer[one] == prints[:, None]).any(1) | (layer[self._other(one, prints, len(layer))] == prints[:, None]).any(1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that aren't in the filter's exact table yet."""
        if not len(keys):
            return
        if not self.layers or self.used[-1] + len(keys) > self.LOAD * self.SLOTS * len(self.layers[-1]):
            need = max(len(keys), 2 * self.used[-1] if self.used else 16)
            self.layers.append(np.zeros((1 << int(np.ceil(np.log2(need / (self.LOAD * self.SLOTS)))), self.SLOTS), np.uint16))
            self.used.append(0)
        layer, (prints, places) = self.layers[-1], self._parts(keys)
        self.used[-1] += len(keys)
        bucket, left = places & (len(layer) - 1), np.arange(len(keys))
        for _ in range(2 * self.SLOTS):  # one key a bucket at a time, for all buckets at once; then the other bucket
            for _ in range(2):
                at, first = np.unique(bucket[left], return_index=True)
                free = layer[at] == 0
                room = free.any(1)
                chosen = left[first[room]]
                layer[at[room], free[room].argmax(1)] = prints[chosen]
                left = np.setdiff1d(left, chosen, assume_unique=True)
                bucket[left] = self._other(bucket[left], prints[left], len(layer))
                if not len(left):
                    return
        rng = np.random.default_rng(1)
        for i in left.tolist():
            print_, b = prints[i], int(bucket[i])
            for _ in range(self.MAX_KICKS):
                free = np.flatnonzero(layer[b] == 0)
                if len(free):
                    layer[b, free[0]] = print_
                    break
                slot = int(rng.integers(self.SLOTS))
                print_, layer[b, slot] = layer[b, slot], print_
                b = int(self._other(np.array([b]), np.array([print_]), len(layer))[0])
            else:  # the last one moved has no place
                self._spill(print_, b)

    def _spill(self, print_: np.uint16, bucket: int) -> None:
        extra = np.zeros_like(self.layers[-1])
        extra[bucket, 0] = print_
        self.layers.insert(0, extra)
        self.used.insert(0, len(extra) * self.SLOTS)

    def remove(self, keys: np.ndarray) -> bool:
        """Remove keys that were added before; False, and nothing is removed, where several layers might hold a key.

        Keys with one fingerprint and bucket have the other bucket in common as well, within a layer;
        so there any copy does.
        """
        prints, places = self._parts(keys)
        held = []
        for layer in self.layers:
            one = places & (len(layer) - 1)
            held.append((layer[one] == prints[:, None]).any(1) | (layer[self._other(one, prints, len(layer))] == prints[:, None]).any(1))
        if len(keys) and (np.sum(held, 0) != 1).any():
            return False
        for k, mine in enumerate(held):
            layer = self.layers[k]
            one = places[mine] & (len(layer) - 1)
            for print_, b, c in zip(prints[mine], one.tolist(), self._other(one, prints[mine], len(layer)).tolist()):
                b = b if (layer[b] == print_).any() else c
                layer[b, np.flatnonzero(layer[b] == print_)[0]] = 0
                self.used[k] -= 1
        return True


def _key_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), "<u8").reshape(-1, 2)


_POSTED = "shard int, key binary, doc_id bigint"
_POSTINGS = f"{_POSTED}, seq bigint"
_GONE = "doc_id bigint, seq bigint"
_ROW = "shard int, key binary, n_docs bigint, first_doc bigint, last_doc bigint, kind int, blob binary"
_LOG = f"{_ROW}, seq bigint"
#: Kinds of rows: references to a key; a key that a filter may know, to be merged; a filter.
_COUNT, _MAYBE, _FILTER = range(3)
_ROW_ARROW = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _post(min_chars: int, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in record_batches(whole, "text"):
                keys: list[bytes] = []
                owners: list[int] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    if doc is None or not text:
                        continue
                    own = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                    keys += own
                    owners += [doc] * len(own)
                shards = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4)[:, 0] % n_shards
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(owners, pa.int64())], ["shard", "key", "doc_id"])

    return tidy(run)


def _filter_row(shard: int, held: CuckooFilter | None) -> pa.Table:
    """A filter as a row; without one, where it has to be filled anew."""
    return pa.table([pa.array([x], t) for x, t in zip((shard, None, None, None, None, _FILTER, held.dumps() if held else None), _ROW_ARROW.types)], schema=_ROW_ARROW)


def _shard_and_filter(filters: pa.Table, keys: pa.Table) -> tuple[int, CuckooFilter]:
    return (keys if keys.num_rows else filters).column("shard")[0].as_py(), CuckooFilter.loads(filters.column("blob")[0].as_py() if filters.num_rows else None)


def _probe_known(filters: pa.Table, table: pa.Table) -> pa.Table:
    """A shard's counted keys, new to the filter or not, then its new filter."""
    if not table.num_rows:
        return _ROW_ARROW.empty_table()
    shard, held = _shard_and_filter(filters, table)
    keys = _key_matrix(table.column("key"))
    seen = held.contains(keys)
    held.add(keys[~seen])
    kind = pa.array(np.where(seen, _MAYBE, _COUNT).astype(np.int32))
    rows = pa.table([*(table.column(c) for c in ("shard", "key", "n_docs", "first_doc", "last_doc")), kind, pa.nulls(len(keys), pa.binary())], schema=_ROW_ARROW)
    return pa.concat_tables([rows, _filter_row(shard, held)])


def _probe_new(table: pa.Table) -> pa.Table:
    return _probe_known(table.select([]).slice(0, 0), table)


def _add(filters: pa.Table, keys: pa.Table) -> pa.Table:
    if not keys.num_rows:
        return _ROW_ARROW.empty_table()
    shard, held = _shard_and_filter(filters, keys)
    held.add(_key_matrix(keys.column("key")))
    return _filter_row(shard, held)


def _take(filters: pa.Table, keys: pa.Table) -> pa.Table:
    if not keys.num_rows:
        return _ROW_ARROW.empty_table()
    shard, held = _shard_and_filter(filters, keys)
    return _filter_row(shard, held if held.remove(_key_matrix(keys.column("key"))) else None)


def _refill(counts: pa.Table) -> pa.Table:
    """The filter of a shard's keys that have references."""
    held = CuckooFilter()
    held.add(_key_matrix(counts.column("key")))
    return _filter_row(counts.column("shard")[0].as_py(), held)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


class LineIndex:
    """A version of an index of lines; insert() and delete() return the next one and leave this one as it is. A version has one successor."""

    def __init__(self, spark: SparkSession, *, min_chars: int = 10, n_shards: int = 256, path: str | None = None) -> None:
        """A new index, at a path or in the shared folder."""
        store = TableStore.open(spark, path) if path else TableStore.temporary(spark, "lines")
        if store.version:
            raise ValueError(f"{path} holds an index; open() it")
        self._set(store.with_parts(about={"min_chars": min_chars, "n_shards": n_shards, "seq": 0}))

    def _set(self, store: TableStore) -> LineIndex:
        self.spark, self.store, self.scratch = store.spark, store, Scratch(store.spark, "lines")
        self.min_chars, self.n_shards, self.seq = (store.state["about"][k] for k in ("min_chars", "n_shards", "seq"))
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The last version of the index at a path."""
        store = TableStore.open(spark, path)
        if not store.version:
            raise ValueError(f"{path} holds no index")
        return cls.__new__(cls)._set(store)

    @classmethod
    def sized(cls, docs: DataFrame, **more) -> LineIndex:
        """An empty index with a shard for every DOCS_A_SHARD rows of docs, so that shards keep their size as the input grows."""
        return cls(docs.sparkSession, n_shards=max(256, docs.count() // DOCS_A_SHARD), **more)

    def _next(self, seq: int, append: dict[str, list[str]] | None = None, replace: dict[str, list[str]] | None = None) -> LineIndex:
        return LineIndex.__new__(LineIndex)._set(self.store.with_parts(append, replace, {"seq": seq}))

    def _log(self, more: list[str]) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(*(f"{self.store.path}/{p}" for p in self.store.parts("log") + more))

    def _last(self, kind: int, by: list[str], columns: list[str], more: list[str], only: DataFrame | None = None) -> DataFrame:
        """The last rows of a kind by key or shard; of those in only."""
        parts = self.store.parts("log") + more
        rows = self._log(more).where(F.col("kind") == kind) if parts else self.spark.createDataFrame([], _LOG)
        rows = rows if only is None else rows.join(only, by, "left_semi")
        if len(parts) < 2:
            return rows.select(*by, *columns)
        return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), "seq").alias("last")).select(*by, "last.*")

    def _counts(self, more: list[str], only: DataFrame | None = None) -> DataFrame:
        return self._last(_COUNT, ["shard", "key"], ["n_docs", "first_doc", "last_doc"], more, only).where("n_docs > 0")

    def _filters(self, more: list[str], only: DataFrame | None = None) -> DataFrame:
        return self._last(_FILTER, ["shard"], ["blob"], more, only)

    @property
    def counts(self) -> DataFrame:
        """shard, key, n_docs, first_doc, last_doc of all keys with references."""
        return self._counts([])

    @property
    def filters(self) -> DataFrame:
        """shard, blob."""
        return self._filters([])

    @property
    def postings(self) -> DataFrame:
        """shard, key, doc_id of all documents that the index holds."""
        return self._live(self.store.read("gone", _GONE) if self.store.parts("gone") else None)

    def _live(self, gone: DataFrame | None) -> DataFrame:
        held = self.store.read("postings", _POSTINGS)
        if gone is None:
            return held.drop("seq")
        last = gone.groupBy("doc_id").agg(F.max("seq").alias("gone_seq")).withColumnRenamed("doc_id", "gone_id")
        return held.join(last, (F.col("doc_id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_seq")), "left_anti").drop("seq")

    def insert(self, docs: DataFrame, *, steps: int = 1) -> LineIndex:
        """Add documents whose doc_ids the index doesn't hold yet, in steps by the hash of doc_id: a step knows the keys of those before."""
        rows = docs.select(F.col("doc_id").cast("long"), "text")
        posted = rows.mapInArrow(_post(self.min_chars, self.n_shards), _POSTED)
        if rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            posted = posted.distinct()
        first = self.seq + 1
        part = self.store.write(posted.withColumn("seq", F.lit(first).cast("long")), "postings")
        posted = self.spark.read.schema(_POSTINGS).parquet(f"{self.store.path}/{part}")
        log: list[str] = []
        for k in range(steps):
            log = self._step(posted if steps == 1 else posted.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) == k), log, first + 2 * k)
        return self._next(first + 2 * steps - 1, {"postings": [part], "log": log})

    def _step(self, posted: DataFrame, log: list[str], seq: int) -> list[str]:
        """log with the parts that the postings of a batch add."""
        numbered = lambda df, n: self.store.write(df.withColumn("seq", F.lit(n).cast("long")), "log")
        fresh = _counted(posted)
        if not self.store.parts("log") + log:
            return [numbered(fresh.groupBy("shard").applyInArrow(_probe_new, _ROW), seq)]
        held = self._filters(log, posted.select("shard").distinct())
        probed = held.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(_probe_known, _ROW)
        log = [*log, numbered(probed, seq)]
        maybe = self.spark.read.schema(_LOG).parquet(f"{self.store.path}/{log[-1]}").where(F.col("kind") == _MAYBE).select("shard", "key", "n_docs", "first_doc", "last_doc")
        both = maybe.withColumn("exact", F.lit(0)).unionByName(self._counts(log, maybe.select("shard", "key")).withColumn("exact", F.lit(1)))
        merged = both.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.max("exact").alias("exact"))
        merged = self.scratch.table(merged, "merged")
        rows = merged.drop("exact").withColumns({"kind": F.lit(_COUNT), "blob": F.lit(None).cast("binary")})
        mistaken = merged.where("exact = 0").select("shard", "key")
        held = self._filters(log, mistaken.select("shard").distinct())
        rows = rows.unionByName(held.groupBy("shard").cogroup(mistaken.groupBy("shard")).applyInArrow(_add, _ROW))
        return [*log, numbered(rows, seq + 1)]

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take the documents of a column doc_id out again."""
        seq = self.seq + 1
        part = self.store.write(doc_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("seq", F.lit(seq).cast("long")), "gone")
        going = self.spark.read.schema(_GONE).parquet(f"{self.store.path}/{part}")
        keys = self.scratch.table(self.postings.join(going.select("doc_id"), "doc_id", "left_semi").select("shard", "key").distinct(), "keys")
        before = self.store.read("gone", _GONE) if self.store.parts("gone") else None
        left = self._live(going if before is None else before.unionByName(going)).join(keys, ["shard", "key"], "left_semi")
        counted = keys.join(_counted(left), ["shard", "key"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)).cast("long"))
        counted = self.scratch.table(counted.select("shard", "key", "n_docs", "first_doc", "last_doc"), "counts")
        dead = counted.where("n_docs = 0").select("shard", "key")
        held = self._filters([], dead.select("shard").distinct())
        taken = self.scratch.table(held.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(_take, _ROW), "filters")
        rows = counted.withColumns({"kind": F.lit(_COUNT), "blob": F.lit(None).cast("binary")}).unionByName(taken.where("blob is not null"))
        numbered = self.store.write(rows.withColumn("seq", F.lit(seq).cast("long")), "log")
        again = self._counts([numbered], None).join(taken.where("blob is null").select("shard"), "shard", "left_semi")
        refilled = self.store.write(again.groupBy("shard").applyInArrow(_refill, _ROW).withColumn("seq", F.lit(seq + 1).cast("long")), "log")
        return self._next(seq + 1, {"gone": [part], "log": [numbered, refilled]})

    def compact(self) -> LineIndex:
        """The same index with one part a table; the parts of earlier versions stay until the folder is cleaned."""
        numbered = lambda df: df.withColumn("seq", F.lit(self.seq).cast("long"))
        empty = F.lit(None).cast("long")
        counts = self.counts.withColumns({"kind": F.lit(_COUNT), "blob": F.lit(None).cast("binary")})
        filters = self.filters.select("shard", F.lit(None).cast("binary").alias("key"), empty.alias("n_docs"), empty.alias("first_doc"), empty.alias("last_doc"), F.lit(_FILTER).alias("kind"), "blob")
        log = self.store.write(numbered(counts.unionByName(filters)), "log")
        return self._next(self.seq, None, {"log": [log], "postings": [self.store.write(numbered(self.postings), "postings")], "gone": []})

    def repeated(self) -> DataFrame:
        """key, first_doc of the keys that two documents or more hold."""
        return self.counts.where("first_doc <> last_doc").select("key", "first_doc")

    def drops(self) -> DataFrame:
        """doc_id, keys: what each document loses, one row a document."""
        repeated = self.scratch.table(self.repeated(), "repeated")
        pairs = self.postings.select("key", "doc_id").join(repeated, "key").where("doc_id <> first_doc")
        return pairs.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs without the lines that an earlier document of the index holds."""
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        drops = self.scratch.table(self.drops(), "drops").withColumnsRenamed({"doc_id": "__drop_id", "keys": "__keys"})
        joined = docs.select(columns).join(drops, F.col("doc_id").cast("long") == F.col("__drop_id"), "left").drop("__drop_id")
        kind = T.StructType([docs.schema[c] for c in columns] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return joined.mapInArrow(_without(self.min_chars), kind)


def _without(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in record_batches(whole, "text"):
                where = batch.schema.get_field_index("text")
                texts = batch.column(where).cast(pa.binary()).to_pylist()
                n_lines, n_dropped, changed = [], [], False
                for i, keys in enumerate(batch.column("__keys").to_pylist()):
                    text = texts[i]
                    n, lost = (text.count(b"\n") + 1 if text else 1), 0
                    if keys and text:
                        bad, lines = set(keys), text.split(b"\n")
                        kept = [x for x in lines if line_key(x, min_chars) not in bad]
                        texts[i], lost, changed = b"\n".join(kept), len(lines) - len(kept), True
                    n_lines.append(n)
                    n_dropped.append(lost)
                names = [c for c in batch.schema.names if c != "__keys"]
                arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" and changed else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return tidy(run)
