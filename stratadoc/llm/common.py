"""Helpers shared by the training-data operators: scratch tables, let-bindings, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and is stripped from lines.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: The same as a Java regular-expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset.

    On a cluster without that setting it raises: executors would write to disks of their own, and
    tables would come back incomplete.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
        at = tempfile.mkdtemp(prefix="stratadoc-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Bytes of a batch between the JVM and Python, where the session leaves it at Spark's own 64 MB.
BATCH_BYTES = 8 << 20
_BATCH_KEY, _BATCH_DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for a session: both sides hold some of them for each task, outside the heap.

    Operators bound the batches of the tables that they write and leave the session as it is; for
    what they return lazily this is up to the caller, as the registered queries do.
    """
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULTS[0]) in _BATCH_DEFAULTS:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches() for what runs inside."""
    before = spark.conf.get(_BATCH_KEY, None)
    bound_batches(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any Hadoop file system."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs no recomputation.

    drop() frees a table as soon as nothing lazy reads it any more; what a returned
    DataFrame still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/stratadoc-{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        with bounded_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._scratch_path)


class TableStore:
    """Tables at a path, each a list of immutable parts; a version is a small file that names the parts.

    A store is a snapshot. with_parts() writes the next version and returns its snapshot; it fails if
    another writer has made that version. Reading a table reads its parts side by side, so plans
    don't grow with appends. open() gives the last version, after the driver that wrote it is gone as well.
    """

    def __init__(self, spark: SparkSession, path: str, version: int, state: dict) -> None:
        self.spark, self.path, self.version, self.state = spark, path.rstrip("/"), version, state

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TableStore:
        """The last version at a path; an empty one where there is none."""
        fs, at = _file_system(spark, f"{path.rstrip('/')}/versions")
        last = max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")), default=0) if fs.exists(at) else 0
        if not last:
            return cls(spark, path, 0, {"about": {}, "parts": {}})
        text = spark.read.text(f"{path.rstrip('/')}/versions/{last}.json", wholetext=True).first()[0]
        return cls(spark, path, last, json.loads(text))

    @classmethod
    def temporary(cls, spark: SparkSession, name: str) -> TableStore:
        return cls.open(spark, f"{shared_dir(spark)}/stratadoc-{name}-{uuid.uuid4().hex[:12]}")

    def parts(self, table: str) -> list[str]:
        return self.state["parts"].get(table, [])

    def read(self, table: str, schema: str) -> DataFrame:
        """The rows of all parts."""
        paths = [f"{self.path}/{p}" for p in self.parts(table)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, table: str) -> str:
        """Write a part and return its name; no version has it yet."""
        part = f"{table}/{self.version + 1}-{uuid.uuid4().hex[:8]}"
        with bounded_batches(self.spark):
            df.write.parquet(f"{self.path}/{part}")
        return part

    def with_parts(self, append: dict[str, list[str]] | None = None, replace: dict[str, list[str]] | None = None, about: dict | None = None) -> TableStore:
        """The next version."""
        parts = {k: list(v) for k, v in self.state["parts"].items()} | (replace or {})
        for table, names in (append or {}).items():
            parts[table] = parts.get(table, []) + names
        state = {"about": self.state["about"] | (about or {}), "parts": parts}
        fs, at = _file_system(self.spark, f"{self.path}/versions/{self.version + 1}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return TableStore(self.spark, self.path, self.version + 1, state)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it any number of times in body, inside one expression."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back at the end of its task: workers stay for later tasks, and what they hold counts for their executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return tidied


def slices(sizes: np.ndarray, most_bytes: int, most_rows: int | None = None) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of about most_bytes (one row at least) and of most_rows at most."""
    most_rows = most_rows or len(sizes)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes) - start


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def record_batches(batch: pa.RecordBatch, text: str, most_bytes: int = 8_000_000, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices, to bound a worker's memory."""
    for start, n in slices(byte_sizes(batch.column(text)), most_bytes, most_rows):
        yield batch.slice(start, n)
