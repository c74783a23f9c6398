"""The index as an append-only table: latest row a point wins, by deterministic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import point_id
from ..schema import POINTS


def points(chunks: DataFrame) -> DataFrame:
    """Chunks with their point_id."""
    return chunks.withColumn("point_id", point_id(F.col("chunk_id")))


def latest(rows: DataFrame, key: str = "point_id", order: str = "ingest_seq") -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


class PointTable:
    """A Parquet folder partitioned by tenant; appends carry a sequence, reads take the latest row of a point."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(at) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))

    def create(self, schema: str = POINTS) -> None:
        """An empty table of a schema (DDL), if there is none yet."""
        if not self.exists():
            self.spark.createDataFrame([], schema).drop("tenant_id").write.parquet(f"{self.path}/tenant_id=__none")

    def count(self) -> int:
        """Current points."""
        return self.read().count()

    def upsert(self, chunks: DataFrame, seq: int) -> int:
        """Append chunks under a sequence number; of a point that a batch has twice the later row wins. The same batch again changes nothing that is read."""
        numbered = points(chunks).withColumn("__no", F.monotonically_increasing_id())
        held = latest(numbered, order="__no").drop("__no").withColumn("ingest_seq", F.lit(seq).cast("long")).persist()
        try:
            n = held.count()
            if n:
                held.write.mode("append").partitionBy("tenant_id").parquet(self.path)
            return n
        finally:
            held.unpersist()

    def read(self, *, replace_document: bool = False) -> DataFrame:
        """The current points; replace_document leaves out those that a later upload of their source doesn't hold."""
        rows = latest(self.spark.read.parquet(self.path))
        if not replace_document:
            return rows
        newest = rows.groupBy("tenant_id", "source").agg(F.max("ingest_seq").alias("ingest_seq"))
        return rows.join(newest, ["tenant_id", "source", "ingest_seq"], "left_semi")

    def compact(self, to: str) -> None:
        """Write the current points to another folder."""
        self.read().repartition("tenant_id").write.mode("overwrite").partitionBy("tenant_id").parquet(to)
