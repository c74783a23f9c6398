"""Streaming ingest: landed rows become chunks and points by micro-batch, and a job row each.

Ids are deterministic and points are read latest-wins, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.chunking import fixed_chunks, normalized_groups, stamped
from ..operators.reports import ingestion_status
from ..operators.upsert import PointTable, latest
from ..sources.files import extension

LANDING = "document_id string, source string, text string"


def to_chunks(documents: DataFrame) -> DataFrame:
    """Fixed windows of documents, with ids by source, document and position."""
    held = fixed_chunks(documents)
    return held.select(F.concat(F.concat_ws("-", "source", "document_id"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "source", F.col("chunk_text").alias("text"))


def job_rows(documents: DataFrame, chunks: DataFrame, tenant_id: str, seq: int) -> DataFrame:
    """A row a document: how many chunks it gave, and what became of it."""
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    held = documents.select("document_id", "source").distinct().join(n, "document_id", "left").fillna(0, ["chunks"])
    status = ingestion_status(F.col("chunks"), F.lit("accepted"), F.lit(0), F.lit(0))
    return held.select("document_id", "source", F.lit(tenant_id).alias("tenant_id"), "chunks", status.alias("status"), F.lit(seq).cast("long").alias("ingest_seq"))


class NothingIndexed(RuntimeError):
    """A batch had documents that gave no chunks."""


def ingest(documents: DataFrame, table: PointTable, jobs: str, *, tenant_id: str, acl_groups: list[str], seq: int, chunker: Callable[[DataFrame], DataFrame] = to_chunks, settings: Settings = Settings(fail_on_zero_chunks=False)) -> int:
    """Chunks of a batch into the table, and its job rows appended; a failed job raises behind that where the settings say so."""
    chunks = stamped(chunker(documents), tenant_id, acl_groups)
    n = table.upsert(chunks, seq)
    rows = job_rows(documents, chunks, tenant_id, seq)
    rows.write.mode("append").parquet(jobs)
    if settings.fail_on_zero_chunks:
        failed = rows.where("status = 'failed'").agg(F.count(F.lit(1)), F.min("source")).first()
        if failed[0]:
            raise NothingIndexed(f"{failed[0]} documents gave nothing to index, the first from {failed[1]}")
    return n


def start(spark: SparkSession, landing: str, table: PointTable, jobs: str, checkpoint: str, *, tenant_id: str, acl_groups: list[str], files: int = 100, settings: Settings = Settings(fail_on_zero_chunks=False)) -> StreamingQuery:
    """Ingest what is in a landing folder, and what comes until it is stopped; the checkpoint keeps the place."""
    normalized_groups(acl_groups)
    rows = spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files).parquet(landing)
    write = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.foreachBatch(lambda df, number: ingest(df, table, jobs, tenant_id=tenant_id, acl_groups=acl_groups, seq=number, settings=settings) and None).start()


def accepted_uploads(uploads: DataFrame, extensions: list[str], *, name: str = "filename") -> DataFrame:
    """uploads with extension, stored_name and status: a name of its own for each file that is allowed, whatever it was called; why others aren't."""
    held = uploads.withColumn("extension", extension(F.col(name)))
    reason = F.when(F.coalesce(F.trim(name), F.lit("")) == "", "filename_required").when(~F.col("extension").isin(*extensions), "unsupported_format").otherwise("accepted")
    held = held.withColumn("status", reason)
    return held.withColumn("stored_name", F.when(F.col("status") == "accepted", F.concat(F.uuid(), F.col("extension"))))


def spool(uploads: DataFrame, landing: str, extensions: list[str], *, tenant_id: str, acl_groups: list[str]) -> DataFrame:
    """Write the allowed uploads (filename, content) to a landing folder and return a row a file: stored_name, source, status.

    Tenant and groups are the uploader's, never the request's.
    """
    groups = normalized_groups(acl_groups)
    held = accepted_uploads(uploads, extensions)
    stamped_ = held.where("status = 'accepted'").select("stored_name", F.col("filename").alias("source"), "content", F.lit(tenant_id).alias("tenant_id"), F.array(*map(F.lit, groups)).alias("acl_groups"))
    stamped_.write.mode("append").parquet(landing)
    stored = uploads.sparkSession.read.parquet(landing).select("stored_name", "source", F.lit("accepted").alias("status"))
    refused = held.where("status <> 'accepted'").select(F.lit(None).cast("string").alias("stored_name"), F.col("filename").alias("source"), "status")
    return stored.unionByName(refused)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each document's job."""
    return latest(spark.read.parquet(path), "document_id")
