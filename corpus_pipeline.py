"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage gets what the one before kept, as a table that was written and read again, and applies
one operator to all of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm import line_dedup, minhash, mixing, packing, quality_rules
from stratadoc.llm.common import Scratch, bound_batches
from stratadoc.llm.queries import MIX_WEIGHTS, mix_domain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tokens of a packed sequence; the share of words that the mix keeps, in per cent.
SEQUENCE, MIX_PERCENT = 1024, 80


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    judged = quality_rules.Cascade().fit(docs).judge(docs, kept="__kept")
    return judged.where("__kept").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars follows the text."""
    bound_batches(spark)
    kept = line_dedup.LineIndex.sized(docs).insert(docs, steps=2).dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on 5-word shingles."""
    return minhash.NearDuplicates(shingle_words=5, percent=80).dedup(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mix, each once."""
    taken = mixing.select(docs, mix_domain(), MIX_WEIGHTS, percent=MIX_PERCENT, max_epochs=1).select(F.col("doc_id").alias("__taken")).distinct()
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["__taken"]), "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences."""
    bound_batches(spark)
    return packing.pack(docs, SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", judge_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Near-duplicate components and packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        written = scratch.table(done, name)
        if k:
            scratch.drop(docs)
        docs = written
    return docs
