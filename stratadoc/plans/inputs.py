"""Engine inputs derived from plain tables: tenants, groups, pages, words, boxes. Everything is arithmetic, so SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..operators.access import Identity

ACTOR = Identity("user_b", "t1", ("g1", "g3"))
QUESTION_VECTOR = 7


#: Bytes of a batch between the JVM and Python, where the session leaves it at Spark's own 64 MB; both sides hold some for each task, outside the heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A table of fewer bytes a core may lie in fewer row groups than there are cores.
SMALL_BYTES_A_CORE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the rows of a small one are dealt to all cores, since a row group is read by one. What queries return lazily passes Python in bounded batches."""
    if spark.conf.get(_BATCH, "64m") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    held = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES_A_CORE * cores
    return held.repartition(cores) if small and name in ("documents", "pages") else held


def groups_of(key: str) -> Column:
    name = lambda m: F.concat(F.lit("g"), (F.col(key) % m).cast("string"))
    return F.array(name(5), name(7))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with tenant_id and acl_groups."""
    return table(spark, sf_dir, "documents").withColumns({"tenant_id": F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")), "acl_groups": groups_of("doc_id")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks."""
    held = table(spark, sf_dir, "embeddings")
    return held.select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("t"), (F.col("label") % 4).cast("string")).alias("tenant_id"), groups_of("vec_id").alias("acl_groups"))


def question_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUESTION_VECTOR).first()["embedding"])


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words of documents: a block a line, places and confidences by arithmetic."""
    # texts are dealt by page, words are twenty times as much: what is done by page needs no other shuffle then
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), "doc_id", "text").repartition("page_id")
    lines = docs.select("page_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    held = lines.select("page_id", "doc_id", "line", F.posexplode(split_words(F.col("body"))).alias("no", "text"))
    n = F.col("line") * 10_000 + F.col("no")
    c = F.col
    return held.select(
        "page_id", n.cast("long").alias("word_no"), (c("line") + 1).alias("block_num"), F.lit(1).alias("par_num"), F.floor(c("no") / 12).cast("int").alias("line_num"), "text",
        ((c("doc_id") * 31 + c("line") * 17 + c("no") * 7) % 103 - 2).cast("string").alias("conf"),
        (c("no") % 12 * 70 + 20).alias("left"), (c("line") * 24 % 1500 + F.floor(c("no") / 12) * 14).cast("int").alias("top"), F.lit(60).alias("width"), F.lit(12).alias("height"), F.lit(1000).alias("page_width"), F.lit(1600).alias("page_height"),
    )


def candidates(spark: SparkSession, sf_dir: str, *, dealt: bool = False) -> DataFrame:
    """Three OCR candidates a document, the text shortened or with garbage.

    dealt: by page before there are three of each text, for work that needs the texts of a page together; what
    needs its figures only is shuffled after them.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), "doc_id", "text")
    docs = docs.repartition("page_id") if dealt else docs
    c = F.col
    held = docs.select("page_id", "doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("candidate_no"))
    text = F.when(c("candidate_no") == 0, c("text")).when(c("candidate_no") == 1, F.replace(c("text"), F.lit("th"), F.lit("□"))).otherwise(F.translate("text", "aeiou", ""))
    return held.select(
        "page_id", "candidate_no", text.alias("text"), F.when(c("candidate_no") == 1, "region_ocr").otherwise("full_page_ocr").alias("route"),
        F.when((c("doc_id") + c("candidate_no")) % 11 != 0, ((c("doc_id") * 13 + c("candidate_no") * 29) % 101).cast("double")).alias("mean_confidence"),
        ((c("doc_id") % 50) / 1000.0).cast("double").alias("coverage"), ((c("doc_id") + c("candidate_no")) % 17 != 0).alias("structurally_valid"), (c("doc_id") % 5 != 0).alias("reading_order_valid"),
        F.lit("fas+eng").alias("language_profile"), F.when(c("candidate_no") == 2, "mixed").otherwise(F.lit("6")).alias("psm"), F.lit("original").alias("preprocessing"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page evidence of documents by their whole texts; blank and short pages are rows of their own, with negative ids."""
    from ..operators.pages import meaningful_ratio, native_characters

    c = F.col
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    more = docs.where("doc_id % 6 < 2").select((-1 - c("doc_id")).alias("doc_id"), F.when(c("doc_id") % 6 == 0, F.lit("")).otherwise(F.left("text", F.lit(20))).alias("text"))
    held = docs.unionByName(more)
    n = F.abs("doc_id")
    return held.select(
        "doc_id", c("text").alias("native_text"), native_characters(c("text")).alias("native_characters"), meaningful_ratio(c("text")).alias("meaningful_ratio"), F.when(n % 9 == 0, 0).otherwise(1).alias("n_blocks"),
        ((n % 8) / 10.0).cast("double").alias("image_coverage"), ((n % 13) / 200.0).cast("double").alias("visual_ratio"), (n % 4 == 0).alias("has_ocr"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages: one a line of a document, by arithmetic."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    c = F.col
    left, top = (c("n") * 137 + c("doc_id")) % 800, c("n") * 61 % 1400
    return lines.select(
        c("doc_id").cast("string").alias("page_id"), c("n").alias("region_id"), c("n").alias("box_no"), c("n").alias("block_num"), left.cast("int").alias("left"), top.cast("int").alias("top"), (left + 150 + F.length("line") % 50).cast("int").alias("right"), (top + 40 + c("n") % 30).cast("int").alias("bottom"),
        F.size(split_words(c("line"))).cast("long").alias("word_count"), F.when(c("n") % 7 != 3, (c("n") * 19 % 100).cast("double")).alias("confidence"), F.lit("x").alias("text"), F.lit(1000).alias("page_width"), F.lit(1600).alias("page_height"),
    )


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, value, n: lengths of words up to 255 as grey values."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.explode(split_words(F.col("text"))).alias("w"))
    return held.groupBy("page_id", F.least(F.length("w") * 9, F.lit(255)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rows: a document's lines as rows, cells between bars, ragged as they come."""
    held = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, r"\|")).alias("rows"))
    return held


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a document; documents of a source make one document."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        c("source").alias("document_id"), "doc_id", c("text").alias("index_text"), c("text").alias("native_text"), F.when(c("doc_id") % 3 == 0, c("text")).otherwise("").alias("ocr_text"), F.when(c("doc_id") % 29 == 0, "empty").otherwise("digital").alias("page_type"),
        F.when(c("doc_id") % 10 == 9, "needs_review").when(c("doc_id") % 41 == 0, "failed").otherwise("accepted").alias("processing_status"), F.when(c("doc_id") % 2 == 0, (c("doc_id") % 100).cast("double")).alias("decision_quality"),
        F.when(c("doc_id") % 5 == 0, (c("doc_id") % 90).cast("double")).alias("decision_agreement"), F.when(c("doc_id") % 23 == 0, "rejected").when(c("doc_id") % 7 == 0, "combined").when(c("doc_id") % 11 == 0, "region_ocr").otherwise("native").alias("selected_route"), (c("doc_id") % 23 != 0).alias("gate_passed"), (c("doc_id") % 4).cast("int").alias("n_fallbacks"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_id, index_text, blocks: a document's lines in order, the first a heading, those with bars tables."""
    kind = lambda x, i: F.when(i == 0, "heading").when(F.instr(x, "|") > 0, "table").otherwise("paragraph")
    held = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("string").alias("block_id"), kind(x, i).alias("block_type"), x.alias("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("page_id"), (F.col("doc_id") + 1).alias("page_number"), F.lit("accepted").alias("processing_status"), F.col("text").alias("index_text"), held.alias("blocks"))
