"""Reports: a row a file, corpus totals, pipelines side by side, diagnostics, job results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import compact, count_matches, persian_ratio

# Routes that used OCR.
OCR_ROUTES = ("full_page_ocr", "region_ocr", "combined")


def file_reports(quality: DataFrame, pages: DataFrame, tables: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """A report row a document (document_id): its quality, its pages read by OCR, its tables; failed files with an error."""
    ocr = pages.groupBy("document_id").agg(F.count_if(F.col("selected_route").isin(*OCR_ROUTES)).alias("ocr_route_pages"))
    n = tables.groupBy("document_id").agg(F.count(F.lit(1)).alias("table_count"))
    out = quality.join(ocr, "document_id", "left").join(n, "document_id", "left").fillna(0, ["ocr_route_pages", "table_count"]).withColumn("error", F.lit(None).cast("string"))
    return out if failures is None else out.unionByName(failures.select("document_id", "error"), allowMissingColumns=True)


def with_warnings(reports: DataFrame, documents: DataFrame) -> DataFrame:
    """reports with warnings: a document's own (documents: document_id, warnings) before those of its quality, each once."""
    none = F.array().cast("array<string>")
    own = documents.select("document_id", F.col("warnings").alias("__own"))
    held = reports.join(own, "document_id", "left")
    return held.withColumn("warnings", F.array_distinct(F.concat(F.coalesce("__own", none), F.coalesce("warnings", none)))).drop("__own")


def corpus_totals(reports: DataFrame) -> DataFrame:
    """Totals of a run: failed files count as files only."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c)
    return reports.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(good).alias("files_extracted"), F.count_if(~good).alias("files_failed"),
        total("total_pages"), total("accepted_pages"), total("needs_review_pages"), total("failed_pages"), total("table_count"),
        F.round(F.avg(F.when(good, F.col("score"))), 2).alias("mean_quality_score"),
        F.round(F.try_divide(F.sum(F.when(good, F.col("accepted_pages"))), F.sum(F.when(good, F.col("total_pages")))), 4).alias("page_acceptance_rate"),
    )


def pipeline_totals(reports: DataFrame, by: str = "pipeline") -> DataFrame:
    """Pipelines side by side; a failed file is an error more."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c)
    size = lambda c: F.coalesce(F.sum(F.when(good, F.coalesce(F.size(c), F.lit(0)))), F.lit(0))
    return reports.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.round(F.avg(F.when(good, F.col("score"))), 2).alias("avg_quality_score"), total("accepted_pages"), total("needs_review_pages"), total("failed_pages"), total("table_count"),
        size("warnings").alias("warning_count"), (size("errors") + F.count_if(~good)).alias("error_count"),
    )


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON report: an object with ``reports``, or a bare list."""
    held = spark.read.json(path, multiLine=True)
    return held.select(F.explode("reports").alias("r")).select("r.*") if "reports" in held.columns else held


def codepoint_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """class, n, percent of the characters of all texts, the commonest first.

    Texts are counted where they are; only classes are shuffled.
    """
    # Classes by their range of code points.
    classes = (("space", r"\s"), ("digit", "[0-9]"), ("latin", "[A-Za-z]"), ("latin_extended", r"[\x{00C0}-\x{024F}]"), ("arabic", r"[\x{0600}-\x{06FF}]"), ("ascii_other", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"))
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: count_matches(body, p).cast("long")
    each = df.select(*(count(p).alias(name) for name, p in classes), F.length(body).cast("long").alias("__all")).agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name, _ in classes), F.coalesce(F.sum("__all"), F.lit(0)).alias("__all"))
    rest = F.col("__all") - sum((F.col(name) for name, _ in classes), F.lit(0))
    pairs = F.array(*(F.struct(F.lit(name).alias("class"), F.col(name).alias("n")) for name, _ in classes), F.struct(F.lit("other").alias("class"), rest.alias("n")))
    return each.select(F.explode(pairs).alias("p"), "__all").select("p.class", "p.n", F.round(F.try_divide(F.col("p.n") * 100.0, F.col("__all")), 4).alias("percent")).where("n > 0")


def triage(pages: DataFrame, by: str = "file") -> DataFrame:
    """Pages, mean characters, empty pages, share of pages with tables, images and Persian text of each file."""
    n = F.length(compact(F.coalesce(F.col("text"), F.lit(""))))
    return pages.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg(n), 2).alias("avg_chars"), F.count_if(n < 50).alias("empty_pages"), F.round(F.avg((F.col("n_tables") > 0).cast("double")) * 100, 2).alias("table_percent"),
        F.sum("n_images").alias("images"), F.round(F.avg(persian_ratio(F.col("text"))) * 100, 2).alias("persian_percent"),
    )


def counts_with_share(df: DataFrame, column: str) -> DataFrame:
    """column, n, share of the values of a column."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def ingestion_status(embedded: Column, level: Column, n_warnings: Column, needs_review: Column) -> Column:
    """indexed, indexed_with_warnings, needs_review or failed."""
    clean = (level == "accepted") & (n_warnings == 0) & (needs_review == 0)
    return F.when((embedded > 0) & clean, "indexed").when(embedded > 0, "indexed_with_warnings").when(needs_review > 0, "needs_review").otherwise("failed")


def results(quality: DataFrame, documents: DataFrame, embedded: DataFrame, *, pipeline: str) -> DataFrame:
    """What became of each document: counts, score and verdict of its quality, embedded chunks, all warnings, status.

    documents: document_id, source, tenant_id, extraction_route, table_count, warnings, errors; embedded: document_id, embedded_chunks.
    """
    none = F.array().cast("array<string>")
    held = quality.withColumnRenamed("warnings", "__told").join(documents, "document_id").join(embedded, "document_id", "left").withColumn("embedded_chunks", F.coalesce("embedded_chunks", F.lit(0)))
    held = held.withColumn("warnings", F.concat(F.coalesce("warnings", none), F.coalesce("__told", none)))
    status = ingestion_status(F.col("embedded_chunks"), F.col("level"), F.size("warnings"), F.col("needs_review_pages"))
    return held.select(
        "document_id", F.col("embedded_chunks").alias("chunks"), "source", "tenant_id", F.lit(pipeline).alias("ingestion_pipeline"), "extraction_route", status.alias("ingestion_status"), F.col("score").alias("quality_score"),
        F.col("level").alias("quality_level"), "total_pages", "accepted_pages", "needs_review_pages", "failed_pages", "empty_pages", "table_count", "warnings", "errors", "embedded_chunks",
    )


def indexed_or_raise(results_: DataFrame) -> DataFrame:
    """results; one that failed without a chunk raises when it is read."""
    empty = (F.col("embedded_chunks") == 0) & (F.col("ingestion_status") == "failed")
    said = F.concat(F.lit("nothing to index in "), "source", F.lit(" (route "), "extraction_route", F.lit(", quality "), "quality_level", F.lit(")"))
    return results_.where(F.when(empty, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def parsed_reports(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Rows of JSON reports, each an object with ``reports`` or a bare list."""
    body = F.col(text)
    held = F.when(body.rlike(r"^\s*\["), F.from_json(body, f"array<struct<{schema}>>")).otherwise(F.from_json(body, f"struct<reports:array<struct<{schema}>>>")["reports"])
    return texts.select(*(c for c in texts.columns if c != text), F.explode(held).alias("r")).select("*", "r.*").drop("r")


def as_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """line_no, line: rows as a table of text, headers and a rule first; a report's rows, which are few."""
    shown = rows.select(F.col(order).alias("__o"), *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns))
    widths = shown.agg(*(F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"w_{c}") for c in columns))
    padded = lambda values: F.concat_ws("  ", *(F.rpad(v, F.col(f"w_{c}"), " ") for c, v in zip(columns, values)))
    head = widths.select(F.lit(0).alias("line_no"), padded([F.lit(c) for c in columns]).alias("line"))
    rule = widths.select(F.lit(1).alias("line_no"), F.concat_ws("  ", *(F.repeat(F.lit("-"), F.col(f"w_{c}")) for c in columns)).alias("line"))
    body = shown.withColumn("line_no", F.row_number().over(Window.orderBy("__o")) + 1).join(F.broadcast(widths)).select("line_no", padded([F.col(c) for c in columns]).alias("line"))
    return head.unionByName(rule).unionByName(body)


def write_artefacts(pages: DataFrame, folder: str) -> None:
    """Pages as JSON and their texts beside it, a part a page number, to look at without an engine."""
    pages.write.mode("overwrite").partitionBy("document_id").json(f"{folder}/pages")
    pages.select("document_id", "page_number", F.col("index_text").alias("value")).write.mode("overwrite").partitionBy("document_id", "page_number").text(f"{folder}/text")


def region_report(regions: DataFrame) -> DataFrame:
    """A row a page (page_id) of its regions: their number, words, mean confidence weighted by words, and the regions as JSON."""
    weight = F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(1), F.col("word_count")))
    rows = F.to_json(F.sort_array(F.collect_list(F.struct("region_id", "left", "top", "right", "bottom", "word_count", F.round("confidence", 2).alias("confidence")))))
    return regions.groupBy("page_id").agg(F.count(F.lit(1)).alias("regions"), F.sum("word_count").alias("words"), F.round(F.sum(F.col("confidence") * weight) / F.sum(weight), 2).alias("mean_confidence"), rows.alias("report"))
