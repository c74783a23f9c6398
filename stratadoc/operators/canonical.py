"""Canonical documents: manifests, provenance, pages, blocks and chunks, from what extractors give."""

from __future__ import annotations

import os
import platform
import re
import subprocess
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, quality, tables
from ..functions.text import blank, language, normalize_ocr
from . import chunking

#: Fields that tell when and how long something ran, and so differ from run to run.
VOLATILE = ("processing_time_ms", "processing_timestamp")


def code_revision(folder: str | None = None) -> str | None:
    """The commit that runs, or None where there is none to tell; asked on the driver."""
    try:
        out = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder or os.path.dirname(__file__), capture_output=True, text=True, timeout=2, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() if re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", out.stdout.strip()) else None


def provenance(pipeline: str, version: str, *, digest: str = "source_sha256", at: datetime | None = None, dpi: int | None = None, languages: tuple[str, ...] = ()) -> Column:
    """How rows came about: a struct beside each, with what is the same for all captured on the driver."""
    system = f"{platform.system()} {platform.release()} {platform.machine()}".strip()
    return F.struct(
        F.lit(pipeline).alias("pipeline_name"), F.lit(version).alias("pipeline_version"), ids.valid_sha256(F.col(digest)).alias("input_sha256"), F.lit(dpi).cast("int").alias("dpi"),
        F.array(*map(F.lit, languages)).cast("array<string>").alias("resolved_language_profiles"), F.lit(platform.python_version()).alias("python_version"), F.lit(system).alias("platform"),
        F.lit(code_revision()).cast("string").alias("code_revision"), (F.lit(at) if at else F.current_timestamp()).alias("processing_timestamp"),
    )


def identified(documents: DataFrame) -> DataFrame:
    """documents (tenant_id, logical_key, source_name, source_sha256, ...) with document_id and revision_id, digest and name as a manifest has them."""
    digest = ids.valid_sha256(F.col("source_sha256"))
    held = documents.withColumn("document_id", ids.canonical_id("document", F.col("tenant_id"), F.col("logical_key")))
    held = held.withColumn("revision_id", ids.canonical_id("revision", ids.Plain(F.col("document_id")), ids.Plain(digest)))
    return held.withColumns({"source_name": F.regexp_extract("source_name", r"[^/\\]*$", 0), "source_sha256": digest})


def manifests(documents: DataFrame, parser: str, version: str, *, at: datetime | None = None) -> DataFrame:
    """A manifest a document (tenant_id, logical_key, source_name, source_type, source_sha256, file_size_bytes, mime_type, total_pages).

    Ids follow from tenant and key, and from the content; of a source only its name is told, never its folder.
    """
    held = identified(documents)
    metadata = F.col("metadata") if "metadata" in documents.columns else F.create_map().cast("map<string,string>")
    return held.select(
        "document_id", "revision_id", "tenant_id", "source_name", "source_type", "source_sha256", "file_size_bytes", "mime_type", "total_pages",
        F.lit(parser).alias("parser_name"), F.lit(version).alias("parser_version"), (F.lit(at) if at else F.current_timestamp()).alias("created_at"), metadata.alias("metadata"),
    )


def _paged(pages: DataFrame, manifests_: DataFrame | None) -> DataFrame:
    """pages (document_id, page_index, ...) with the identities of their document; those that carry its revision_id need no manifests."""
    held = pages if manifests_ is None else pages.join(manifests_.select("document_id", "revision_id"), "document_id")
    index = F.when(F.col("page_index") >= 0, F.col("page_index")).otherwise(F.raise_error(F.lit("page_index must be 0 or more")).cast("int"))
    return held.withColumns({"page_id": ids.canonical_id("page", ids.Plain(F.col("revision_id")), ids.Plain(index)), "page_number": (F.col("page_index") + 1).cast("int")})


def _assembled(held: DataFrame, text: str, route: str, page_type: Column, candidates: int) -> DataFrame:
    """Pages with their decision: those without text are rejected and empty, never accepted, and pass no gate."""
    none = blank(F.col(text))
    return held.withColumns({
        "page_type": F.when(none, "empty").otherwise(page_type),
        "selected_route": F.when(none, "rejected").otherwise(route),
        "processing_status": F.when(none & (F.col("processing_status") == "accepted"), "failed").otherwise(F.col("processing_status")),
        "gate_passed": ~none & F.col("gate_passed"),
        "candidate_count": F.when(none, 0).otherwise(candidates),
        "index_text": chunking.layer_text(F.col("native_text"), F.col("ocr_text")),
    })


def native_pages(pages: DataFrame, manifests_: DataFrame | None = None) -> DataFrame:
    """Pages (document_id, page_index, native_text, processing_status, gate_passed) of extractors that read text."""
    held = _paged(pages, manifests_).withColumns({"native_text": F.coalesce("native_text", F.lit("")), "ocr_text": F.lit("")})
    return _assembled(held, "native_text", "native", F.lit("digital"), 0)


def ocr_pages(pages: DataFrame, manifests_: DataFrame | None = None) -> DataFrame:
    """Pages (document_id, page_index, ocr_text, processing_status, gate_passed) of extractors that read an image."""
    held = _paged(pages, manifests_).withColumns({"ocr_text": F.coalesce("ocr_text", F.lit("")), "native_text": F.lit("")})
    return _assembled(held, "ocr_text", "full_page_ocr", F.lit("scanned"), 1)


def judged(pages: DataFrame, text: str) -> DataFrame:
    """pages with processing_status, gate_passed and quality_score by their text's score, as the plain extractors judge."""
    held = quality.with_text_score(pages, text)
    verdict = quality.level(F.col("text_score"))
    held = held.withColumns({"quality_score": F.col("text_score"), "processing_status": quality.status_of(verdict), "gate_passed": verdict.isin("accepted", "accepted_with_warning")})
    return held.select(*pages.columns, "quality_score", "processing_status", "gate_passed")


def blocks(rows: DataFrame, *, layer: str = "native", route: str = "native") -> DataFrame:
    """Blocks (page_id, block_type, reading_order, text, ...) with ids, language, layer and route."""
    order = F.when(F.col("reading_order") >= 0, F.col("reading_order")).otherwise(F.raise_error(F.lit("reading_order must be 0 or more")).cast("int"))
    return rows.withColumns({"block_id": ids.canonical_id("block", ids.Plain(F.col("page_id")), ids.Plain(F.col("block_type")), ids.Plain(order)), "language_profile": language(F.col("text")), "layer": F.lit(layer), "route": F.lit(route)})


def flattened(pages: DataFrame) -> DataFrame:
    """A row a block of pages with their blocks nested."""
    return pages.select(*(c for c in pages.columns if c != "blocks"), F.explode("blocks").alias("block")).select("*", "block.*").drop("block")


# Labels of layout engines and the block types they stand for.
LABELS = {
    "title": "heading", "section_header": "heading", "subtitle": "heading", "paragraph": "paragraph", "text": "paragraph", "list_item": "list_item", "caption": "caption",
    "page_header": "header", "page_footer": "footer", "footnote": "footer", "key_value_region": "key_value",
}


def layout_blocks(items: DataFrame) -> DataFrame:
    """Blocks of a layout engine's items (document_id, item_no, label, page_no, text, rows) with page_index without gaps.

    Types are by label, paragraphs for labels that aren't known; a table without a grid is a paragraph of
    its text. Items without text go; an item without a page is on the first.
    """
    label = F.lower(F.coalesce("label", F.lit("")))
    grid = F.when(F.exists(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: ~blank(c))), tables.padded(F.col("rows")))
    kinds = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    is_table = (label == "table") & grid.isNotNull()
    text = F.when(is_table, tables.reading_text(grid, F.lit(None).cast("string"))).otherwise(normalize_ocr(F.col("text")))
    number = F.when(F.col("page_no") > 0, F.col("page_no")).otherwise(1)
    held = items.select("document_id", "item_no", number.alias("page_no"), F.when(is_table, "table").otherwise(F.coalesce(F.try_element_at(kinds, label), F.lit("paragraph"))).alias("block_type"), text.alias("text"), F.when(is_table, grid).alias("rows"))
    held = held.where("text <> ''")
    page = F.dense_rank().over(_by("document_id", "page_no")) - 1
    order = F.row_number().over(_by("document_id", "item_no", also="page_no")) - 1
    return held.withColumns({"page_index": page, "reading_order": order})


def _by(key: str, order: str, also: str | None = None):
    from pyspark.sql import Window

    return Window.partitionBy(*([key, also] if also else [key])).orderBy(order)


def workbook_blocks(rows: DataFrame) -> DataFrame:
    """One page and one table block a sheet (path, sheet, sheet_no, values by row): hidden sheets go, blank rows too.

    A sheet without rows keeps its page, empty. path, page_index, sheet, text, rows.
    """
    shown = rows.where(~F.col("sheet").startswith("_"))
    full = F.exists("values", lambda v: ~blank(v))
    values = F.transform("values", lambda v: F.coalesce(v, F.lit("")))
    held = shown.groupBy("path", "sheet", "sheet_no").agg(F.transform(F.sort_array(F.collect_list(F.when(full, F.struct("row", values.alias("v"))))), lambda r: r["v"]).alias("rows"))
    grid = F.when(F.size("rows") > 0, tables.padded(F.col("rows")))
    text = F.coalesce(tables.reading_text(grid, F.col("sheet")), F.lit(""))
    held = held.withColumns({"text": F.when(grid.isNull(), "").otherwise(text), "rows": grid})
    return held.withColumn("page_index", F.row_number().over(_by("path", "sheet_no")) - 1).drop("sheet_no")


def mismatched(pages: DataFrame, manifests_: DataFrame) -> DataFrame:
    """Pages whose document or revision isn't that of a manifest."""
    return pages.join(manifests_.select("document_id", "revision_id"), ["document_id", "revision_id"], "left_anti")


def matched(pages: DataFrame, manifests_: DataFrame) -> DataFrame:
    """pages with tenant_id, source_name and source_type of their manifest; a page of no manifest raises."""
    named = manifests_.select("document_id", "revision_id", "tenant_id", "source_name", "source_type", F.lit(True).alias("__known"))
    held = pages.join(named, ["document_id", "revision_id"], "left")
    return held.where(F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.lit("page and manifest identities do not match")).cast("boolean"))).drop("__known")


def page_scores(pages: DataFrame) -> DataFrame:
    """document_id, page_number, quality_score of pages, by their full page quality."""
    return quality.page_quality(pages).select("document_id", "page_number", F.col("score").alias("quality_score"))


def chunks(pages: DataFrame, blocks_: DataFrame, manifests_: DataFrame, scores: DataFrame, acl_groups: list[str], *, extractor: str, allow_needs_review: bool = False, max_words: int = 350) -> DataFrame:
    """Canonical chunks with all of their provenance: pages to blocks to structural chunks, a page's score by its number.

    Pages that aren't allowed give none. A page without blocks is cut by its text.
    """
    packed = blocks_.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", "block_type", "text"))), lambda b: F.struct(b["block_id"].alias("block_id"), b["block_type"].alias("block_type"), b["text"].alias("text"))).alias("blocks"))
    held = matched(pages.drop("quality_score"), manifests_).join(packed, "page_id", "left").join(scores, ["document_id", "page_number"], "left")
    return nested_chunks(held, acl_groups, extractor=extractor, allow_needs_review=allow_needs_review, max_words=max_words)


def nested_blocks(text: str) -> Column:
    """A paragraph block a line of a page's text, nested in order, as chunks take them; blank lines are none."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: ~blank(x))
    kind = F.lit("paragraph")
    return F.transform(lines, lambda x, i: F.struct(ids.canonical_id("block", ids.Plain(F.col("page_id")), ids.Plain(kind), ids.Plain(i)).alias("block_id"), kind.alias("block_type"), x.alias("text")))


def nested_chunks(pages: DataFrame, acl_groups: list[str], *, extractor: str, allow_needs_review: bool = False, max_words: int = 350) -> DataFrame:
    """The same of pages that carry their blocks (nested in order), their document's tenant_id, source_name and source_type, and quality_score: nothing is shuffled."""
    held = chunking.document_chunks(pages, acl_groups, allow_needs_review=allow_needs_review, max_words=max_words)
    place = F.struct(
        F.lit("page").alias("type"), F.col("page_number").alias("num"), "page_id", "document_id", "revision_id", "source_type", F.lit(extractor).alias("extractor_route"), F.col("selected_route").alias("route"),
        "quality_score", F.lit("structural-v1").alias("strategy"), "block_ids", "kind",
    )
    return held.select("chunk_id", "text", "lang", "tenant_id", F.col("source_name").alias("source"), "source_type", place.alias("location"), "acl_groups", "chunk_index")


def deterministic(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with payload: the columns as JSON, in structs too without what differs from run to run."""

    def kept(name: str) -> Column:
        kind = rows.schema[name].dataType
        gone = [f.name for f in getattr(kind, "fields", []) if f.name in VOLATILE]
        return (F.col(name).dropFields(*gone) if gone else F.col(name)).alias(name)

    names = [c for c in columns or rows.columns if c not in VOLATILE]
    return rows.withColumn("payload", F.to_json(F.struct(*map(kept, names))))


def extracted_chunks(documents: DataFrame, acl_groups: list[str], *, parser: str = "native", version: str = "1", allow_needs_review: bool = False, max_words: int = 350) -> DataFrame:
    """From text documents (tenant_id, logical_key, source_name, source_type, pages: array<string>) to canonical chunks, end to end.

    Manifest, pages, a paragraph block a line, page quality, structural chunks.
    """
    body = F.array_join(F.transform("pages", lambda p: F.coalesce(p, F.lit(""))), "\f")
    held = documents.withColumns({"source_sha256": F.sha2(body, 256), "file_size_bytes": F.octet_length(body).cast("long"), "mime_type": F.lit("text/plain"), "total_pages": F.size("pages")})
    named = identified(held).select("document_id", "revision_id", "tenant_id", "source_name", "source_type", F.posexplode("pages").alias("page_index", "raw"))
    pages = native_pages(judged(named.withColumn("native_text", normalize_ocr(F.col("raw"))).drop("raw"), "native_text"))
    empty = {"decision_quality": F.lit(None).cast("double"), "decision_agreement": F.lit(None).cast("double"), "n_fallbacks": F.lit(0)}
    scored = quality.page_quality(pages.withColumns(empty)).withColumns({"quality_score": F.col("score"), "blocks": nested_blocks("native_text")})
    return nested_chunks(scored.select(*pages.columns, "blocks"), acl_groups, extractor=parser, allow_needs_review=allow_needs_review, max_words=max_words)
