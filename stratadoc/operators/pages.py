"""Pages: evidence, classification, routing, the adaptive decision, blocks of native text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import solid_counts
from ..functions.text import blank, normalize_ocr, split_words, strip


@dataclass(frozen=True)
class PagePolicy:
    """Thresholds of page classification."""

    min_native_characters: int = 40
    min_any_native_characters: int = 5
    min_meaningful_ratio: float = 0.55
    mixed_image_coverage: float = 0.25
    scanned_image_coverage: float = 0.50
    min_visual: float = 0.01
    min_dense_visual: float = 0.05
    max_empty_visual: float = 0.003


def native_characters(text: Column) -> Column:
    """Characters but for white space; null of null."""
    return F.when(text.isNotNull(), solid_counts(text)["n"])


def meaningful_ratio(text: Column) -> Column:
    counts = solid_counts(text)
    return F.when(counts["n"] == 0, 0.0).otherwise(F.round(counts["meaningful"] / counts["n"], 4))


def evidence(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Raw pages (page_id, native_text, ...) with character counts and the number of usable text blocks."""
    held = pages.withColumn("native_text", normalize_ocr(F.col("native_text")))
    usable = blocks.where((F.length(normalize_ocr(F.col("text"))) > 0) & (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
    n = usable.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    held = held.join(n, "page_id", "left").fillna(0, ["n_blocks"])
    return held.withColumns({"native_characters": native_characters(F.col("native_text")), "meaningful_ratio": meaningful_ratio(F.col("native_text"))})


def classified(pages: DataFrame, policy: PagePolicy = PagePolicy()) -> DataFrame:
    """page_type, reasons, native_usable from evidence; has_ocr tells whether accepted OCR text is there."""
    p, c = policy, F.col
    usable = (c("native_characters") >= p.min_native_characters) & (c("meaningful_ratio") >= p.min_meaningful_ratio) & (c("n_blocks") > 0)
    some = c("native_characters") >= p.min_any_native_characters
    visual, dense = c("visual_ratio") >= p.min_visual, c("visual_ratio") >= p.min_dense_visual
    ocr, images = c("has_ocr"), c("image_coverage")
    outcomes = (
        (usable & (images >= p.mixed_image_coverage) & visual, "mixed", ("usable_native_text", "substantial_image_content")),
        (usable, "digital", ("usable_native_text",)),
        (some & (dense | (images >= p.mixed_image_coverage) | ocr), "mixed", ("limited_native_text", "additional_visual_or_ocr_evidence")),
        (some, "unknown", ("limited_native_text_without_scan_evidence",)),
        (ocr, "scanned", ("accepted_ocr_without_usable_native_text",)),
        ((images >= p.scanned_image_coverage) & visual, "scanned", ("large_displayed_image", "visible_page_content")),
        (dense, "scanned", ("dense_rendered_content_without_native_text",)),
        (c("visual_ratio") <= p.max_empty_visual, "empty", ("no_native_or_visible_content",)),
        (visual, "unknown", ("limited_visual_content_may_be_decorative",)),
        (F.lit(True), "unknown", ("insufficient_classification_evidence",)),
    )
    verdict = F.coalesce(*(F.when(test, F.struct(F.lit(kind).alias("page_type"), F.array(*map(F.lit, why)).alias("reasons"))) for test, kind, why in outcomes))
    return pages.withColumn("__v", verdict).withColumns({"native_usable": usable, "page_type": c("__v.page_type"), "reasons": c("__v.reasons")}).drop("__v")


def inspected_type(characters: Column, visual: Column, *, least: int = 50, visible: float = 0.01) -> Column:
    """A quick look: text, scanned_candidate, or empty_or_unknown."""
    return F.when(characters >= least, "text").when(visual >= visible, "scanned_candidate").otherwise("empty_or_unknown")


def routed(pages: DataFrame, preferred: str = "full_page_ocr") -> DataFrame:
    """route, status, passed from page_type, native_text, ocr_text and ocr_passed."""
    if preferred not in ("full_page_ocr", "region_ocr"):
        raise ValueError("preferred must be an OCR route")
    has = lambda c: ~blank(F.col(c))
    native, ocr, passed = has("native_text"), has("ocr_text"), F.col("ocr_passed")
    digital = (F.col("page_type") == "digital") & ~ocr
    return pages.withColumns({
        "route": F.when(native & ocr & passed, "combined").when(native, "native").when(ocr & passed, preferred).otherwise("rejected"),
        "status": F.when(native & ocr & passed, "accepted").when(native & digital, "accepted").when(native, "needs_review").when(ocr & passed, "accepted").when(ocr, "needs_review").otherwise("failed"),
        "passed": F.when(native & ocr & passed, True).when(native, digital).otherwise(ocr & passed),
    })


def decided(pages: DataFrame) -> DataFrame:
    """route, status and fallback reasons of the adaptive path.

    Read: native_text, ocr_text (of the selected or best rejected candidate), selected_route (null: none
    passed), reason (of the selection), page_type, first_type and native_usable (before OCR).
    """
    has = lambda c: ~blank(F.col(c))
    chosen, native = F.col("selected_route").isNotNull(), has("native_text")
    combined = chosen & native & (F.col("page_type") == "mixed")
    plain = (F.col("first_type") == "digital") & F.col("native_usable")
    why = F.array(
        F.col("reason"),
        F.when(~chosen & native, "usable_native_text_preserved_after_ocr_rejection"),
        F.when(combined, "mixed_layers_preserved_without_coordinate_merge"),
        F.when(F.col("page_type") == "empty", "empty_page_detected"),
    )
    return pages.withColumns({
        "route": F.when(combined, "combined").when(chosen, F.col("selected_route")).when(native, "native").otherwise("rejected"),
        "status": F.when(combined, "needs_review").when(chosen, "accepted").when(native & plain, "accepted").when(native, "needs_review").when(has("ocr_text"), "needs_review").otherwise("failed"),
        "fallback_reasons": F.array_distinct(F.filter(why, lambda r: r.isNotNull())),
    })


#: A list item begins with a bullet, a number or a letter.
BULLET = r"^(?:[•·◦▪–\-*]|[0-9۰-۹]+[.)]|[a-zA-Z][.)])[ \t]+"


def native_blocks(spans: DataFrame) -> DataFrame:
    """Blocks (page_id, block_no, text, size, block_type, reading_order) of spans (page_id, block_no, line_no, span_no, text, size).

    A block of at most 8 words that is a fifth larger than the page's median and ends no sentence is a heading.
    """
    shown = spans.where(F.length(strip(F.col("text"))) > 0)
    shown = shown.withColumn("median_size", F.median("size").over(Window.partitionBy("page_id")))
    lines = shown.groupBy("page_id", "block_no", "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), "").alias("line"), F.max("size").alias("size"), F.first("median_size").alias("median_size")
    )
    blocks = lines.groupBy("page_id", "block_no").agg(
        normalize_ocr(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")).alias("text"), F.max("size").alias("size"), F.first("median_size").alias("median_size")
    )
    large = (F.col("median_size") > 0) & (F.col("size") >= F.col("median_size") * 1.2)
    heading = (F.size(split_words(F.col("text"))) <= 8) & large & ~F.col("text").rlike("[.؟?!]$")
    kind = F.when(F.col("text").rlike(BULLET), "list_item").when(heading, "heading").otherwise("paragraph")
    held = blocks.where("text <> ''").withColumn("block_type", kind)
    return held.withColumn("reading_order", F.row_number().over(Window.partitionBy("page_id").orderBy("block_no")) - 1)


def paragraph_type(style: Column) -> Column:
    """Block type of a paragraph's style."""
    s = F.lower(F.coalesce(style, F.lit("")))
    return F.when(s.startswith("heading") | s.isin("title", "subtitle"), "heading").when(s.contains("list"), "list_item").otherwise("paragraph")


def renumbered(pages: DataFrame, document: str = "document_id", page: str = "source_page_number") -> DataFrame:
    """page_index without gaps; the source's number stays beside it."""
    return pages.withColumn("page_index", F.dense_rank().over(Window.partitionBy(document).orderBy(page)) - 1)


def violations(pages: DataFrame) -> DataFrame:
    """Pages that break an invariant, with its name."""
    has = lambda c: ~blank(F.col(c))
    route, ok = F.col("selected_route"), F.col("processing_status") == "accepted"
    rules = F.array(
        F.when(F.col("page_number") != F.col("page_index") + 1, "page_number"),
        F.when((route == "native") & ~has("native_text"), "native_without_text"),
        F.when(route.isin("full_page_ocr", "region_ocr") & ~has("ocr_text"), "ocr_without_text"),
        F.when((route == "combined") & ~(has("native_text") & has("ocr_text")), "combined_without_both"),
        F.when(ok & ((route == "rejected") | ~F.col("gate_passed") | ~has("index_text") | (F.col("page_type") == "unknown")), "accepted_without_ground"),
        F.when((route == "rejected") & F.col("gate_passed"), "rejected_but_passed"),
    )
    return pages.withColumn("violation", F.explode(F.filter(rules, lambda r: r.isNotNull())))


def native_regions(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text blocks in points as regions in pixels, inside the page, from the top, right before left.

    pages: page_id, page_width_points, page_height_points, rendered_width, rendered_height; blocks: page_id, text, left, top, right, bottom.
    """
    c = F.col
    held = blocks.join(pages, "page_id")
    place = lambda v, points, pixels: F.greatest(F.lit(0), F.least(c(pixels), F.round(c(v) * c(pixels) / c(points)).cast("int")))
    held = held.select(
        "page_id", "text", place("left", "page_width_points", "rendered_width").alias("left"), place("top", "page_height_points", "rendered_height").alias("top"),
        place("right", "page_width_points", "rendered_width").alias("right"), place("bottom", "page_height_points", "rendered_height").alias("bottom"),
    )
    held = held.where((c("right") > c("left")) & (c("bottom") > c("top")))
    return held.withColumn("reading_order", F.row_number().over(Window.partitionBy("page_id").orderBy("top", F.desc("right"), "left", "bottom", "text")) - 1)


def all_regions(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native regions, then those of the chosen OCR candidate with their order moved behind."""
    n = native.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    moved = ocr.join(n, "page_id", "left").withColumn("reading_order", (F.col("reading_order") + F.coalesce("n", F.lit(0))).cast("int")).drop("n")
    return native.withColumn("layer", F.lit("native")).unionByName(moved.withColumn("layer", F.lit("ocr")))


def simple_type(characters: Column, score: Column, images: Column, *, least: int = 40) -> Column:
    """The simpler classification: by length of the native text, its score and the images' share."""
    return (
        F.when((characters < 5) & (images >= 0.02), "scanned").when(characters < 5, "empty")
        .when((characters >= least) & (score >= 60), F.when(images >= 0.25, "mixed").otherwise("digital"))
        .when((images >= 0.15) | (score < 60), "mixed").otherwise("digital")
    )


def missing_languages(requested: Column, available: list[str]) -> Column:
    """Languages of profiles like a+b that aren't installed."""
    from ..functions.text import required_languages

    return F.array_except(required_languages(requested), F.array(*map(F.lit, available)).cast("array<string>"))


def require_languages(df: DataFrame, profiles: str, available: list[str]) -> DataFrame:
    """df; a row that asks for a language that isn't installed raises."""
    missing = missing_languages(F.col(profiles), available)
    return df.where(F.when(F.size(missing) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing languages: "), F.array_join(missing, ", "))).cast("boolean")))


def usable_profiles(profiles: Column, available: list[str], fallback: str = "eng") -> Column:
    """Profiles all of whose languages are installed; the fallback where none is."""
    kept = F.filter(profiles, lambda p: F.size(F.array_except(F.split(p, r"\+"), F.array(*map(F.lit, available)))) == 0)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))
