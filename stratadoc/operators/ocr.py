"""OCR as a pluggable engine, and what is made of its words: full-page and region candidates, a simpler second policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality
from ..functions.quality import clamp, half_up
from ..functions.text import ODD, blank, bound, normalize_ocr, router_normalized, squeezed_fold
from . import layout

#: A word that an engine reads: its text, confidence (negative: none), box and place in the page's structure.
WORD = "struct<text:string,conf:string,left:int,top:int,width:int,height:int,block_num:int,par_num:int,line_num:int>"
#: Bytes of an image, languages, page mode, preprocessing to words.
Engine = Callable[[bytes, str, int, str], list[dict]]


class EngineUnavailable(RuntimeError):
    """An engine isn't installed where it should run."""


def read(images: DataFrame, make: Callable[[], Engine], *, content: str = "content") -> DataFrame:
    """images (content, language_profile, psm, preprocessing) with words: an engine is made once a worker and called by Arrow batch.

    An image that the engine can't read (ValueError, TimeoutError) has null words, so that one bad page
    fails no job; an engine that isn't there fails it.
    """

    @F.pandas_udf(f"array<{WORD}>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        engine = make()

        def one(*args) -> list[dict] | None:
            try:
                return engine(*args)
            except (ValueError, TimeoutError):
                return None

        for held in batches:
            yield pd.Series([one(*args) for args in zip(*held)])

    return images.withColumn("words", run(content, "language_profile", "psm", "preprocessing"))


def exploded(read_images: DataFrame, *keys: str) -> DataFrame:
    """keys, page_width, page_height and a row a word, in the columns that layout takes."""
    held = read_images.select(*keys, "page_width", "page_height", F.posexplode("words").alias("word_no", "w"))
    return held.select(*keys, "page_width", "page_height", F.col("word_no").cast("long").alias("word_no"), "w.*")


def summary(words: DataFrame, *keys: str) -> DataFrame:
    """keys, mean_confidence (2 decimals), word_count, coverage (6 decimals): of words with text that were read with any confidence."""
    held = words.withColumn("c", layout.confidence(F.col("conf"))).where(~blank(F.col("text")) & F.col("c").isNotNull())
    area = F.sum(F.greatest(F.lit(0), F.col("width")).cast("double") * F.greatest(F.lit(0), F.col("height")))
    page = F.greatest(F.lit(1), F.first(F.col("page_width").cast("long") * F.col("page_height")))
    return held.groupBy(*keys).agg(half_up(F.avg("c"), 2).alias("mean_confidence"), F.count(F.lit(1)).alias("word_count"), half_up(F.least(area / page, F.lit(1.0)), 6).alias("coverage"))


def full_page_candidates(words: DataFrame) -> DataFrame:
    """A candidate a page (page_id) of its words: text, mean_confidence, word_count, coverage, structurally_valid."""
    texts = layout.reconstructed(words).select("page_id", normalize_ocr(F.col("text")).alias("text"))
    held = words.select("page_id").distinct().join(texts, "page_id", "left").join(summary(words, "page_id"), "page_id", "left")
    held = held.withColumns({"text": F.coalesce("text", F.lit("")), "word_count": F.coalesce("word_count", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0))})
    return held.withColumns({"route": F.lit("full_page_ocr"), "structurally_valid": F.col("text") != "", "reading_order_valid": F.lit(True)})


def region_candidates(regions: DataFrame) -> DataFrame:
    """A candidate a page of its regions (page_id, region_no, text, mean_confidence, word_count, coverage, left, top, right, bottom, page_width, page_height).

    The first region of each text counts; confidence weighs words, a region by one at least; coverage is
    that of a region by its share of the page.
    """
    # regions that don't count stay as rows, so that pages without any are there without a join
    held = regions.withColumn("__key", squeezed_fold(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("page_id", "__key").orderBy("region_no"))
    held = held.withColumn("__first", (F.col("__key") != "") & (nth == 1)).drop("__key")
    box = F.struct("left", "top", "right", "bottom")
    again = F.coalesce(F.lag(box).over(Window.partitionBy("page_id", "__first").orderBy("region_no")) == box, F.lit(False))
    held = held.withColumn("__again", F.col("__first") & again)
    of = lambda value: F.when(F.col("__first"), value)
    weight = F.when(F.col("mean_confidence").isNotNull(), F.greatest(F.col("word_count"), F.lit(1)))
    share = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) / F.greatest(F.lit(1), F.col("page_width") * F.col("page_height"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(of(F.struct("region_no", "text")))), lambda r: r["text"]), "\n\n")
    out = held.groupBy("page_id").agg(
        normalize_ocr(text).alias("text"), half_up(F.sum(of(F.col("mean_confidence") * weight)) / F.sum(of(weight)), 2).alias("mean_confidence"), F.coalesce(F.sum(of(F.col("word_count"))), F.lit(0)).alias("word_count"),
        F.coalesce(half_up(F.least(F.sum(of(F.col("coverage") * share)), F.lit(1.0)), 6), F.lit(0.0)).alias("coverage"), (~F.max("__again")).alias("reading_order_valid"), F.max("__first").alias("structurally_valid"),
    )
    return out.withColumn("route", F.lit("region_ocr"))


def needs_ocr(page_type: Column) -> Column:
    """Pages of text, and empty ones, skip OCR."""
    return ~page_type.isin("digital", "empty")


# The simpler policy.

# Punctuation of readable text; what garbage looks like.
PUNCTUATION = ".,،؛:!?؟()[]{}-_/@%+*=<>«»'\""
SUSPICIOUS = "�□■◆"


def _class(chars: str) -> str:
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars)


def _simple_counts(text: str | None) -> tuple[int, ...]:
    text = router_normalized(text or "")
    n, meaningful, _ = quality.characters(text, "")
    words = text.split()
    plain = [x for w in words if (x := (w if w.isalnum() else ODD.sub("", w)).lower())]
    return n, meaningful, sum(map(text.count, PUNCTUATION)), sum(map(text.count, SUSPICIOUS)), len(words), len(plain), len(set(plain))


_COUNTS = ("n", "meaningful", "marks", "suspicious", "words", "plain", "distinct")


@F.pandas_udf(T.StructType([T.StructField(name, T.IntegerType()) for name in _COUNTS]))
def simple_counts(texts: pd.Series) -> pd.DataFrame:
    """What simple_quality weighs, in one pass over a batch; the JVM needs a regular expression each."""
    return pd.DataFrame([_simple_counts(t) for t in texts], columns=_COUNTS)


def simple_quality(text: Column, confidence: Column | None = None) -> Column:
    """0 to 100: letters and digits, valid characters, length and words, less what is suspicious or repeated; with confidence where it is known."""

    def score(k: Column) -> Column:
        n = k["n"]
        base = k["meaningful"] / n * 35 + (k["meaningful"] + k["marks"]) / n * 25
        base = base + F.least(n / 250, F.lit(1.0)) * 20 + F.least(k["words"] / 35, F.lit(1.0)) * 20 - k["suspicious"] / n * 100
        repeats = (k["plain"] > 0) & (k["distinct"] / k["plain"] < 0.25)
        bounded = clamp(F.when(repeats, base - 15).otherwise(base))
        known = bounded if confidence is None else F.when(confidence.isNull(), bounded).otherwise(bounded * 0.55 + clamp(confidence) * 0.45)
        return F.when(n == 0, 0.0).otherwise(F.round(clamp(known), 2))

    return bound(simple_counts(text), score)


def simple_gate(*, least_confidence: float = 55.0, least_quality: float = 55.0, least_agreement: float = 55.0, least_characters: int = 10) -> Column:
    """Whether a candidate (confidence, quality_score, agreement_score, text) passes the simpler gate."""
    c = F.col
    return (c("confidence") >= least_confidence) & (c("quality_score") >= least_quality) & (c("agreement_score") >= least_agreement) & (F.length("text") >= least_characters)


def region_accepted() -> Column:
    """Whether a region's candidate is taken by the simpler policy."""
    return (F.col("confidence") >= 35) & (F.col("quality_score") >= 40) & (F.col("word_count") >= 1)


def _score(candidate: Column) -> Column:
    return F.when(candidate.isNull(), 0.0).otherwise(F.round(candidate["quality_score"] * 0.40 + candidate["confidence"] * 0.35 + candidate["agreement_score"] * 0.25, 2))


def simple_route(page_type: Column, native_text: Column, full: Column, region: Column, complex_: Column, *, tolerance: float = 12.0) -> Column:
    """The simpler policy's route of a page from its best candidates (struct<confidence, quality_score, agreement_score, text>, or null).

    A region's is taken if it is usable and the full page's failed, or the layout is complex and it is
    within a tolerance, or it is better by more than 3.
    """
    good = F.coalesce((full["confidence"] >= 55) & (full["quality_score"] >= 55) & (full["agreement_score"] >= 55) & (F.length(full["text"]) >= 10), F.lit(False))
    usable = F.coalesce((region["confidence"] >= 45) & (region["quality_score"] >= 50) & (F.length(region["text"]) >= 10), F.lit(False))
    prefers = usable & (~good | (complex_ & (_score(region) >= _score(full) - tolerance)) | (_score(region) > _score(full) + 3))
    return (
        F.when(page_type == "digital", "native").when(prefers, "region_ocr").when(full.isNotNull(), "full_page_ocr").when(region.isNotNull(), "region_ocr")
        .when(F.coalesce(native_text, F.lit("")) != "", "native").otherwise("region_ocr")
    )


def swept_best(runs: DataFrame, *, page: str = "page_id") -> DataFrame:
    """The best run of each page over all settings: by selection_score, quality_score, confidence, length of text, then the first."""
    order = Window.partitionBy(page).orderBy(F.desc("selection_score"), F.desc("quality_score"), F.desc("confidence"), F.desc(F.length("text")), "run_no")
    return runs.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


# Pictures as arrays of grey values.


def binarized(pixels: Column, threshold: Column) -> Column:
    """White above the threshold, else black."""
    return F.transform(pixels, lambda v: F.when(v > threshold, 255).otherwise(0))


def inverted(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: 255 - v)


def stretched(pixels: Column) -> Column:
    """Grey values spread over the whole range; a picture of one value stays."""
    spread = lambda p: F.when(p["low"] == p["high"], p["v"]).otherwise(F.transform(p["v"], lambda v: F.floor((v - p["low"]) * 255 / (p["high"] - p["low"])).cast("int")))
    # the bounds are worked out once a picture, not once a pixel
    return bound(bound(pixels, lambda v: F.struct(v.alias("v"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))), spread)
