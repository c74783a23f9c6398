"""Text quality: metrics, scores, verdicts of blocks, pages and documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank, ocr_normalized

# Characters that count as garbage, besides control, surrogate and private-use ones.
GARBAGE_TEXT = "�□■◆●▪▫"
GARBAGE_CANDIDATE = "�□■◆"
#: Verdicts from the worst to the best.
LEVELS = ("failed", "needs_review", "accepted_with_warning", "accepted")


@dataclass(frozen=True)
class Bands:
    """The least score of each verdict but failed."""

    accepted: float = 90.0
    accepted_with_warning: float = 70.0
    needs_review: float = 40.0


@dataclass(frozen=True)
class TextWeights:
    """What each signal weighs, the garbage characters, and the length that is long enough."""

    meaningful: float = 0.45
    clean: float = 0.25
    varied: float = 0.15
    length: float = 0.15
    full_length: int = 200
    garbage: str = GARBAGE_TEXT


def half_up(value: Column, digits: int) -> Column:
    """Rounded, halves up also where the binary value lies just below one."""
    return F.round(value + 1e-9, digits)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


_WORDS = re.compile(r"\w+")
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_ASCII_SPACE = bytes(c for c in range(128) if chr(c).isspace())
_ASCII_CONTROL = bytes(c for c in range(128) if unicodedata.category(chr(c)) == "Cc" and not chr(c).isspace())
_IS_SPACE, _IS_ALNUM, _IS_CONTROL = 1, 2, 4


def _kind(char: str) -> int:
    return _IS_SPACE * char.isspace() | _IS_ALNUM * char.isalnum() | _IS_CONTROL * (unicodedata.category(char) in ("Cc", "Cs", "Co"))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kinds of the characters of the basic plane."""
    return np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)


def characters(text: str, garbage: str) -> tuple[int, int, int]:
    """Characters but for white space, and of these letters or digits, and garbage."""
    if text.isascii():
        raw = text.encode()
        less = lambda kind: len(raw) - len(raw.translate(None, kind))
        return len(raw) - less(_ASCII_SPACE), less(_ALNUM), less(_ASCII_CONTROL)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    wide = codes > 0xFFFF
    for code in np.unique(codes[wide]).tolist():
        kinds[codes == code] = _kind(chr(code))
    solid = kinds & _IS_SPACE == 0
    return int(solid.sum()), int((kinds & _IS_ALNUM > 0).sum()), int((solid & (kinds & _IS_CONTROL > 0)).sum()) + sum(text.count(c) for c in garbage)


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("meaningful", T.IntegerType())]))
def solid_counts(texts: pd.Series) -> pd.DataFrame:
    """Characters of a text as it is but for white space, and of these letters or digits."""
    return pd.DataFrame([characters(t or "", "")[:2] for t in texts], columns=["n", "meaningful"])


#: Bytes of Latin-1 with ASCII in lower case and a space for what is no word character.
_LATIN = bytes((ord(chr(c).lower()) if c < 128 else c) if _WORDS.match(chr(c)) else 32 for c in range(256))


def words_counted(text: str, garbage: str = "") -> tuple[int, int]:
    """Words and distinct ones, case folded; no garbage character is one of a word. What Latin-1 can say is cut as bytes."""
    if not text.isascii():
        for x in garbage:
            text = text.replace(x, " ")
    try:
        held = text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        words = _WORDS.findall(text)
        return len(words), len(set(map(str.casefold, set(words))))
    distinct = set(held)
    return len(held), len(distinct if text.isascii() else {x.decode("latin-1").casefold() for x in distinct})


def _counted(text: str | None, garbage: str) -> tuple[int, int, int, int, int, str]:
    text = ocr_normalized(text or "")
    return *characters(text, garbage), *words_counted(text, garbage), text


@lru_cache(8)
def text_counts(garbage: str = GARBAGE_TEXT, with_text: bool = False) -> Callable[[Column], Column]:
    """struct<n, meaningful, garbage, words, distinct> of a text, normalised, and that text if asked for.

    Composition, Unicode's word characters and case folding have no function in Spark; one pass over a
    batch in Python counts all five, at a tenth of the cost of a regular expression each in the JVM.
    """
    names = ["n", "meaningful", "garbage", "words", "distinct"] + ["text"] * with_text

    @F.pandas_udf("n int, meaningful int, garbage int, words int, distinct int" + ", text string" * with_text)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_counted(t, garbage)[: len(names)] for t in texts], columns=names)

    return run


def ratios(counts: Column) -> dict[str, Column]:
    """meaningful_ratio, garbage_ratio, repetition_ratio of counts, not rounded."""
    n, words = counts["n"], counts["words"]
    return {
        "meaningful_ratio": F.when(n == 0, 0.0).otherwise(counts["meaningful"] / n),
        "garbage_ratio": F.when(n == 0, 1.0).otherwise(counts["garbage"] / n),
        "repetition_ratio": F.when((n == 0) | (words == 0), 1.0).otherwise(1 - counts["distinct"] / words),
    }


def with_text_metrics(df: DataFrame, text: str = "text", *, garbage: str = GARBAGE_TEXT, prefix: str = "", counts: str | None = None, normalized: str | None = None) -> DataFrame:
    """df with meaningful_ratio, garbage_ratio, repetition_ratio (4 decimals), character_count, word_count; the counts and the normalised text if they get a name."""
    held = df.withColumn("__s", text_counts(garbage, normalized is not None)(F.col(text)))
    s = F.col("__s")
    out = {f"{prefix}{name}": half_up(value, 4) for name, value in ratios(s).items()}
    out |= {f"{prefix}character_count": s["n"], f"{prefix}word_count": F.when(s["n"] == 0, 0).otherwise(s["words"])}
    if counts:
        out[counts] = s
    if normalized:
        out[normalized] = s["text"]
    return held.withColumns(out).drop("__s")


def text_score(prefix: str = "", weights: TextWeights = TextWeights()) -> Column:
    """0 to 100 from the metrics' columns."""
    c = lambda name: F.col(prefix + name)
    length = F.least(c("character_count") / weights.full_length, F.lit(1.0))
    score = 100 * (c("meaningful_ratio") * weights.meaningful + (1 - c("garbage_ratio")) * weights.clean + (1 - c("repetition_ratio")) * weights.varied + length * weights.length)
    return F.when(c("character_count") == 0, 0.0).otherwise(half_up(clamp(score), 2))


def with_text_score(df: DataFrame, text: str = "text") -> DataFrame:
    return with_text_metrics(df, text).withColumn("text_score", text_score())


def level(score: Column, bands: Bands = Bands()) -> Column:
    return F.when(score >= bands.accepted, "accepted").when(score >= bands.accepted_with_warning, "accepted_with_warning").when(score >= bands.needs_review, "needs_review").otherwise("failed")


def rank(level_: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level_)


def worst(first: Column, second: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(rank(first), rank(second)).cast("int"))


def status_ceiling(status: Column) -> Column:
    """The best verdict that a processing status allows."""
    return F.when(status == "accepted", "accepted").when(status == "needs_review", "needs_review").otherwise("failed")


def status_of(level_: Column) -> Column:
    return F.when(level_.isin("accepted", "accepted_with_warning"), "accepted").when(level_ == "needs_review", "needs_review").otherwise("failed")


def block_quality(blocks: DataFrame) -> DataFrame:
    """blocks (text, quality_score) with score, level, warnings."""
    held = with_text_score(blocks)
    score = F.coalesce(F.col("quality_score"), F.col("text_score"))
    warnings = F.array(F.when(F.col("garbage_ratio") > 0.1, "high_garbage_ratio"), F.when(F.col("repetition_ratio") > 0.8, "high_repetition_ratio"))
    return held.withColumns({"score": half_up(score, 2), "level": level(score), "warnings": F.filter(warnings, lambda w: w.isNotNull())})


def page_quality(pages: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Pages with is_empty, score, level, status and warnings.

    Read: index_text, native_text, ocr_text, page_type, processing_status, decision_quality,
    decision_agreement, selected_route, gate_passed, n_fallbacks.
    """
    held = with_text_score(pages, "index_text")
    empty = blank(F.col("index_text")) | (F.col("page_type") == "empty")
    mixed = F.when(F.col("decision_quality").isNotNull(), 0.6 * F.col("text_score") + 0.4 * F.col("decision_quality")).otherwise(F.col("text_score"))
    both = ~blank(F.col("native_text")) & ~blank(F.col("ocr_text")) & F.col("decision_agreement").isNotNull()
    scored = half_up(clamp(F.when(both, 0.85 * mixed + 0.15 * F.col("decision_agreement")).otherwise(mixed)), 2)
    rejected = (F.col("selected_route") == "rejected") & ~empty
    score = F.when(empty, 0.0).when(rejected, F.least(scored, F.lit(bands.needs_review - 0.01))).otherwise(scored)
    warnings = F.array(F.when(rejected, "extraction_route_rejected"), F.when(F.col("n_fallbacks") > 0, "fallback_route_used"), F.when(~F.col("gate_passed"), "quality_gate_not_passed"))
    held = held.withColumns({"is_empty": empty, "score": score, "warnings": F.filter(warnings, lambda w: w.isNotNull())})
    held = held.withColumn("level", worst(level(F.col("score"), bands), status_ceiling(F.col("processing_status"))))
    return held.withColumn("status", status_of(F.col("level")))


def document_quality(pages: DataFrame, keys: Sequence[str] = ("document_id",), documents: DataFrame | None = None) -> DataFrame:
    """Counts by status, mean score, verdict and warnings of each document; those of documents without a page are failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pages"), n("accepted").alias("accepted_pages"), n("needs_review").alias("needs_review_pages"), n("failed").alias("failed_pages"),
        F.count_if("is_empty").alias("empty_pages"), half_up(F.avg("score"), 2).alias("score"),
    )
    if documents is not None:
        out = documents.select(*keys).distinct().join(out, list(keys), "left").fillna(0, ["total_pages", "accepted_pages", "needs_review_pages", "failed_pages", "empty_pages", "score"])
    verdict = level(F.col("score"))
    verdict = F.when(F.col("total_pages") == 0, "failed").when(F.col("accepted_pages") == 0, worst(verdict, F.lit("needs_review"))).otherwise(verdict)
    told = F.array(
        F.when(F.col("failed_pages") > 0, F.concat(F.col("failed_pages").cast("string"), F.lit("_failed_pages"))),
        F.when(F.col("needs_review_pages") > 0, F.concat(F.col("needs_review_pages").cast("string"), F.lit("_pages_need_review"))),
    )
    return out.withColumns({"level": verdict, "warnings": F.filter(told, lambda w: w.isNotNull())})
