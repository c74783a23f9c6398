"""Evaluation: error rates, accuracies, durations, recall of retrieval, leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_for_evaluation, split_words


def cer(hypothesis: Column, truth: Column, *, compose: bool = True) -> Column:
    """Edits of code points over the truth's length; null without a truth."""
    h, t = (normalize_for_evaluation(c, compose=compose) for c in (hypothesis, truth))
    return F.when(truth.isNotNull() & (F.length(t) > 0), F.levenshtein(h, t) / F.length(t))


#: Code points beyond the basic plane, where no surrogates are.
_MOST_WORDS = 0x110000 - 0x10000


def wer(hypothesis: Column, truth: Column, *, compose: bool = True) -> Column:
    """Edits of words over the truth's words; words are coded as single characters, so that the JVM's edit distance counts them."""
    h, t = (split_words(normalize_for_evaluation(c, compose=compose)) for c in (hypothesis, truth))

    def coded(words: Column, known: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")

    def edits(s: Column) -> Column:
        many = F.raise_error(F.concat(F.lit(f"more than {_MOST_WORDS} distinct words: "), F.size(s["k"]).cast("string"))).cast("int")
        return F.when(F.size(s["k"]) > _MOST_WORDS, many).otherwise(F.levenshtein(coded(s["h"], s["k"]), coded(s["t"], s["k"])))

    both = F.transform(F.array(F.struct(h.alias("h"), t.alias("t"), F.array_union(h, t).alias("k"))), lambda s: edits(s) / F.size(s["t"]))
    return F.when(truth.isNotNull() & (F.size(t) > 0), F.get(both, F.lit(0)))


def accuracy(actual: str, expected: str) -> Column:
    """Share of equal labels; null for none."""
    return F.avg((F.col(actual) == F.col(expected)).cast("double"))


def rate(part: Column, total: Column) -> Column:
    """A share of counts; null for a total of 0; counts that can't be raise."""
    bad = (part < 0) | (total < 0) | (part > total)
    return F.when(bad, F.raise_error(F.lit("counts must satisfy 0 <= part <= total")).cast("double")).otherwise(F.try_divide(part.cast("double"), total))


def durations(df: DataFrame, duration: str, *by: str) -> DataFrame:
    """Number, total, mean, median and maximum; a negative duration raises."""
    held = F.when(F.col(duration) < 0, F.raise_error(F.lit("durations must not be negative")).cast("double")).otherwise(F.col(duration).cast("double"))
    held = df.select(*by, held.alias("d"))
    return held.groupBy(*by).agg(F.count("d").alias("count"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("total_ms"), F.avg("d").alias("mean_ms"), F.median("d").alias("median_ms"), F.max("d").alias("maximum_ms"))


def recall(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), key: str = "chunk_id") -> DataFrame:
    """recall_at_k: the share of questions (question_id) with one of their true ids among the first k hits (rank)."""
    right = hits.join(truth.select("question_id", key).distinct(), ["question_id", key], "left_semi").groupBy("question_id").agg(F.min("rank").alias("first"))
    each = truth.select("question_id").distinct().join(right, "question_id", "left")
    return each.agg(F.count(F.lit(1)).alias("questions"), *(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in ks))
