"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a predicate over features of a text. Each rule's cost (seconds a row) and selectivity
(share of rows that it rejects) are measured on a Bernoulli sample; the cascade then runs the rules
by rejection per cost, highest first, and stops at the first that rejects a row. The order decides
how much work is done, never the verdict: a row is kept if no rule rejects it.

Defined results: a null, empty or blank text has no words (all counts 0) and is rejected by
``too_short``. A rule that gives null doesn't reject. Repeated rows are judged one by one. An
empty table gives an empty table. Very long texts are judged whole, as any other. Columns of the
input stay; a feature column is added under the name asked for and replaces an input column of that
name. Repeated windows are found by hash and told by their words.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CHAR, Scratch, let

Features = Callable[[str], Column]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")


def _window_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, linear but for one sort.

    Each window is one long: its hash shifted left over its position, so that a sort of longs puts
    windows of one hash side by side with their places; such neighbours are compared by their words.
    Where they differ (a collision), the text's windows are sorted by their words instead.
    """
    covered = lambda starts: let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))).cast("long"))
    places = lambda w: F.sequence(F.lit(0), F.size(w) - 3)

    def beside(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
        """The rows that are the same as the one before or behind."""
        like = lambda x, k: F.coalesce(same(x, F.get(rows, k)), F.lit(False))
        return F.filter(rows, lambda x, k: like(x, k - 1) | like(x, k + 1))

    def by_words(w: Column) -> Column:
        windows = F.transform(places(w), lambda i: F.struct(F.concat_ws("\n", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))
        return covered(let(F.sort_array(windows), lambda rows: F.transform(beside(rows, lambda x, y: x["t"] == y["t"]), lambda x: x["i"])))

    def by_hashes(w: Column, hashes: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        place = lambda x: x.bitwiseAND(mask).cast("int")
        near = lambda x, y: F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)

        def same(x: Column, y: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.get(w, place(x) + d) == F.get(w, place(y) + d) for d in range(3)))

        keys = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))
        # rows of one hash beside each other that differ in words are a collision: then no hash of the text is trusted
        apart = lambda rows: F.filter(rows, lambda x, k: F.coalesce(near(x, F.get(rows, k + 1)) & ~same(x, F.get(rows, k + 1)), F.lit(False)))
        return let(let(keys, lambda rows: beside(rows, near)), lambda rows: F.when(F.size(apart(rows)) == 0, covered(F.transform(rows, place))).otherwise(by_words(w)))

    def with_hashes(w: Column) -> Column:
        bits = F.greatest(F.ceil(F.log2(F.size(w).cast("double"))), F.lit(1)).cast("int")
        repeats = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(bits, lambda b: by_hashes(w, h, b)))
        return let(F.transform(places(w), lambda i: _window_hash(w, i)), repeats)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(with_hashes(w)))


def _count(text: Column, kept: str) -> Column:
    """Characters of the class ``kept``."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kept}]+", "")).cast("long")


def feature(name: str, text: Column, words: Column) -> Column:
    """A feature as an expression over a text and its words."""
    if name == "n_words":
        return F.size(words).cast("long")
    if name == "word_chars":
        return F.length(F.array_join(words, "")).cast("long")
    if name == "n_symbols":
        return _count(text, "#*$%&|<>")
    if name == "n_dup_lines":
        lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_CHAR))
        return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    if name == "n_lines":
        return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD_CHAR))).cast("long")
    if name == "n_repeat_words":
        return _repeat_words(words)
    if name == "n_shouts":
        return _count(text, "!")
    raise ValueError(f"unknown feature {name}")


@dataclass(frozen=True)
class Rule:
    """rejects() gets a resolver from feature names to columns and returns a boolean column."""

    name: str
    rejects: Callable[[Features], Column]


#: The rules that the digest columns of the query name.
BASE_RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda f: f("n_words") < 50),
    Rule("repeated_windows", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
)
#: Rules on symbol noise, shouting, repeated lines and the length of words.
SHAPE_RULES: tuple[Rule, ...] = (
    Rule("symbol_noise", lambda f: 100 * f("n_symbols") > 20 * f("n_words")),
    Rule("shouting", lambda f: 100 * f("n_shouts") > 20 * f("n_words")),
    Rule("repeated_lines", lambda f: 100 * f("n_dup_lines") > 50 * f("n_lines")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
)
RULES: tuple[Rule, ...] = BASE_RULES + SHAPE_RULES


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds_a_row: float
    rejects_share: float

    @property
    def value(self) -> float:
        return self.rejects_share / max(self.seconds_a_row, 1e-12)


class Cascade:
    """Rules in the order of rejection per cost, as measured on a sample of at most about sample_rows rows."""

    def __init__(self, rules: Sequence[Rule] = RULES, *, sample_rows: int = 2000, seed: int = 7) -> None:
        self.rules, self.sample_rows, self.seed = list(rules), sample_rows, seed
        self.measured: list[Measured] = []

    @staticmethod
    def _resolver(text: Column, words: Column, ready: set[str]) -> Features:
        return lambda name: F.col(name) if name in ready else feature(name, text, words)

    def fit(self, df: DataFrame, text: str = "text", ready: Sequence[str] = ()) -> Cascade:
        """Measure every rule on a Bernoulli sample; features in ready will be columns when rules are judged, and cost a rule nothing."""
        rows = df.count()
        sample = df.select(text)
        if rows > self.sample_rows:
            sample = sample.sample(withReplacement=False, fraction=self.sample_rows / rows, seed=self.seed)
        scratch = Scratch(df.sparkSession, "cascade")
        sample = scratch.table(with_features(sample.coalesce(8), ready, text), "sample")
        words = _words(F.col(text))
        f = self._resolver(F.col(text), words, set(ready))

        def timed(*columns: Column) -> tuple[float, list]:
            began = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)), *columns).first()
            return time.perf_counter() - began, list(row)

        timed(F.max(F.length(text)))  # warms up the reader
        floor, row = timed(F.max(F.length(text)))
        n = max(row[0], 1)
        self.measured = []
        for rule in self.rules:
            took, (_, rejected) = timed(F.count_if(rule.rejects(f)))
            self.measured.append(Measured(rule, max(took - floor, 1e-4) / n, (rejected or 0) / n))
        self.measured.sort(key=lambda m: (-m.value, m.rule.name))
        scratch.drop(sample)
        return self

    def verdict(self, text: Column, words: Column, ready: Sequence[str] = ()) -> Column:
        """True where no rule rejects. Chained CASE branches: a later rule isn't evaluated once one has rejected."""
        f = self._resolver(text, words, set(ready))
        ordered = [m.rule for m in self.measured] or self.rules
        return reduce(lambda later, rule: F.when(rule.rejects(f), F.lit(False)).otherwise(later), reversed(ordered), F.lit(True))

    def judge(self, df: DataFrame, text: str = "text", kept: str = "kept", ready: Sequence[str] = ()) -> DataFrame:
        """df with a boolean column."""
        # the words are bound inside the expression, so a filter on the verdict that is pushed down splits them once too
        return df.withColumn(kept, let(_words(F.col(text)), lambda words: self.verdict(F.col(text), words, ready)))


def with_features(df: DataFrame, names: Sequence[str], text: str = "text") -> DataFrame:
    """df with feature columns; the words are split once."""
    if not names:
        return df
    held = df.withColumn("__words", _words(F.col(text)))
    return held.withColumns({n: feature(n, F.col(text), F.col("__words")) for n in names}).drop("__words")
