"""Extraction routing: extractors as stages, each for what the ones before left insufficient."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """What an extraction is told; access groups are checked by those who index."""

    tenant_id: str
    acl_groups: tuple[str, ...] = ()
    languages: str = "fas+eng"


class Unavailable(Exception):
    """The engine of an extractor isn't there."""


class Failed(Exception):
    """An extractor couldn't read a document set; kind says why, without a path."""

    kind = "failed"


class Encrypted(Failed):
    kind = "encrypted"


class Unreadable(Failed):
    kind = "unreadable"


class InvalidPages(Failed):
    kind = "invalid_page_range"


class TimedOut(Failed):
    kind = "timed_out"


class Extractor(ABC):
    """A pluggable engine: documents to attempts (document_id, outcome, accepted_pages, needs_review_pages, score)."""

    name: str
    extensions: frozenset[str] = frozenset()

    @abstractmethod
    def extract(self, documents: DataFrame, options: Options) -> DataFrame: ...


class Wrapped(Extractor):
    """An engine that is loaded when it is first used: what it raises becomes an outcome, and is never told with a path.

    make loads it (ImportError: it isn't there) and gives a function from documents and options to attempts;
    errors names what its own exceptions mean.
    """

    def __init__(self, name: str, extensions: frozenset[str], make: Callable[[], Callable[[DataFrame, Options], DataFrame]], errors: Mapping[type[Exception], type[Exception]] | None = None) -> None:
        self.name, self.extensions, self._make, self._errors = name, extensions, make, dict(errors or {})

    def extract(self, documents: DataFrame, options: Options) -> DataFrame:
        try:
            run = self._make()
        except ImportError as error:
            raise Unavailable(f"{self.name} isn't installed") from error
        try:
            return run(documents, options)
        except (Unavailable, Failed):
            raise
        except Exception as error:
            kind = next((to for of, to in self._errors.items() if isinstance(error, of)), Failed)
            raise kind(f"{self.name} could not read the documents") from error


class PageRenderer(ABC):
    """A pluggable engine: documents and a resolution to images (document_id, page_index, content, page_width, page_height)."""

    @abstractmethod
    def render(self, documents: DataFrame, dpi: int) -> DataFrame: ...


def sufficient() -> Column:
    return (F.col("outcome") == "ok") & ((F.col("accepted_pages") > 0) | (F.col("needs_review_pages") > 0))


def staged(documents: DataFrame, extractors: Sequence[Extractor], options: Options) -> DataFrame:
    """Attempts of all stages: an extractor gets the documents that no earlier one extracted sufficiently."""
    attempts: DataFrame | None = None
    left = documents
    for number, extractor in enumerate(extractors):
        mine = left.where(F.col("extension").isin(*extractor.extensions)) if extractor.extensions else left
        try:
            got = extractor.extract(mine, options).select("document_id", "outcome", "accepted_pages", "needs_review_pages", "score")
        except (Unavailable, Failed) as error:
            outcome = "unavailable" if isinstance(error, Unavailable) else "failed"
            got = mine.select("document_id", F.lit(outcome).alias("outcome"), F.lit(0).alias("accepted_pages"), F.lit(0).alias("needs_review_pages"), F.lit(None).cast("double").alias("score"))
        got = got.withColumns({"attempt": F.lit(number), "extractor": F.lit(extractor.name)})
        attempts = got if attempts is None else attempts.unionByName(got)
        left = left.join(got.where(sufficient()), "document_id", "left_anti")
    if attempts is None:
        raise ValueError("there is no extractor")
    return attempts


def chosen(attempts: DataFrame) -> DataFrame:
    """document_id, extractor, outcome, warnings: the first sufficient attempt, else the best that extracted anything.

    The best has most accepted pages, then the highest score, then comes first. Documents without any
    extraction have no extractor.
    """
    first = F.min_by(F.col("extractor"), F.when(sufficient(), F.col("attempt")))
    ok = F.col("outcome") == "ok"
    best = F.max_by(F.col("extractor"), F.when(ok, F.struct("accepted_pages", "score", -F.col("attempt"))))
    told = F.when(F.col("outcome") == "ok", F.when(~sufficient(), F.concat("extractor", F.lit("_insufficient_output")))).otherwise(F.concat("extractor", F.lit("_"), "outcome"))
    held = attempts.groupBy("document_id").agg(
        first.alias("good"), best.alias("best"), F.min(F.when(sufficient(), F.col("attempt"))).alias("until"),
        F.sort_array(F.collect_list(F.when(told.isNotNull(), F.struct("attempt", told.alias("w"))))).alias("told"),
    )
    warnings = F.transform(F.filter("told", lambda t: F.col("until").isNull() | (t["attempt"] < F.col("until"))), lambda t: t["w"])
    outcome = F.when(F.col("good").isNotNull(), "ok").when(F.col("best").isNotNull(), "best_effort").otherwise("failed")
    extra = F.when(outcome == "best_effort", F.array(F.lit("all_routes_insufficient"))).otherwise(F.array().cast("array<string>"))
    return held.select("document_id", F.coalesce("good", "best").alias("extractor"), outcome.alias("outcome"), F.concat(warnings, extra).alias("warnings"))
