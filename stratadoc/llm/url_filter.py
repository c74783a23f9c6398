"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule fits its host and all subdomains where the path starts as the rule's does; the longest that
fits decides. URLs that no rule fits are judged by trees trained on those that one does (or on labels
of the input): lengths, depth, digit ratio, entropy, parameter counts, and the statistics of suffixes:
of a host's last label, its last two, and its last one with the first segment of the path. Suffixes
are counted over all labelled URLs, in FOLDS by the URL's hash; a labelled URL gets the counts of the
other folds, so its own label isn't among its features. The trees are fitted on a Bernoulli sample of
at most about ``fit_rows`` labelled rows; features and scores are of every row.

Features are DataFrame expressions; trees are grown and scored in arrays.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is
judged by the trees like any other. Without labelled rows of both verdicts the method gives the
only verdict seen, or ``allow``. Repeated rows are judged one by one. Very long URLs are measured
whole. Columns of the input pass through, whatever their names, but for host, path, rule, verdict and
score, which are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Statistics of these: the last label of a host, the last two, the last one before the path's first segment.
SUFFIXES = ("suffix1", "suffix2", "suffix_path")
FOLDS = 5
LEXICAL = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "query_length", "has_fragment")
FEATURES = (*LEXICAL, *(f"{s}_{x}" for s in SUFFIXES for x in ("seen", "blocked")))


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    last = F.substring_index(host, ".", -1)
    return {"suffix1": last, "suffix2": F.substring_index(host, ".", -2), "suffix_path": F.concat(last, F.lit("/"), F.substring_index(F.substring(path, 2, 1 << 30), "/", 1))}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """LEXICAL of a URL, as doubles."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"^[^?]*\?([^#]*)", 1)

    def bits(chars: Column) -> Column:
        share = lambda c: (F.length(url) - F.length(F.replace(url, c))) / n
        return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))

    values = [
        F.length(url), F.length(host), F.length(path), count(host, "."), count(path, "/"), F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
        bits(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))), count(query, "="), F.length(query), (F.instr(url, "#") > 0).cast("int"),
    ]
    return {name: v.cast("double") for name, v in zip(LEXICAL, values)}


@dataclass
class BoostedTrees:
    """Trees of depth ``depth`` for the logistic loss, grown on histograms of ``bins`` quantile bins."""

    n_trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    least: int = 20
    l2: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """y: 0 or 1."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.trees = math.log(share / (1 - share)), []
        if y.min(initial=0) == y.max(initial=0) or len(y) == 0 or y.min() == 1:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree, value = self._grow(coded, cuts, g, h)
            self.trees.append(tree)
            score += value
        return self

    def _grow(self, coded, cuts, g, h):
        """Arrays by heap position: feature (-1: leaf), cut, value; and each row's value."""
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.ones(len(g), int)
        for at in range(1, size):
            mine = np.flatnonzero(node == at)
            if not len(mine):
                continue
            total_g, total_h = g[mine].sum(), h[mine].sum()
            value[at] = self.rate * total_g / (total_h + self.l2)
            if at >= size // 2 or len(mine) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                code = coded[mine, j]
                left_g, left_h, n = (np.cumsum(np.bincount(code, w, len(c) + 1))[:-1] for w in (g[mine], h[mine], np.ones(len(mine))))
                gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                gain[(n < self.least) | (len(mine) - n < self.least)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[at], cut[at] = best[1], cuts[best[1]][best[2]]
                node[mine] = 2 * at + (coded[mine, best[1]] > best[2])
        return (feature, cut, value), value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


class UrlFilter:
    """block or allow for each URL; positive: the verdict that the trees score."""

    def __init__(self, rules: Sequence[UrlRule], *, fit_rows: int = 20_000, seed: int = 3, positive: str = "block", negative: str = "allow") -> None:
        self.rules, self.fit_rows, self.seed, self.positive, self.negative = list(rules), fit_rows, seed, positive, negative
        self.trees: BoostedTrees | None = None

    def parsed(self, df: DataFrame, url: str = "url", label: str | None = None) -> DataFrame:
        """row (the input's columns), url, host, path, fit (the rule and its verdict), label (the rule's verdict, or else the column label's), fold, s (suffixes), x (lexical features)."""
        own = F.col(label).cast("string") if label else F.lit(None).cast("string")
        held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(url).alias("url"), own.alias("own"))
        held = held.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        held = held.withColumn("fit", fitting(F.col("host"), F.col("path"), self.rules))
        s = F.struct(*(c.alias(n) for n, c in suffixes(F.col("host"), F.col("path")).items()))
        x = F.array(*lexical(F.col("url"), F.col("host"), F.col("path")).values())
        fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
        return held.select("row", "url", "host", "path", "fit", F.coalesce("fit.verdict", "own").alias("label"), fold.alias("fold"), s.alias("s"), x.alias("x"))

    def featured(self, parsed: DataFrame, scratch: Scratch) -> DataFrame:
        """parsed with x of all FEATURES; tables of suffixes are joined as Spark sees fit by their size."""
        out = parsed.withColumns({f"s_{k}": F.col(f"s.{k}") for k in SUFFIXES}).drop("s")
        per_fold = lambda value: F.array(*(F.sum(F.when(F.col("fold") == i, value).otherwise(0.0)) for i in range(FOLDS)))
        stats: list[Column] = []
        for k in SUFFIXES:
            blocked = F.when(F.col("label") == self.positive, 1.0).otherwise(0.0)
            counted = parsed.where("label is not null").groupBy(F.col(f"s.{k}").alias(f"at_{k}")).agg(per_fold(F.lit(1.0)).alias(f"seen_{k}"), per_fold(blocked).alias(f"blocked_{k}"))
            out = out.join(scratch.table(counted, k), F.col(f"s_{k}") == F.col(f"at_{k}"), "left")
            total = lambda name: F.coalesce(F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v) - F.when(F.col("label").isNotNull(), F.get(name, F.col("fold"))).otherwise(0.0), F.lit(0.0))
            seen, positive = total(f"seen_{k}"), total(f"blocked_{k}")
            stats += [F.log1p(seen), (positive + 1) / (seen + 2)]
        return out.select("row", "url", "host", "path", "fit", "label", F.concat("x", F.array(*stats)).alias("x"))

    def fit(self, featured: DataFrame) -> BoostedTrees:
        """Trees of the labelled rows of featured."""
        labelled = featured.where("label is not null").select("url", "label", "x")
        n = labelled.count()
        sample = labelled if n <= self.fit_rows else labelled.sample(fraction=self.fit_rows / n, seed=self.seed)
        table = sample.orderBy("url").toArrow()
        y = np.array([v == self.positive for v in table.column("label").to_pylist()], float)
        return BoostedTrees().fit(_matrix(table.column("x")), y) if n else BoostedTrees(base=-1.0)

    def judge(self, df: DataFrame, url: str = "url", label: str | None = None) -> DataFrame:
        """The columns of df, host, path, rule, verdict, score (log odds of the trees)."""
        scratch = Scratch(df.sparkSession, "urls")
        parsed = scratch.table(self.parsed(df, url, label), "parsed")
        featured = scratch.table(self.featured(parsed, scratch), "featured")
        trees = self.trees = self.fit(featured)
        positive, negative = self.positive, self.negative

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = trees.score(_matrix(batch.column("x")))
                verdict = [v or (positive if s > 0 else negative) for v, s in zip(batch.column("verdict").to_pylist(), score.tolist())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score)], kind.names)

        kept = featured.select("row", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "x")
        kind = T.StructType([kept.schema[c] for c in ("row", "host", "path", "rule", "verdict")] + [T.StructField("score", T.DoubleType())])
        names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
        return kept.mapInArrow(run, kind).select(*(F.col(f"row.`{c}`") for c in names), "host", "path", "rule", "verdict", "score")


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of FEATURES as rows."""
    flat = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
