"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget flows from the root down. At each node it is shared among the children by weight; a
child that can't use its share (its documents, repeated max_epochs times, are fewer) is capped and
its shortage goes to its siblings by weight. Only what all children together can't use stays with
the ancestor, which has already dealt it to the node's own siblings, because a node's capacity is
the sum of its leaves'. A leaf takes whole epochs and then the prefix of one more epoch, in an
order seeded by epoch, whose running token count stays within its budget.

The prefix is found in two steps: tokens are summed by hash bins of a leaf, and only the bin in
which the budget ends is ordered, so a leaf with a third of all rows is no single task.

Defined results: null lang or source are values of their own (shown as ''). A text without words
has 0 tokens and is taken wherever it stands in the prefix; a leaf without tokens is taken whole
once if its budget isn't negative. Very long texts are counted whole, as any other. Repeated rows are separate entries. An empty table gives an
empty table. Weights default to 1 for names that aren't listed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that name a bin: 4096 bins a leaf at least, more where all rows are more than so many a bin.
BIN_DIGITS, MOST_DIGITS, BIN_ROWS = 3, 6, 10_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), lambda w: w != "")).cast("long")


def share(nodes: DataFrame, parents: list[str], child: str, weight: Column) -> DataFrame:
    """nodes (parents, child, capacity, budget of the parent) with the child's budget in the parent's place.

    Children are ordered by capacity over weight; the capped ones come first, and the rest is shared by
    weight, rounded down.
    """
    own = nodes.withColumn("w", weight.cast("long"))
    order = Window.partitionBy(*parents, "budget").orderBy(F.col("capacity") / F.col("w"), child)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = own.withColumns({"spent": F.coalesce(F.sum("capacity").over(below), F.lit(0)), "w_left": F.sum("w").over(onward)})
    own = own.withColumn("capped", F.col("capacity") * F.col("w_left") <= (F.col("budget") - F.col("spent")) * F.col("w"))
    whole = Window.partitionBy(*parents, "budget")
    own = own.withColumns({"used": F.sum(F.when(F.col("capped"), F.col("capacity")).otherwise(0)).over(whole), "w_open": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)})
    given = F.when(F.col("capped"), F.col("capacity")).otherwise(F.expr("(budget - used) * w div w_open"))
    return own.withColumn("given", given).drop("budget").withColumnRenamed("given", "budget").select(*parents, child, "capacity", "budget")


def _weights(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], *, percent: int, max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget of each leaf; the root's budget is a percentage of all tokens."""
    leaves = leaves.withColumns({"capacity": F.col("tokens") * max_epochs, "root": F.lit(0)})
    level = leaves.groupBy("root").agg(F.least(F.expr(f"sum(tokens) * {percent} div 100"), F.sum("capacity")).alias("budget"))
    parents = ["root"]
    for child in LEVELS:
        nodes = leaves.groupBy(*parents, child).agg(F.sum("capacity").alias("capacity"))
        level = share(nodes.join(level.select(*parents, "budget"), parents), parents, child, _weights(child, weights.get(child, {})))
        parents.append(child)
    return leaves.join(level.select(*LEVELS, "budget"), list(LEVELS))


def select(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], *, percent: int = 50, max_epochs: int = 1, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of the rows of docs that are taken once or more."""
    scratch = Scratch(docs.sparkSession, "mix")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    count = tokens if tokens is not None else word_count(F.col("text"))
    slim = docs.select("doc_id", domain.alias("domain"), name("lang").alias("lang"), name("source").alias("source"), count.alias("n_tokens"))
    slim = scratch.table(slim.withColumn("domain", F.coalesce("domain", F.lit(""))), "slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    dealt = scratch.table(budgets(scratch.table(leaves, "leaves"), weights, percent=percent, max_epochs=max_epochs), "budgets")
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("budget div tokens"), F.lit(max_epochs))).otherwise(1)
    leaf = dealt.select(*LEVELS, whole.alias("epochs"), F.when(whole < max_epochs, F.col("budget") - whole * F.col("tokens")).otherwise(-1).alias("rest"))
    digits = max(BIN_DIGITS, min(MOST_DIGITS, math.ceil(math.log(max(slim.count() / BIN_ROWS, 1), 16))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    held = slim.join(leaf, list(LEVELS)).withColumn("key", key).withColumn("bin", F.substring("key", 1, digits))
    bins = held.where("rest >= 0").groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    bins = scratch.table(bins.withColumn("end", upto).select(*LEVELS, "bin", "end", (F.col("end") - F.col("k")).alias("begin")), "bins")
    placed = held.join(bins, [*LEVELS, "bin"], "left")
    sure = placed.where("rest < 0 or end <= rest or begin > rest").withColumn("more", F.coalesce(F.col("end") <= F.col("rest"), F.lit(False)) & (F.col("rest") >= 0))
    torn = placed.where("rest >= 0 and begin <= rest and end > rest")
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bin").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    torn = torn.withColumn("more", F.col("begin") + running <= F.col("rest"))
    columns = ["doc_id", *LEVELS, "n_tokens", (F.col("epochs") + F.col("more").cast("int")).cast("long").alias("copies")]
    return sure.select(columns).unionByName(torn.select(columns)).where("copies > 0")
