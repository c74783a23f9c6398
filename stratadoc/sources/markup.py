"""HTML pages as blocks, by expressions: headings, paragraphs, list items, table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(fragment: Column) -> Column:
    """A fragment without tags, entities resolved, blanks reduced."""
    out = F.regexp_replace(fragment, "<[^>]*>", " ")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


#: Tags that begin or end a block; a table is one block with all that is in it.
_BLOCK_TAG = r"(?i)</?(?:h[1-6]|p|li|table)\b[^>]*>"
_SKIPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def html_blocks(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, reading_order, block_type, text of the blocks that hold text; scripts, styles and comments are skipped.

    A page is cut at its block tags, and every stretch between two is text of a block: of the kind of
    the tag before it, or a paragraph behind a closing tag. Stretches inside a table, also a nested one,
    are one block, so no text is lost where tags are nested or not closed.
    """
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _SKIPPED, " ")
    cut = pages.select(F.col(key), body.alias("__body")).withColumns({"__tags": F.regexp_extract_all("__body", F.lit(_BLOCK_TAG), F.lit(0)), "__parts": F.split("__body", _BLOCK_TAG)})
    rows = cut.select(key, F.posexplode("__parts").alias("n", "part"), "__tags").withColumn("tag", F.lower(F.coalesce(F.get("__tags", F.col("n") - 1), F.lit(""))))
    opens = F.when(F.col("tag").startswith("<table"), 1).when(F.col("tag").startswith("</table"), -1).otherwise(0)
    here = Window.partitionBy(key).orderBy("n")
    rows = rows.drop("__tags").withColumn("depth", F.sum(opens).over(here))
    # a table's rows have the number of the row that opened it; others their own
    inside = (F.col("depth") > 0) & ~((F.col("depth") == 1) & F.col("tag").startswith("<table"))
    rows = rows.withColumn("unit", F.max(F.when(~inside, F.col("n"))).over(here))
    kind = F.when(F.col("depth") > 0, "table").when(F.col("tag").startswith("<h"), "heading").when(F.col("tag").startswith("<li"), "list_item").otherwise("paragraph")
    units = rows.withColumn("kind", kind).groupBy(key, "unit").agg(F.min_by("kind", "n").alias("block_type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]), " ").alias("fragment"))
    held = units.select(key, "unit", "block_type", plain(F.col("fragment")).alias("text")).where("text <> ''")
    return held.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("unit")) - 1).alias("reading_order"), "block_type", "text")
