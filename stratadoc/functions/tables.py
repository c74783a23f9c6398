"""Tables as arrays of rows of strings: padding, Markdown, reading text, long form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def padded(rows: Column) -> Column:
    """Every row trimmed cell by cell and filled up with empty cells; null where there are no columns."""
    n = width(rows)
    cell = lambda r, i: strip(F.coalesce(F.get(r, i), F.lit("")))
    return bound(n, lambda n: F.when(n > 0, F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), n - 1), lambda i: cell(r, i)))))


def markdown(rows: Column, header_rows: int = 1) -> Column:
    """Pipe table of padded rows; pipes are escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width(rows)), " | "), F.lit(" |"))
    head = F.array(line(F.get(rows, F.lit(0))), rule) if header_rows >= 1 else F.array(line(F.get(rows, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(head, F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")


def reading_text(rows: Column, caption: Column) -> Column:
    """Caption, then each data row as header: value pairs; Markdown or the caption where that is empty."""

    def told(rows: Column) -> Column:
        head = F.get(rows, F.lit(0))
        pairs = lambda r: F.filter(F.transform(r, lambda v, i: F.when(strip(v) != "", strip(F.concat(F.get(head, i), F.lit(": "), v)))), lambda x: x.isNotNull())
        lines = F.filter(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(pairs(r), " | ")), lambda x: x != "")
        named = F.filter(F.array(caption), lambda c: c.isNotNull() & (c != ""))
        return bound(F.concat(named, lines), lambda every: F.when(F.size(every) > 0, F.array_join(every, "\n")).otherwise(F.coalesce(markdown(rows), caption, F.lit(""))))

    # rows may be an expression of its own, which every cell would work out again
    return bound(rows, told)


def cells(rows: Column, header_rows: int = 1) -> Column:
    """array<struct<row_index, col_index, text, is_header>>"""
    return F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda c, j: F.struct(i.alias("row_index"), j.alias("col_index"), c.alias("text"), (i < header_rows).alias("is_header")))))
