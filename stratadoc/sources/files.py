"""Files as rows: folder scans on any file system, digests, the registry of parsers by extension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import office

#: Parser by extension: it gets rows of path and content and returns rows of its own kind.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {".xlsx": office.xlsx_cells, ".docx": office.docx_items}


def register(extension: str, parser: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[extension.lower()] = parser


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def scan(spark: SparkSession, folder: str, *, only_supported: bool = True) -> DataFrame:
    """path, name, size, sha256, extension, content of the files directly inside a folder, by name."""
    held = described(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder))
    return (held.where("supported") if only_supported else held).drop("supported").orderBy("name")


def described(files: DataFrame) -> DataFrame:
    """Files (path, length, content) with name, size, sha256, extension, and whether there is a parser for them."""
    kind = extension(F.col("path"))
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("extension"), kind.isin(*PARSERS).alias("supported"), "content")


def parse(files: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of file; an unknown extension raises."""
    if kind.lower() not in PARSERS:
        raise ValueError(f"no parser for {kind}")
    return PARSERS[kind.lower()](files.where(F.col("extension") == kind.lower()))


def union_tenants(parts: list[tuple[str, list[str], DataFrame]]) -> DataFrame:
    """One frame of the chunks of several tenants; a tenant without groups raises before anything runs."""
    from ..operators.chunking import normalized_groups, stamped

    for tenant, groups, _ in parts:
        if not tenant:
            raise ValueError("a tenant needs an id")
        normalized_groups(groups)
    return reduce(DataFrame.unionByName, (stamped(df, tenant, groups) for tenant, groups, df in parts))
