"""Chunking: sliding windows, articles, structural groups of blocks, page-sized chunks. Words are split and joined in one pass over Arrow batches, the rest is expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import SPACE, blank, language, normalize_for_comparison, strip

#: Windows of at most so many characters are left out.
LEAST_CHARS = 50
OVERLAP = 64


def windows(text: str | None, size: int, overlap: int) -> list[str]:
    """What split_fixed gives, in Python."""
    words = (text or "").split()
    held = (" ".join(words[i : i + size]) for i in range(0, len(words), size - overlap))
    return [x for x in held if len(x) > LEAST_CHARS]


@lru_cache(16)
def _windows(size: int, overlap: int) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([windows(x, size, overlap) for x in texts.to_pylist()], pa.list_(pa.string()))

    return run


def split_fixed(text: Column, size: int = 512, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` words that start every size - overlap words, joined by spaces; short ones are left out."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    return _windows(size, overlap)(text)


def fixed_chunks(df: DataFrame, text: str = "text", size: int = 512, overlap: int = OVERLAP) -> DataFrame:
    """One row a window, with chunk_index and chunk_text."""
    return df.select(*df.columns, F.posexplode(split_fixed(F.col(text), size, overlap)).alias("chunk_index", "chunk_text"))


def native_page_chunks(pages: DataFrame, language_: str, *, start: int = 0, end: int | None = None, page: str = "page_index") -> DataFrame:
    """Fixed windows page by page (source, page_index from 0, text) in a range whose end is excluded; ids by source, page and window, the language as it is told."""
    inside = F.col(page) >= start if end is None else (F.col(page) >= start) & (F.col(page) < end)
    held = fixed_chunks(pages.where(inside))
    return held.select(
        F.concat_ws("", "source", F.lit("-"), F.col(page).cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit(language_).alias("lang"), F.lit("pdf").alias("source_type"), "source",
        F.struct(F.lit("page").alias("type"), F.col(page).alias("num")).alias("location"), F.col("chunk_text").alias("text"),
    )


def split_articles(text: Column, mark: str = "ماده") -> Column:
    """Articles from one heading (a line of the mark and digits of any script) to the next, as they stand; what is before the first goes, and none gives no rows."""
    head = rf"\n{SPACE}*{mark}\p{{Nd}}+"
    return F.regexp_extract_all(text, F.lit(rf"(?s)({head}.*?)(?={head}|\z)"), F.lit(1))


_PIECES = "array<struct<text:string,kind:string,blocks:array<string>>>"
_PIECE = pa.struct([("text", pa.string()), ("kind", pa.string()), ("blocks", pa.list_(pa.string()))])


def grouped(blocks: Iterable[tuple[str, str | None, str | None]], max_words: int, overlap: int) -> Iterator[tuple[str, str, list[str]]]:
    """What structural gives, in Python: text, kind, block ids. A text that is null counts as none."""
    parts: list[str] = []
    held: list[str] = []
    words = 0
    for name, kind, text in blocks:
        n = len((text or "").split())
        if kind == "table" or n > max_words:
            yield "\n\n".join(parts).strip(), "text", held
            parts, held, words = [], [], 0
            alone = [text or ""] if n <= max_words else windows(text, max_words, overlap)
            yield from ((x.strip(), "table" if kind == "table" else "text", [name]) for x in alone)
            continue
        if (kind == "heading" and held) or (words > 0 and words + n > max_words):
            yield "\n\n".join(parts).strip(), "text", held
            parts, held, words = [], [], 0
        if text is not None:
            parts.append(text)
        held.append(name)
        words += n
    yield "\n\n".join(parts).strip(), "text", held


@lru_cache(16)
def _grouped(max_words: int, overlap: int) -> Callable[[Column], Column]:
    @F.arrow_udf(_PIECES)
    def run(rows: pa.Array) -> pa.Array:
        flat = rows.flatten()
        named = dict(zip((f.name for f in flat.type), flat.flatten()))
        blocks = zip(*(named[x].to_pylist() for x in ("block_id", "block_type", "text")))
        ends, texts, kinds, own = [0], [], [], []
        for n in rows.value_lengths().fill_null(0).to_pylist():
            for text, kind, ids_ in grouped(islice(blocks, n), max_words, overlap):
                if text:
                    texts.append(text)
                    kinds.append(kind)
                    own.append(ids_)
            ends.append(len(texts))
        pieces = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((texts, kinds, own), _PIECE)], fields=list(_PIECE))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)

    return run


def structural(blocks: Column, max_words: int = 512, overlap: int = OVERLAP) -> Column:
    """array<struct<text, kind, blocks>> of array<struct<block_id, block_type, text>> in reading order.

    Paragraphs are grouped up to a budget of words. A heading closes an open group, a table stands
    alone, a block over the budget is split alone. One pass over the blocks with the open group as state.
    """
    return _grouped(max_words, min(overlap, max_words - 1))(blocks)


def page_chunks(pages: DataFrame, max_words: int = 512) -> DataFrame:
    """Chunks of pages (page_id, index_text, blocks): structural, or fixed windows of the text where there are no blocks."""
    there = F.coalesce(F.size("blocks"), F.lit(0)) > 0  # what the other way takes is null, and makes nothing
    plain = F.transform(split_fixed(F.when(~there, F.col("index_text"))), lambda t: F.struct(strip(t).alias("text"), F.lit("text").alias("kind"), F.array().cast("array<string>").alias("blocks")))
    pieces = F.concat(structural(F.when(there, F.col("blocks")), max_words), plain)
    out = pages.select(*[c for c in pages.columns if c != "blocks"], F.posexplode(pieces).alias("chunk_index", "piece"))
    return out.select("*", F.col("piece.text").alias("text"), F.col("piece.kind").alias("kind"), F.col("piece.blocks").alias("block_ids")).drop("piece")


def allowed_pages(pages: DataFrame, *, allow_needs_review: bool = False, strict: bool = False, allow_empty: bool = False) -> DataFrame:
    """Accepted pages and, if asked for, those to be reviewed; strict raises for any other, and for an empty one unless allowed, instead of leaving it out."""
    allowed = (F.col("processing_status") == "accepted") | (F.lit(allow_needs_review) & (F.col("processing_status") == "needs_review"))
    if strict:
        whole = F.lit(allow_empty) | ~blank(F.col("index_text"))
        return pages.where(F.when(allowed & whole, F.lit(True)).otherwise(F.raise_error(F.lit("a page is failed, unreviewed or empty")).cast("boolean")))
    return pages.where(allowed)


def document_chunks(pages: DataFrame, acl_groups: list[str], *, allow_needs_review: bool = False, max_words: int = 512) -> DataFrame:
    """Chunks of the allowed pages of documents, with ids, language, groups and provenance."""
    groups = normalized_groups(acl_groups)
    held = page_chunks(allowed_pages(pages, allow_needs_review=allow_needs_review), max_words)
    held = held.withColumns({
        "chunk_id": ids.canonical_id("chunk", ids.Plain(F.col("page_id")), ids.Plain(F.lit("structural-v1")), ids.Plain(F.col("chunk_index"))),
        "lang": language(F.col("text")), "acl_groups": F.array(*map(F.lit, groups)),
        "location": F.struct(F.lit("page").alias("type"), F.col("page_number").alias("num"), F.col("page_id").alias("page_id"), F.lit("structural-v1").alias("strategy"), F.col("kind").alias("kind"), F.col("block_ids").alias("block_ids")),
    })
    return held.drop("index_text")


def page_sized(pages: DataFrame, *, allow_needs_review: bool = False, allow_empty: bool = False) -> DataFrame:
    """One chunk a page; a page that isn't allowed raises, one without text too unless that is allowed."""
    return allowed_pages(pages, allow_needs_review=allow_needs_review, strict=True, allow_empty=allow_empty).select(
        "*", F.col("index_text").alias("text"), ids.canonical_id("chunk", ids.Plain(F.col("page_id")), ids.Plain(F.lit("page-v1")), ids.Plain(F.lit(0))).alias("chunk_id"), language(F.col("index_text")).alias("lang")
    )


def normalized_groups(groups: list[str]) -> list[str]:
    """Groups trimmed, in order, each once; none at all raises, since missing groups are never public."""
    out = list(dict.fromkeys(g.strip() for g in groups or [] if g and g.strip()))
    if not out:
        raise ValueError("access groups are required")
    return out


def stamped(chunks: DataFrame, tenant_id: str, acl_groups: list[str]) -> DataFrame:
    """Tenant and groups overwritten, ids put under the tenant."""
    return chunks.withColumns({"tenant_id": F.lit(tenant_id), "acl_groups": F.array(*map(F.lit, normalized_groups(acl_groups))), "chunk_id": F.concat_ws(":", F.lit(tenant_id), "chunk_id")})


def layer_text(native: Column, ocr: Column) -> Column:
    """Both layers of a page, the native one alone where they say the same: composed, case and variants folded, blanks reduced."""
    n, o = strip(F.coalesce(native, F.lit(""))), strip(F.coalesce(ocr, F.lit("")))
    both = (n != "") & (o != "")  # others aren't compared
    same = normalize_for_comparison(F.when(both, n)) == normalize_for_comparison(F.when(both, o))
    return F.when(n == "", o).when((o == "") | same, n).otherwise(F.concat(n, F.lit("\n\n"), o))
