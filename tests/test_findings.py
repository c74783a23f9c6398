"""What a review found: queries that grew with the square of a row or a group, repeated work, ties of a format, pages without text."""

import re
import time

import pytest
from pyspark.sql import functions as F

from stratadoc.functions import quality, tables, text
from stratadoc.operators import canonical, chunking, ocr
from stratadoc.operators import pages as operators_pages
from stratadoc.plans import catalogue, inputs, library
from stratadoc.sources import office

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def within(seconds: float, run):
    began = time.perf_counter()
    out = run()
    assert time.perf_counter() - began < seconds
    return out


def test_sizes_at_a_tie_go_to_the_even_digit(spark):
    """37 * 512 * 512 bytes are 9.25 MB."""
    rows = spark.createDataFrame([(37 * 16**2,), (37 * 512**2,), (37 * 16384**2,), (1792,), (1280,), (10239,)], "n long").select(text.human_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["9.2 KB", "9.2 MB", "9.2 GB", "1.8 KB", "1.2 KB", "10.0 KB"]


def test_pages_without_text_are_chunks_where_that_is_allowed(spark):
    """a blank page stopped the whole query."""
    held = spark.createDataFrame([("1", "accepted", "a text"), ("2", "accepted", " \n"), ("3", "accepted", None)], "page_id string, processing_status string, index_text string")
    out = chunking.page_sized(held, allow_empty=True).collect()
    assert [(r.page_id, r.text, r.lang) for r in out] == [("1", "a text", "en"), ("2", " \n", "en"), ("3", None, "en")]
    with pytest.raises(Exception, match="empty"):
        chunking.page_sized(held).collect()
    with pytest.raises(Exception, match="unreviewed"):
        chunking.page_sized(held.withColumn("processing_status", F.lit("failed")), allow_empty=True).collect()


def test_large_pictures_take_time_by_their_pixels(spark):
    """the least and the greatest value were looked for again at each pixel."""
    held = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: (i * 7 % 101).cast("int")).alias("v"))
    out = within(20, lambda: held.select(ocr.stretched(F.col("v")).alias("v")).first().v)
    assert out == [(i * 7 % 101) * 255 // 100 for i in range(100_000)]


def test_large_sheets_take_time_by_their_cells(spark):
    """the whole grid was padded again for each cell's header."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.array(i.cast("string"), F.lit(" x ")))
    out = within(30, lambda: spark.range(1).select(tables.reading_text(tables.padded(grid), F.lit("cap")).alias("t")).first().t)
    assert out.split("\n")[:2] == ["cap", "0: 1 | x: x"] and out.count("\n") == 20_000


def test_words_of_pages_are_shuffled_once(spark):
    """texts are dealt by page before they are words; nothing after that deals words again."""
    for name in ("region_bbox_agg", "text_reconstruction", "top20_low_confidence"):
        assert plan(catalogue.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") == 1
    assert plan(library.grey_pictures(spark, SF)).count("Exchange hashpartitioning") == 1


def test_regions_carry_the_line_before_and_not_all_lines(spark):
    """each line carried its document's lines, and regions were made three times."""
    done = plan(library.region_candidates(spark, SF))
    assert done.count("Scan parquet") == 1 and "ls#" not in done


def test_batches_of_queries_are_bounded(spark):
    """a batch was of 64 MB on both sides, for each task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    inputs.table(spark, SF, "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"
    assert plan(library.ocr_page_results(spark, SF)).count("ArrowEvalPython") <= 4  # one a side of the join, and one for its filter


def test_normalisers_are_one_pass(spark):
    """Each is one function over a batch, whatever else names its result."""
    t = F.col("text")
    for made in (ocr.simple_quality(t), text.normalize_ocr(t), text.normalize_for_evaluation(t), text.normalize_for_agreement(t), chunking.layer_text(t, F.lower(t))):
        done = plan(inputs.table(spark, SF, "documents").select(made.alias("x")))
        assert done.count("ArrowEvalPython") == 1 and "regexp_replace" not in done


@pytest.mark.parametrize("x", ["  A‌\xa0ß\t\r\n \n\n\n ي", "\x1c a\x85b c d e　", "ΑΣ. ΑΣ", "", "كًx ـ"])
def test_python_and_jvm_normalisers_agree(spark, x):
    df = spark.createDataFrame([(x,)], "a string")
    a = F.col("a")
    got = df.select(text.normalize_router(a).alias("r"), text.squeeze(a).alias("s"), F.size(text.split_words(a)).alias("n"), text.compact(a).alias("c"), text.blank(a).alias("b")).first()
    assert (got.r, got.s, got.n, got.c, got.b) == (text.router_normalized(x), " ".join(x.split()), len(x.split()), "".join(x.split()), not x.strip())


def test_plain_chunks_of_documents_are_not_shuffled(spark):
    """lines were dealt by document and sorted again, though a document's lines came from one row."""
    done = plan(library.document_plain_chunks(spark, SF))
    assert "hashpartitioning" not in done and "collect_list" not in done
    rows = [("a", [(0, "paragraph", " one  two "), (1, "table", "no"), (2, "paragraph", None), (3, "paragraph", "three " * 600)]), ("b", [(0, "table", "no")]), ("c", [(1, "paragraph", " \n"), (0, "paragraph", "word " * 20)])]
    packed = spark.createDataFrame([(p, [(*i, "", []) for i in sorted(items)]) for p, items in rows], "path string, items array<struct<item_no:int,kind:string,text:string,style:string,rows:array<array<string>>>>")
    long = packed.select("path", F.explode("items").alias("i")).select("path", "i.*")
    told = lambda df: sorted((r.path, r["index"], r.text, r.lang) for r in office.plain_chunks(df).collect())
    assert told(packed) == told(long) == [("a", 0, "one two" + " three" * 510, "en"), ("a", 1, " ".join(["three"] * 154), "en"), ("c", 0, " ".join(["word"] * 20), "en")]


def test_pages_of_many_blocks_take_time_by_their_blocks(spark):
    """each block copied all that its group had so far; a text that is null put an end to the budget of words."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(149_999)), lambda i: F.struct(i.cast("string").alias("block_id"), F.lit("paragraph").alias("block_type"), F.when(i % 50_000 == 0, "word").otherwise("").alias("text")))
    out = within(20, lambda: spark.range(1).select(chunking.structural(blocks, 2).alias("p")).first().p)
    assert [len(p.blocks) for p in out] == [100_000, 50_000]
    rows = [([("0", "paragraph", "a b"), ("1", None, None), ("2", "paragraph", "c d"), ("3", "table", None)],), ([],), (None,)]
    held = spark.createDataFrame(rows, "b array<struct<block_id:string,block_type:string,text:string>>").select(chunking.structural(F.col("b"), 3).alias("p")).collect()
    assert [[(x.text, x.kind, x.blocks) for x in r.p] for r in held] == [[("a b", "text", ["0", "1"]), ("c d", "text", ["2"])], [], []]


def test_chunks_of_documents_need_no_join(spark):
    """pages, blocks, manifests and scores of the same row were joined again, and each side was worked out anew."""
    done = plan(library.extracted_document_chunks(spark, SF))
    assert "hashpartitioning" not in done and "Join" not in done and done.count("Scan parquet") == 1
    docs = spark.createDataFrame([("t", "k1", r"C:\in\a.txt", "text", ["Line one has words.\n\nLine two too. " * 9, None, " "]), ("t", "k2", "b.txt", "text", [])], "tenant_id string, logical_key string, source_name string, source_type string, pages array<string>")
    whole = docs.withColumn("source_sha256", F.sha2(F.array_join(F.transform("pages", lambda p: F.coalesce(p, F.lit(""))), "\f"), 256))
    named = canonical.manifests(whole.withColumns({"file_size_bytes": F.lit(0), "mime_type": F.lit(""), "total_pages": F.size("pages")}), "native", "1")
    texts = named.join(whole.select("source_sha256", F.posexplode("pages").alias("page_index", "raw")), "source_sha256").select("document_id", "page_index", text.normalize_ocr(F.col("raw")).alias("native_text"))
    pages = canonical.native_pages(canonical.judged(texts, "native_text"), named)
    lines = pages.select("page_id", F.posexplode(F.filter(F.split("native_text", "\n"), lambda x: ~text.blank(x))).alias("reading_order", "text")).withColumn("block_type", F.lit("paragraph"))
    scores = canonical.page_scores(pages.withColumns({"decision_quality": F.lit(None).cast("double"), "decision_agreement": F.lit(None).cast("double"), "n_fallbacks": F.lit(0)}))
    joined = canonical.chunks(pages, canonical.blocks(lines), named, scores, ["g"], extractor="native", max_words=20)
    nested = canonical.extracted_chunks(docs, ["g"], max_words=20)
    told = lambda df: sorted(df.select(F.to_json(F.struct("*")).alias("j")).collect())
    assert told(nested) == told(joined) and nested.count() > 2


def test_evidence_of_pages_is_one_pass(spark):
    """white space was taken out by a regular expression for each figure, and whole texts stripped for each test."""
    done = plan(catalogue.route_policy(spark, SF))
    assert "regexp_replace" not in done and "btrim" not in done
    rows = [("a b　é²\x85-", 5, 0.8), (" \n", 0, 0.0), ("", 0, 0.0), (None, None, 0.0), ("😀x", 2, 0.5)]
    got = spark.createDataFrame([(x,) for x, _, _ in rows], "a string").select(operators_pages.native_characters(F.col("a")), operators_pages.meaningful_ratio(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_blocks_of_documents_are_not_shuffled(spark):
    """lines were dealt by document and sorted again for their order."""
    done = plan(library.document_blocks(spark, SF))
    assert "hashpartitioning" not in done and "Window" not in done
    rows = [("a", [(0, "paragraph", "Title", " A \t b ", []), (1, "paragraph", "Normal", " ", []), (2, "paragraph", None, None, []), (3, "table", "", "", [["h", "k"], ["1", ""]]), (4, "paragraph", "List", "x", [])]), ("b", [])]
    packed = spark.createDataFrame(rows, "path string, items array<struct<item_no:int,kind:string,style:string,text:string,rows:array<array<string>>>>")
    long = packed.select("path", F.explode("items").alias("i")).select("path", "i.*")
    told = lambda df: sorted((r.path, r.item_no, r.reading_order, r.block_type, r.text) for r in office.docx_blocks(df).collect())
    assert told(packed) == told(long) == [("a", 0, 0, "heading", "A b"), ("a", 3, 1, "table", "h: 1"), ("a", 4, 2, "list_item", "x")]


def test_selection_reads_candidates_once(spark):
    """candidates were made twice and joined by page, and their whole texts were shuffled."""
    done = plan(catalogue.candidate_selection(spark, SF))
    assert done.count("Scan parquet") == 1 and "Join" not in done and done.count("Exchange hashpartitioning") <= 2  # figures by page and route, the first of each by page
    for x in ("One oNE é É\x85_x ß² ss2", "a□b A", "Σς σ ǰ", ""):
        held = re.findall(r"\w+", x)
        assert quality.words_counted(x, quality.GARBAGE_TEXT) == (len(held), len({w.casefold() for w in held}))
