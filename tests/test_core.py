"""Operators of document analytics: hand-worked values, contracts, negative controls, plans."""

import json
import random
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from stratadoc.functions import ids, quality, tables, text
from stratadoc.operators import access, candidates, chunking, evaluate, layout, pages, rbac, reports, retrieval, upsert
from stratadoc.plans import catalogue, inputs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return row.select(column).first()[0]


# Text


def test_white_space_is_pythons(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, c.isspace()) for c in chars], "c string, want boolean")
    assert df.where(F.col("c").rlike(f"^{text.SPACE}$") != F.col("want")).count() == 0


def test_normalisers(spark):
    assert one(spark, text.normalize_chars(F.col("a")), a="كتاب‌ي") == "کتاب ی"
    assert one(spark, text.normalize_ocr(F.col("a")), a="  كـت‍﻿  x \r\n\r\n\r\n\n y\t z­ ") == "کت x\n\ny z"
    assert one(spark, text.normalize_chars(F.col("a"), compose=False), a="سلام") == "سالم"
    assert one(spark, text.normalize_for_evaluation(F.col("a")), a="سَلام‌  دنیا\n") == "سلام دنیا"
    assert one(spark, text.normalize_for_agreement(F.col("a")), a="A-b, C_d!") == "a b c_d"
    assert one(spark, text.nfkc(F.col("a")), a="ﬁ①") == "fi1"


def test_scripts(spark):
    assert one(spark, text.persian_ratio(F.col("a")), a="سلam ") == 0.5
    assert one(spark, text.language(F.col("a")), a="سلam") == "en" and one(spark, text.language(F.col("a")), a="سلاm") == "fa"
    assert one(spark, text.direction(F.col("a")), a="سل ab") == "rtl" and one(spark, text.direction(F.col("a")), a="سل abc") == "ltr"


def test_display(spark):
    assert one(spark, text.human_bytes(F.col("a")), a=1536) == "1.5 KB" and one(spark, text.human_bytes(F.col("a")), a=100) == "100 B"
    assert one(spark, text.clock(F.col("a")), a=125) == "2:05"
    assert one(spark, text.score_band(F.col("a")), a=0.449) == "good" and one(spark, text.score_band(F.col("a")), a=0.44) == "weak"
    assert one(spark, text.preview(F.col("a"), 5), a="abcd efgh") == "abcd…"
    assert spark.range(1).select(text.required_languages(F.array(F.lit("fas+eng"), F.lit("eng+ara")))).first()[0] == ["fas", "eng", "ara"]


def test_stable_characters_are_stable(spark):
    import unicodedata

    chars = [chr(c) for c in range(0x200)]
    df = spark.createDataFrame([(c, unicodedata.normalize("NFKC", c) == c) for c in chars], "c string, same boolean")
    assert df.where(F.col("c").rlike(f"^[{text.STABLE}]$") & ~F.col("same")).count() == 0
    held = ["été e\u0301", "Straße", "x\u00b2", "plain", None, "ﬁn"]
    out = spark.createDataFrame([(i, h) for i, h in enumerate(held)], "i int, h string").select("i", text.nfkc(F.col("h")).alias("n")).orderBy("i").collect()
    assert [r.n for r in out] == [None if h is None else unicodedata.normalize("NFKC", h) for h in held]


# Ids


@pytest.mark.parametrize("name", ["t1:src1-1_0", "سلام دنیا", "é😀", ""])
def test_uuid5_equals_python(spark, name):
    assert one(spark, ids.uuid5(uuid.NAMESPACE_DNS, F.col("a")), a=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_canonical_ids(spark):
    assert one(spark, ids.point_id(F.col("a")), a="t1:src1-1_0") == "887b346f-4e29-5302-9a6c-49dac4dc3257"
    same = [one(spark, ids.canonical_id("document", F.lit("Tenant-A"), F.col("a")), a=a) for a in ("DMS:policy-42", " dms:Policy-42 ")]
    assert same[0] == same[1] == str(uuid.uuid5(ids.NAMESPACE, "\x1f".join(["document", "tenant-a", "dms:policy-42"])))
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, ids.canonical_id("document", F.col("a")), a=" ")
    assert one(spark, ids.valid_sha256(F.col("a")), a=" " + "A" * 64) == "a" * 64
    with pytest.raises(Exception, match="SHA-256"):
        one(spark, ids.valid_sha256(F.col("a")), a="abc")


# Quality


@pytest.mark.parametrize(("value", "score", "level"), [("alpha beta beta.", 77.84, "accepted_with_warning"), ("□□ a", 38.56, "failed"), ("   ", 0.0, "failed"), ("Word " * 60, 85.25, "accepted_with_warning"), (None, 0.0, "failed")])
def test_text_scores(spark, value, score, level):
    row = quality.with_text_score(spark.createDataFrame([(value,)], "text string")).select("text_score", quality.level(F.col("text_score"))).first()
    assert row[0] == pytest.approx(score, abs=0.011) and row[1] == level


def test_verdicts(spark):
    assert one(spark, quality.worst(F.lit("accepted"), quality.status_ceiling(F.col("a"))), a="needs_review") == "needs_review"
    assert one(spark, quality.status_of(F.col("a")), a="accepted_with_warning") == "accepted"
    blocks = spark.createDataFrame([("□□□□ a", None), ("same " * 30, 12.5)], "text string, quality_score double")
    out = quality.block_quality(blocks).collect()
    assert out[0].warnings == ["high_garbage_ratio"] and out[1].warnings == ["high_repetition_ratio"] and out[1].score == 12.5


def test_page_and_document_quality(spark):
    kind = "document_id string, index_text string, native_text string, ocr_text string, page_type string, processing_status string, decision_quality double, decision_agreement double, selected_route string, gate_passed boolean, n_fallbacks int"
    good = "A long enough sentence with many different words stands here, so nothing about it is wrong at all. " * 2
    df = spark.createDataFrame(
        [("d", good, good, "", "digital", "accepted", None, None, "native", True, 0), ("d", good, good, good, "mixed", "accepted", 100.0, 0.0, "combined", True, 0), ("d", good, "", good, "scanned", "accepted", None, None, "rejected", False, 1), ("e", " ", "", "", "empty", "failed", None, None, "rejected", False, 0)], kind
    )
    out = {(r.document_id, r.selected_route): r for r in quality.page_quality(df).collect()}
    assert out[("d", "native")].status == "accepted" and out[("d", "native")].warnings == []
    assert out[("d", "combined")].score == pytest.approx(0.85 * (0.6 * out[("d", "native")].score + 40), abs=0.011)
    assert out[("d", "rejected")].score == 39.99 and out[("d", "rejected")].warnings == ["extraction_route_rejected", "fallback_route_used", "quality_gate_not_passed"]
    assert out[("e", "rejected")].is_empty and out[("e", "rejected")].score == 0
    known = spark.createDataFrame([("d",), ("e",), ("none",)], "document_id string")
    docs = {r.document_id: r for r in quality.document_quality(quality.page_quality(df), documents=known).collect()}
    assert docs["d"].failed_pages == 1 and docs["d"].warnings == ["1_failed_pages"] and docs["none"].level == "failed" and docs["e"].empty_pages == 1


# Access


CHUNKS = [("1", "t1", ["g1"], [1.0, 0.0]), ("2", "t1", ["g2"], [1.0, 0.1]), ("3", "t2", ["g1"], [1.0, 0.0]), ("4", "t1", None, [1.0, 0.0]), ("5", "t1", [], [1.0, 0.0]), ("6", "t1", ["g1", "g2"], [0.0, 1.0])]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, tenant_id string, acl_groups array<string>, vector array<double>")


def test_only_own_groups_are_seen(spark):
    seen = lambda *groups: {r.chunk_id for r in access.SecureChunks(chunks(spark), access.Identity("u", "t1", groups)).frame().collect()}
    assert seen("g1") == {"1", "6"} and seen("g1", "g2") == {"1", "2", "6"} and seen() == set() and seen("g9") == set()


def test_the_filter_stands_below_the_limit(spark):
    me = access.Identity("u", "t1", ("g1",))
    hits = retrieval.search(access.SecureChunks(chunks(spark), me).frame(), [1.0, 0.0], 2)
    assert [r.chunk_id for r in hits.collect()] == ["1", "6"] and access.filter_below_ranking(hits)
    late = retrieval.search(chunks(spark), [1.0, 0.0], 2).where(access.visible(me))
    assert not access.filter_below_ranking(late) and late.count() < 2
    control = retrieval.search(chunks(spark), [1.0, 0.0], 6)
    allowed = access.SecureChunks(chunks(spark), me).frame()
    assert access.leaks(hits, allowed).count() == 0 < access.leaks(control, allowed).count()


def test_k_is_bounded(spark):
    for k in (0, -1, 1001):
        with pytest.raises(ValueError):
            retrieval.search(chunks(spark), [1.0, 0.0], k)


def test_scopes(spark):
    user, creator = access.Identity("u", "t1"), access.Identity("c", "t9", level="creator")
    assert access.tenant_scope(chunks(spark), user).count() == 5 and access.tenant_scope(chunks(spark), creator).count() == 6
    assert access.in_scope(chunks(spark), user, "chunk_id", "3").count() == 0 < access.in_scope(chunks(spark), creator, "chunk_id", "3").count()
    assert access.may(creator, "x") and not access.may(user, "x")


# Retrieval


def test_arrow_cosine_equals_expressions(spark):
    df = chunks(spark).select("chunk_id", retrieval.cosine_to([1.0, 2.0])("vector").alias("a"), retrieval.cosine(F.col("vector"), F.array(F.lit(1.0), F.lit(2.0))).alias("b"))
    assert all(r.a == pytest.approx(r.b) for r in df.collect())


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([("t", "1", "a b a"), ("t", "2", "b c"), ("t", "3", "d e f a"), ("x", "4", "c c c")], "tenant_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("t", 1, "a c c")], "tenant_id string, question_id int, question string")
    out = {r.chunk_id: r.bm25 for r in retrieval.bm25(corpus, asked, scope=["tenant_id"]).collect()}
    assert out == {"1": pytest.approx(0.060813, abs=1e-6), "2": pytest.approx(1.201943, abs=1e-6), "3": pytest.approx(0.037016, abs=1e-6)}


def test_minmax_and_fusion(spark):
    df = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.5), (1, "c", 0.8), (2, "a", 1.0), (2, "b", 1.0)], "question_id int, chunk_id string, score double")
    out = {(r.question_id, r.chunk_id): r.n for r in df.select("*", retrieval.minmax("score", "question_id").alias("n")).collect()}
    assert out == {(1, "a"): 0, (1, "b"): pytest.approx(0.5), (1, "c"): 1, (2, "a"): 0.5, (2, "b"): 0.5}
    lexical = spark.createDataFrame([(1, "a", 9.0)], "question_id int, chunk_id string, bm25 double")
    fused = {r.chunk_id: r.score for r in retrieval.fuse(df.where("question_id = 1"), lexical, keys=["question_id", "chunk_id"]).collect()}
    assert fused == {"a": 0.5, "b": pytest.approx(0.25), "c": 0.5}


def test_rerank_prompt_sources(spark):
    hits = spark.createDataFrame([(1, "red fox", "a", "a blue dog", 1), (1, "red fox", "b", "the red fox", 2)], "question_id int, question string, chunk_id string, text string, rank int")
    best = retrieval.rerank(hits, 2)
    assert [r.chunk_id for r in best.orderBy("rank").collect()] == ["b", "a"]
    assert retrieval.prompt(best, "{context} ? {question}").first().prompt == "the red fox\n\n---\n\na blue dog ? red fox"
    at = lambda *refs: spark.createDataFrame([("s", (r,)) for r in refs], "source string, location struct<ref:string>")
    assert [r.ref for r in retrieval.unique_sources(at("1", "2"), at("2")).collect()] == ["1"]


def test_embedding_is_pluggable(spark):
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r.v for r in df.select(retrieval.embed(lambda: lambda batch: [[len(t), 1.0] for t in batch], F.col("text")).alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0]]


# Chunking


def windows(value, size, overlap):
    words = value.split()
    return [w for i in range(0, len(words), size - overlap) if len(w := " ".join(words[i : i + size])) > 50]


@pytest.mark.parametrize("n", [0, 5, 100, 512, 513, 1000])
def test_fixed_windows(spark, n):
    value = " ".join(f"w{i}" for i in range(n))
    assert spark.createDataFrame([(value,)], "a string").select(chunking.split_fixed(F.col("a"))).first()[0] == windows(value, 512, 64)


def test_fixed_windows_refuse_a_small_size():
    with pytest.raises(ValueError):
        chunking.split_fixed(F.lit("a") if False else None, 64)


def test_articles(spark):
    value = "preamble\nماده1 first\nmore\n ماده2 second"
    assert one(spark, chunking.split_articles(F.col("a")), a=value) == ["\nماده1 first\nmore", "\n ماده2 second"]
    assert one(spark, chunking.split_articles(F.col("a")), a="\nماده۱ الف\n\u2003ماده۲۳ ب\n") == ["\nماده۱ الف", "\n\u2003ماده۲۳ ب\n"]
    assert one(spark, chunking.split_articles(F.col("a")), a="nothing") == []


def grouped(blocks, most):
    out, parts, held, n = [], [], [], 0

    def close():
        nonlocal parts, held, n
        if parts:
            out.append(("\n\n".join(parts), "text", held))
        parts, held, n = [], [], 0

    for key, kind, value in blocks:
        size = len(value.split())
        if kind == "table" or size > most:
            close()
            name = "table" if kind == "table" else "text"
            out += [(w, name, [key]) for w in ([value] if kind == "table" and size <= most else windows(value, most, min(64, most - 1)))]
            continue
        if (kind == "heading" and parts) or (n and n + size > most):
            close()
        parts.append(value)
        held = held + [key]
        n += size
    close()
    return [(t.strip(), k, h) for t, k, h in out if t.strip()]


def test_structural_groups(spark):
    import random

    rng = random.Random(5)
    held = []
    for i in range(40):
        held.append((i, [(str(j), rng.choice(["paragraph", "paragraph", "heading", "table"]), " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 5, 30, 90, 200])))) for j in range(rng.randint(0, 9))]))
    df = spark.createDataFrame(held, "i int, blocks array<struct<block_id:string,block_type:string,text:string>>")
    for row in df.select("i", "blocks", chunking.structural(F.col("blocks"), 80).alias("out")).collect():
        assert [tuple(x) for x in row.out] == grouped([tuple(b) for b in row.blocks], 80), row.i


def test_allowed_pages_and_groups(spark):
    df = spark.createDataFrame([("a", "accepted", "x"), ("b", "needs_review", "x"), ("c", "failed", "x")], "page_id string, processing_status string, index_text string")
    assert [r.page_id for r in chunking.allowed_pages(df).collect()] == ["a"]
    assert chunking.allowed_pages(df, allow_needs_review=True).count() == 2
    with pytest.raises(Exception, match="failed, unreviewed or empty"):
        chunking.page_sized(df).collect()
    assert chunking.normalized_groups([" a", "b", "a", ""]) == ["a", "b"]
    for none in ([], [" "], None):
        with pytest.raises(ValueError):
            chunking.normalized_groups(none)


def test_layers(spark):
    same = [("a b", "a  b"), ("Straße", "STRASSE"), ("a\nb", "A B"), ("\u0643\u064a", "\u06a9\u06cc"), ("ﬁn", "FIN"), ("x\u200cy", "x y"), ("م\u0640ا", "ما")]
    df = spark.createDataFrame([*same, ("a", "b"), ("", "b"), ("a", None)], "n string, o string")
    out = df.select(chunking.layer_text(F.col("n"), F.col("o")).alias("t")).collect()
    assert [r.t for r in out] == [*(n for n, _ in same), "a\n\nb", "b", "a"]


# Candidates


def test_agreement_and_similarity(spark):
    texts = ["the quick brown fox", "the quick brown fix", "something else", "the quick fox"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("q", 0, "alone")], "page_id string, candidate_no int, text string")

    def alike(a, b):
        overlap = len(set(a.split()) & set(b.split())) / max(1, min(len(set(a.split())), len(set(b.split()))))
        return (SequenceMatcher(None, a, b).ratio() * 0.45 + overlap * 0.55) * 100

    out = {(r.page_id, r.candidate_no): r.agreement_score for r in candidates.with_agreement(df).collect()}
    for i, t in enumerate(texts):
        best = sorted((alike(t, o) for j, o in enumerate(texts) if j != i), reverse=True)[:3]
        assert out[("p", i)] == pytest.approx(sum(best) / 3, abs=0.02)
    assert out[("q", 0)] is None


CANDIDATE = "page_id string, candidate_no int, text string, route string, mean_confidence double, coverage double, structurally_valid boolean, reading_order_valid boolean, language_profile string, psm string, preprocessing string"


def candidate(page, n, value, route="full_page_ocr", confidence=90.0, **more):
    held = {"coverage": 0.03, "structurally_valid": True, "reading_order_valid": True, "language_profile": "fas+eng", "psm": "6", "preprocessing": "original"} | more
    return (page, n, value, route, confidence, *held.values())


def test_gate_and_selection(spark):
    good = "these are different words of a readable sentence on one page"
    df = spark.createDataFrame(
        [candidate("a", 0, good), candidate("a", 1, good, "region_ocr", 95.0), candidate("b", 0, good, confidence=60.0), candidate("b", 1, good, "region_ocr", 99.0), candidate("c", 0, "x", confidence=None), candidate("d", 1, good, "region_ocr", reading_order_valid=False), candidate("e", 0, good, coverage=0.0)], CANDIDATE
    )
    held = candidates.gated(candidates.scored(df).withColumn("agreement_score", F.lit(None).cast("double")))
    reasons = {(r.page_id, r.candidate_no): r.rejection_reasons for r in held.collect()}
    assert reasons[("a", 0)] == [] and reasons[("d", 1)] == ["invalid_region_reading_order"] and reasons[("e", 0)] == ["ocr_coverage_below_threshold"]
    assert reasons[("c", 0)] == ["ocr_text_too_short", "ocr_word_count_below_threshold", "ocr_confidence_below_threshold"]
    out = {r.page_id: (r.route, r.reason) for r in candidates.selected(held).collect()}
    assert out == {
        "a": ("full_page_ocr", "full_page_candidate_not_outscored_by_region_margin"), "b": ("region_ocr", "region_candidate_met_required_advantage"), "c": (None, "all_ocr_candidates_rejected"),
        "d": (None, "all_ocr_candidates_rejected"), "e": (None, "all_ocr_candidates_rejected"),
    }
    again = candidates.selected(held.repartition(3).orderBy(F.rand(1)))
    assert {r.page_id: (r.route, r.reason) for r in again.collect()} == out
    assert len(candidates.plans(["a", "b"], [3, 6, 11], ["x", "y"], most=8)) == 7


def test_gate_and_selection_by_agreement(spark, tmp_path):
    """Scores, reasons and routes of document candidates with agreement, against the rules by hand on each document's three."""
    words = "other things that the brother thinks with a healthy thirst for truth and depth in every path of the north"
    texts = {3: words, 4: f"{words} " * 9, 6: "aeiou eau oui aie " * 9, 7: "Straße thé " * 30, 8: "", 9: "x", 12: "the thin thug " * 40}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ours = {(int(r.page_id), r.candidate_no): r for r in candidates.scored(inputs.candidates(spark, str(tmp_path))).collect()}

    def alike(a, b):
        a, b = (" ".join(x.casefold().split()) for x in (a, b))
        if not a or not b:
            return 0.0
        x, y = set(a.split()), set(b.split())
        return round((SequenceMatcher(None, a, b).ratio() * 0.45 + len(x & y) / max(1, min(len(x), len(y))) * 0.55) * 100, 2)

    gate = {(r.doc_id, r.candidate_no): r for r in catalogue.candidate_gate_agreed(spark, str(tmp_path)).collect()}
    assert set(gate) == {(d, k) for d in texts for k in range(3)}
    low = 0
    for (d, k), r in gate.items():
        row = ours[(d, k)]
        agreement = sum(alike(row.text, ours[(d, o)].text) for o in range(3) if o != k) / 2
        assert r.agreement_score == pytest.approx(agreement, abs=0.011)
        assert r.selection_score == pytest.approx(max(0, min(100, row.quality_score * 0.45 + (row.mean_confidence or 0) * 0.35 + r.agreement_score * 0.20)), abs=0.011)
        assert ("ocr_agreement_below_threshold" in r.reasons.split(",")) == (r.agreement_score < 45)
        low += r.agreement_score < 45
    assert 0 < low < len(gate)
    for r in catalogue.candidate_selection_agreed(spark, str(tmp_path)).collect():
        best = {route: max((g.selection_score for (d, k), g in gate.items() if d == r.doc_id and not g.reasons and (k == 1) == (route == "region_ocr")), default=None) for route in ("full_page_ocr", "region_ocr")}
        full, region = best["full_page_ocr"], best["region_ocr"]
        want = None if full is region is None else "region_ocr" if full is None or (region is not None and region >= full + 5) else "full_page_ocr"
        assert r.route == want


def test_matcher_ratio_is_that_of_difflib():
    rng = random.Random(5)
    for n in (0, 1, 30, 199, 200, 500):
        for k in (1, 3, 20, 90):
            a, b = ("".join(chr(97 + rng.randrange(k)) for _ in range(size)) for size in (rng.randint(0, n), n))
            assert candidates.matcher_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_selection_scores(spark):
    base = spark.createDataFrame([candidate("p", 0, "x y", confidence=80.0)], CANDIDATE)
    held = base.withColumns({"quality_score": F.lit(85.25), "meaningful_ratio": F.lit(1.0), "garbage_ratio": F.lit(0.0), "repetition_ratio": F.lit(0.0), "word_count": F.lit(2)})
    assert candidates.gated(held.withColumn("agreement_score", F.lit(None).cast("double"))).first().selection_score == pytest.approx(82.95, abs=0.011)
    assert candidates.gated(held.withColumn("agreement_score", F.lit(70.0))).first().selection_score == pytest.approx(80.36, abs=0.011)


# Pages


def test_routes(spark):
    df = spark.createDataFrame([("digital", "n", "", False), ("digital", "n", "o", True), ("mixed", "n", "o", False), ("scanned", "", "o", True), ("scanned", "", "o", False), ("empty", " ", None, False)], "page_type string, native_text string, ocr_text string, ocr_passed boolean")
    assert [(r.route, r.status, r.passed) for r in pages.routed(df).collect()] == [
        ("native", "accepted", True), ("combined", "accepted", True), ("native", "needs_review", False), ("full_page_ocr", "accepted", True), ("rejected", "needs_review", False), ("rejected", "failed", False),
    ]
    with pytest.raises(ValueError):
        pages.routed(df, "native")


def test_native_block_types(spark):
    spans = [("p", 0, 0, 0, "Chapter One", 18.0), ("p", 1, 0, 0, "Some text. ", 10.0), ("p", 1, 0, 1, "And more.", 10.0), ("p", 1, 1, 0, "Next line", 10.0), ("p", 2, 0, 0, "• item", 10.0), ("p", 3, 0, 0, " ", 30.0), ("p", 4, 0, 0, "Ends a sentence.", 18.0)]
    out = pages.native_blocks(spark.createDataFrame(spans, "page_id string, block_no int, line_no int, span_no int, text string, size double")).orderBy("reading_order").collect()
    assert [(r.block_type, r.text) for r in out] == [("heading", "Chapter One"), ("paragraph", "Some text. And more.\nNext line"), ("list_item", "• item"), ("paragraph", "Ends a sentence.")]


# Layout


def test_boxes():
    assert layout.sanitize_boxes([(-5, 0, 50, 50), (0, 0, 49, 49), (60, 60, 60, 90), (100, 0, 200, 50)], 150, 100) == [(0, 0, 50, 50), (100, 0, 150, 50)]
    page = [(0, 0, 1000, 50), (520, 100, 980, 200), (20, 100, 480, 200), (520, 250, 980, 300), (0, 900, 1000, 950)]
    assert layout.reading_order(page, 1000, "rtl") == [page[0], page[1], page[3], page[2], page[4]]
    assert layout.reading_order(page, 1000, "ltr") == [page[0], page[2], page[1], page[3], page[4]]


def test_regions_merge_through_others(spark):
    kind = "page_id string, region_id int, block_num int, left int, top int, right int, bottom int, word_count long, confidence double, text string, page_height int"
    held = [("p", 1, 1, 0, 0, 100, 50, 3, 90.0, "a", 1000), ("p", 2, 2, 0, 40, 100, 90, 1, 50.0, "b", 1000), ("p", 3, 3, 0, 80, 100, 130, 0, None, "c", 1000), ("p", 4, 4, 500, 0, 600, 50, 2, 70.0, "d", 1000)]
    df = spark.createDataFrame(held, kind)
    out = {r.text: r for r in layout.merged(df).collect()}
    assert set(out) == {"a b c", "d"} and out["a b c"].bottom == 130 and out["a b c"].confidence == 80.0
    assert layout.overlapping(df).count() == 2


def test_words_to_text_and_regions(spark):
    kind = "page_id string, word_no long, block_num int, par_num int, line_num int, text string, conf string, left int, top int, width int, height int, page_width int, page_height int"
    held = [("p", 0, 1, 1, 1, "one", "90", 10, 10, 20, 10, 1000, 1000), ("p", 1, 1, 1, 1, " two ", "80", 40, 10, 20, 10, 1000, 1000), ("p", 2, 1, 1, 2, "three", "-1", 10, 30, 20, 10, 1000, 1000), ("p", 3, 2, 1, 1, "four", "40", 10, 90, 20, 10, 1000, 1000), ("p", 4, 2, 1, 1, "", "x", 10, 90, 20, 10, 1000, 1000)]
    df = spark.createDataFrame(held, kind)
    assert layout.reconstructed(df).first().text == "one two\nthree\n\nfour"
    regions = layout.word_regions(df, padding=5).collect()
    assert [(r.text, r.confidence, r.left, r.right) for r in regions] == [("one two", 85.0, 5, 65)]
    assert layout.page_summary(df).first().word_count == 4 and [r.text for r in layout.low_confidence(df).collect()] == ["four"]


# Tables


def test_tables(spark):
    df = spark.createDataFrame([([["Category", " Amount "], ["a|b", "1"], ["c"]],)], "rows array<array<string>>").select(tables.padded(F.col("rows")).alias("rows"))
    assert df.first().rows == [["Category", "Amount"], ["a|b", "1"], ["c", ""]]
    assert df.select(tables.markdown(F.col("rows"))).first()[0] == "| Category | Amount |\n| --- | --- |\n| a\\|b | 1 |\n| c |  |"
    assert df.select(tables.reading_text(F.col("rows"), F.lit("cap"))).first()[0] == "cap\nCategory: a|b | Amount: 1\nCategory: c"
    only = spark.createDataFrame([([["h"]],), ([],)], "rows array<array<string>>").select(tables.reading_text(tables.padded(F.col("rows")), F.lit(None).cast("string")).alias("t")).collect()
    assert [r.t for r in only] == ["| h |\n| --- |", ""]


# Evaluation, reports, users, index


def test_error_rates(spark):
    df = spark.createDataFrame([("سلام دنی", "سلام دنیا"), ("x", None), ("x", " "), ("a b c d", "a c")], "h string, t string")
    out = df.select(evaluate.cer(F.col("h"), F.col("t")).alias("c"), evaluate.wer(F.col("h"), F.col("t")).alias("w")).collect()
    assert out[0].c == pytest.approx(1 / 9) and out[0].w == 0.5 and out[1][:] == out[2][:] == (None, None) and out[3].w == 1.0


def test_cer_of_all_passages(spark, tmp_path):
    """Every passage has a rate, by edits of code points."""
    texts = ["the path", "thé où le théâtre", "کتاب the خانه", "日本 the 語😀", "Straße", "naïve other thing ☕"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    out = {r.item_id: r.cer for r in catalogue.cer(spark, str(tmp_path)).collect()}
    assert out == {i: pytest.approx(edits(t.replace("th", "d"), t) / len(t), abs=1e-6) for i, t in enumerate(texts)}


def test_durations_and_rates(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "d double")
    assert evaluate.durations(df, "d").first()[:] == (3, 60.0, 20.0, 20.0, 30.0)
    assert evaluate.durations(df.limit(0), "d").first()[:] == (0, 0.0, None, None, None)
    with pytest.raises(Exception, match="negative"):
        evaluate.durations(df.withColumn("d", -F.col("d")), "d").collect()
    assert one(spark, evaluate.rate(F.col("a"), F.col("b")), a=0, b=0) is None
    with pytest.raises(Exception, match="part <= total"):
        one(spark, evaluate.rate(F.col("a"), F.col("b")), a=2, b=1)


def test_recall(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "b", 4)], "question_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (2, "q"), (3, "z")], "question_id int, chunk_id string")
    assert evaluate.recall(hits, truth).first()[:] == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6))


def test_reports(spark, tmp_path):
    rows = [{"pipeline": "a", "score": 90.0, "accepted_pages": 3, "warnings": ["w"], "errors": []}, {"pipeline": "a", "error": "broken"}]
    (tmp_path / "r.json").write_text(json.dumps({"reports": rows}))
    (tmp_path / "l.json").write_text(json.dumps(rows))
    for name in ("r.json", "l.json"):
        assert reports.report_rows(spark, str(tmp_path / name)).count() == 2
    kind = "pipeline string, score double, accepted_pages int, needs_review_pages int, failed_pages int, total_pages int, table_count int, warnings array<string>, errors array<string>, error string"
    df = spark.createDataFrame([("a", 90.0, 3, 1, 0, 4, 2, ["w"], [], None), ("a", None, None, None, None, None, None, None, None, "broken")], kind)
    row = reports.pipeline_totals(df).first()
    assert (row.files, row.avg_quality_score, row.accepted_pages, row.warning_count, row.error_count) == (2, 90.0, 3, 1, 1)
    totals = reports.corpus_totals(df).first()
    assert (totals.files, totals.files_failed, totals.page_acceptance_rate) == (2, 1, 0.75)
    assert reports.corpus_totals(df.limit(0)).first().page_acceptance_rate is None


@pytest.mark.parametrize(("embedded", "level", "warnings", "review", "status"), [(2, "accepted", 0, 0, "indexed"), (2, "accepted", 1, 0, "indexed_with_warnings"), (2, "accepted", 0, 1, "indexed_with_warnings"), (0, "needs_review", 0, 1, "needs_review"), (0, "failed", 0, 0, "failed")])
def test_job_status(spark, embedded, level, warnings, review, status):
    assert one(spark, reports.ingestion_status(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=embedded, b=level, c=warnings, d=review) == status


def test_permissions_and_guards(spark):
    users = spark.createDataFrame([(1, "root", "creator", "t9"), (2, "admin_a", "admin", "t1"), (3, "user_a", "user", "t1"), (4, "user_b", "user", "t2")], "user_id int, username string, level string, tenant_id string")
    roles = spark.createDataFrame([(3, 1), (3, 2)], "user_id int, role_id int")
    grants = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "role_id int, permission_id int")
    names = spark.createDataFrame([(1, "b.read"), (2, "a.read")], "permission_id int, name string")
    out = {r.user_id: r.permissions for r in rbac.effective_permissions(users, roles, grants, names).collect()}
    assert out == {1: [], 2: [], 3: ["a.read", "b.read"], 4: []}
    kind = "n int, action string, target_id int, level string, tenant_id string, acl_groups array<string>"
    asked = spark.createDataFrame(
        [(0, "update", 3, None, None, ["g1"]), (1, "update", 4, None, None, None), (2, "update", 3, "admin", None, None), (3, "create", None, None, "t2", None), (4, "create", None, None, "t1", ["g9"]), (5, "delete", 2, None, None, None), (6, "delete", 3, None, None, None)], kind
    )
    judge = lambda actor: {r.n: r.deny_reason for r in rbac.judged_requests(asked, users, actor).collect()}
    assert judge(access.Identity("admin_a", "t1", ("g1",), "admin")) == {0: None, 1: "not_found", 2: "level_change", 3: "tenant_scope", 4: "acl_scope", 5: "self_deletion", 6: None}
    assert set(judge(access.Identity("user_a", "t1", ("g1",))).values()) == {"not_an_admin"}
    last = spark.createDataFrame([(0, "delete", 1, None, None, None), (1, "update", 1, "user", None, None)], kind)
    assert [r.deny_reason for r in rbac.judged_requests(last, users, access.Identity("c2", "t9", (), "creator")).orderBy("n").collect()] == ["last_creator", "last_creator"]
    seed = rbac.seeded(names, spark.createDataFrame([(3, "b.read"), (4, "c.read")], "permission_id int, name string"), "name")
    assert seed.count() == 3 and rbac.seeded(seed, seed, "name").count() == 3


def test_points_are_upserted(spark, tmp_path):
    held = upsert.PointTable(spark, str(tmp_path / "points"))
    assert not held.exists()
    chunks_ = lambda *n: spark.createDataFrame([(f"c{i}", "t1", "s", f"text {i}") for i in n], "chunk_id string, tenant_id string, source string, text string")
    assert held.upsert(chunks_(1, 2, 3), 0) == 3 and held.upsert(chunks_(1, 2, 3), 0) == 3 and held.upsert(chunks_(2), 1) == 1 and held.upsert(chunks_().limit(0), 2) == 0
    assert held.exists() and held.read().count() == 3 and {r.chunk_id: r.ingest_seq for r in held.read().collect()} == {"c1": 0, "c2": 1, "c3": 0}
    assert [r.chunk_id for r in held.read(replace_document=True).collect()] == ["c2"]
    held.compact(str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


# Settings, contracts, regions


def test_settings():
    from stratadoc import config

    assert config.Settings.read({}) == config.Settings() and config.Settings.read({"PDF_MODE": " Adaptive ", "MAX_CHUNK_WORDS": "9"}).max_chunk_words == 9
    for bad in ({"PDF_MODE": "x"}, {"MAX_CHUNK_WORDS": "0"}, {"MAX_CHUNK_WORDS": "y"}, {"ALLOW_NEEDS_REVIEW": "maybe"}):
        with pytest.raises(ValueError):
            config.Settings.read(bad)
    assert config.page_numbers("5, 1-3,2") == [1, 2, 3, 5]
    for bad in ("", "0", "3-1", "a", "1-"):
        with pytest.raises(ValueError):
            config.page_numbers(bad)


def test_public_metadata(spark):
    from stratadoc import schema

    df = spark.createDataFrame([({"API-Key": "x"}, ["ok"]), ({"text": "x", "file": "/home/a"}, ["api_key=abc"]), ({"pages": "3"}, ["see /home/x"])], "m map<string,string>, s array<string>")
    out = df.select(schema.metadata_faults(F.col("m")).alias("m"), schema.message_faults(F.col("s")).alias("s")).collect()
    assert [r.m for r in out] == [["secret_field"], ["text_copy", "absolute_path"], []] and [r.s for r in out] == [[], ["secret_value"], ["private_path"]]
    with pytest.raises(Exception, match="contract: "):
        schema.checked(df, schema.metadata_faults(F.col("m"))).collect()
    blocks = spark.createDataFrame([("table", None, None), ("paragraph", [["a"]], None), ("heading", None, (0.0, 0.0, 0.0, 5.0)), ("odd", None, None), ("table", [["a"]], (0.0, 0.0, 1.0, 1.0))], f"block_type string, rows array<array<string>>, bbox {schema.BOX}")
    assert sorted(r.fault for r in schema.table_faults(blocks).collect()) == ["block_type:odd", "box", "rows_without_table", "table_without_rows"]
    for ddl in (schema.CHUNKS, schema.POINTS, schema.MANIFESTS, schema.BLOCKS, schema.PAGES, schema.JOBS):
        assert spark.createDataFrame([], ddl).count() == 0


def test_native_and_ocr_regions(spark):
    page = spark.createDataFrame([("p", 600.0, 800.0, 1200, 1600)], "page_id string, page_width_points double, page_height_points double, rendered_width int, rendered_height int")
    blocks = spark.createDataFrame([("p", "b", 10.0, 20.0, 100.0, 40.0), ("p", "a", 300.0, 20.0, 700.0, 40.0), ("p", "gone", 610.0, 0.0, 700.0, 10.0)], "page_id string, text string, left double, top double, right double, bottom double")
    native = pages.native_regions(page, blocks)
    assert [(r.text, r.left, r.right, r.reading_order) for r in native.orderBy("reading_order").collect()] == [("a", 600, 1200, 0), ("b", 20, 200, 1)]
    ocr = spark.createDataFrame([("p", "o", 0, 0, 1, 1, 0)], "page_id string, text string, left int, top int, right int, bottom int, reading_order int")
    assert {(r.text, r.reading_order) for r in pages.all_regions(native, ocr).collect()} == {("a", 0), ("b", 1), ("o", 2)}


def test_languages_and_simple_policy(spark):
    df = spark.createDataFrame([(["fas+eng", "ara"],)], "p array<string>")
    assert df.select(pages.missing_languages(F.col("p"), ["eng", "fas"])).first()[0] == ["ara"]
    assert df.select(pages.usable_profiles(F.col("p"), ["eng", "fas"])).first()[0] == ["fas+eng"] and df.select(pages.usable_profiles(F.col("p"), ["x"])).first()[0] == ["eng"]
    with pytest.raises(Exception, match="missing languages: ara"):
        pages.require_languages(df, "p", ["eng", "fas"]).collect()
    kinds = [one(spark, pages.simple_type(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c) for a, b, c in ((0, 0.0, 0.5), (0, 0.0, 0.0), (90, 80.0, 0.5), (90, 80.0, 0.0), (20, 80.0, 0.0), (90, 10.0, 0.0))]
    assert kinds == ["scanned", "empty", "mixed", "digital", "digital", "mixed"]
    assert one(spark, candidates.simple_selection(F.col("a"), F.col("b"), F.lit(None)), a=50.0, b=50.0) == 62.5


def test_duplicate_region_texts(spark):
    df = spark.createDataFrame([("p", 1, "Hello  World one two"), ("p", 2, "hello world one two"), ("p", 3, "hello world one twoo"), ("p", 4, " "), ("p", 5, "other")], "page_id string, region_id int, text string")
    assert sorted(r.region_id for r in candidates.distinct_texts(df).collect()) == [1, 5]
    assert sorted(r.region_id for r in candidates.first_texts(df).collect()) == [1, 3, 5]
