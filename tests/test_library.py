"""Operators of canonical documents, OCR, accounts, retrieval and text counts, against plain Python and by hand."""

import math
import random
import unicodedata
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratadoc import config, schema
from stratadoc.functions import ids, quality, text
from stratadoc.operators import access, auth, canonical, evaluate, layout, ocr, rbac, reports, retrieval, upsert
from stratadoc.plans import router
from stratadoc.sources import markup
from stratadoc.streaming import ingest


def column(spark, values, expression, kind="string"):
    """An expression over values (as column a), in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, a {kind}")
    return [r[1] for r in df.select("i", expression(F.col("a"))).orderBy("i").collect()]


ODD = ["", " ", "Straße STRASSE", "İstanbul istanbul", "ΣΑΣ σας ΐ", "ŉ ǰ ﬁ", "ي ى ك ـ", "a\u200db\ufeff\u00adc", "x\r\ny\rz", "\t a \xa0 b \n\n\n\n c", "□■◆●▪▫�", "\x00\x01\x1f\x85", "😀 a😀 𝔘𝔫", "日本 日本", "\ue000\U000f0000", "e\u0301 é", "_ __ 1 ١ ²", "a-b a_b"]


def test_case_folding_is_pythons(spark):
    rng = random.Random(1)
    values = ODD + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x700), rng.randrange(0x1E00, 0x2100), rng.randrange(0x3000, 0x3100)])) for _ in range(20)) for _ in range(300)]
    assert column(spark, values, text.casefold) == [v.casefold() for v in values]


def test_counts_of_texts(spark):
    """The five counts by their definition, on odd and on random texts."""

    def plain(value):
        value = unicodedata.normalize("NFKC", value)
        for old, new in (("ي", "ی"), ("ى", "ی"), ("ك", "ک"), ("ـ", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00ad", "")):
            value = value.replace(old, new)
        solid = [ch for ch in value if not ch.isspace()]
        words = [w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in value).split(" ") if w]
        bad = sum(ch in quality.GARBAGE_TEXT or unicodedata.category(ch) in ("Cc", "Cs", "Co") for ch in solid)
        return len(solid), sum(ch.isalnum() for ch in solid), bad, len(words), len({w.casefold() for w in words})

    rng = random.Random(2)
    pool = "ab A.Z\n\t□é😀ß İ١_\x01\u200d" + "ي"
    values = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = column(spark, values, quality.text_counts())
    assert [tuple(r) for r in got] == [plain(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "a string")
    assert df.where(text.normalize_ocr(F.col("a")) != quality.text_counts(with_text=True)(F.col("a"))["text"]).count() == 0


def test_ids_fold_case(spark):
    one = lambda *parts: column(spark, ["x"], lambda _: ids.canonical_id("document", *map(F.lit, parts)))[0]
    assert one("T", "Straße") == one("t", "STRASSE") == one(" t ", "strasse")
    want = str(uuid.uuid5(ids.NAMESPACE, "\x1f".join(("document", "t", "strasse"))))
    assert one("t", "straße") == want == column(spark, ["x"], lambda _: ids.canonical_id("document", ids.Plain(F.lit("t")), ids.Plain(F.lit("strasse"))))[0]


def test_error_rates_of_many_words(spark):
    many = " ".join(f"w{i}" for i in range(40_000))
    other = many.replace("w39999", "x") + " y"
    # distances of such texts are long to count; short ones with many distinct words in between tell codes apart
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(0, 400, 2)), " ".join(f"w{i}" for i in range(400)))], "h string, t string")
    assert df.select(evaluate.wer(F.col("h"), F.col("t"))).first()[0] == 0.5
    assert len(set(many.split()) | set(other.split())) == 40_002 < evaluate._MOST_WORDS


def test_nested_markup_loses_no_text(spark):
    html = "lead<table><tr><td><p>one</p></td><td>two<table><tr><td>in</td></tr></table>three</td></tr></table>tail<ul><li>a<ul><li>b</li></ul>c</li></ul><p>open<h2>head</h2>"
    out = markup.html_blocks(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("reading_order").collect()
    assert [(r.block_type, r.text) for r in out] == [("paragraph", "lead"), ("table", "one two in three"), ("paragraph", "tail"), ("list_item", "a"), ("list_item", "b"), ("paragraph", "c"), ("paragraph", "open"), ("heading", "head")]


# Canonical documents


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, logical_key string, source_name string, source_type string, pages array<string>")


def test_from_documents_to_chunks(spark):
    good = "A heading of this page\n" + "\n".join(f"paragraph {i} with a few different words like {'abcdefgh'[i]}{i} and more" for i in range(8))
    docs = documents(spark, ("T1", "Key", "/private/in/a.txt", "text", [good, " ", good]), ("t2", "key", "b.txt", "text", ["□□"]))
    out = canonical.extracted_chunks(docs, [" g1", "g1"], max_words=40).orderBy("source", "location.num", "chunk_index").collect()
    assert {r.source for r in out} == {"a.txt"} and {r.location.num for r in out} == {1, 3} and all(r.acl_groups == ["g1"] for r in out)
    first = [r for r in out if r.location.num == 1]
    assert [r.chunk_index for r in first] == list(range(len(first))) and len(first) > 1
    assert "\n\n".join(r.text for r in first).split() == good.split()
    assert all(len(r.text.split()) <= 40 and r.location.quality_score > 70 and r.location.route == "native" and r.location.strategy == "structural-v1" for r in first)
    assert len({r.chunk_id for r in out}) == len(out) and all(uuid.UUID(r.chunk_id).version == 5 for r in out)
    again = canonical.extracted_chunks(docs.withColumn("logical_key", F.upper("logical_key")), ["g1"], max_words=40)
    assert {r.chunk_id for r in again.collect()} == {r.chunk_id for r in out}
    assert canonical.extracted_chunks(docs, ["g1"], allow_needs_review=True).where("source = 'b.txt'").count() <= 1
    with pytest.raises(ValueError):
        canonical.extracted_chunks(docs, [])


def test_pages_and_manifests_belong_together(spark):
    pages = spark.createDataFrame([("d1", "r1"), ("d1", "r2")], "document_id string, revision_id string")
    named = spark.createDataFrame([("d1", "r1", "t", "s", "text")], "document_id string, revision_id string, tenant_id string, source_name string, source_type string")
    assert canonical.mismatched(pages, named).count() == 1
    assert canonical.matched(pages.where("revision_id = 'r1'"), named).first().tenant_id == "t"
    with pytest.raises(Exception, match="identities do not match"):
        canonical.matched(pages, named).collect()


def test_manifests_need_a_digest_and_tell_no_folder(spark):
    rows = [("t", "k", r"C:\in\a b.pdf", "pdf", "A" * 64, 1, "application/pdf", 2)]
    kind = "tenant_id string, logical_key string, source_name string, source_type string, source_sha256 string, file_size_bytes long, mime_type string, total_pages int"
    held = canonical.manifests(spark.createDataFrame(rows, kind), "p", "1")
    assert held.first().source_name == "a b.pdf" and held.first().source_sha256 == "a" * 64
    with pytest.raises(Exception, match="SHA-256"):
        canonical.manifests(spark.createDataFrame([(*rows[0][:4], "nothing", *rows[0][5:])], kind), "p", "1").collect()
    told = held.select(canonical.provenance("p", "1", dpi=300, languages=("eng",)).alias("p")).first().p
    assert told.pipeline_name == "p" and told.dpi == 300 and told.processing_timestamp is not None and (told.code_revision is None or len(told.code_revision) == 40)
    assert canonical.code_revision("/nonexistent") is None


def test_layout_items_and_sheets(spark):
    items = spark.createDataFrame(
        [("d", 0, "title", 3, " A  title ", None), ("d", 1, "table", 3, "", [["k", "v"], ["a", "1"]]), ("d", 2, "table", 7, "as text", [["", " "]]), ("d", 3, "odd", None, "no page", None), ("d", 4, "text", 7, " ", None)],
        "document_id string, item_no int, label string, page_no int, text string, rows array<array<string>>",
    )
    out = canonical.layout_blocks(items).orderBy("item_no").collect()
    assert [(r.page_index, r.reading_order, r.block_type, r.text) for r in out] == [(1, 0, "heading", "A title"), (1, 1, "table", "k: a | v: 1"), (2, 0, "paragraph", "as text"), (0, 0, "paragraph", "no page")]
    rows = spark.createDataFrame([("f", "A", 0, 0, ["k", "v"]), ("f", "A", 0, 1, [None, " "]), ("f", "A", 0, 2, ["x", "1"]), ("f", "_h", 1, 0, ["k"]), ("f", "E", 2, 0, [None])], "path string, sheet string, sheet_no int, row int, values array<string>")
    out = canonical.workbook_blocks(rows).orderBy("page_index").collect()
    assert [(r.sheet, r.page_index, r.text) for r in out] == [("A", 0, "A\nk: x | v: 1"), ("E", 1, "")]


def test_nested_metadata(spark):
    held = {'{"a":{"Api-Key":"x"}}': ["secret_field"], '{"a":[{"b":["/home/x"]}]}': ["absolute_path"], '{"text_preview":{"a":1}}': ["text_copy"], '{"a":"token","b":"x/y"}': [], r'{"a":"C:\\in"}': ["absolute_path"], None: []}
    assert column(spark, held, schema.json_faults) == list(held.values())


def test_payloads_leave_out_times(spark):
    rows = spark.createDataFrame([(1, (2.5, 3))], "id int, decision struct<processing_time_ms:double,score:int>").withColumn("processing_timestamp", F.current_timestamp())
    assert canonical.deterministic(rows).first().payload == '{"id":1,"decision":{"score":3}}'


# OCR


def test_an_engine_is_pluggable(spark):
    def make():
        def run(content, languages, psm, preprocessing):
            if content == b"bad":
                raise ValueError("no image")
            words = content.decode().split(" ")
            return [{"text": w, "conf": "-1" if w == "?" else "80", "left": 10 * i, "top": 0, "width": 8, "height": 10, "block_num": 1, "par_num": 1, "line_num": 1} for i, w in enumerate(words)]

        return run

    images = spark.createDataFrame([("p", bytearray(b"one two ?"), "eng", 6, "original", 100, 100), ("q", bytearray(b"bad"), "eng", 6, "original", 100, 100)], "page_id string, content binary, language_profile string, psm int, preprocessing string, page_width int, page_height int")
    read = ocr.read(images, make)
    assert read.where("page_id = 'q' and words is null").count() == 1
    out = ocr.full_page_candidates(ocr.exploded(read, "page_id")).collect()
    assert [(r.page_id, r.text, r.mean_confidence, r.word_count, r.coverage, r.structurally_valid) for r in out] == [("p", "one two ?", 80.0, 2, 0.016, True)]


def test_regions_of_a_candidate(spark):
    rows = [("p", 1, "A  b", 50.0, 3, 0.5, 0), ("p", 2, "a B", 90.0, 9, 0.5, 0), ("p", 3, "c", None, 4, 0.5, 0), ("p", 4, "d", 80.0, 0, 0.0, 60), ("q", 1, " ", 9.0, 1, 0.1, 0)]
    df = spark.createDataFrame([(*r, 0, r[6] + 50, 100, 100, 100) for r in rows], "page_id string, region_no int, text string, mean_confidence double, word_count int, coverage double, left int, top int, right int, bottom int, page_width int, page_height int")
    out = {r.page_id: r for r in ocr.region_candidates(df).collect()}
    assert (out["p"].text, out["p"].mean_confidence, out["p"].word_count, out["p"].coverage, out["p"].reading_order_valid) == ("A b\n\nc\n\nd", 57.5, 7, 0.5, False)
    assert out["q"].text == "" and not out["q"].structurally_valid and out["q"].mean_confidence is None


def test_reading_order_by_hand():
    left, right = (0, 100, 400, 900), (600, 50, 1000, 800)
    top, middle, last = (0, 0, 1000, 40), (0, 400, 1000, 450), (0, 950, 1000, 990)
    boxes = [left, right, top, middle, last]
    assert layout.reading_order(boxes, 1000) == [top, right, left, middle, last]
    assert layout.reading_order(boxes, 1000, "ltr") == [top, left, right, middle, last]
    assert layout.reading_order([last, top], 1000) == [top, last] and layout.reading_order([], 1000) == []
    assert layout.sanitize_boxes([(0, 0, 100, 100), (5, 5, 100, 100), (-5, 200, 50, 300), (7, 7, 7, 9), (0, 0, 20, 20)], 90, 250) == [(0, 0, 90, 100), (0, 200, 50, 250)]


def test_the_simpler_policy(spark):
    assert column(spark, ["", "□□□□", "word " * 60], lambda a: ocr.simple_quality(a)) == [0.0, 0.0, pytest.approx(35 + 25 + 240 / 250 * 20 + 20 - 15, abs=0.01)]
    runs = spark.createDataFrame([("p", 0, 50.0, 50.0, 50.0, "a"), ("p", 1, 50.0, 50.0, 50.0, "ab"), ("p", 2, 49.0, 99.0, 99.0, "abc")], "page_id string, run_no int, selection_score double, quality_score double, confidence double, text string")
    assert ocr.swept_best(runs).first().run_no == 1


# Accounts


def test_passwords_and_tokens():
    hashed = auth.hash_password("secret", rounds=1000)
    assert auth.verify_password("secret", hashed) and not auth.verify_password("Secret", hashed) and not auth.verify_password("secret", "broken")
    assert hashed != auth.hash_password("secret", rounds=1000)
    token = auth.encode_token({"sub": "a"}, "key", minutes=1, now=1000)
    assert auth.decode_token(token, "key", now=1059) == {"sub": "a", "exp": 1060}
    assert auth.decode_token(token, "key", now=1060) is None and auth.decode_token(token, "other", now=1000) is None
    head, body, signature = token.split(".")
    forged = auth._code(b'{"alg":"none","typ":"JWT"}')
    assert [auth.decode_token(t, "key", now=1000) for t in (f"{forged}.{body}.{signature}", f"{head}.{body}.", "x", "", None)] == [None] * 5


def test_signup_login_and_me(spark, monkeypatch):
    monkeypatch.setattr(auth, "ROUNDS", 1000)
    users = spark.createDataFrame([(1, "root", "creator", "t1", ["g"], auth.hash_password("pw", rounds=1000))], "user_id int, username string, level string, tenant_id string, acl_groups array<string>, password_hash string")
    asked = spark.createDataFrame([(1, "new", "a@b", "pw", "creator"), (2, "new", "c@d", "pw", "user"), (3, "root", "e@f", "pw", "user")], "request_id int, username string, email string, password string, level string")
    out = auth.signed_up(asked, users, tenant="public").orderBy("request_id").collect()
    assert [(r.status, r.level, r.tenant_id, r.acl_groups) for r in out] == [("created", "user", "public", []), ("conflict", None, None, None), ("conflict", None, None, None)]
    assert auth.verify_password("pw", out[0].password_hash) and out[1].password_hash is None
    links = spark.createDataFrame([(1, 5)], "user_id int, role_id int")
    roles = spark.createDataFrame([(5, "Reader")], "role_id int, name string")
    held = spark.createDataFrame([(5, 9)], "role_id int, permission_id int")
    names = spark.createDataFrame([(9, "a.read")], "permission_id int, name string")
    claims = auth.claims_of(users, links, held, names)
    tried = spark.createDataFrame([("root", "pw"), ("root", "no"), ("nobody", "pw")], "username string, password string")
    logged = {(r.username, r.status): r.claims for r in auth.logged_in(tried, users, claims).collect()}
    assert set(logged) == {("root", "ok"), ("root", "unauthorized"), ("nobody", "unauthorized")} and '"permissions":["a.read"]' in logged[("root", "ok")]
    token = spark.createDataFrame([(logged[("root", "ok")],)], "claims string").select(auth.tokens("key", F.col("claims"))).first()[0]
    assert auth.decode_token(token, "key")["tenant_id"] == "t1"
    me = {r.username: r for r in auth.current(spark.createDataFrame([("root",), ("gone",)], "username string"), users, links, roles, held, names).collect()}
    assert me["root"].roles == ["Reader"] and me["root"].permissions == ["a.read"] and me["gone"].status == "unauthorized"


def test_roles_are_granted_only_by_those_who_hold_them(spark):
    users = spark.createDataFrame([(1, "u", "user", "t1"), (2, "v", "user", "t2")], "user_id int, username string, level string, tenant_id string")
    roles = spark.createDataFrame([(5, "a"), (6, "b")], "role_id int, name string")
    held = spark.createDataFrame([(5, 1), (6, 1), (6, 2)], "role_id int, permission_id int")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "permission_id int, name string")
    asked = spark.createDataFrame([(1, "assign", 1, 5), (2, "assign", 1, 6), (3, "assign", 2, 5), (4, "unassign", 1, 6), (5, "assign", 1, 9)], "request_id int, action string, user_id int, role_id int")
    judge = lambda actor: [r.status for r in rbac.judged_assignments(asked, users, roles, held, names, actor).orderBy("request_id").collect()]
    assert judge(access.Identity("a", "t1", (), "admin", frozenset({"users.write", "x"}))) == ["ok", "ungrantable", "not_found", "ok", "not_found"]
    assert judge(access.Identity("c", "t9", (), "creator")) == ["ok", "ok", "ok", "ok", "not_found"] and set(judge(access.Identity("u", "t1"))) == {"forbidden"}
    links = spark.createDataFrame([(1, 6)], "user_id int, role_id int")
    judged = rbac.judged_assignments(asked, users, roles, held, names, access.Identity("a", "t1", (), "admin", frozenset({"users.write", "x"})))
    after = rbac.applied(links, judged, ["user_id", "role_id"], adds="assign")
    assert [tuple(r) for r in after.collect()] == [(1, 5)] and rbac.applied(after, judged, ["user_id", "role_id"], adds="assign").count() == 1
    left = rbac.deleted(roles, [held, links], roles.where("role_id = 6"), "role_id")
    assert [df.count() for df in left] == [1, 1, 0]
    want = rbac.judged_attachments(spark.createDataFrame([(1, "attach", 5, 2), (2, "attach", 5, 1), (3, "detach", 5, 2), (4, "attach", 5, 7)], "request_id int, action string, role_id int, permission_id int"), roles, names, access.Identity("a", "t1", (), "admin", frozenset({"roles.write", "x"})))
    assert [r.status for r in want.orderBy("request_id").collect()] == ["ungrantable", "ok", "ok", "not_found"]


def test_the_standard_seed_changes_nothing_twice(spark):
    empty = lambda kind: spark.createDataFrame([], kind)
    users = spark.createDataFrame([("sara",)], "username string")
    first = rbac.standard_seed(spark, empty("name string"), empty("name string"), empty("username string, role string"), users)
    assert [df.count() for df in first] == [len(rbac.STANDARD_PERMISSIONS), len(rbac.STANDARD_ROLES), sum(map(len, rbac.STANDARD_ROLES.values())), 1]
    again = rbac.standard_seed(spark, first[0], first[1], empty("username string, role string"), users)  # the grant was taken away
    assert [df.count() for df in again] == [len(rbac.STANDARD_PERMISSIONS), len(rbac.STANDARD_ROLES), 0, 0]


def test_panel_and_permission(spark):
    users = spark.createDataFrame([("creator", []), ("admin", ["p"]), ("admin", []), ("user", ["p"]), ("user", None)], "level string, permissions array<string>")
    out = users.select(access.may_panel(), access.granted("p"), access.granted("p", panel=True)).collect()
    assert [tuple(r) for r in out] == [(True, True, True), (True, True, True), (True, False, False), (False, True, False), (False, False, False)]
    assert access.one_row(users.where("level = 'creator'"), "user").count() == 1
    with pytest.raises(Exception, match="user not found"):
        access.one_row(users.where("level = 'x'"), "user").collect()


# Plans, retrieval


def test_a_filter_above_a_limit_is_found(spark):
    df = spark.createDataFrame([("t1", ["g1"], 1), ("t1", ["g2"], 2)], "tenant_id string, acl_groups array<string>, n int").repartition(2)
    me = access.Identity("a", "t1", ("g1",))
    below, above = df.where(access.visible(me)).orderBy("n").limit(1), df.orderBy("n").limit(1).where(access.visible(me))
    assert access.filter_below_ranking(below) and not access.filter_below_ranking(above) and not access.filter_below_ranking(df.orderBy("n").limit(1))
    joined = below.join(above.withColumnRenamed("n", "m"), "tenant_id")
    assert not access.filter_below_ranking(joined) and access.filter_below_ranking(below.join(df.select("tenant_id").distinct(), "tenant_id"))


@pytest.mark.parametrize("groups", [False, True])
def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch, groups):
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 17)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 5)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(130, 6)).round(2)
    vectors[7] = 0
    vectors[20:24] = vectors[19]
    rows = [(i, v.tolist(), f"t{min(i % 5, 1)}", [f"g{i % 3}", f"g{i % 4}"] if i % 9 else None) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, scope string, groups array<string>").repartition(3)
    asked = df.where("id % 6 = 0")
    out = {}
    for r in retrieval.nearest(df, asked, 4, scope="scope", groups=groups).collect():
        out.setdefault(r.question_id, []).append((r["rank"], r.chunk_id, round(r.score, 9), round(r.low, 9), round(r.high, 9)))
    want = {}
    for i, v, s, g in rows[::6]:
        seen = [(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w, t, h in rows if t == s and np.linalg.norm(v) and np.linalg.norm(w) and (not groups or set(g or []) & set(h or []))]
        if seen:
            best = sorted(seen, key=lambda x: (-round(x[0], 12), x[1]))[:4]
            want[i] = [(k + 1, j, round(x, 9), round(min(seen)[0], 9), round(max(seen)[0], 9)) for k, (x, j) in enumerate(best)]
    assert {k: sorted(v) for k, v in out.items()} == want


def test_hybrid_equals_scoring_everything(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    chunks = [(i, " ".join(rng.choice(words[: 3 + i % 6]) for _ in range(rng.randint(1, 12))), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    asked = [(0, "alpha zeta", [1.0, 0.0, 0.2]), (1, "nothing here", [0.0, 1.0, 0.1]), (2, "theta eta eta", [0.3, 0.3, -1.0])]
    c = spark.createDataFrame(chunks, "chunk_id bigint, text string, vector array<double>")
    q = spark.createDataFrame(asked, "question_id bigint, question string, qvec array<double>")
    out = [(r.question_id, r["rank"], r.chunk_id) for r in retrieval.hybrid(c, q, 3, first=8).collect()]
    pairs = c.join(q, F.lit(True)).select("question_id", "chunk_id", retrieval.cosine(F.col("vector"), F.col("qvec")).alias("score"))
    scoped = lambda df: df.withColumn("scope", F.lit(0))
    lexical = retrieval.bm25(scoped(c), scoped(q), scope=["scope"]).select("question_id", "chunk_id", F.greatest("bm25", F.lit(0.0)).alias("bm25"))
    fused = retrieval.fuse(pairs, lexical, keys=["question_id", "chunk_id"]).select("question_id", "chunk_id", F.round("score", 9).alias("fused"))
    first = retrieval.top_k_each(fused.withColumn("score", F.col("fused")), "question_id", 8, "chunk_id").collect()
    texts, asks = {i: t for i, t, _ in chunks}, {i: t for i, t, _ in asked}
    share = lambda r: len(set(asks[r.question_id].split()) & set(texts[r.chunk_id].split())) / len(set(asks[r.question_id].split()))
    want = []
    for k in asks:
        mine = sorted((r for r in first if r.question_id == k), key=lambda r: (-share(r), -r.fused, r.chunk_id))[:3]
        want += [(k, n + 1, r.chunk_id) for n, r in enumerate(mine)]
    assert sorted(out) == want


def test_texts_that_contain_a_passage(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(80, "xa b cy"), (81, ""), (82, None)]
    asked = [(0, "a b c"), (1, "b b d a"), (2, "a"), (3, "d c"), (4, "z z z"), (5, "a b")]
    out = retrieval.containing(spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame(asked, "question_id int, question string"))
    assert sorted(map(tuple, out.collect())) == sorted((q, i) for q, p in asked for i, t in texts if t and p in t)


def test_vectors_and_chunks_must_match(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "position int, text string"), spark.createDataFrame([(0, 1.0), (1, 2.0)], "position int, v double")
    assert [tuple(r) for r in retrieval.zipped(a, b).orderBy("position").collect()] == [(0, "x", 1.0), (1, "y", 2.0)]
    with pytest.raises(Exception, match="differ in number"):
        retrieval.zipped(a, b.where("position = 0")).collect()


def test_the_later_row_of_a_batch_wins(spark, tmp_path):
    table = upsert.PointTable(spark, str(tmp_path / "points"))
    table.create()
    assert table.exists() and table.count() == 0
    rows = spark.createDataFrame([("a", "t1", "s", f"text {i}") for i in range(50)], "chunk_id string, tenant_id string, source string, text string").coalesce(1)
    other = upsert.PointTable(spark, str(tmp_path / "other"))
    assert other.upsert(rows, 0) == 1 and other.read().first().text == "text 49" and other.count() == 1


# Settings, reports, ingest


def test_page_lists_and_labels():
    assert config.selected_pages(5) == [0, 1, 2, 3, 4] and config.selected_pages(5, start=1, end=3) == [1, 2] and config.selected_pages(5, indexes=[4, 0, 4]) == [0, 4]
    for bad in ({"start": 3, "end": 3}, {"end": 6}, {"indexes": []}, {"indexes": [5]}, {"indexes": [-1]}, {"indexes": [1], "start": 1}):
        with pytest.raises(ValueError):
            config.selected_pages(5, **bad)
    assert config.labelled_paths(["a = x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    for bad in (["a"], ["=x"], ["a="], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            config.labelled_paths(bad)


def test_artefacts_and_results(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, "two\nlines")], "document_id string, page_number int, index_text string")
    reports.write_artefacts(pages, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/text"), wholetext=True).count() == 2 and spark.read.json(str(tmp_path / "out/pages")).count() == 2
    kind = "document_id string, embedded_chunks int, ingestion_status string, source string, extraction_route string, quality_level string"
    good = spark.createDataFrame([("a", 1, "indexed", "s", "native", "accepted"), ("b", 0, "needs_review", "s", "native", "needs_review")], kind)
    assert reports.indexed_or_raise(good).count() == 2
    with pytest.raises(Exception, match="nothing to index in s"):
        reports.indexed_or_raise(spark.createDataFrame([("a", 0, "failed", "s", "native", "failed")], kind)).collect()


def test_ingest_fails_loud_where_it_is_asked_to(spark, tmp_path):
    docs = spark.createDataFrame([("a", "s", "word " * 30), ("b", "s", "x")], ingest.LANDING)
    table, jobs = upsert.PointTable(spark, str(tmp_path / "p")), str(tmp_path / "j")
    with pytest.raises(ingest.NothingIndexed, match="1 documents"):
        ingest.ingest(docs, table, jobs, tenant_id="t", acl_groups=["g"], seq=0, settings=config.Settings())
    assert spark.read.parquet(jobs).count() == 2 and table.count() == 1
    uploads = spark.createDataFrame([("../A.DOCX", bytearray(b"x")), ("b.exe", bytearray(b"y")), ("", bytearray(b"z"))], "filename string, content binary")
    out = {r.source: (r.status, r.stored_name) for r in ingest.spool(uploads, str(tmp_path / "landing"), [".docx"], tenant_id="t", acl_groups=["g"]).collect()}
    assert out["../A.DOCX"][0] == "accepted" and "/" not in out["../A.DOCX"][1] and out["../A.DOCX"][1].endswith(".docx")
    assert out["b.exe"] == ("unsupported_format", None) and out[""] == ("filename_required", None)


def test_wrapped_engines(spark):
    docs = spark.createDataFrame([("a", ".pdf")], "document_id string, extension string")

    def missing():
        raise ImportError("no engine")

    def broken():
        def run(documents, options):
            raise KeyError("/private/path")

        return run

    for make, outcome in ((missing, "unavailable"), (broken, "failed")):
        engine = router.Wrapped("adaptive", frozenset({".pdf"}), make, {KeyError: router.Encrypted})
        assert [r.outcome for r in router.staged(docs, [engine], router.Options("t")).collect()] == [outcome]
    with pytest.raises(router.Encrypted) as caught:
        router.Wrapped("adaptive", frozenset(), broken, {KeyError: router.Encrypted}).extract(docs, router.Options("t"))
    assert "/private" not in str(caught.value) and caught.value.kind == "encrypted"
    assert math.isclose(len(schema.BLOCK_TYPES), 10)
