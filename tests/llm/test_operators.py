"""Each operator against brute force on a small corpus with planted cases, and on odd inputs."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCS, prose, rows
from pyspark.sql import functions as F

from stratadoc.llm import fingerprints, line_dedup, lyndon_sort, minhash, mixing, packing, quality_rules, queries, secret_scan, suffix_dedup, token_counts, url_filter


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1 quality rules


def test_quality_counts_equal_brute_force(spark, docs, corpus):
    out = by_id(queries.op1_quality_rules(spark, docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, text in corpus.items():
        want = brute.quality(text)
        assert out[d][:6] == tuple(want.values()), d
        assert not (want["base_failed"] and out[d][6])
    assert out[5][6] and not out[126][6] and not out[127][6] and not out[121][6]


def test_quality_order_never_changes_the_verdict(spark, docs, no_docs, odd_docs):
    df = queries.documents(spark, docs)
    fitted = quality_rules.Cascade(sample_rows=50).fit(df)
    values = [m.value for m in fitted.measured]
    assert values == sorted(values, reverse=True) and len(values) == len(quality_rules.RULES)
    turned = quality_rules.Cascade()
    turned.measured = fitted.measured[::-1]
    assert by_id(fitted.judge(df), "kept") == by_id(turned.judge(df), "kept")
    assert quality_rules.Cascade().fit(no_docs).judge(no_docs).count() == 0
    judged = quality_rules.Cascade().judge(odd_docs)
    assert judged.count() == 5 and judged.columns == odd_docs.columns and judged.where("kept").count() == 0


def test_repeated_windows_are_told_by_their_words(spark, monkeypatch):
    """With hashes of four values most windows collide, and the counts are the same."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [" ".join(map(str, range(80))), "x " * 30, prose(1, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: (brute.quality(t)["n_repeat_words"],) for i, t in enumerate(texts)}
    assert by_id(quality_rules.with_features(df, ["n_repeat_words"]), "n_repeat_words") == want
    monkeypatch.setattr(quality_rules, "_window_hash", lambda w, i: F.ascii(F.get(w, i)).cast("long") % 2)
    assert by_id(quality_rules.with_features(df, ["n_repeat_words"]), "n_repeat_words") == want


# 2 line dedup


def test_line_dedup_equals_brute_force(spark, docs, corpus):
    out = by_id(queries.op2_line_dedup(spark, docs), "n_lines", "n_dropped", "kept_sha256")
    assert out == brute.line_dedup(corpus)
    assert sum(v[1] for v in out.values()) > 20


def test_line_index_is_incremental_and_reversible(spark, docs):
    df = queries.documents(spark, docs)
    first, second = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    key = lambda index: {(bytes(r.key), r.n_docs, r.first_doc, r.last_doc) for r in index.counts.collect()}
    whole = line_dedup.LineIndex(spark, n_shards=8).insert(df)
    half = line_dedup.LineIndex(spark, n_shards=8).insert(first)
    both = half.insert(second)
    assert key(both) == key(whole)
    assert by_id(both.dedup(df), "text") == by_id(whole.dedup(df), "text")
    undone = both.delete(second.select("doc_id"))
    assert key(undone) == key(half)
    again = line_dedup.LineIndex.open(spark, undone.store.path)  # as another session would
    for index in (undone, again, again.compact()):
        for row in index.filters.collect():  # no false negative is left or made
            held = line_dedup.CuckooFilter.loads(row.blob)
            mine = [bytes(r.key) for r in index.counts.where(F.col("shard") == row.shard).collect()]
            assert not mine or held.contains(np.frombuffer(b"".join(mine), "<u8").reshape(-1, 2)).all()
        assert key(index) == key(half)
    back = line_dedup.LineIndex.open(spark, undone.store.path).insert(second, steps=3)
    packed = back.compact()
    assert key(back) == key(whole) == key(packed)
    assert by_id(packed.dedup(df), "text") == by_id(whole.dedup(df), "text")
    with pytest.raises(Exception, match="FileAlreadyExists"):  # a version has one successor
        undone.insert(second)
    with pytest.raises(ValueError):
        line_dedup.LineIndex(spark, path=undone.store.path)


def test_line_index_of_many_keys_is_reversible(spark):
    """240,000 keys in one shard, so that the filter is mistaken about some of the second half."""
    lines = lambda first, ids: spark.range(ids).select((F.col("id") + first).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit("a line of number "), (F.col("id") * 100 + k + first).cast("string"))), "\n").alias("text"))
    old, more = lines(0, 600), lines(1_000_000, 1800)
    key = lambda index: sorted((bytes(r.key), r.n_docs, r.first_doc, r.last_doc) for r in index.counts.collect())
    half = line_dedup.LineIndex(spark, n_shards=1).insert(old)
    both = half.insert(more)
    assert both.counts.count() == 240_000
    undone = both.delete(more.select("doc_id"))
    assert key(undone) == key(half)
    assert undone.seq > both.seq
    again = undone.insert(old.withColumn("doc_id", F.col("doc_id") + 5_000_000))
    assert again.counts.agg(F.count("*"), F.min("n_docs"), F.max("n_docs")).first()[:] == (60_000, 2, 2)
    assert again.repeated().count() == 60_000


def test_rows_that_share_an_id_are_one_document(spark):
    df = spark.createDataFrame([(1, "the same line"), (1, "the same line"), (2, "the same line\nother line"), (None, "the same line")], "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, n_shards=2).insert(df)
    assert sorted(r.n_docs for r in index.counts.collect()) == [1, 2]
    assert sorted(r.n_docs for r in index.delete(df.where("doc_id = 1").select("doc_id")).counts.collect()) == [1, 1]
    assert sorted((r.doc_id or 0, r.n_dropped) for r in index.dedup(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]


@pytest.mark.parametrize("goes, stays", [(2, 0), (1, 1)])
def test_deleting_one_of_two_keys_that_the_filter_confuses(spark, goes, stays):
    """The second line's key is a false positive of the first one's filter; the key that stays is known after the other one goes."""
    key = lambda line: np.frombuffer(line_dedup.line_key(line.encode(), 10), "<u8").reshape(-1, 2)
    held = line_dedup.CuckooFilter()
    held.add(key("the first line"))
    many = [f"another line {i}" for i in range(1_500_000)]
    lines = ["the first line", many[int(held.contains(np.concatenate([key(x) for x in many])).argmax())]]
    assert held.contains(key(lines[1])).all()
    of = lambda doc, line: spark.createDataFrame([(doc, line)], DOCS.split(", lang")[0])
    index = line_dedup.LineIndex(spark, n_shards=1).insert(of(1, lines[0])).insert(of(2, lines[1]))
    index = index.delete(of(goes, "").select("doc_id")).insert(of(3, lines[stays]))
    assert [(bytes(r.key), r.n_docs) for r in index.counts.collect()] == [(key(lines[stays]).tobytes(), 2)]
    assert [r.first_doc for r in index.repeated().collect()] == [stays + 1]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    held = line_dedup.CuckooFilter()
    for part in np.array_split(keys[:10_000], 7):
        held.add(part)
        held = line_dedup.CuckooFilter.loads(held.dumps())
    assert held.contains(keys[:10_000]).all()
    assert held.contains(keys[10_000:]).mean() < 0.01
    assert not held.remove(keys[:9_000])  # a fingerprint in several layers: some key's place is open
    one = [held.contains(keys[:9_000]).all(), held.remove(keys[:1])]
    assert all(one)
    held = line_dedup.CuckooFilter()
    held.add(keys[:10_000])
    assert held.remove(keys[:9_000])
    assert held.contains(keys[9_000:10_000]).all() and held.contains(keys[:9_000]).mean() < 0.01


def test_line_dedup_odd_inputs(spark, odd_docs, no_docs):
    out = line_dedup.LineIndex(spark, n_shards=4).insert(odd_docs).dedup(odd_docs)
    assert out.count() == 5 and out.agg(F.sum("n_dropped")).first()[0] == 0
    assert out.where("doc_id = 2").first().text is None
    assert line_dedup.LineIndex(spark, n_shards=4).insert(no_docs).dedup(no_docs).count() == 0


# 3 suffix dedup


def test_suffix_arrays_equal_sorting():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab" if k % 2 else b"abcdef") for _ in range(rng.randint(0, 60))) for k in range(200)] + [b"a" * 50, b"ab" * 30, b""]
    symbols = np.concatenate([np.r_[np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0] for t in texts])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out = lyndon_sort.suffix_arrays(symbols, bounds)
    for k, t in enumerate(texts):
        assert (out[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == sorted(range(len(t) + 1), key=lambda i: t[i:])


@pytest.mark.parametrize("block", [24, 2])
def test_suffix_dedup_equals_brute_force(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTENTS", block)
    out = by_id(queries.op3_suffix_dedup(spark, docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert out == brute.substring_dedup(corpus)


def test_suffix_dedup_on_repetitive_texts(spark):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice(["ab", "ba", "abc" * 20, "x" * 70, "\n"]) for _ in range(rng.randint(0, 40))) for i in range(60)}
    df = spark.createDataFrame(rows(texts), DOCS)
    out = by_id(suffix_dedup.dedup_substrings(df), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    want = brute.substring_dedup(texts)
    assert {d: v[:4] for d, v in out.items()} == want
    assert all(brute.sha(bytes(v[4])) == v[3] for v in out.values())


def test_suffix_dedup_odd_inputs(spark, odd_docs, no_docs):
    assert suffix_dedup.dedup_substrings(odd_docs).agg(F.count("*"), F.sum("n_removed")).first()[:] == (5, 0)
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0


# 4 near duplicates


def test_near_duplicates_equal_brute_force(spark, docs, corpus):
    out = by_id(queries.op4_minhash_near_dedup(spark, docs), "n_shingles", "component_id", "kept")
    assert out == brute.near_components(corpus)
    assert out[45][1] == 5 and out[70][1] == 3 and out[114][1] == 113 and out[123][1] == 122


def test_near_duplicates_in_large_mixed_groups(spark, monkeypatch):
    """Copies of one text with few to many edits: some are linked, some only through others, some not."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 20)
    rng = random.Random(9)
    base = prose(1, 120).split()
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts[i * 3] = " ".join(words)
    df = spark.createDataFrame(rows(texts), DOCS)
    out = by_id(minhash.NearDuplicates(shingle_words=4).components(df), "n_shingles", "component_id", "kept")
    want = brute.near_components(texts)
    assert out == want and 1 < len({v[1] for v in want.values()}) < 150


@pytest.mark.parametrize("rows_a_block", [20, 2])
def test_near_duplicates_of_one_template(spark, monkeypatch, rows_a_block):
    """Pages of one template with parts from a small stock: most are alike but not alike enough, so that blocks, and at 2 rows prefixes, must find the links."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_a_block)
    rng = random.Random(10)
    frame, stock = prose(2, 70).split(), [prose(300 + k, 8) for k in range(9)]
    texts = {i: " ".join([*frame[:35], *rng.sample(stock, 4), *frame[35:]]) for i in range(160)}
    df = spark.createDataFrame(rows(texts), DOCS)
    out = by_id(minhash.NearDuplicates(shingle_words=4).components(df), "n_shingles", "component_id", "kept")
    want = brute.near_components(texts)
    assert out == want and 1 < len({v[1] for v in want.values()}) < 160


def test_near_duplicates_of_many_short_rows_in_one_batch(spark):
    """More rows to an Arrow batch than a slice may have."""
    texts = {i: f"row {i % 7001} of many {i % 7001} rows" for i in range(20_000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50000")
    try:
        out = by_id(minhash.NearDuplicates(shingle_words=4).components(df), "n_shingles", "component_id", "kept")
    finally:
        spark.conf.set(key, before)
    assert out == {i: (3, i % 7001, i < 7001) for i in texts}


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words of both letters collide in any polynomial modulo 2**64 with an odd base."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z")], "doc_id bigint, text string")
    assert by_id(minhash.NearDuplicates(shingle_words=4).components(df), "component_id") == {k: (k,) for k in (1, 2, 3, 4)}


def test_near_dedup_judges_rows_that_share_an_id_by_their_texts(spark):
    x, y, z = prose(1, 50), prose(2, 50), prose(3, 50)
    near = y + " and one word"
    df = spark.createDataFrame([(3, y, "a"), (7, x, "b"), (7, y, "c"), (3, z, "d"), (3, z, "d"), (9, z, "e"), (3, near, "f"), (None, y, "g"), (5, "", "h")], "doc_id bigint, text string, signature string")
    kept = sorted((r.doc_id or 0, r.text, r.signature) for r in minhash.NearDuplicates().dedup(df).collect())
    firsts = [t for t in (y, near)]
    assert [k for k in kept if k[1] not in firsts] == sorted([(5, "", "h"), (3, z, "d"), (7, x, "b")])
    assert len([k for k in kept if k[1] in firsts and k[0]]) == 1 and (0, y, "g") in kept
    judged = minhash.NearDuplicates().components(df).where("doc_id = 7").collect()
    assert sorted((r.component_id, r.kept) for r in judged) == [(3, False), (7, True)]


def test_candidates_are_found_at_the_threshold(spark):
    """Pairs of a similarity just at 0.8: the measured recall of signatures is whole."""
    texts = {}
    for k in range(300):
        words = [f"p{k}w{i}" for i in range(93)]
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join([*words[:40], *(f"q{k}x{i}" for i in range(6)), *words[46:]]) if k % 2 else " ".join(words[: 74 + 1])
    want = brute.near_components(texts)
    out = by_id(minhash.NearDuplicates(shingle_words=4).components(spark.createDataFrame(rows(texts), DOCS)), "n_shingles", "component_id", "kept")
    assert out == want and sum(not v[2] for v in want.values()) == 300


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_BYTES", 1000)
    texts = {0: prose(4, 3000), 1: "x" * 9000, 2: "x" * 9000 + " y", 3: " \n" * 4000 + "a b c d e"}
    texts[4] = texts[0] + " more"
    df = spark.createDataFrame(rows(texts), DOCS)
    assert by_id(minhash.NearDuplicates(shingle_words=4).components(df), "n_shingles", "component_id", "kept") == brute.near_components(texts)
    shingler = minhash.Shingler(4, 5)
    for text in texts.values():
        assert len(shingler.sets(pa.array([text]))[1]) == len(brute.shingles(text))


def test_near_duplicates_odd_inputs(spark, odd_docs, no_docs):
    out = minhash.NearDuplicates().components(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [(-3, 1, -3, True), (0, 3, 0, True), (1, 10, 1, True), (1, 10, 1, True), (2, 0, 2, True)]
    assert minhash.NearDuplicates().components(no_docs).count() == 0 and minhash.NearDuplicates().dedup(no_docs).count() == 0
    left = minhash.NearDuplicates().dedup(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [-3, 0, 1, 2] and left.where("signature <> 'x'").count() == 0


# 5 fingerprints


def test_fingerprints(spark, docs, corpus):
    ids = sorted(corpus)
    out = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, docs).collect()}
    prints = {}
    for d, after in zip(ids, ids[1:] + ids[:1]):
        text, other = corpus[d] or "", corpus[after] or ""
        half = len(text) // 2
        assert out[d].n_chars == len(text) and out[d].edited_sha256 == brute.sha(text[: len(text) - half] + other[:half])
        assert prints.setdefault(text, out[d].fingerprint) == out[d].fingerprint
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    assert len(set(prints.values())) == len(prints)
    plain = [out[d] for d in range(39)]
    assert np.mean([r.near_edited for r in plain]) > 0.25 > np.mean([r.near_next for r in plain])


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("one two. three\nfour", "three\nfour\none two.", "one two.", "three\nfour")], "a string, b string, c string, d string")
    f = {c: fingerprints.fingerprint(F.col(c)) for c in "abcd"}
    row = df.select((f["a"] == f["b"]).alias("order"), (fingerprints.combine(f["c"], f["d"]) == f["a"]).alias("insert"), (fingerprints.retract(f["a"], f["d"]) == f["c"]).alias("delete"), (f["a"] == f["c"]).alias("other")).first()
    assert row[:] == (True, True, True, False)


def test_likeness_of_texts_that_repeat_a_line(spark):
    """Counts of a line repeated to more than 16 bits hold; half of the text is half as much."""
    texts = {n: "\n".join(["x" * 100] * n) for n in (200, 328, 400, 656)}
    texts[65536] = "\n".join(["x" * 128] * 512)
    df = spark.createDataFrame([(texts[a], texts[b], kept) for a, b, kept in ((400, 200, 0.5), (656, 328, 0.5), (656, 400, 400 / 656))] + [(texts[65536], "x" * 128, 1 / 512)], "a string, b string, kept double")
    f = {c: fingerprints.fingerprint(F.col(c)) for c in "ab"}
    for row in df.select(fingerprints.likeness(f["a"], f["b"]).alias("near"), "kept").collect():
        assert row.near == pytest.approx(row.kept)
    joined = fingerprints.combine(f["a"], f["b"])
    assert [abs(sum(r[0])) for r in df.select(fingerprints.counts(joined)).collect()] == [60000, 98400, 105600, 65664]
    assert df.select((fingerprints.retract(joined, f["b"]) == f["a"]).alias("same")).where("not same").count() == 0


def test_next_rows_over_many_buckets(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    ids = random.Random(2).sample(range(-500, 10_000), 300)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(6)
    out = {r.doc_id: r["__next"] for r in fingerprints.with_next(df).collect()}
    order = sorted(ids)
    assert out == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    same = [(None if i % 2 else 7, f"u{i}") for i in range(200)] + [(i, f"v{i}") for i in range(50)]
    got = {r.text: r["__next"] for r in fingerprints.with_next(spark.createDataFrame(same, "doc_id bigint, text string").repartition(5)).collect()}
    at, seen = "v0", []
    for _ in range(250):  # one ring through all rows, by key
        seen.append(at)
        at = got[at]
    keys = [1 << 63 if t[0] == "u" and int(t[1:]) % 2 else 7 if t[0] == "u" else int(t[1:]) for t in seen]
    assert at == "v0" and len(set(seen)) == 250 and keys == sorted(keys)
    assert len(fingerprints._cuts([7] * 8 + [9])) == 9
    assert fingerprints.with_next(odd_docs).count() == 5 and fingerprints.with_next(no_docs).count() == 0


# 6 token counts


def test_token_counts_equal_the_library(spark, docs, corpus, monkeypatch):
    library = token_counts.ranks(token_counts.default_model()).library
    out = by_id(queries.op6_token_counts(spark, docs), "n_bytes", "n_tokens", "over_limit")
    for d, text in corpus.items():
        n = len(library.encode(text or ""))
        assert out[d] == (len((text or "").encode()), n, n > 4096), d


@pytest.mark.parametrize("long", [2048, 3])
def test_merging_equals_the_library_on_odd_texts(monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    rng = random.Random(4)
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "é", "日", "the", "ing", "​", "1", "<", "/s>", "in", "er", "\0", "😀", "<s>"]
    texts = ["", " ", "▁▁a", "x" * 5000, "ab" * 3000, " " * 300] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    counter = token_counts.PieceRanks(token_counts.default_model())
    assert counter.count(texts) == [len(x) for x in counter.library.encode(texts)]


def test_token_counts_odd_inputs(odd_docs, no_docs):
    assert token_counts.count_tokens(odd_docs).count() == 5 and token_counts.count_tokens(no_docs).count() == 0


# 7 mixing


def test_mixing_keeps_to_budgets_and_weights(spark, docs):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    weights = {"source": {"src1": 5}}
    out = mixing.select(df, F.lit("all"), weights, percent=50, max_epochs=2, seed=3)
    total = df.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    used = out.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert 0.35 * total < used <= 0.5 * total
    again = mixing.select(df.repartition(3), F.lit("all"), weights, percent=50, max_epochs=2, seed=3)
    assert sorted(out.collect()) == sorted(again.collect())


@pytest.mark.parametrize("percent, epochs, seed", [(60, 2, 1), (80, 1, 1), (150, 3, 5), (7, 1, 9)])
def test_mixing_equals_brute_force(spark, docs, corpus, percent, epochs, seed):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    domain = lambda source: {True: "web"}.get(source[-1] in "01234", "books" if source[-1] in "56789" else "other")
    held = {r.doc_id: (domain(r.source), r.lang or "", r.source, r.text) for r in df.collect()}
    want = brute.mix(held, queries.MIX_WEIGHTS, percent=percent, max_epochs=epochs, seed=seed)
    out = mixing.select(df, queries.mix_domain(), queries.MIX_WEIGHTS, percent=percent, max_epochs=epochs, seed=seed)
    assert {d: n for d, (n,) in by_id(out, "copies").items()} == want and set(held) == set(corpus)


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 1000)], "domain string, lang string, source string, tokens bigint")
    out = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, {}, percent=50, max_epochs=1).collect()}
    assert out[("a", "x")] == 10 and out[("a", "y")] + 10 == out[("b", "x")] == 502


def test_mixing_odd_inputs(spark, odd_docs, no_docs):
    held = odd_docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    assert mixing.select(held, F.lit(None).cast("string"), {}, percent=100).count() == 5
    assert mixing.select(no_docs, F.lit("d"), {}).count() == 0


# 8 secrets


def test_secrets_equal_brute_force(spark, docs, corpus):
    out = by_id(queries.op8_secret_scan(spark, docs), "n_assign", "n_access", "n_hex", "base_sha256")
    assert out == {d: brute.secrets(t) for d, t in corpus.items()}
    assert out[124][:3] == (2, 1, 1)


def test_secrets_of_a_very_long_text(spark):
    """A match in every few words, and places beyond the basic plane."""
    text = "".join(f"😀 token={'a' * (7 + i % 3)} AKIAABCDEFGHIJ{'KLMNO' * (i % 2)} é{i:032x}\n" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, text[1:])], "doc_id bigint, text string")
    out = {r.path: r.spans for r in secret_scan.BlobLedger(spark).scan(df, path="doc_id").collect()}
    for k, t in ((1, text), (2, text[1:])):
        base = [(s.start, s.kind, f"{secret_scan.KINDS[s.kind].name}:{s.start}:{s.end}") for s in out[k] if s.kind < 3]
        assert brute.sha(",".join(x for *_, x in base)) == brute.secrets(t)[3] and len(base) > 6000


def test_ledger_is_found_again_at_its_path(spark, tmp_path):
    df = spark.createDataFrame([("a", "token=abcdefghij"), ("b", "plain")], "path string, text string")
    first = secret_scan.BlobLedger(spark, path=str(tmp_path / "ledger"))
    first.scan(df).collect()
    again = secret_scan.BlobLedger(spark, path=str(tmp_path / "ledger"))
    more = spark.createDataFrame([("c", "token=abcdefghij"), ("d", "secret: abcdefgh12")], "path string, text string")
    assert {r.path: len(r.spans) for r in again.scan(more).collect()} == {"c": 1, "d": 1} and again.unseen.count() == 1
    again.compact()
    last = secret_scan.BlobLedger(spark, path=str(tmp_path / "ledger"))
    assert last.scanned.count() == 3 and last.findings.count() == 2 and len(last.store.parts("scanned")) == 1
    assert {r.path: len(r.spans) for r in last.scan(df.union(more)).collect()} == {"a": 1, "b": 0, "c": 1, "d": 1} and last.unseen.count() == 0


def test_ledger_scans_only_unseen_blobs(spark):
    held = [("a", "token=abcdefghij ghp_" + "a1" * 15), ("b", "plain"), ("c", "token=abcdefghij ghp_" + "a1" * 15)]
    df = spark.createDataFrame(held, "path string, text string")
    ledger = secret_scan.BlobLedger(spark)
    found = {r.path: len(r.spans) for r in ledger.scan(df).collect()}
    assert found == {"a": 2, "b": 0, "c": 2} and ledger.unseen.count() == 2
    more = spark.createDataFrame([("d", held[0][1]), ("b", "now secret = 12345678")], "path string, text string")
    assert {r.path: len(r.spans) for r in ledger.scan(more).collect()} == {"d": 2, "b": 1} and ledger.unseen.count() == 1
    ledger.rules = "2"
    ledger.scan(df).collect()
    assert ledger.unseen.count() == 2


def test_secrets_odd_inputs(spark, odd_docs, no_docs):
    assert secret_scan.BlobLedger(spark).scan(odd_docs, path="doc_id").count() == 5
    assert secret_scan.BlobLedger(spark).scan(no_docs, path="doc_id").count() == 0


# 9 packing


def test_packing_is_an_exact_cut_and_a_packing(spark, docs, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = queries.op9_best_fit_packing(spark, docs).collect()
    by_doc = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(corpus)
    for d, held in by_doc.items():
        ids = np.array([*library.encode(corpus[d] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(held):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in pieces) // 1024) + 2


def test_encoder_equals_the_library_on_odd_texts():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.default_encoder()
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x85", "é", "日本", "'s", "'LL", "1", "٣", "_", "-", "😀", "<|endoftext|>", "́", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert own(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_plan_packs_everything_and_near_the_least():
    rng = random.Random(8)
    for capacity in (10, 50, 1024):
        for _ in range(30):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
            bins = packing.plan(counts, capacity)
            left = dict(counts)
            for lengths, times in bins:
                assert times > 0 and sum(lengths) <= capacity
                for n in lengths:
                    left[n] -= times
            assert not any(left.values())
            lower = max(-(-sum(n * k for n, k in counts.items()) // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))
            assert sum(t for _, t in bins) <= 1.25 * lower + 1


def test_reduction_never_costs_a_bin():
    """Small instances against the best packing by search."""
    from functools import lru_cache

    def least(items, capacity):
        @lru_cache(None)
        def go(left):
            if not left:
                return 0
            best = len(left)
            first, rest = left[0], left[1:]
            for mask in range(1 << len(rest)):
                chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
                if first + sum(chosen) <= capacity:
                    best = min(best, 1 + go(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
            return best

        return go(tuple(sorted(items, reverse=True)))

    rng = random.Random(12)
    for _ in range(60):
        capacity = rng.randint(5, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 7))]
        counts = {n: items.count(n) for n in items}
        bins, left = packing._reduce(counts, capacity)
        rest = [n for n, k in left.items() for _ in range(k)]
        assert sum(t for _, t in bins) + least(rest, capacity) == least(items, capacity), (items, capacity)


def test_packing_odd_inputs(odd_docs, no_docs):
    assert packing.pack(odd_docs).count() == 5 and packing.pack(no_docs).count() == 0


# 10 URLs


@pytest.fixture(scope="module")
def urls(spark, tmp_path_factory):
    rng = random.Random(1)
    held = [(i, f"https://{rng.choice(['WWW.', '', 'm.'])}{rng.choice(['a', 'b', 'example'])}.{rng.choice(['com', 'org', 'net'])}{rng.choice(['/fr/', '/de/', '/es/', '/en/1', '/en/2', ''])}{rng.randrange(99)}{rng.choice(['', '?a=1&b=2', '#x'])}") for i in range(600)]
    held += [(600, None), (601, "no scheme"), (602, "://"), (603, "http://COM/de/?x"), (604, "http://xcom/de/1"), (605, "http://example.org/en/1"), (606, "http://a.b.example.org/es/x#f/y"), (607, "")]
    path = str(tmp_path_factory.mktemp("urls"))
    spark.createDataFrame(held, "page_id bigint, url string").write.parquet(f"{path}/pages.parquet")
    return path, dict(held)


def test_urls_follow_the_rules(spark, urls):
    path, held = urls
    out = {r.page_id: r for r in queries.op10_url_filter(spark, path).collect()}
    assert set(out) == set(held)
    for i, address in held.items():
        host, path_, rule, verdict = brute.url(address)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path_, rule), address
        assert out[i].verdict == (verdict or out[i].verdict) and out[i].verdict in ("allow", "block")


def test_trees_learn_what_is_held_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] + x[:, 3] > 0.5)).astype(float)
    trees = url_filter.BoostedTrees().fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0) == y[3000:]).mean() > 0.93


def test_trees_on_held_out_urls(spark):
    """Trees of three quarters of the labelled URLs judge the others better than the larger class does."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    judge = url_filter.UrlFilter(queries.URL_RULES)
    known = judge.parsed(pages).where("label is not null").withColumn("truth", F.col("label"))
    held_out = F.pmod(F.xxhash64(F.lit("out"), "url"), F.lit(4)) == 0
    # what is held out has no label while features and trees are made
    parsed = known.withColumn("label", F.when(~held_out, F.col("label"))).withColumn("row", F.struct("truth")).drop("truth")
    featured = judge.featured(parsed, url_filter.Scratch(spark, "test")).cache()
    trees = judge.fit(featured)
    out = featured.where("label is null").select("row.truth", "x").toArrow()
    y = np.array([t == "block" for t in out.column("truth").to_pylist()])
    right = ((trees.score(url_filter._matrix(out.column("x"))) > 0) == y).mean()
    assert len(y) > 200 and right > max(y.mean(), 1 - y.mean()) + 0.05, (right, y.mean())


def test_url_features(spark):
    text = "HTTP://a1.b.co/x/y?p=1&q=2#f?z=1"
    df = spark.createDataFrame([(text,), (None,), ("http://h/" + "ab" * 500_000,)], "url string")
    rows_ = url_filter.UrlFilter(queries.URL_RULES).parsed(df).collect()
    x = dict(zip(url_filter.LEXICAL, rows_[0].x))
    entropy = -sum(c / len(text) * np.log2(c / len(text)) for c in map(text.count, set(text)))
    assert x["entropy"] == pytest.approx(entropy) and x["digit_ratio"] == pytest.approx(4 / len(text))
    assert [x[k] for k in ("url_length", "host_length", "path_length", "host_depth", "path_depth", "n_params", "query_length", "has_fragment")] == [32, 7, 4, 2, 2, 2, 7, 1]
    assert tuple(rows_[0].s) == ("co", "b.co", "co/x") and rows_[1].x[0] == 0 and rows_[1].x[6] == 0
    assert rows_[2].x[0] == 1_000_009 and rows_[2].x[6] == pytest.approx(1.0, abs=0.01)


def test_own_label_is_not_among_the_features(spark):
    """Every URL has a suffix of its own: the statistics of all folds but its own say nothing of it."""
    df = spark.createDataFrame([(f"http://h{i}.u{i}/", ("allow", "block")[i % 2]) for i in range(400)], "url string, mark string")
    judge = url_filter.UrlFilter([])
    featured = judge.featured(judge.parsed(df, label="mark"), url_filter.Scratch(spark, "test"))
    assert {tuple(r.x[len(url_filter.LEXICAL) :]) for r in featured.collect()} == {(0.0, 0.5) * 3}


def test_url_odd_inputs(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.UrlFilter(queries.URL_RULES).judge(empty).count() == 0
    clash = "label fold seen_suffix1 suffix1 s x row fit __fit s_suffix1 own"
    held = [(1, "http://x.net/", "h", *["mine"] * len(clash.split()))] * 2
    one = spark.createDataFrame(held, "page_id bigint, url string, host string, " + ", ".join(f"{c} string" for c in clash.split()))
    out = url_filter.UrlFilter(queries.URL_RULES).judge(one).collect()
    assert [r.verdict for r in out] == ["allow", "allow"] and all(r[c] == "mine" for r in out for c in clash.split()) and out[0].host == "x.net"
    assert url_filter.UrlFilter(queries.URL_RULES).judge(spark.createDataFrame([(1, "http://a.com/de/"), (2, None)], "page_id bigint, url string")).where("verdict = 'block'").count() == 2
