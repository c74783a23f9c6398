"""Texts longer than what operators hold at once: whole results, as for any other text."""

import random
import zlib

import brute
import numpy as np
import pytest
from conftest import DOCS, rows
from pyspark.sql import functions as F

from stratadoc.llm import fingerprints, mixing, packing, queries, suffix_dedup, token_counts

SECRET = "token=abcdefghij"


@pytest.fixture(scope="module")
def long_texts():
    """9 MB in 7000 lines, above the largest slice; the same with a changed line; one more with a third of its lines."""
    rng = random.Random(1)
    lines = [" ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(50_000)}z" for _ in range(150)) for _ in range(7000)]
    lines[3500] += " " + SECRET
    return {0: "\n".join(lines), 1: "\n".join([*lines[:5000], "a line that was changed in this copy", *lines[5001:]]), 2: "\n".join(lines[::3]), 3: "a short text of ten words that is no copy here"}


@pytest.fixture(scope="module")
def long_docs(spark, long_texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows(long_texts), DOCS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    assert len(long_texts[0]) > 8_000_000
    return path


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality_rules(spark, long_docs, long_texts):
    out = by_id(queries.op1_quality_rules(spark, long_docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out == {d: tuple(brute.quality(t).values()) for d, t in long_texts.items()}


def test_line_dedup(spark, long_docs, long_texts):
    assert by_id(queries.op2_line_dedup(spark, long_docs), "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(long_texts)


def test_suffix_dedup(spark):
    rng = random.Random(2)
    body = "".join(rng.choices("abcdefghijklmnop \n", k=2_000_000))
    df = spark.createDataFrame([(1, body), (2, "x" * 50 + body + "y" * 50), (3, None)], "doc_id bigint, text string")
    out = by_id(suffix_dedup.dedup_substrings(df), "n_bytes", "n_removed", "n_spans")
    assert out == {1: (2_000_000, 0, 0), 2: (2_000_100, 2_000_000, 1), 3: (0, 0, 0)}


def test_near_dedup(spark, long_docs):
    out = by_id(queries.op4_minhash_near_dedup(spark, long_docs), "n_shingles", "component_id", "kept")
    assert {d: v[1:] for d, v in out.items()} == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True)} and out[0][0] == 7000 * 150 + 1 - 3


def test_fingerprints(spark, long_docs, long_texts):
    out = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, long_docs).collect()}
    assert out[0].n_chars == len(long_texts[0]) and out[0].near_next > 0.99 and out[1].near_next == pytest.approx(1 / 3, abs=0.25) and out[2].near_next < 0.3
    f = fingerprints.fingerprint(F.col("text"))
    df = spark.read.parquet(f"{long_docs}/documents.parquet").where("doc_id = 0").select("text", F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("turned"))
    assert df.select(f == fingerprints.fingerprint(F.col("turned"))).first()[0]


def test_token_counts(spark, long_docs, long_texts):
    library = token_counts.ranks(token_counts.default_model()).library
    assert by_id(queries.op6_token_counts(spark, long_docs), "n_tokens") == {d: (len(library.encode(t)),) for d, t in long_texts.items()}


def test_mixing(spark, long_docs):
    docs = spark.read.parquet(f"{long_docs}/documents.parquet")
    assert by_id(mixing.select(docs, F.lit("d"), {}, percent=100), "n_tokens")[1] == (6999 * 150 + 1 + 8,)


def test_secrets(spark, long_docs, long_texts):
    assert by_id(queries.op8_secret_scan(spark, long_docs), "n_assign", "n_access", "n_hex", "base_sha256") == {d: brute.secrets(t) for d, t in long_texts.items()}


def test_packing(spark, long_docs, long_texts):
    encode = packing.default_encoder()
    out = sorted(queries.op9_best_fit_packing(spark, long_docs).collect(), key=lambda r: (r.doc_id, r.piece))
    for d, text in long_texts.items():
        own = np.array([*encode(text), 2], "<u4")
        mine = [r for r in out if r.doc_id == d]
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)]).tolist()[:-1] and sum(r.length for r in mine) == len(own)
        assert all(r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) for r in mine)
