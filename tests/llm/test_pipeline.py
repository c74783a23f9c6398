"""The pipeline against the same stages by brute force."""

import zlib

import brute
import corpus_pipeline
import numpy as np
from conftest import DOCS, prose, rows

from stratadoc.llm import packing, queries


def test_stages_take_effect(spark, docs, corpus):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    held = dict(corpus)
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, docs)
        assert df.columns == [c.split()[0] for c in DOCS.split(", ")]
        got = {r.doc_id: r.text for r in df.collect()}
        if name == "quality_rules":
            assert set(got) <= {d for d, t in held.items() if not brute.quality(t)["base_failed"]} and 5 in got and 121 not in got
        elif name == "line_dedup":
            want = brute.line_dedup(held)
            assert {d: brute.sha(t or "") for d, t in got.items()} == {d: v[2] for d, v in want.items()}
        else:
            assert set(got) == {d for d, v in brute.near_components(held, size=5).items() if v[2]}
        held = got
    mixed = corpus_pipeline.mix_sources(spark, df, docs)
    domain = lambda source: "web" if source[-1] in "01234" else "books"
    rows_ = {r.doc_id: (domain(r.source), r.lang or "", r.source, r.text) for r in df.collect()}
    want = brute.mix(rows_, queries.MIX_WEIGHTS, percent=corpus_pipeline.MIX_PERCENT, max_epochs=1, seed=1)
    assert {r.doc_id for r in mixed.collect()} == set(want) and mixed.columns == df.columns and 0 < len(want) < len(rows_)
    pieces = corpus_pipeline.run(spark, docs).collect()
    encode = packing.default_encoder()
    assert {r.doc_id for r in pieces} == set(want)
    for d in want:
        own = np.array([*encode(held[d] or ""), 2], "<u4")
        mine = sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == d)
        assert sum(n for _, n, _ in mine) == len(own) and all(x == zlib.crc32(own[s : s + n].tobytes()) for s, n, x in mine)
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for part in bins.values():
        assert [o for o, _ in sorted(part)] == np.cumsum([0, *(n for _, n in sorted(part))]).tolist()[:-1] and sum(n for _, n in part) <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in pieces) // 1024) + 2


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_nulls_and_repeats(spark, tmp_path):
    """Null, empty, short and repetitive texts are rejected; of repeated rows one stays, with or without a source; a row without an id isn't compared."""
    good, other = prose(70, 90), prose(71, 90)
    rest = "\n".join(x for x in good.split("\n") if len(x.strip()) < 10)  # what a copy keeps of its lines
    texts = rows({1: None, 2: "", 3: "word " * 100, 4: good})
    more = [(None, other, None, None, None), (5, good, None, None, None), (6, other + " x", None, "", 1)]
    spark.createDataFrame([*texts, *texts, (None, "a b c " * 3, None, None, None), *more], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality_rules", "line_dedup", "minhash_near_dedup"):
        df = stages[name](spark, df, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in df.collect()) == sorted([(0, other), (4, good), (5, rest), (6, other + " x")])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} <= {None, 4, 5, 6} and len(pieces) == len({(r.doc_id, r.piece) for r in pieces})
