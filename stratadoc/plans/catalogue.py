"""The registered queries: each applies an operator to whole tables; SQL stands beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, quality, tables, text
from ..operators import access, candidates, chunking, evaluate, layout, pages, rbac, reports, retrieval, upsert
from ..sources import markup
from . import inputs
from .inputs import ACTOR, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL that several oracles share.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _split(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_WS}+'), lambda x: x <> '')"


def _ocr(c: str) -> str:
    out = f"translate(coalesce({c}, ''), chr(1610) || chr(1609) || chr(1603) || chr(1600) || chr(8205) || chr(65279) || chr(173), chr(1740) || chr(1740) || chr(1705))"
    out = f"regexp_replace({out}, '\\r\\n?', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[ \t\x{{a0}}]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' *\\n *', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^{_WS}+|{_WS}+$', '', 'g')"


def _metrics(source: str, c: str, garbage: str, carry: str = "*") -> str:
    """Common table expressions that end in m: source with the five metrics of column c, and the ratios before they are rounded."""
    return rf"""n0 AS (SELECT *, {_ocr(c)} AS norm FROM {source}),
n1 AS (SELECT *, regexp_replace(norm, '{_WS}', '', 'g') AS comp, regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+') AS toks FROM n0),
n2 AS (SELECT *, CASE WHEN length(comp) = 0 THEN 0.0 ELSE (length(comp) - length(regexp_replace(comp, '[\p{{L}}\p{{N}}]', '', 'g'))) / length(comp) END AS raw_meaningful,
  CASE WHEN length(comp) = 0 THEN 1.0 ELSE (length(comp) - length(regexp_replace(comp, '[{garbage}\p{{Cc}}\p{{Cs}}\p{{Co}}]', '', 'g'))) / length(comp) END AS raw_garbage,
  CASE WHEN length(comp) = 0 OR len(toks) = 0 THEN 1.0 ELSE 1 - len(list_distinct(list_transform(toks, lambda x: replace(lower(x), 'ß', 'ss')))) / len(toks) END AS raw_repetition FROM n1),
m AS (SELECT *, round(raw_meaningful + 1e-9, 4) AS meaningful_ratio, round(raw_garbage + 1e-9, 4) AS garbage_ratio, round(raw_repetition + 1e-9, 4) AS repetition_ratio,
  length(comp) AS character_count, CASE WHEN length(comp) = 0 THEN 0 ELSE len(toks) END AS word_count FROM n2)"""


_SCORE = "CASE WHEN character_count = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, 100 * (meaningful_ratio * 0.45 + (1 - garbage_ratio) * 0.25 + (1 - repetition_ratio) * 0.15 + least(character_count / 200, 1.0) * 0.15))) + 1e-9, 2) END"
_LEVEL = "CASE WHEN {0} >= 90 THEN 'accepted' WHEN {0} >= 70 THEN 'accepted_with_warning' WHEN {0} >= 40 THEN 'needs_review' ELSE 'failed' END"
_GROUPS = "['g' || ({0} % 5), 'g' || ({0} % 7)]"
_VECTORS = "v AS (SELECT vec_id, embedding AS vector, label, 't' || (label % 4) AS tenant_id, ['g' || (vec_id % 5), 'g' || (vec_id % 7)] AS acl_groups FROM embeddings)"
_SEEN = "tenant_id = 't1' AND list_has_any(acl_groups, ['g1', 'g3'])"
_DOCS = "d AS (SELECT *, 't' || (doc_id % 4) AS tenant_id, ['g' || (doc_id % 5), 'g' || (doc_id % 7)] AS acl_groups FROM documents)"
_CHUNKS = f"""w AS (SELECT doc_id, source, {_split('text')} AS ws FROM documents),
i AS (SELECT doc_id, source, ws, unnest(range(0, len(ws), 448)) AS b FROM w),
p AS (SELECT doc_id, source, b, array_to_string(list_slice(ws, b + 1, b + 512), ' ') AS chunk_text FROM i),
c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS chunk_index, chunk_text FROM p WHERE length(chunk_text) > 50)"""


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Access and vectors


@query(f"WITH {_VECTORS}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, label, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM v, q WHERE {_SEEN} ORDER BY list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def acl_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the nearest visible chunks of one question."""
    seen = access.SecureChunks(inputs.vectors(spark, sf_dir), ACTOR).frame()
    hits = retrieval.search(seen, inputs.question_vector(spark, sf_dir), 10)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTORS}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), t AS (SELECT *, list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s FROM v, q ORDER BY s DESC, CAST(vec_id AS VARCHAR) LIMIT 10) SELECT vec_id, {_SEEN} AS allowed FROM t")
def acl_postfilter_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative control: ranked without a filter, so that hits leak."""
    hits = retrieval.search(inputs.vectors(spark, sf_dir), inputs.question_vector(spark, sf_dir), 10)
    return hits.select("vec_id", access.visible(ACTOR).alias("allowed"))


@query(f"WITH {_DOCS} SELECT doc_id, source FROM d WHERE {_SEEN}")
def acl_visible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.SecureChunks(inputs.documents(spark, sf_dir), ACTOR).frame().select("doc_id", "source")


@query(f"WITH {_VECTORS}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT *, {_SEEN} AS ok, list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s FROM v, q), a AS (SELECT * FROM s WHERE ok ORDER BY s DESC, CAST(vec_id AS VARCHAR) LIMIT 10), b AS (SELECT * FROM s ORDER BY s DESC, CAST(vec_id AS VARCHAR) LIMIT 10) SELECT 'filtered' AS kind, count(*) FILTER (WHERE NOT ok) AS leaks FROM a UNION ALL SELECT 'control', count(*) FILTER (WHERE NOT ok) FROM b")
def acl_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits outside what the identity may see, with the filter and without."""
    every, vector = inputs.vectors(spark, sf_dir), inputs.question_vector(spark, sf_dir)
    allowed = access.SecureChunks(every, ACTOR).frame()
    count = lambda kind, hits: access.leaks(hits, allowed).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("leaks"))
    return count("filtered", retrieval.search(allowed, vector, 10)).unionByName(count("control", retrieval.search(every, vector, 10)))


@query(f"WITH {_VECTORS}, s AS (SELECT q.vec_id AS question_id, v.vec_id, list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS score FROM v q JOIN v ON v.tenant_id = q.tenant_id AND list_has_any(v.acl_groups, q.acl_groups) WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank FROM s) SELECT question_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a question, against all that its groups may see."""
    chunks = inputs.vectors(spark, sf_dir)
    questions = chunks.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), "tenant_id", F.col("acl_groups").alias("groups"), F.col("vector").alias("qvec"))
    hits = retrieval.search_many(chunks, questions, 5)
    return hits.select("question_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH q AS (SELECT vec_id AS a, embedding AS e FROM embeddings WHERE vec_id % 20 = 0) SELECT a, vec_id AS b, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> a QUALIFY row_number() OVER (PARTITION BY a ORDER BY list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) DESC, vec_id) = 1")
def vector_self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of every vector whose id is divisible by 20: the query set goes to all rows, in blocks."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = retrieval.nearest(held, held.where("id % 20 = 0"), 2).where("chunk_id <> question_id")
    best = hits.groupBy("question_id").agg(F.min_by(F.struct("chunk_id", "score"), "rank").alias("h"))
    return best.select(F.col("question_id").alias("a"), F.col("h.chunk_id").alias("b"), F.round("h.score", 6).alias("score"))


# Chunks and ids


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_index, length(chunk_text) AS n_chars, md5(chunk_text) AS text_md5 FROM c")
def split_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chunking.fixed_chunks(table(spark, sf_dir, "documents"))
    return held.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk_text").cast("long").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


@query(f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, count(DISTINCT doc_id) AS documents, min(length(chunk_text)) AS least, max(length(chunk_text)) AS most, round(avg(length(chunk_text)), 4) AS mean FROM c GROUP BY source")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("n", F.length("chunk_text").cast("long"))
    return held.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query(f"WITH {_CHUNKS}, k AS (SELECT source || '-' || doc_id || '_' || chunk_index AS chunk_id FROM c), s AS (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM k) SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM s")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    named = held.select(F.concat(F.concat_ws("-", "source", F.col("doc_id").cast("string")), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"))
    return named.withColumn("point_id", ids.point_id(F.col("chunk_id")))


def _structural(most: int) -> str:
    """Common table expressions that end in sc: doc_id, chunk_index, kind, n_blocks, block numbers and text of structural groups of most words."""
    window = most - min(64, most - 1)
    return rf"""sb AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
sw AS (SELECT doc_id, i, ls[i + 1] AS t, len({_split('ls[i + 1]')}) AS w, instr(ls[i + 1], '|') > 0 AND i > 0 AS tab FROM sb),
sg AS (SELECT doc_id, i, w, tab OR w > {most} AS alone, tab, CASE WHEN tab OR w > {most} THEN 0 ELSE w END AS held, 1 AS grp FROM sw WHERE i = 0
UNION ALL SELECT b.doc_id, b.i, b.w, b.tab OR b.w > {most}, b.tab, CASE WHEN b.tab OR b.w > {most} THEN 0 WHEN g.alone OR (g.held > 0 AND g.held + b.w > {most}) THEN b.w ELSE g.held + b.w END,
CASE WHEN b.tab OR b.w > {most} OR g.alone OR (g.held > 0 AND g.held + b.w > {most}) THEN g.grp + 1 ELSE g.grp END FROM sg g JOIN sw b ON b.doc_id = g.doc_id AND b.i = g.i + 1),
st AS (SELECT sg.doc_id, grp, bool_or(alone) AS alone, bool_or(sg.tab) AS tab, max(sg.w) AS w, list(sg.i ORDER BY sg.i) AS ids, string_agg(sw.t, chr(10) || chr(10) ORDER BY sg.i) AS t FROM sg JOIN sw ON sw.doc_id = sg.doc_id AND sw.i = sg.i GROUP BY sg.doc_id, grp),
sp AS (SELECT doc_id, grp, 0 AS b, tab, ids, t FROM st WHERE NOT alone OR w <= {most}
UNION ALL SELECT * FROM (SELECT doc_id, grp, b, tab, ids, array_to_string(list_slice(ws, b + 1, b + {most}), ' ') AS t FROM (SELECT doc_id, grp, tab, ids, ws, unnest(range(0, len(ws), {window})) AS b FROM (SELECT *, {_split('t')} AS ws FROM st WHERE alone AND w > {most}))) WHERE length(t) > 50),
sq AS (SELECT doc_id, grp, b, CASE WHEN tab THEN 'table' ELSE 'text' END AS kind, ids, regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM sp),
sc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, b) - 1 AS chunk_index, kind, len(ids) AS n_blocks, ids, t FROM sq WHERE t <> '')"""


def _chunk_id(parts: str) -> str:
    h = f"sha1(unhex('{ids.NAMESPACE.hex}') || encode({parts}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1] || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"WITH RECURSIVE {_structural(200)} SELECT doc_id, chunk_index, kind, n_blocks, md5(t) AS text_md5 FROM sc")
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents in groups of up to 200 words."""
    held = chunking.page_chunks(inputs.blocks(spark, sf_dir), 200)
    return held.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "kind", F.size("block_ids").cast("long").alias("n_blocks"), F.md5("text").alias("text_md5"))


@query(rf"""WITH RECURSIVE {_structural(512)}, l AS (SELECT *, regexp_replace(t, '{_WS}', '', 'g') AS s FROM sc) SELECT doc_id, {_chunk_id("'chunk' || chr(31) || doc_id || chr(31) || 'structural-v1' || chr(31) || chunk_index")} AS chunk_id, CASE WHEN (length(s) - length(regexp_replace(s, '[\x{{0600}}-\x{{06FF}}]', '', 'g'))) / greatest(length(s), 1) > 0.5 THEN 'fa' ELSE 'en' END AS lang, '{{"type":"page","num":' || (doc_id + 1) || ',"page_id":"' || doc_id || '","strategy":"structural-v1","kind":"' || kind || '","block_ids":[' || array_to_string(list_transform(ids, lambda i: '"' || i || '"'), ',') || ']}}' AS location FROM l""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = chunking.document_chunks(inputs.blocks(spark, sf_dir), ["g1", "g3"])
    return held.select("doc_id", "chunk_id", "lang", F.to_json("location").alias("location"))


_HEADS = rf"\n{_WS}*ماده\p{{Nd}}+"


@query(f"WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), t AS (SELECT doc_id, chr(10) || string_agg('ماده' || CASE WHEN doc_id % 2 = 0 THEN CAST(i AS VARCHAR) ELSE translate(CAST(i AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') END || ' ' || ls[i], chr(10) || ' ' ORDER BY i) AS t FROM l GROUP BY doc_id), h AS (SELECT doc_id, regexp_extract_all(t, '{_HEADS}') AS hs, regexp_split_to_array(t, '{_HEADS}') AS ps FROM t), a AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS i, hs, ps FROM h) SELECT doc_id, i - 1 AS article, md5(hs[i] || ps[i + 1]) AS body_md5 FROM a")
def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered as articles, in ASCII or Persian digits, then split at the headings again."""
    digits = lambda n: F.when(F.col("doc_id") % 2 == 0, n).otherwise(F.translate(n, "0123456789", "۰۱۲۳۴۵۶۷۸۹"))
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("ماده"), digits((i + 1).cast("string")), F.lit(" "), x)), "\n ")
    held = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_articles(F.concat(F.lit("\n"), numbered))).alias("article", "body"))
    return held.select("doc_id", F.col("article").cast("long").alias("article"), F.md5("body").alias("body_md5"))


def _folded(c: str) -> str:
    """What layers are compared by: case and variants folded, blanks reduced (composition leaves these texts as they are)."""
    return f"trim(regexp_replace(translate(replace(lower({c}), 'ß', 'ss'), chr(1610) || chr(1609) || chr(1603) || chr(8204) || chr(1600), chr(1740) || chr(1740) || chr(1705) || ' '), '{_WS}+', ' ', 'g'))"


@query(rf"WITH d AS (SELECT doc_id, text AS n, CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), '  ') WHEN 1 THEN replace(text, 'a', 'A') WHEN 2 THEN replace(text, 'e', 'o') ELSE '' END AS o FROM documents), s AS (SELECT doc_id, regexp_replace(n, '^{_WS}+|{_WS}+$', '', 'g') AS n, regexp_replace(o, '^{_WS}+|{_WS}+$', '', 'g') AS o FROM d) SELECT doc_id, md5(CASE WHEN n = '' THEN o WHEN o = '' OR {_folded('n')} = {_folded('o')} THEN n ELSE n || chr(10) || chr(10) || o END) AS text_md5 FROM s")
def layer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that differ by line breaks, by case, by letters, and one alone."""
    t, k = F.col("text"), F.col("doc_id") % 4
    o = F.when(k == 0, F.replace(t, F.lit("\n"), F.lit("  "))).when(k == 1, F.replace(t, F.lit("a"), F.lit("A"))).when(k == 2, F.replace(t, F.lit("e"), F.lit("o"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chunking.layer_text(t, o)).alias("text_md5"))


# Text and quality


@query(rf"WITH {_metrics('documents', 'text', quality.GARBAGE_TEXT)} SELECT doc_id, meaningful_ratio, garbage_ratio, repetition_ratio, character_count, word_count FROM m")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.with_text_metrics(table(spark, sf_dir, "documents"))
    return held.select("doc_id", "meaningful_ratio", "garbage_ratio", "repetition_ratio", F.col("character_count").cast("long").alias("character_count"), F.col("word_count").cast("long").alias("word_count"))


@query(rf"WITH {_metrics('documents', 'text', quality.GARBAGE_TEXT)}, s AS (SELECT doc_id, {_SCORE} AS score FROM m) SELECT doc_id, score, {_LEVEL.format('score')} AS level FROM s")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.with_text_score(table(spark, sf_dir, "documents"))
    return held.select("doc_id", F.col("text_score").alias("score"), quality.level(F.col("text_score")).alias("level"))


@query(rf"WITH {_metrics('documents', 'text', quality.GARBAGE_TEXT)}, s AS (SELECT lang, {_SCORE} AS score FROM m), l AS (SELECT lang, score, {_LEVEL.format('score')} AS level FROM s) SELECT lang, level, count(*) AS n, round(avg(score), 4) AS mean_score FROM l GROUP BY lang, level")
def quality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.with_text_score(table(spark, sf_dir, "documents")).withColumn("level", quality.level(F.col("text_score")))
    return held.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("text_score"), 4).alias("mean_score"))


_PAGE = rf"""pg AS (SELECT doc_id, source AS document_id, lang, text AS index_text, text AS native_text, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS ocr_text, CASE WHEN doc_id % 29 = 0 THEN 'empty' ELSE 'digital' END AS page_type,
  CASE WHEN doc_id % 10 = 9 THEN 'needs_review' WHEN doc_id % 41 = 0 THEN 'failed' ELSE 'accepted' END AS ps, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS dq, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 90 AS DOUBLE) END AS da,
  doc_id % 23 = 0 AS rejected, doc_id % 4 AS nf FROM documents),
{_metrics('pg', 'index_text', quality.GARBAGE_TEXT)},
q0 AS (SELECT *, {_SCORE} AS ts, length(comp) = 0 AS blank, trim(ocr_text) <> '' AS has_ocr FROM m),
q1 AS (SELECT *, blank OR page_type = 'empty' AS is_empty, CASE WHEN dq IS NULL THEN ts ELSE 0.6 * ts + 0.4 * dq END AS mx FROM q0),
q2 AS (SELECT *, round(greatest(0.0, least(100.0, CASE WHEN NOT blank AND has_ocr AND da IS NOT NULL THEN 0.85 * mx + 0.15 * da ELSE mx END)) + 1e-9, 2) AS sc FROM q1),
q3 AS (SELECT *, CASE WHEN is_empty THEN 0.0 WHEN rejected THEN least(sc, 39.99) ELSE sc END AS score FROM q2),
q4 AS (SELECT *, least(CASE WHEN score >= 90 THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 2 ELSE 1 END, CASE ps WHEN 'accepted' THEN 4 WHEN 'needs_review' THEN 2 ELSE 1 END) AS lv FROM q3),
pq AS (SELECT *, ['failed', 'needs_review', 'accepted_with_warning', 'accepted'][lv] AS level, CASE WHEN lv >= 3 THEN 'accepted' WHEN lv = 2 THEN 'needs_review' ELSE 'failed' END AS status FROM q4)"""
_DOC = _PAGE + """,
dq0 AS (SELECT document_id, count(*) AS total_pages, count(*) FILTER (WHERE status = 'accepted') AS accepted_pages, count(*) FILTER (WHERE status = 'needs_review') AS needs_review_pages, count(*) FILTER (WHERE status = 'failed') AS failed_pages, count(*) FILTER (WHERE is_empty) AS empty_pages, round(avg(score) + 1e-9, 2) AS score FROM pq GROUP BY document_id),
dd AS (SELECT *, ['failed', 'needs_review', 'accepted_with_warning', 'accepted'][CASE WHEN accepted_pages = 0 THEN least(2, lv) ELSE lv END] AS level FROM (SELECT *, CASE WHEN score >= 90 THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 2 ELSE 1 END AS lv FROM dq0))"""


@query(f"WITH {_PAGE} SELECT doc_id, is_empty, score, level, status, array_to_string(list_filter([CASE WHEN rejected AND NOT is_empty THEN 'extraction_route_rejected' END, CASE WHEN nf > 0 THEN 'fallback_route_used' END, CASE WHEN rejected THEN 'quality_gate_not_passed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM pq")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.page_quality(inputs.pages(spark, sf_dir))
    return held.select("doc_id", "is_empty", "score", "level", "status", F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {_DOC} SELECT document_id, total_pages, accepted_pages, needs_review_pages, failed_pages, empty_pages, score, level FROM dd")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(quality.page_quality(inputs.pages(spark, sf_dir))).drop("warnings")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.pages(spark, sf_dir)
    with_bars = table(spark, sf_dir, "documents").where(F.instr("text", "|") > 0).select(F.col("source").alias("document_id"))
    failed = table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select(F.concat(F.lit("file "), F.col("item_id").cast("string")).alias("document_id"), F.lit("unreadable").alias("error"))
    return reports.file_reports(quality.document_quality(quality.page_quality(held)), held, with_bars, failed)


@query(f"WITH {_DOC}, tb AS (SELECT source AS document_id, count(*) AS n FROM documents WHERE instr(text, '|') > 0 GROUP BY source) SELECT document_id, total_pages, accepted_pages, score, level, CAST(coalesce(n, 0) AS BIGINT) AS table_count, (SELECT count(*) FROM documents WHERE source = document_id AND doc_id % 23 > 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)) AS ocr_route_pages FROM dd LEFT JOIN tb USING (document_id) UNION ALL SELECT 'file ' || item_id, NULL, NULL, NULL, NULL, NULL, NULL FROM benchmark WHERE item_id % 3 = 0")
def file_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("document_id", "total_pages", "accepted_pages", "score", "level", "table_count", "ocr_route_pages")


@query(f"WITH {_DOC}, tb AS (SELECT count(*) AS n FROM documents WHERE instr(text, '|') > 0) SELECT count(*) + (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0) AS files, count(*) AS files_extracted, (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0) AS files_failed, CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(sum(accepted_pages) AS BIGINT) AS accepted_pages, CAST(sum(needs_review_pages) AS BIGINT) AS needs_review_pages, CAST(sum(failed_pages) AS BIGINT) AS failed_pages, CAST(any_value(n) AS BIGINT) AS table_count, round(avg(score), 2) AS mean_quality_score, round(sum(accepted_pages) / sum(total_pages), 4) AS page_acceptance_rate FROM dd, tb")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_totals(_reports(spark, sf_dir))


@query("SELECT lang AS pipeline, count(*) AS files, round(avg(CASE WHEN doc_id % 12 > 0 THEN CAST(doc_id % 101 AS DOUBLE) END), 2) AS avg_quality_score, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 7 ELSE 0 END) AS BIGINT) AS accepted_pages, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 3 ELSE 0 END) AS BIGINT) AS needs_review_pages, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 2 ELSE 0 END) AS BIGINT) AS failed_pages, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 5 ELSE 0 END) AS BIGINT) AS table_count, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 4 ELSE 0 END) AS BIGINT) AS warning_count, CAST(sum(CASE WHEN doc_id % 12 > 0 THEN doc_id % 2 ELSE 1 END) AS BIGINT) AS error_count FROM documents GROUP BY lang")
def pipeline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("pipeline"), (c % 101).cast("double").alias("score"), (c % 7).alias("accepted_pages"), (c % 3).alias("needs_review_pages"), (c % 2).alias("failed_pages"), (c % 5).alias("table_count"),
        F.array_repeat(F.lit("w"), (c % 4).cast("int")).alias("warnings"), F.array_repeat(F.lit("e"), (c % 2).cast("int")).alias("errors"), F.when(c % 12 == 0, "failed").alias("error"),
    )
    out = reports.pipeline_totals(rows)
    return out.withColumns({n: F.col(n).cast("long") for n in ("warning_count", "error_count")})


@query(r"WITH d AS (SELECT coalesce(text, '') AS t FROM documents), e AS (SELECT unnest([{'class': 'space', 'n': length(t) - length(regexp_replace(t, '[\t\n\x{0b}\f\r ]', '', 'g'))}, {'class': 'digit', 'n': length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))}, {'class': 'latin', 'n': length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g'))}, {'class': 'latin_extended', 'n': length(t) - length(regexp_replace(t, '[\x{00C0}-\x{024F}]', '', 'g'))}, {'class': 'arabic', 'n': length(t) - length(regexp_replace(t, '[\x{0600}-\x{06FF}]', '', 'g'))}, {'class': 'ascii_other', 'n': length(t) - length(regexp_replace(t, '[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g'))}, {'class': 'all', 'n': length(t)}]) AS s FROM d), g AS (SELECT s.class AS class, CAST(sum(s.n) AS BIGINT) AS n FROM e GROUP BY s.class), o AS (SELECT class, n FROM g WHERE class <> 'all' UNION ALL SELECT 'other', CAST((SELECT n FROM g WHERE class = 'all') - sum(n) AS BIGINT) FROM g WHERE class <> 'all') SELECT class, n, round(n * 100.0 / (SELECT n FROM g WHERE class = 'all'), 4) AS percent FROM o WHERE n > 0")
def codepoint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.codepoint_classes(table(spark, sf_dir, "documents"))


@query(rf"WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS c FROM documents), r AS (SELECT doc_id, CASE WHEN length(c) = 0 THEN 0.0 ELSE (length(c) - length(regexp_replace(c, '[\x{{0600}}-\x{{06FF}}]', '', 'g'))) / length(c) END AS p FROM d) SELECT doc_id, round(p, 6) AS persian_ratio, CASE WHEN p > 0.5 THEN 'fa' ELSE 'en' END AS language FROM r")
def script_ratio_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.persian_ratio(F.col("text")), 6).alias("persian_ratio"), text.language(F.col("text")).alias("language"))


_ROUTER = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(1610) || chr(1609) || chr(1603) || chr(8204) || chr(160) || chr(8205) || chr(65279) || chr(173), chr(1740) || chr(1740) || chr(1705) || '  '), '[ \t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


@query(rf"SELECT doc_id, md5(replace(replace(translate(text, chr(1610) || chr(1603), chr(1740) || chr(1705)), chr(1604) || chr(1575), chr(1575) || chr(1604)), chr(8204), ' ')) AS chars_md5, md5({_ocr('text')}) AS ocr_md5, md5(trim(regexp_replace(replace(regexp_replace({_ocr('text')}, '[\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g'), chr(8204), ' '), '{_WS}+', ' ', 'g'))) AS evaluation_md5, md5(trim(regexp_replace(regexp_replace(replace(lower({_ROUTER}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', ' ', 'g'), '{_WS}+', ' ', 'g'))) AS agreement_md5 FROM documents")
def nfkc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_chars(c)).alias("chars_md5"), F.md5(text.normalize_ocr(c)).alias("ocr_md5"), F.md5(text.normalize_for_evaluation(c)).alias("evaluation_md5"), F.md5(text.normalize_for_agreement(c)).alias("agreement_md5"))


@query("WITH p AS (SELECT source AS file, doc_id, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN translate(text, 'aeiou', 'اویهع') ELSE text END, '" + _WS + r"', '', 'g') AS c FROM documents), t AS (SELECT *, length(c) AS n, CASE WHEN length(c) = 0 THEN 0.0 ELSE (length(c) - length(regexp_replace(c, '[\x{0600}-\x{06FF}]', '', 'g'))) / length(c) END AS fa FROM p) SELECT file, count(*) AS pages, round(avg(n), 2) AS avg_chars, count(*) FILTER (WHERE n < 50) AS empty_pages, round(avg(CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.0 END) * 100, 2) AS table_percent, CAST(sum(doc_id % 4) AS BIGINT) AS images, round(avg(fa) * 100, 2) AS persian_percent FROM t GROUP BY file")
def triage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 5 == 0, F.translate("text", "aeiou", "اویهع")).otherwise(F.col("text")).alias("text")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), body, (F.col("doc_id") % 3).alias("n_tables"), (F.col("doc_id") % 4).alias("n_images"))
    return reports.triage(rows)


@query("SELECT doc_id, CASE WHEN p >= 60 THEN 'strong' WHEN p >= 45 THEN 'good' ELSE 'weak' END AS band, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS elapsed FROM (SELECT doc_id, round((doc_id % 100) / 100 * 100) AS p, n_chars % 1000 AS s FROM documents)")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select("doc_id", text.score_band((c("doc_id") % 100) / 100.0).alias("band"), text.clock(c("n_chars") % 1000).alias("elapsed"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform([1, 2, 3], lambda i: CASE WHEN i = 1 THEN CASE WHEN lang = 'en' THEN 'eng' ELSE lang END WHEN i = 2 AND lang <> 'fr' THEN 'fas' WHEN i = 3 AND lang = 'fr' THEN 'eng' END), lambda x: x IS NOT NULL), ',') AS languages FROM documents")
def required_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang"))
    second = F.when(F.col("lang") == "fr", "eng").otherwise("fas")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.required_languages(F.array(F.concat_ws("+", first, second), first)), ",").alias("languages"))


# Retrieval


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit(ACTOR.tenant_id).alias("tenant_id"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = access.SecureChunks(inputs.documents(spark, sf_dir), ACTOR).frame().select("tenant_id", F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25(seen, _questions(spark, sf_dir), scope=["tenant_id"])


_BM25 = f"""{_DOCS}, ch AS (SELECT doc_id AS chunk_id, {_split('text')} AS ws FROM d WHERE {_SEEN}),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM ch) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM ch),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM tf, st GROUP BY term, n),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS question_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_split('text')}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT question_id, tf.chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))) AS bm25 FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN ch ON ch.chunk_id = tf.chunk_id GROUP BY question_id, tf.chunk_id)"""


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM b) SELECT question_id, chunk_id, round(round(bm25, 6), 4) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as questions; statistics are over what the identity may see."""
    scored = _bm25(spark, sf_dir).select("question_id", "chunk_id", F.round("bm25", 6).alias("score"))
    hits = retrieval.top_k_each(scored, "question_id", 5, "chunk_id")
    return hits.select("question_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25}, m AS (SELECT *, min(bm25) OVER w AS lo, max(bm25) OVER w AS hi FROM b WINDOW w AS (PARTITION BY question_id)) SELECT question_id, chunk_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (bm25 - lo) / (hi - lo) END, 4) AS score FROM m")
def minmax_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _bm25(spark, sf_dir)
    return held.select("question_id", "chunk_id", F.round(retrieval.minmax("bm25", "question_id"), 4).alias("score"))


_HYBRID = f"""{_DOCS}, ch AS (SELECT doc_id AS chunk_id, text, CAST(embedding AS DOUBLE[]) AS v, {_split('text')} AS ws FROM d JOIN embeddings ON vec_id = doc_id WHERE {_SEEN}),
qs AS (SELECT item_id AS question_id, text AS question, CAST(embedding AS DOUBLE[]) AS qv, {_split('text')} AS qws FROM benchmark JOIN embeddings ON vec_id = item_id),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS term FROM ch) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM ch),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM tf, st GROUP BY term, n),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw),
qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(qws) AS term FROM qs) GROUP BY ALL),
b AS (SELECT question_id, tf.chunk_id, greatest(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avgdl))), 0.0) AS bm25 FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN ch ON ch.chunk_id = tf.chunk_id GROUP BY question_id, tf.chunk_id),
s AS (SELECT qs.question_id, ch.chunk_id, list_cosine_similarity(v, qv) AS dense, coalesce(bm25, 0.0) AS bm25, question, text FROM qs CROSS JOIN ch LEFT JOIN b ON b.question_id = qs.question_id AND b.chunk_id = ch.chunk_id),
n AS (SELECT *, min(dense) OVER w AS l1, max(dense) OVER w AS h1, min(bm25) OVER w AS l2, max(bm25) OVER w AS h2 FROM s WINDOW w AS (PARTITION BY question_id)),
f AS (SELECT question_id, chunk_id, question, text, round(0.5 * CASE WHEN h1 = l1 THEN 0.5 ELSE (dense - l1) / (h1 - l1) END + 0.5 * CASE WHEN h2 = l2 THEN 0.5 ELSE (bm25 - l2) / (h2 - l2) END, 9) AS fused FROM n),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, chunk_id) <= 20),
r AS (SELECT question_id, chunk_id, fused, len(list_intersect(list_distinct({_split('lower(question)')}), {_split('lower(text)')})) / len(list_distinct({_split('lower(question)')})) AS score FROM t)"""


@query(f"WITH {_HYBRID}, k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, fused DESC, chunk_id) AS rank FROM r) SELECT question_id, chunk_id, round(score, 6) AS score, round(fused, 6) AS fused, rank FROM k WHERE rank <= 5")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question: dense and BM25 scores of the texts that the identity may see, fused, the 20 best reranked, 5 of them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    seen = access.SecureChunks(inputs.documents(spark, sf_dir), ACTOR).frame()
    chunks = seen.join(vectors, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), "text", "vector")
    questions = table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.col("vector").alias("qvec"))
    hits = retrieval.hybrid(chunks, questions, 5)
    return hits.select("question_id", "chunk_id", F.round("score", 6).alias("score"), F.round("fused", 6).alias("fused"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM b), tr AS (SELECT item_id AS question_id, doc_id AS chunk_id FROM benchmark, documents WHERE doc_id % 4 = 1 AND contains(documents.text, benchmark.text)), h AS (SELECT tr.question_id, min(rank) AS first FROM tr LEFT JOIN r ON r.question_id = tr.question_id AND r.chunk_id = tr.chunk_id AND rank <= 5 GROUP BY tr.question_id) SELECT count(*) AS questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5 FROM h")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents that contain a passage are among its best hits."""
    hits = retrieval.top_k_each(_bm25(spark, sf_dir).select("question_id", "chunk_id", F.round("bm25", 6).alias("score")), "question_id", 5, "chunk_id")
    mine = inputs.documents(spark, sf_dir).where(F.col("tenant_id") == ACTOR.tenant_id)
    truth = retrieval.containing(mine.select(F.col("doc_id").alias("chunk_id"), "text"), _questions(spark, sf_dir))
    return evaluate.recall(hits, truth)


@query(f"WITH {_BM25}, h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 6) DESC, chunk_id) AS rank FROM b), t AS (SELECT question_id, chunk_id, benchmark.text AS question, documents.text AS text FROM h JOIN benchmark ON item_id = question_id JOIN documents ON doc_id = chunk_id WHERE rank <= 20), s AS (SELECT *, len(list_intersect(list_distinct({_split('lower(question)')}), {_split('lower(text)')})) / len(list_distinct({_split('lower(question)')})) AS score FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT question_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || any_value(question)) AS prompt_md5 FROM k WHERE rank <= 5 GROUP BY question_id")
def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best by BM25, reranked by word overlap, as prompts."""
    hits = retrieval.top_k_each(_bm25(spark, sf_dir).select("question_id", "chunk_id", F.round("bm25", 6).alias("score")), "question_id", 20, "chunk_id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    full = hits.join(texts, "chunk_id").join(_questions(spark, sf_dir).select("question_id", "question"), "question_id")
    return retrieval.prompt(retrieval.rerank(full, 5)).select("question_id", F.md5("prompt").alias("prompt_md5"))


# Evaluation


@query(rf"WITH {_metrics('documents', 'text', quality.GARBAGE_TEXT)}, s AS (SELECT doc_id, lang, {_SCORE} AS score FROM m) SELECT lang, count(*) AS n, round(avg(CASE WHEN (score >= 70) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s JOIN labels USING (doc_id) GROUP BY lang")
def categorical_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's verdict against human labels."""
    verdict = quality.with_text_score(table(spark, sf_dir, "documents")).select("doc_id", "lang", (quality.status_of(quality.level(F.col("text_score"))) == "accepted").alias("actual"))
    both = verdict.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected")), "doc_id")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(evaluate.accuracy("actual", "expected"), 6).alias("accuracy"))


@query('SELECT event_type, count(abs(value)) AS "count", round(sum(abs(value)), 4) AS total_ms, round(avg(abs(value)), 6) AS mean_ms, median(abs(value)) AS median_ms, max(abs(value)) AS maximum_ms FROM events GROUP BY event_type')
def duration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = evaluate.durations(table(spark, sf_dir, "events").withColumn("d", F.abs("value")), "d", "event_type")
    return held.withColumns({"total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 6)})


@query(rf"WITH p AS (SELECT item_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS t, trim(regexp_replace(replace(text, 'th', 'd'), '{_WS}+', ' ', 'g')) AS h FROM benchmark WHERE regexp_full_match(text, '[\x00-\x7F]*')) SELECT item_id, round(levenshtein(h, t) / length(t), 6) AS cer FROM p")
def cer_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates of ASCII passages with th misread; SQL's distance counts bytes, so others are in the tests."""
    held = table(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    return held.select("item_id", F.round(evaluate.cer(F.replace("text", F.lit("th"), F.lit("d")), F.col("text")), 6).alias("cer"))


@query()
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates of all passages with th misread."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(evaluate.cer(F.replace("text", F.lit("th"), F.lit("d")), F.col("text")), 6).alias("cer"))


#: A passage without some of its words.
_FEWER = "regexp_replace(text, ' (?:the|and) ', ' ', 'g')"


@query(f"WITH p AS (SELECT item_id, {_split('text')} AS t, {_split(_FEWER)} AS h FROM benchmark) SELECT item_id, round((len(t) - len(h)) / len(t), 6) AS wer FROM p")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of passages that lost some words: what is left is a subsequence, so the SQL needs no alignment."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(evaluate.wer(F.regexp_replace("text", " (?:the|and) ", " "), F.col("text")), 6).alias("wer"))


@query("SELECT lang, round(count(*) FILTER (WHERE doc_id % 5 > 0) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE doc_id % 17 = 0) / count(*), 6) AS failure_rate FROM documents GROUP BY lang")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("doc_id") % 5 > 0).alias("good"), F.count_if(F.col("doc_id") % 17 == 0).alias("bad"), F.count(F.lit(1)).alias("n"))
    return held.select("lang", F.round(evaluate.rate(F.col("good"), F.col("n")), 6).alias("coverage"), F.round(evaluate.rate(F.col("bad"), F.col("n")), 6).alias("failure_rate"))


# Users, roles, sets


def _rbac(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = F.col
    users = table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), c("c_name").alias("username"), F.when(c("c_custkey") == 1, "creator").when(c("c_custkey") % 10 == 0, "admin").otherwise("user").alias("level"), F.concat(F.lit("t"), (c("c_nationkey") % 4).cast("string")).alias("tenant_id"), "c_nationkey")
    user_roles = users.where("c_nationkey % 6 <> 5").select("user_id", c("c_nationkey").alias("role_id"))
    role_permissions = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("role_id"), c("n_regionkey").alias("permission_id"))
    role_permissions = role_permissions.unionByName(role_permissions.select("role_id", ((c("permission_id") + 1) % 5).alias("permission_id")))
    permissions = table(spark, sf_dir, "region").select(c("r_regionkey").alias("permission_id"), F.lower(F.concat("r_name", F.lit(".read"))).alias("name"))
    return users.drop("c_nationkey"), user_roles, role_permissions, permissions


_RBAC = "u AS (SELECT c_custkey AS user_id, c_name AS username, CASE WHEN c_custkey = 1 THEN 'creator' WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS level, 't' || (c_nationkey % 4) AS tenant_id, c_nationkey FROM customer), ur AS (SELECT user_id, c_nationkey AS role_id FROM u WHERE c_nationkey % 6 <> 5), rp AS (SELECT n_nationkey AS role_id, n_regionkey AS permission_id FROM nation UNION ALL SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation), pm AS (SELECT r_regionkey AS permission_id, lower(r_name || '.read') AS name FROM region)"


@query(f"WITH {_RBAC}, h AS (SELECT user_id, list_sort(list_distinct(list(name))) AS p FROM ur JOIN rp USING (role_id) JOIN pm USING (permission_id) GROUP BY user_id) SELECT u.user_id, coalesce(array_to_string(p, ','), '') AS permissions FROM u LEFT JOIN h USING (user_id)")
def effective_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rbac.effective_permissions(*_rbac(spark, sf_dir)).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query(f"WITH {_RBAC}, h AS (SELECT user_id, list(name) AS p FROM ur JOIN rp USING (role_id) JOIN pm USING (permission_id) GROUP BY user_id) SELECT user_id, array_to_string(list_sort(list_filter(list_distinct(p), lambda x: x NOT IN ('asia.read', 'europe.read'))), ',') AS missing FROM h")
def missing_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an actor of two permissions can't grant of each user's."""
    actor = access.Identity("admin_a", "t1", ("g1",), "admin", frozenset({"asia.read", "europe.read"}))
    held = rbac.effective_permissions(*_rbac(spark, sf_dir)).where(F.size("permissions") > 0)
    return held.select("user_id", F.array_join(F.sort_array(rbac.missing_grants(F.col("permissions"), actor)), ",").alias("missing"))


@query("SELECT n_nationkey AS role_id, r_regionkey AS permission_id FROM nation, region WHERE n_regionkey <> r_regionkey AND (n_regionkey + 1) % 5 <> r_regionkey")
def role_gap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions that each role doesn't have."""
    _, _, held, permissions = _rbac(spark, sf_dir)
    every = held.select("role_id").distinct().join(permissions.select("permission_id"))
    return rbac.not_held(every, held, ["role_id", "permission_id"])


@query(f"WITH {_RBAC} SELECT user_id, username, level FROM u WHERE tenant_id = 't1'")
def tenant_scoped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.tenant_scope(_rbac(spark, sf_dir)[0], ACTOR).select("user_id", "username", "level")


@query(f"WITH {_RBAC} SELECT split_part(name, '.', 1) AS resource, string_agg(name, ',' ORDER BY name) AS names FROM pm GROUP BY ALL")
def permission_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rbac.permission_groups(_rbac(spark, sf_dir)[3]).select("resource", F.array_join("names", ",").alias("names"))


_REQUESTS = "r AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' ELSE 'create' END AS action, CASE WHEN o_orderkey % 13 = 0 THEN 10 WHEN o_orderkey % 17 = 0 THEN 1 ELSE o_custkey END AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN 'admin' END AS new_level, CASE WHEN o_orderkey % 4 = 0 THEN 't' || (o_orderkey % 3) END AS new_tenant, 'g' || (o_orderkey % 6) AS g FROM orders)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    target = F.when(c("o_orderkey") % 13 == 0, 10).when(c("o_orderkey") % 17 == 0, 1).otherwise(c("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("request_id"), F.when(c("o_orderkey") % 3 == 0, "update").when(c("o_orderkey") % 3 == 1, "delete").otherwise("create").alias("action"), target.alias("target_id"),
        F.when(c("o_orderkey") % 5 == 0, "admin").alias("level"), F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("t"), (c("o_orderkey") % 3).cast("string"))).alias("tenant_id"), F.array(F.concat(F.lit("g"), (c("o_orderkey") % 6).cast("string"))).alias("acl_groups"),
    )


def _identity(spark: SparkSession, sf_dir: str, user_id: int) -> access.Identity:
    """A user of the tables as who asks."""
    row = _rbac(spark, sf_dir)[0].where(F.col("user_id") == user_id).first()
    return access.Identity(row["username"], row["tenant_id"], ("g1", "g3"), row["level"])


@query(f"WITH {_RBAC}, {_REQUESTS}, me AS (SELECT username AS mine, tenant_id AS home FROM u WHERE user_id = 10) SELECT request_id, CASE WHEN action <> 'create' AND (u.user_id IS NULL OR u.tenant_id <> home) THEN 'not_found' WHEN new_level IS NOT NULL AND new_level <> coalesce(u.level, 'user') THEN 'level_change' WHEN new_tenant IS NOT NULL AND new_tenant <> home THEN 'tenant_scope' WHEN g NOT IN ('g1', 'g3') THEN 'acl_scope' WHEN action = 'delete' AND username = mine THEN 'self_deletion' WHEN u.level = 'creator' AND (action = 'delete' OR new_level IS NOT NULL) THEN 'last_creator' END AS deny_reason FROM me, r LEFT JOIN u ON u.user_id = r.target_id")
def admin_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of user management over requests made of orders, asked by an admin among the users."""
    return rbac.judged_requests(_requests(spark, sf_dir), _rbac(spark, sf_dir)[0], _identity(spark, sf_dir, 10)).select("request_id", "deny_reason")


@query(f"WITH {_RBAC}, {_REQUESTS} SELECT request_id, CASE WHEN action <> 'create' AND u.user_id IS NULL THEN 'not_found' WHEN action = 'delete' AND u.user_id = 1 THEN 'self_deletion' WHEN u.user_id = 1 AND new_level IS NOT NULL THEN 'self_demotion' END AS deny_reason FROM r LEFT JOIN u ON u.user_id = r.target_id")
def creator_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests asked by the only creator."""
    return rbac.judged_requests(_requests(spark, sf_dir), _rbac(spark, sf_dir)[0], _identity(spark, sf_dir, 1)).select("request_id", "deny_reason")


@query("SELECT source, lang AS ref FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source, lang FROM documents WHERE doc_id % 3 = 0")
def source_diff_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of one answer that another doesn't have."""
    held = table(spark, sf_dir, "documents").select("doc_id", "source", F.struct(F.col("lang").alias("ref")).alias("location"))
    return retrieval.unique_sources(held.where("doc_id % 2 = 0"), held.where("doc_id % 3 = 0")).select("source", "ref")


@query("SELECT CASE WHEN lang = 'en' THEN 't0' ELSE 't1' END || ':' || doc_id AS chunk_id, CASE WHEN lang = 'en' THEN 't0' ELSE 't1' END AS tenant_id, CASE WHEN lang = 'en' THEN 'g0' ELSE 'g1,g2' END AS acl_groups FROM documents")
def union_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import union_tenants as union

    held = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "lang")
    every = union([("t0", ["g0"], held.where("lang = 'en'")), ("t1", ["g1", " g2", "g1"], held.where("lang <> 'en'"))])
    return every.select("chunk_id", "tenant_id", F.array_join("acl_groups", ",").alias("acl_groups"))


@query("SELECT source || '/' || lang AS point_id, max(doc_id) AS ingest_seq, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("point_id"), F.col("doc_id").alias("ingest_seq"), "n_chars")
    return upsert.latest(rows)


@query("SELECT doc_id, CASE WHEN e > 0 AND lv = 'accepted' AND w = 0 AND r = 0 THEN 'indexed' WHEN e > 0 THEN 'indexed_with_warnings' WHEN r > 0 THEN 'needs_review' ELSE 'failed' END AS status FROM (SELECT doc_id, doc_id % 3 AS e, CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'needs_review' END AS lv, doc_id % 5 AS w, doc_id % 7 AS r FROM documents)")
def job_status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", reports.ingestion_status(c % 3, F.when(c % 2 == 0, "accepted").otherwise("needs_review"), c % 5, c % 7).alias("status"))


# Candidates, pages, routes


_CAND = rf"""c0 AS (SELECT doc_id, unnest([0, 1, 2]) AS k, text AS t FROM documents),
c1 AS (SELECT doc_id, k, CASE k WHEN 0 THEN t WHEN 1 THEN replace(t, 'th', '□') ELSE regexp_replace(t, '[aeiou]', '', 'g') END AS text, CASE WHEN k = 1 THEN 'region_ocr' ELSE 'full_page_ocr' END AS route, CASE WHEN (doc_id + k) % 11 <> 0 THEN CAST((doc_id * 13 + k * 29) % 101 AS DOUBLE) END AS mc, CAST((doc_id % 50) / 1000.0 AS DOUBLE) AS cov, (doc_id + k) % 17 <> 0 AS sv, doc_id % 5 <> 0 AS ov FROM c0),
{_metrics('c1', 'text', quality.GARBAGE_CANDIDATE)},
c2 AS (SELECT *, 100 * (raw_meaningful * 0.40 + (1 - raw_garbage) * 0.20 + (1 - raw_repetition) * 0.15 + least(character_count / 120, 1.0) * 0.15 + least(greatest(cov, 0.0) / 0.02, 1.0) * 0.10) AS tsc FROM m),
c3 AS (SELECT *, round(greatest(0.0, least(100.0, CASE WHEN mc IS NULL THEN tsc ELSE tsc * 0.70 + mc * 0.30 END)) + 1e-9, 2) AS quality_score FROM c2),
c4 AS (SELECT *, list_filter([CASE WHEN NOT sv THEN 'structurally_invalid' END, CASE WHEN route = 'region_ocr' AND NOT ov THEN 'invalid_region_reading_order' END, CASE WHEN length(comp) < 10 THEN 'ocr_text_too_short' END, CASE WHEN word_count < 2 THEN 'ocr_word_count_below_threshold' END, CASE WHEN mc IS NULL OR mc < 55 THEN 'ocr_confidence_below_threshold' END, CASE WHEN quality_score < 55 THEN 'ocr_quality_below_threshold' END, CASE WHEN meaningful_ratio < 0.55 THEN 'meaningful_character_ratio_below_threshold' END, CASE WHEN garbage_ratio > 0.08 THEN 'garbage_ratio_above_threshold' END, CASE WHEN repetition_ratio > 0.75 THEN 'repetition_ratio_above_threshold' END, CASE WHEN cov < 0.0005 THEN 'ocr_coverage_below_threshold' END], lambda x: x IS NOT NULL) AS reasons, round(greatest(0.0, least(100.0, quality_score * 0.5625 + coalesce(mc, 0.0) * 0.4375)) + 1e-9, 2) AS selection_score FROM c3)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = candidates.scored(inputs.candidates(spark, sf_dir)).withColumn("agreement_score", F.lit(None).cast("double"))
    return candidates.gated(held)


@query(f"WITH {_CAND} SELECT doc_id, k AS candidate_no, quality_score, selection_score, array_to_string(reasons, ',') AS reasons FROM c4")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _gated(spark, sf_dir)
    return held.select(F.col("page_id").cast("long").alias("doc_id"), "candidate_no", "quality_score", "selection_score", F.array_join("rejection_reasons", ",").alias("reasons"))


@query(f"WITH {_CAND}, r AS (SELECT doc_id, k, route, selection_score, row_number() OVER (PARTITION BY doc_id, route ORDER BY selection_score DESC, quality_score DESC, coalesce(mc, 0.0) DESC, CASE WHEN k = 2 THEN 999 ELSE 6 END, sha256(norm)) AS n FROM c4 WHERE len(reasons) = 0), f AS (SELECT * FROM r WHERE n = 1), j AS (SELECT d.doc_id, a.k AS ak, a.selection_score AS asc_, b.k AS bk, b.selection_score AS bsc FROM documents d LEFT JOIN f a ON a.doc_id = d.doc_id AND a.route = 'full_page_ocr' LEFT JOIN f b ON b.doc_id = d.doc_id AND b.route = 'region_ocr') SELECT doc_id, CASE WHEN ak IS NULL AND bk IS NULL THEN NULL WHEN ak IS NULL THEN 'region_ocr' WHEN bk IS NULL THEN 'full_page_ocr' WHEN bsc >= asc_ + 5 THEN 'region_ocr' ELSE 'full_page_ocr' END AS route, CASE WHEN ak IS NULL AND bk IS NULL THEN 'all_ocr_candidates_rejected' WHEN ak IS NULL OR bk IS NULL THEN 'only_one_ocr_route_passed_quality_gate' WHEN bsc >= asc_ + 5 THEN 'region_candidate_met_required_advantage' ELSE 'full_page_candidate_not_outscored_by_region_margin' END AS reason FROM j")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.selected(_gated(spark, sf_dir)).select(F.col("page_id").cast("long").alias("doc_id"), "route", "reason")


def _gated_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = candidates.scored(inputs.candidates(spark, sf_dir, dealt=True))
    return candidates.gated(candidates.with_agreement(held))


@query()
def candidate_gate_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with agreement among a document's candidates, which SQL can't express; candidate_gate's SQL takes each candidate for a single one."""
    held = _gated_agreed(spark, sf_dir)
    return held.select(F.col("page_id").cast("long").alias("doc_id"), "candidate_no", "quality_score", "agreement_score", "selection_score", F.array_join("rejection_reasons", ",").alias("reasons"))


@query()
def candidate_selection_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection from candidate_gate_agreed."""
    return candidates.selected(_gated_agreed(spark, sf_dir)).select(F.col("page_id").cast("long").alias("doc_id"), "route", "reason")


@query()
def candidate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement among the passages of a benchmark item: as it is, misread, without vowels."""
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("page_id"), F.posexplode(F.array(F.col("text"), F.replace("text", F.lit("th"), F.lit("d")), F.regexp_replace("text", "[aeiou]", ""))).alias("candidate_no", "text"))
    return candidates.with_agreement(held).select("page_id", "candidate_no", "agreement_score")


_EVID = rf"""ev AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 6 = 0 THEN '' ELSE substr(text, 1, 20) END FROM documents WHERE doc_id % 6 < 2),
e0 AS (SELECT doc_id, text AS nt, CASE WHEN abs(doc_id) % 9 = 0 THEN 0 ELSE 1 END AS nb, (abs(doc_id) % 8) / 10.0 AS ic, (abs(doc_id) % 13) / 200.0 AS vr, abs(doc_id) % 4 = 0 AS ocr FROM ev),
e1 AS (SELECT *, regexp_replace(nt, '{_WS}', '', 'g') AS comp FROM e0),
e AS (SELECT *, length(comp) AS nc, CASE WHEN length(comp) = 0 THEN 0.0 ELSE round((length(comp) - length(regexp_replace(comp, '[\p{{L}}\p{{N}}]', '', 'g'))) / length(comp), 4) END AS mr FROM e1),
cl AS (SELECT *, nc >= 40 AND mr >= 0.55 AND nb > 0 AS usable FROM e),
pt AS (SELECT doc_id, nt, ocr, usable, CASE WHEN usable AND ic >= 0.25 AND vr >= 0.01 THEN 'mixed' WHEN usable THEN 'digital' WHEN nc >= 5 AND (vr >= 0.05 OR ic >= 0.25 OR ocr) THEN 'mixed' WHEN nc >= 5 THEN 'unknown' WHEN ocr THEN 'scanned' WHEN ic >= 0.5 AND vr >= 0.01 THEN 'scanned' WHEN vr >= 0.05 THEN 'scanned' WHEN vr <= 0.003 THEN 'empty' ELSE 'unknown' END AS page_type FROM cl)"""


@query(f"WITH {_EVID} SELECT doc_id, page_type, usable AS native_usable FROM pt")
def page_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.classified(inputs.evidence(spark, sf_dir)).select("doc_id", "page_type", "native_usable")


@query(f"WITH {_EVID} SELECT page_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pt GROUP BY page_type")
def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_with_share(pages.classified(inputs.evidence(spark, sf_dir)), "page_type")


@query(f"WITH {_EVID} SELECT doc_id, CASE WHEN nc >= 50 THEN 'text' WHEN vr >= 0.01 THEN 'scanned_candidate' ELSE 'empty_or_unknown' END AS page_type FROM e")
def inspector_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.evidence(spark, sf_dir).select("doc_id", pages.inspected_type(F.col("native_characters"), F.col("visual_ratio")).alias("page_type"))


@query(f"WITH {_EVID}, r AS (SELECT doc_id, page_type, trim(nt) <> '' AS hn, abs(doc_id) % 3 = 0 AS ho, abs(doc_id) % 2 = 0 AS ok FROM pt) SELECT doc_id, CASE WHEN hn AND ho AND ok THEN 'combined' WHEN hn THEN 'native' WHEN ho AND ok THEN 'full_page_ocr' ELSE 'rejected' END AS route, CASE WHEN hn AND ho AND ok THEN 'accepted' WHEN hn THEN CASE WHEN page_type = 'digital' AND NOT ho THEN 'accepted' ELSE 'needs_review' END WHEN ho AND ok THEN 'accepted' WHEN ho THEN 'needs_review' ELSE 'failed' END AS status, CASE WHEN hn AND ho AND ok THEN true WHEN hn THEN page_type = 'digital' AND NOT ho ELSE ho AND ok END AS passed FROM r")
def route_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages.classified(inputs.evidence(spark, sf_dir))
    held = held.withColumns({"ocr_text": F.when(F.abs("doc_id") % 3 == 0, "x").otherwise(""), "ocr_passed": F.abs("doc_id") % 2 == 0})
    return pages.routed(held).select("doc_id", "route", "status", "passed")


@query(f"WITH {_EVID}, a AS (SELECT doc_id, page_type, usable, trim(nt) <> '' AS hn, CASE WHEN abs(doc_id) % 5 < 2 THEN 'full_page_ocr' WHEN abs(doc_id) % 5 = 2 THEN 'region_ocr' END AS sr, abs(doc_id) % 5 < 4 AS ho FROM pt) SELECT doc_id, CASE WHEN sr IS NOT NULL AND hn AND page_type = 'mixed' THEN 'combined' WHEN sr IS NOT NULL THEN sr WHEN hn THEN 'native' ELSE 'rejected' END AS route, CASE WHEN sr IS NOT NULL AND hn AND page_type = 'mixed' THEN 'needs_review' WHEN sr IS NOT NULL THEN 'accepted' WHEN hn AND page_type = 'digital' AND usable THEN 'accepted' WHEN hn THEN 'needs_review' WHEN ho THEN 'needs_review' ELSE 'failed' END AS status, array_to_string(list_filter(['r', CASE WHEN sr IS NULL AND hn THEN 'usable_native_text_preserved_after_ocr_rejection' END, CASE WHEN sr IS NOT NULL AND hn AND page_type = 'mixed' THEN 'mixed_layers_preserved_without_coordinate_merge' END, CASE WHEN page_type = 'empty' THEN 'empty_page_detected' END], lambda x: x IS NOT NULL), ',') AS fallback_reasons FROM a")
def adaptive_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages.classified(inputs.evidence(spark, sf_dir))
    n = F.abs("doc_id") % 5
    pick = F.when(n < 2, "full_page_ocr").when(n == 2, "region_ocr")
    held = held.withColumns({"selected_route": pick, "ocr_text": F.when(n < 4, "x").otherwise(""), "reason": F.lit("r"), "first_type": F.col("page_type")})
    return pages.decided(held).select("doc_id", "route", "status", F.array_join("fallback_reasons", ",").alias("fallback_reasons"))


@query("WITH p AS (SELECT doc_id, doc_id % 19 = 0 AS off, ['native', 'full_page_ocr', 'region_ocr', 'combined', 'rejected'][doc_id % 5 + 1] AS route, doc_id % 3 > 0 AS hn, doc_id % 4 > 0 AS ho, doc_id % 9 > 0 AS hi, doc_id % 2 = 0 AS ok, doc_id % 11 = 0 AS unknown, doc_id % 7 > 0 AS gate FROM documents) SELECT doc_id, unnest(list_filter([CASE WHEN off THEN 'page_number' END, CASE WHEN route = 'native' AND NOT hn THEN 'native_without_text' END, CASE WHEN route IN ('full_page_ocr', 'region_ocr') AND NOT ho THEN 'ocr_without_text' END, CASE WHEN route = 'combined' AND NOT (hn AND ho) THEN 'combined_without_both' END, CASE WHEN ok AND (route = 'rejected' OR NOT gate OR NOT hi OR unknown) THEN 'accepted_without_ground' END, CASE WHEN route = 'rejected' AND gate THEN 'rejected_but_passed' END], lambda x: x IS NOT NULL)) AS violation FROM p")
def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that break an invariant; all kinds are put in by arithmetic."""
    d = F.col("doc_id")
    route = F.element_at(F.array(*map(F.lit, ("native", "full_page_ocr", "region_ocr", "combined", "rejected"))), (d % 5 + 1).cast("int"))
    held = table(spark, sf_dir, "documents").select(
        "doc_id", d.alias("page_index"), F.when(d % 19 == 0, d).otherwise(d + 1).alias("page_number"), route.alias("selected_route"), F.when(d % 2 == 0, "accepted").otherwise("needs_review").alias("processing_status"),
        F.when(d % 3 == 0, " ").otherwise("x").alias("native_text"), F.when(d % 4 == 0, "").otherwise("y").alias("ocr_text"), F.when(d % 9 == 0, "").otherwise("z").alias("index_text"), F.when(d % 11 == 0, "unknown").otherwise("digital").alias("page_type"), (d % 7 > 0).alias("gate_passed"),
    )
    return pages.violations(held).select("doc_id", "violation")


@query("SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn * turn) - 1 AS page_index FROM conversations")
def contiguous_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages whose numbers have gaps."""
    held = pages.renumbered(table(spark, sf_dir, "conversations").withColumn("number", F.col("turn") * F.col("turn")), "conv_id", "number")
    return held.select("conv_id", "turn", F.col("page_index").cast("long").alias("page_index"))


_PLAIN = "trim(regexp_replace(" + "replace(" * 6 + "regexp_replace({0}, '<[^>]*>', ' ', 'g')" + "".join(f", '{e}', {c})" for e, c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'"))) + f", '{_WS}+', ' ', 'g'))"


@query(r"WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages), c AS (SELECT page_id, regexp_extract_all(h, '(?i)</?(?:h[1-6]|p|li|table)\b[^>]*>') AS tags, regexp_split_to_array(h, '(?i)</?(?:h[1-6]|p|li|table)\b[^>]*>') AS parts FROM b), r AS (SELECT page_id, unnest(range(0, len(parts))) AS n, tags, parts FROM c), s AS (SELECT page_id, n, parts[n + 1] AS part, CASE WHEN n > 0 THEN lower(tags[n]) ELSE '' END AS tag FROM r), d AS (SELECT *, sum(CASE WHEN tag LIKE '<table%' THEN 1 WHEN tag LIKE '</table%' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS depth FROM s), u AS (SELECT *, max(CASE WHEN depth > 0 AND NOT (depth = 1 AND tag LIKE '<table%') THEN NULL ELSE n END) OVER (PARTITION BY page_id ORDER BY n) AS unit, CASE WHEN depth > 0 THEN 'table' WHEN tag LIKE '<h%' THEN 'heading' WHEN tag LIKE '<li%' THEN 'list_item' ELSE 'paragraph' END AS kind FROM d), g AS (SELECT page_id, unit, arg_min(kind, n) AS block_type, string_agg(part, ' ' ORDER BY n) AS f FROM u GROUP BY page_id, unit), t AS (SELECT page_id, unit, block_type, " + _PLAIN.replace("{0}", "f") + r" AS text FROM g) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY unit) - 1 AS reading_order, block_type, md5(text) AS text_md5 FROM t WHERE text <> ''")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = markup.html_blocks(table(spark, sf_dir, "pages"))
    return held.select("page_id", F.col("reading_order").cast("long").alias("reading_order"), "block_type", F.md5("text").alias("text_md5"))


@query(rf"WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), s AS (SELECT doc_id, n, ls[n + 1] AS raw, CASE WHEN n = 0 THEN 18.0 ELSE 12.0 END AS size FROM l WHERE regexp_replace(ls[n + 1], '{_WS}', '', 'g') <> ''), m AS (SELECT *, median(size) OVER (PARTITION BY doc_id) AS mid, {_ocr('raw')} AS t FROM s), k AS (SELECT * FROM m WHERE t <> '') SELECT CAST(doc_id AS VARCHAR) AS page_id, CAST(n AS INTEGER) AS block_no, CASE WHEN regexp_matches(t, '^(?:[•·◦▪–\-*]|[0-9۰-۹]+[.)]|[a-zA-Z][.)])[ \t]+') THEN 'list_item' WHEN len({_split('t')}) <= 8 AND mid > 0 AND size >= mid * 1.2 AND NOT regexp_matches(t, '[.؟?!]$') THEN 'heading' ELSE 'paragraph' END AS block_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS reading_order FROM k")
def native_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans, the first one larger, as blocks with their types."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    spans = lines.select("page_id", "block_no", F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), "text", F.when(F.col("block_no") == 0, 18.0).otherwise(12.0).alias("size"))
    return pages.native_blocks(spans).select("page_id", "block_no", "block_type", "reading_order")


# Layout


_WORDS = rf"""ln AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
wd AS (SELECT doc_id, line, unnest(range(0, len(ws))) AS no, ws FROM (SELECT doc_id, line, {_split('ls[line + 1]')} AS ws FROM ln)),
wo AS (SELECT doc_id, line, no, ws[no + 1] AS text, line * 10000 + no AS word_no, line + 1 AS block_num, (doc_id * 31 + line * 17 + no * 7) % 103 - 2 AS cf, no % 12 * 70 + 20 AS l, line * 24 % 1500 + no // 12 * 14 AS t FROM wd)"""


@query(f"WITH {_WORDS}, b AS (SELECT doc_id, block_num, min(l) AS l, min(t) AS t, max(l + 60) AS r, max(t + 12) AS b, count(*) AS word_count, avg(cf) AS confidence, md5(string_agg(text, ' ' ORDER BY word_no)) AS text_md5 FROM wo WHERE cf >= 0 GROUP BY doc_id, block_num), k AS (SELECT doc_id, block_num, word_count, round(confidence, 6) AS confidence, text_md5, greatest(0, l - 12) AS \"left\", greatest(0, t - 12) AS top, least(1000, r + 12) AS \"right\", least(1600, b + 12) AS bottom FROM b WHERE word_count > 1 OR confidence >= 50) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(top / 20, 0), -\"right\", block_num) AS region_id, block_num, word_count, confidence, text_md5, \"left\", top, \"right\", bottom FROM k")
def region_bbox_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layout.word_regions(inputs.words(spark, sf_dir))
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.col("region_id").cast("long").alias("region_id"), F.col("block_num").cast("long").alias("block_num"), "word_count", F.round("confidence", 6).alias("confidence"), F.md5("text").alias("text_md5"), *(F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")))


@query(f"WITH {_WORDS}, g AS (SELECT doc_id, block_num, no // 12 AS ln, min(word_no) AS k, string_agg(text, ' ' ORDER BY word_no) AS line FROM wo GROUP BY ALL), o AS (SELECT doc_id, k, CASE WHEN lag(block_num) OVER (PARTITION BY doc_id ORDER BY k) <> block_num THEN chr(10) || line ELSE line END AS line FROM g) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY k)) AS text_md5 FROM o GROUP BY doc_id")
def text_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reconstructed(inputs.words(spark, sf_dir)).select(F.col("page_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"))


@query(f"WITH {_WORDS} SELECT doc_id, round(avg(CASE WHEN cf >= 0 THEN cf END), 6) AS mean_confidence, count(*) AS word_count, round(least(sum(60.0 * 12.0) / 1600000, 1.0), 6) AS coverage FROM wo GROUP BY doc_id")
def ocr_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layout.page_summary(inputs.words(spark, sf_dir))
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.round("mean_confidence", 6).alias("mean_confidence"), "word_count", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_WORDS}, r AS (SELECT doc_id, word_no, text, cf, row_number() OVER (PARTITION BY doc_id ORDER BY word_no) AS n FROM wo WHERE cf >= 0 AND cf < 60) SELECT doc_id, n, word_no, text, CAST(cf AS DOUBLE) AS conf FROM r WHERE n <= 20")
def top20_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty words of each page that were read badly: the limit is the report's."""
    held = layout.low_confidence(inputs.words(spark, sf_dir))
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), "word_no", "text", "conf")


_BOX = rf"""bl AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
bx AS (SELECT doc_id, n, (n * 137 + doc_id) % 800 AS l, n * 61 % 1400 AS t, (n * 137 + doc_id) % 800 + 150 + length(ls[n + 1]) % 50 AS r, n * 61 % 1400 + 40 + n % 30 AS b, len({_split('ls[n + 1]')}) AS wc, CASE WHEN n % 7 <> 3 THEN CAST(n * 19 % 100 AS DOUBLE) END AS cf FROM bl)"""


@query(f"WITH {_BOX} SELECT doc_id, round(sum(cf * greatest(1, wc)) / sum(greatest(1, wc)), 6) AS confidence FROM bx WHERE cf IS NOT NULL GROUP BY doc_id")
def word_weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layout.weighted_confidence(inputs.boxes(spark, sf_dir))
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_BOX} SELECT x.doc_id, x.n AS a, y.n AS b FROM bx x JOIN bx y ON x.doc_id = y.doc_id AND x.n < y.n WHERE least(x.b, y.b) > greatest(x.t, y.t) AND greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) / least(x.r - x.l, y.r - y.l) >= 0.6")
def region_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layout.overlapping(inputs.boxes(spark, sf_dir))
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.col("a_region_id").cast("long").alias("a"), F.col("b_region_id").cast("long").alias("b"))


@query(f"WITH RECURSIVE {_BOX}, pr AS (SELECT x.doc_id, x.n AS a, y.n AS b FROM bx x JOIN bx y ON x.doc_id = y.doc_id AND x.n <> y.n WHERE least(x.b, y.b) > greatest(x.t, y.t) AND greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) / least(x.r - x.l, y.r - y.l) >= 0.6), re AS (SELECT doc_id, n AS d, n AS m FROM bx UNION SELECT re.doc_id, d, b FROM re JOIN pr ON pr.doc_id = re.doc_id AND pr.a = re.m), co AS (SELECT doc_id, d, min(m) AS g FROM re GROUP BY doc_id, d), ag AS (SELECT bx.doc_id, g, min(n) AS block_num, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, CAST(sum(wc) AS BIGINT) AS word_count, sum(cf * greatest(1, wc)) / sum(CASE WHEN cf IS NOT NULL THEN greatest(1, wc) END) AS confidence FROM bx JOIN co ON co.doc_id = bx.doc_id AND co.d = bx.n GROUP BY bx.doc_id, g) SELECT CAST(doc_id AS VARCHAR) AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round_even(t / 20, 0), -r, block_num) AS INTEGER) AS region_id, CAST(l AS INTEGER) AS \"left\", CAST(t AS INTEGER) AS top, CAST(r AS INTEGER) AS \"right\", CAST(b AS INTEGER) AS bottom, word_count, round(confidence, 6) AS confidence FROM ag")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged(inputs.boxes(spark, sf_dir)).select("page_id", "region_id", "left", "top", "right", "bottom", "word_count", F.round("confidence", 6).alias("confidence"))


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ordered_boxes(inputs.boxes(spark, sf_dir))


@query()
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_boxes(inputs.boxes(spark, sf_dir))


@query(f"WITH {_BOX}, m AS (SELECT x.doc_id, x.n, max(CASE WHEN y.b <= x.t THEN y.b END) AS ab, min(CASE WHEN y.t >= x.b THEN y.t END) AS be FROM bx x JOIN bx y ON x.doc_id = y.doc_id AND x.n <> y.n WHERE greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) / greatest(1, least(x.r - x.l, y.r - y.l)) >= 0.2 GROUP BY x.doc_id, x.n) SELECT bx.doc_id, bx.n AS box_no, greatest(0, t - CASE WHEN ab IS NULL THEN 10 ELSE least(10, floor((t - ab) / 2)) END) AS top, least(1600, b + CASE WHEN be IS NULL THEN 10 ELSE least(10, floor((be - b) / 2)) END) AS bottom FROM bx LEFT JOIN m ON m.doc_id = bx.doc_id AND m.n = bx.n")
def neighbour_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = layout.padded_boxes(inputs.boxes(spark, sf_dir), 10)
    return held.select(F.col("page_id").cast("long").alias("doc_id"), F.col("box_no").cast("long").alias("box_no"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))


@query(f"WITH {_BOX} SELECT doc_id, count(*) FILTER (WHERE (r - l) * (b - t) / 1600000 BETWEEN 0.001 AND 0.80) AS n_meaningful FROM bx GROUP BY doc_id")
def meaningful_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.meaningful_regions(inputs.boxes(spark, sf_dir)).select(F.col("page_id").cast("long").alias("doc_id"), "n_meaningful")


@query(f"WITH {_BOX}, a AS (SELECT doc_id, greatest(0, least(r, 1000) - greatest(l, 0)) * greatest(0, least(b, 1600) - greatest(t, 0)) / 1600000 AS a FROM bx) SELECT doc_id, round(least(sum(a), 1.0) + 1e-9, 4) AS image_coverage, round(least(max(a), 1.0) + 1e-9, 4) AS largest_image FROM a GROUP BY doc_id")
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.image_coverage(inputs.boxes(spark, sf_dir)).select(F.col("page_id").cast("long").alias("doc_id"), "image_coverage", "largest_image")


_HIST = f"h AS (SELECT doc_id AS page_id, least(length(w) * 9, 255) AS value, count(*) AS n FROM (SELECT doc_id, unnest({_split('text')}) AS w FROM documents) GROUP BY ALL)"


@query(f"WITH {_HIST}, u AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY value) AS up, sum(n) OVER (PARTITION BY page_id) AS tot FROM h) SELECT page_id, min(value) AS median FROM u WHERE up * 2 >= tot GROUP BY page_id")
def histogram_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.histogram_median(inputs.histograms(spark, sf_dir)).select("page_id", F.col("median").cast("long").alias("median"))


@query(f"WITH {_HIST}, u AS (SELECT *, CAST(sum(n) OVER o AS DOUBLE) AS w, CAST(sum(n * value) OVER o AS DOUBLE) AS s, CAST(sum(n) OVER e AS DOUBLE) AS wt, CAST(sum(n * value) OVER e AS DOUBLE) AS st FROM h WINDOW o AS (PARTITION BY page_id ORDER BY value), e AS (PARTITION BY page_id)), v AS (SELECT page_id, value, w * (wt - w) * (s / w - (st - s) / (wt - w)) * (s / w - (st - s) / (wt - w)) AS var FROM u WHERE w < wt) SELECT page_id, value AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY var DESC, value) = 1")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.otsu(inputs.histograms(spark, sf_dir)).select("page_id", F.col("threshold").cast("long").alias("threshold"))


@query(f"WITH {_HIST} SELECT page_id, round(sum(CASE WHEN value < 100 THEN n ELSE 0 END) / sum(n), 4) AS visual_ratio FROM h GROUP BY page_id")
def visual_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visual_ratio(inputs.histograms(spark, sf_dir), 100)


# Tables


_GRID = rf"""g0 AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, '|')) AS rows FROM documents),
g1 AS (SELECT doc_id, rows, list_max(list_transform(rows, lambda r: len(r))) AS nc FROM g0),
g AS (SELECT doc_id, nc, list_transform(rows, lambda r: list_transform(range(1, nc + 1), lambda i: regexp_replace(coalesce(r[i], ''), '^{_WS}+|{_WS}+$', '', 'g'))) AS rows FROM g1)"""


@query(f"WITH {_GRID} SELECT doc_id, len(rows) AS num_rows, nc AS num_cols, md5(array_to_string(list_transform(rows, lambda r: array_to_string(r, chr(31))), chr(30))) AS cells_md5 FROM g")
def table_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.grids(spark, sf_dir).withColumn("rows", tables.padded(F.col("rows")))
    return held.select("doc_id", F.size("rows").cast("long").alias("num_rows"), tables.width(F.col("rows")).cast("long").alias("num_cols"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "\x1f")), "\x1e")).alias("cells_md5"))


@query(f"WITH {_GRID}, l AS (SELECT doc_id, list_transform(rows, lambda r: '| ' || array_to_string(r, ' | ') || ' |') AS ls, '| ' || array_to_string(list_transform(range(nc), lambda i: '---'), ' | ') || ' |' AS rule FROM g) SELECT doc_id, md5(array_to_string(list_concat(list_concat([ls[1]], [rule]), ls[2:]), chr(10))) AS markdown_md5 FROM l")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.grids(spark, sf_dir).withColumn("rows", tables.padded(F.col("rows")))
    return held.select("doc_id", F.md5(tables.markdown(F.col("rows"))).alias("markdown_md5"))


@query(f"WITH {_GRID}, p AS (SELECT doc_id, list_filter(list_transform(rows[2:], lambda r: array_to_string(list_filter(list_transform(range(1, nc + 1), lambda i: CASE WHEN r[i] <> '' THEN regexp_replace(rows[1][i] || ': ' || r[i], '^{_WS}+|{_WS}+$', '', 'g') END), lambda x: x IS NOT NULL), ' | ')), lambda x: x <> '') AS ls FROM g) SELECT doc_id, md5(array_to_string(list_concat(['caption'], ls), chr(10))) AS text_md5 FROM p")
def table_reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.grids(spark, sf_dir).withColumn("rows", tables.padded(F.col("rows")))
    return held.select("doc_id", F.md5(tables.reading_text(F.col("rows"), F.lit("caption"))).alias("text_md5"))


@query(f"WITH {_GRID}, c AS (SELECT doc_id, nc, unnest(range(1, len(rows) + 1)) AS i, rows FROM g), f AS (SELECT doc_id, i, unnest(range(1, nc + 1)) AS j, rows FROM c) SELECT doc_id, count(*) AS cells, count(*) FILTER (WHERE i = 1) AS header_cells, CAST(sum(length(rows[i][j])) AS BIGINT) AS chars FROM f GROUP BY doc_id")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = inputs.grids(spark, sf_dir).select("doc_id", F.explode(tables.cells(tables.padded(F.col("rows")))).alias("c"))
    return held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("c.is_header").alias("header_cells"), F.sum(F.length("c.text")).alias("chars"))
