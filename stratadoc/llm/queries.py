"""The queries on training data: each applies one operator to its whole table. SQL stands beside those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.inputs import table
from .common import bound_batches
from . import fingerprints, line_dedup, minhash, mixing, packing, quality_rules, secret_scan, suffix_dedup, token_counts, url_filter

BASE_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """documents; a small table, which one row group may hold, is dealt to all cores."""
    return table(spark, sf_dir, "documents").select(*columns or ("doc_id", "text"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade over all documents. The base features are columns of the result; those of the other rules are worked out where no rule before them has rejected."""
    measured = quality_rules.with_features(documents(spark, sf_dir), BASE_FEATURES)
    cascade = quality_rules.Cascade().fit(documents(spark, sf_dir), ready=BASE_FEATURES)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cascade.judge(measured, ready=BASE_FEATURES).select("doc_id", *BASE_FEATURES, base.alias("base_failed"), "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted into an empty index in two steps, then freed of the lines that an earlier one holds."""
    bound_batches(spark)
    docs = documents(spark, sf_dir)
    kept = line_dedup.LineIndex.sized(docs, min_chars=10).insert(docs, steps=2).dedup(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    bound_batches(spark)
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir), size=100, keep=False)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at a similarity of 0.8."""
    near = minhash.NearDuplicates(shingle_words=4, percent=80)
    return near.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, whose second half comes from the next document."""
    n = F.length("text")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = fingerprints.with_next(docs, derive={"print": fingerprints.fingerprint(F.col("text"))})
    half = F.floor(n / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.left("text", n - half), F.left("__next", half)))
    edited = edited.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("print")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("__next_print")).alias("near_next"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the vocabulary of piece_bpe_32k.model."""
    bound_batches(spark)
    counted = token_counts.count_tokens(documents(spark, sf_dir))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents, each distinct text scanned once through an empty ledger."""
    found = secret_scan.BlobLedger(spark).scan(documents(spark, sf_dir), path="doc_id")
    spans = F.col("spans")
    n = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(secret_scan.BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"),
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


#: Target weights of the tree; names that aren't listed weigh 1.
MIX_WEIGHTS = {"domain": {"web": 6, "books": 3}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 3, "src1": 2}}


def mix_domain(source: str = "source"):
    """The domain of a source, by the last digit of its name."""
    last = F.right(F.coalesce(F.col(source), F.lit("")), F.lit(1))
    return F.when(last.isin(*"01234"), "web").when(last.isin(*"56789"), "books").otherwise("other")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 60 % of their words, up to two epochs a leaf."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    return mixing.select(docs, mix_domain(), MIX_WEIGHTS, percent=60, max_epochs=2, seed=1)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens at most."""
    bound_batches(spark)
    return packing.pack(documents(spark, sf_dir), 1024)


#: The rules of the URL query.
URL_RULES = (
    url_filter.UrlRule("allow", "org", "/"),
    url_filter.UrlRule("block", "example.org", "/es/"),
    url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"),
    url_filter.UrlRule("block", "com", "/de/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL, by rule or by trees."""
    bound_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.UrlFilter(URL_RULES).judge(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filter": op10_url_filter,
}


def _secrets_sql() -> str:
    """Each kind's matches and what stands between them, as places; the kinds' own tests are in their patterns but for that of an assignment."""
    parts = []
    for number, kind in enumerate(secret_scan.KINDS):
        pattern = kind.pattern.replace("'", "''")
        holds = f"length(regexp_extract(m, '{pattern}', 1)) >= 8" if kind.name == "assign" else "true"
        parts.append(f"""SELECT doc_id, {number} AS kind, m, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda g: length(g))), 0) AS start
FROM (SELECT doc_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i, ms, gaps FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d)) WHERE {holds}""")
    names = ", ".join(f"'{k.name}'" for k in secret_scan.KINDS)
    told = f"[{names}][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
string_agg({told}, ',' ORDER BY start, kind) FILTER (WHERE kind < {len(secret_scan.BASE_KINDS)}) AS base, string_agg({told}, ',' ORDER BY start, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_shouts
  FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id
), g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_shouts > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM g
""",
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT doc_id, i, line, coalesce(doc_id <> first_doc, false) AS dropped FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op3_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM w),
g AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
o AS (SELECT *, coalesce(i > max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM g),
n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY doc_id, span),
e AS (SELECT s.*, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM s),
p AS (SELECT e.doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN p ON p.doc_id = d.doc_id
""",
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.m
), c AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT c.d AS doc_id, coalesce(n, 0) AS n_shingles, component_id, c.d = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.d
""",
    "op8_secret_scan": _secrets_sql(),
    "op7_source_mixing": r"""
WITH d AS (
  SELECT doc_id,
         CASE WHEN right(coalesce(source, ''), 1) IN ('0', '1', '2', '3', '4') THEN 'web'
              WHEN right(coalesce(source, ''), 1) IN ('5', '6', '7', '8', '9') THEN 'books' ELSE 'other' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS capacity FROM d GROUP BY ALL
), root AS (
  SELECT least(CAST(sum(tokens) AS BIGINT) * 60 // 100, CAST(sum(capacity) AS BIGINT)) AS budget FROM leaf
), a0 AS (
  SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CASE domain WHEN 'web' THEN 6 WHEN 'books' THEN 3 ELSE 1 END AS w, any_value(budget) AS budget FROM leaf, root GROUP BY domain
), a1 AS (
  SELECT *, coalesce(CAST(sum(capacity) OVER (ORDER BY capacity / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent,
         CAST(sum(w) OVER (ORDER BY capacity / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM a0
), a2 AS (SELECT *, capacity * w_left <= (budget - spent) * w AS capped FROM a1
), a3 AS (
  SELECT *, coalesce(CAST(sum(capacity) FILTER (WHERE capped) OVER () AS BIGINT), 0) AS used, CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS BIGINT) AS w_open FROM a2
), domains AS (SELECT domain, CASE WHEN capped THEN capacity ELSE (budget - used) * w // w_open END AS budget FROM a3
), b0 AS (
  SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(budget) AS budget
  FROM leaf JOIN domains USING (domain) GROUP BY domain, lang
), b1 AS (
  SELECT *, coalesce(CAST(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent,
         CAST(sum(w) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM b0
), b2 AS (SELECT *, capacity * w_left <= (budget - spent) * w AS capped FROM b1
), b3 AS (
  SELECT *, coalesce(CAST(sum(capacity) FILTER (WHERE capped) OVER (PARTITION BY domain) AS BIGINT), 0) AS used, CAST(sum(w) FILTER (WHERE NOT capped) OVER (PARTITION BY domain) AS BIGINT) AS w_open FROM b2
), langs AS (SELECT domain, lang, CASE WHEN capped THEN capacity ELSE (budget - used) * w // w_open END AS budget FROM b3
), c0 AS (
  SELECT domain, lang, source, tokens, capacity, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END AS w, budget FROM leaf JOIN langs USING (domain, lang)
), c1 AS (
  SELECT *, coalesce(CAST(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS spent,
         CAST(sum(w) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM c0
), c2 AS (SELECT *, capacity * w_left <= (budget - spent) * w AS capped FROM c1
), c3 AS (
  SELECT *, coalesce(CAST(sum(capacity) FILTER (WHERE capped) OVER (PARTITION BY domain, lang) AS BIGINT), 0) AS used, CAST(sum(w) FILTER (WHERE NOT capped) OVER (PARTITION BY domain, lang) AS BIGINT) AS w_open FROM c2
), budgets AS (
  SELECT domain, lang, source, tokens, CASE WHEN capped THEN capacity ELSE (budget - used) * w // w_open END AS budget FROM c3
), e AS (
  SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, 2) ELSE 1 END AS epochs FROM budgets
), held AS (
  SELECT d.*, e.epochs, CASE WHEN e.epochs < 2 THEN e.budget - e.epochs * e.tokens ELSE -1 END AS rest, md5('1:' || e.epochs || ':' || d.doc_id) AS key
  FROM d JOIN e USING (domain, lang, source)
), running AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM held
), taken AS (
  SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest >= 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM running
)
SELECT * FROM taken WHERE copies > 0
""",
}
