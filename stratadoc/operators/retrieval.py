"""Retrieval: cosine top-k, BM25, min-max fusion, reranking, for one question or many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_words

MOST_K = 1000


def bounded_k(k: int) -> int:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be from 1 to {MOST_K}")
    return k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_to(vector: list[float]) -> Callable[[Column], Column]:
    """Cosine to a fixed vector, in Arrow batches: one product of a batch and the vector."""
    fixed = np.asarray(vector, np.float64)
    fixed = fixed / (np.linalg.norm(fixed) or 1.0)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype="float64")
                continue
            rows = np.stack(batch.to_numpy()).astype(np.float64)
            yield pd.Series(rows @ fixed / np.maximum(np.linalg.norm(rows, axis=1), 1e-300))

    return score


def top_k(chunks: DataFrame, score: Column, k: int, tie: str = "chunk_id") -> DataFrame:
    """The k best of a filtered frame: a heap in each partition, merged; ties by id."""
    return chunks.withColumn("score", score).orderBy(F.desc("score"), tie).limit(bounded_k(k))


def search(chunks: DataFrame, vector: list[float], k: int = 5, *, column: str = "vector", tie: str = "chunk_id") -> DataFrame:
    """chunks (filtered by access) that are nearest to a question's vector."""
    return top_k(chunks, cosine(F.col(column), F.array(*(F.lit(float(x)) for x in vector))), k, tie)


def top_k_each(scored: DataFrame, question: str, k: int, tie: str) -> DataFrame:
    """The k best of each question, by score; Spark keeps k rows a question in each partition before it shuffles."""
    order = Window.partitionBy(question).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bounded_k(k))


#: Rows of chunks and of questions that meet in one block.
BLOCK_CHUNKS, BLOCK_QUESTIONS = 4096, 512


def _blocks(k: int, kind: str, groups: bool):
    """The k best chunks of each question of a block, and the least and greatest score of all that it may see: one matrix product."""
    names = [c.split(":")[0].split()[0] for c in kind.split(", ")]

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        chunks, questions = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        if not chunks.num_rows or not questions.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (table.schema.field("id").type, table.schema.field("id").type, *[pa.float64()] * 3))})
        chunks = chunks.take(pc.sort_indices(chunks, [("id", "ascending")]))
        scores = unit(questions.column("vector")) @ unit(chunks.column("vector")).T
        seen = ~np.isnan(scores)
        if groups:
            every = {g: i for i, g in enumerate(dict.fromkeys(g for t in (chunks, questions) for gs in t.column("groups").to_pylist() for g in gs or []))}
            has = [np.zeros((t.num_rows, len(every)), np.float32) for t in (questions, chunks)]
            for held, t in zip(has, (questions, chunks)):
                for i, gs in enumerate(t.column("groups").to_pylist()):
                    held[i, [every[g] for g in gs or []]] = 1
            seen &= has[0] @ has[1].T > 0
        out: list[list] = [[], [], [], [], []]
        ids, asked = chunks.column("id").to_pylist(), questions.column("id").to_pylist()
        for q, row, mine in zip(asked, scores, seen):
            at = np.flatnonzero(mine)
            if not len(at):
                continue
            best = at[np.argsort(-row[at], kind="stable")[:k]]
            low, high = row[at].min(), row[at].max()
            for c in best.tolist():
                for column, value in zip(out, (q, ids[c], row[c], low, high)):
                    column.append(value)
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, out, (table.schema.field("id").type, table.schema.field("id").type, *[pa.float64()] * 3))})

    return run


def nearest(chunks: DataFrame, questions: DataFrame, k: int, *, scope: str | None = None, groups: bool = False) -> DataFrame:
    """question_id, chunk_id, score of the k nearest chunks of each question, and low, high: the scores' range over all chunks that the question may see.

    chunks: id, vector, and scope and groups if used; questions likewise, with ids of the same type. Both
    are dealt to blocks within a scope, so that no group grows with the data or with one tenant's share;
    a block gives k rows a question. A chunk is copied for each block of questions, a question for each
    block of chunks. Who has no group in common with a chunk doesn't see it: that is tested in the block,
    below the ranking. Ties are broken by id. Vectors without length are seen by nobody.
    """
    kind = f"question_id {chunks.schema['id'].dataType.simpleString()}, chunk_id {chunks.schema['id'].dataType.simpleString()}, score double, low double, high double"
    by = F.col(scope) if scope else F.lit(0)
    shape = lambda df, asks: df.where("vector is not null").select(by.alias("scope"), "id", "vector", *(["groups"] if groups else []), F.lit(asks).alias("asks"))
    c, q = shape(chunks, False), shape(questions, True)
    parts = c.groupBy("scope").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CHUNKS), F.lit(1)).cast("int").alias("parts"))
    sides = q.groupBy("scope").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_QUESTIONS), F.lit(1)).cast("int").alias("sides"))
    sizes = parts.join(sides, "scope")  # a row a scope that has both
    c, q = (df.join(sizes, "scope") for df in (c, q))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["scope", "part", "side"]
    columns = ["id", "vector", *(["groups"] if groups else []), "asks"]
    dealt = c.select("scope", own("parts").alias("part"), every("sides").alias("side"), *columns).unionByName(q.select("scope", every("parts").alias("part"), own("sides").alias("side"), *columns))
    found = dealt.groupBy(*keys).applyInArrow(_blocks(bounded_k(k), kind, groups), kind)
    order = Window.partitionBy("question_id")
    held = found.withColumns({"low": F.min("low").over(order), "high": F.max("high").over(order)})
    return top_k_each(held, "question_id", k, "chunk_id")


def search_many(chunks: DataFrame, questions: DataFrame, k: int, *, tie: str = "chunk_id") -> DataFrame:
    """question_id, tie, score, rank: questions (question_id, tenant_id, groups, qvec) against the chunks each may see, in blocks of a tenant."""
    c = chunks.select("tenant_id", F.col(tie).cast("string").alias("id"), "vector", F.col("acl_groups").alias("groups"))
    q = questions.select("tenant_id", F.col("question_id").cast("string").alias("id"), F.col("qvec").alias("vector"), "groups")
    hits = nearest(c, q, k, scope="tenant_id", groups=True)
    return hits.select(F.col("question_id").cast(questions.schema["question_id"].dataType).alias("question_id"), F.col("chunk_id").cast(chunks.schema[tie].dataType).alias(tie), "score", "rank")


def minmax(score: str, question: str) -> Column:
    """Scores of a question to 0..1; 0.5 where all are the same."""
    over = Window.partitionBy(question)
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, 0.5).otherwise((F.col(score) - low) / (high - low))


def bm25(chunks: DataFrame, questions: DataFrame, *, scope: list[str], key: str = "chunk_id", text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """question_id, key, bm25 of chunks that share a word with a question of their scope.

    Corpus statistics are those of the frame that is given, which access has filtered already. A term of
    a negative inverse frequency gets epsilon times the mean of its scope; a word that a question repeats
    counts again.
    """
    words = chunks.select(*scope, key, split_words(F.col(text)).alias("words"))
    corpus = words.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    tf = words.select(*scope, key, F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy(*scope, key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(corpus, scope).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(*scope).agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(mean, scope).withColumn("idf", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))).select(*scope, "term", "idf", "avgdl")
    asked = questions.select(*scope, "question_id", F.explode(split_words(F.col("question"))).alias("term")).groupBy(*scope, "question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    met = asked.join(idf, [*scope, "term"]).join(tf, [*scope, "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy(*scope, "question_id", key).agg(F.sum(part).alias("bm25"))


def fuse(dense: DataFrame, lexical: DataFrame, *, alpha: float = 0.5, keys: list[str], question: str = "question_id") -> DataFrame:
    """dense (score) and lexical (bm25) scores, each to 0..1 within a question, mixed; a chunk without lexical score has 0."""
    both = dense.join(lexical.select(*keys, "bm25"), keys, "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    both = both.withColumns({"dense_norm": minmax("score", question), "bm25_norm": minmax("bm25", question)})
    return both.withColumn("score", alpha * F.col("dense_norm") + (1 - alpha) * F.col("bm25_norm"))


def hybrid(chunks: DataFrame, questions: DataFrame, k: int, *, alpha: float = 0.5, first: int = 20, scorer: Reranker | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank: dense and lexical scores of the same chunks fused, the first best, reranked, k of them.

    chunks: chunk_id (bigint), text, vector, filtered by access; questions: question_id (bigint), question,
    qvec. Scores are brought to 0..1 over all chunks of a question. A chunk without a word of the question
    has a lexical score of 0 and can only be among the first if it is among the first by vectors alone, so
    the fused scores of these and of all lexical hits are all that is needed; a lexical score below 0, as
    tiny corpora give, counts as 0.
    """
    scorer = scorer or word_overlap
    ids = lambda df, key, vector: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    near = nearest(ids(chunks, "chunk_id", "vector"), ids(questions, "question_id", "qvec"), first)
    span = near.groupBy("question_id").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    scoped = lambda df: df.withColumn("scope", F.lit(0))
    words = bm25(scoped(chunks.select("chunk_id", "text")), scoped(questions.select("question_id", "question")), scope=["scope"])
    words = words.select("question_id", "chunk_id", F.greatest("bm25", F.lit(0.0)).alias("bm25"))
    dense = words.join(chunks.select("chunk_id", "vector"), "chunk_id").join(questions.select("question_id", "qvec"), "question_id").select("question_id", "chunk_id", "bm25", cosine(F.col("vector"), F.col("qvec")).alias("dense"))
    only = near.select("question_id", "chunk_id", F.col("score").alias("dense")).join(words.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    both = dense.unionByName(only.withColumn("bm25", F.lit(0.0))).join(span, "question_id")
    # a question whose words all chunks have has a least lexical score above 0
    lexical = words.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("bm25").alias("least"), F.max("bm25").alias("most"))
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    both = both.join(lexical, "question_id", "left").join(F.broadcast(total))  # one row
    low = F.when(F.col("n") == F.col("chunks"), F.col("least")).otherwise(0.0)
    high = F.coalesce("most", F.lit(0.0))
    unit = lambda v, a, b: F.when(b == a, 0.5).otherwise((v - a) / (b - a))
    fused = alpha * unit(F.col("dense"), F.col("low"), F.col("high")) + (1 - alpha) * unit(F.col("bm25"), low, high)
    best = top_k_each(both.select("question_id", "chunk_id", F.round(fused, 9).alias("score")), "question_id", first, "chunk_id")
    full = best.select("question_id", "chunk_id", F.col("score").alias("fused")).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    ranked = full.withColumn("score", scorer(F.col("question"), F.col("text")))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("fused"), "chunk_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bounded_k(k)).select("question_id", "chunk_id", "score", "fused", "rank")


def containing(texts: DataFrame, passages: DataFrame, *, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """question_id, key of texts that contain a passage (question_id, question): met by the passage's rarest inner word, then compared.

    A passage's inner words (all but the first and the last, which the text may go on with) stand as whole
    words in a text that contains it. Passages without one are met with all texts, in as many copies as there are of them.
    """
    words = texts.select(key, F.explode(F.array_distinct(split_words(F.col(text)))).alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    held = split_words(F.col("question"))
    inner = F.filter(F.slice(held, F.lit(2), F.greatest(F.size(held) - 2, F.lit(0))), lambda w: w != "")
    asked = passages.select("question_id", "question", F.explode(F.array_distinct(inner)).alias("word")).join(often, "word", "left")
    rare = asked.groupBy("question_id", "question").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")).alias("word"))
    met = words.join(rare, "word").join(texts.select(key, text), key)
    short = passages.where(F.size(inner) == 0).select("question_id", "question").withColumn("every", F.lit(0))
    whole = texts.select(key, text).withColumn("every", F.lit(0)).join(short, "every").drop("every")
    pairs = met.select("question_id", "question", key, text).unionByName(whole.select("question_id", "question", key, text))
    return pairs.where(F.contains(F.col(text), F.col("question"))).select("question_id", key)


Reranker = Callable[[Column, Column], Column]


def word_overlap(question: Column, text: Column) -> Column:
    """A deterministic scorer: the share of a question's words that a text has."""
    asked = F.array_distinct(split_words(F.lower(question)))
    return F.try_divide(F.size(F.array_intersect(asked, split_words(F.lower(text)))).cast("double"), F.size(asked))


def rerank(hits: DataFrame, k: int, scorer: Reranker = word_overlap, *, tie: str = "chunk_id") -> DataFrame:
    """hits (question_id, question, text) by another scorer, the k best of each question."""
    return top_k_each(hits.drop("rank").withColumn("score", scorer(F.col("question"), F.col("text"))), "question_id", k, tie)


def prompt(hits: DataFrame, template: str = "{context}\n\n{question}") -> DataFrame:
    """question_id, prompt: the contexts of a question, in rank order, in a template."""
    joined = hits.groupBy("question_id").agg(F.first("question").alias("question"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("held"))
    context = F.array_join(F.col("held.text"), "\n\n---\n\n")
    return joined.select("question_id", F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{question}"), F.col("question")).alias("prompt"))


def sources(hits: DataFrame) -> DataFrame:
    """Reference, source, location and score of hits."""
    return hits.select(F.col("location.ref").alias("ref"), "source", "location", "score")


def unique_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sources of a that b doesn't have, by source, reference and location."""
    key = lambda d: d.select("source", F.coalesce("location.ref", F.lit("")).alias("ref"), F.to_json("location").alias("location"))
    return key(a).subtract(key(b))


Embedder = Callable[[list[str]], "np.ndarray"]


def embed(make: Callable[[], Embedder], text: Column) -> Column:
    """Vectors by a pluggable model, made once a worker and called by Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), np.float32)))

    return run(text)


def answers(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """prompts (question_id, prompt) with answer, by a pluggable model, made once a worker and called by Arrow batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()))

    return prompts.withColumn("answer", run("prompt"))


def zipped(chunks: DataFrame, vectors: DataFrame, *, position: str = "position") -> DataFrame:
    """Chunks and vectors of a batch, joined by position; one without the other raises."""
    both = chunks.withColumn("__c", F.lit(True)).join(vectors.withColumn("__v", F.lit(True)), position, "full")
    whole = F.col("__c").isNotNull() & F.col("__v").isNotNull()
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("chunks and vectors differ in number")).cast("boolean"))).drop("__c", "__v")


def overfetched(chunks: DataFrame, vector: list[float], k: int = 5, *, first: int = 20, tie: str = "chunk_id") -> DataFrame:
    """The first nearest chunks, of which k are kept as they are, without a rerank."""
    return search(chunks, vector, first, tie=tie).orderBy(F.desc("score"), tie).limit(bounded_k(k))
