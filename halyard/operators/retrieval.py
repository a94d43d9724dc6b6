"""Retrieval over chunks: exact vector search, group votes, BM25 and term frequency ranking, fusion, reranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.text import words
from halyard.sources.staging import staged

#: BM25 saturation and length weight, rank offset of the fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Rows of the queries that meet the vectors in one block.
QUERY_BLOCK = 512
#: Vectors that a block of queries meets in one task.
VECTOR_BLOCK = 50_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where one has no length."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    x, y = d(a), d(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def vector_topk(vectors: DataFrame, query: list[float], k: int, labels: list[int] | None = None) -> DataFrame:
    """(vec_id, label, similarity) of the k vectors nearest to one query, optionally of some labels only; ties by vec_id.

    Null vectors and those of another length are left out. Every batch is one product of a matrix and the query and
    leaves k rows, so that only these are sorted.
    """
    v = vectors.where("embedding is not null")
    if labels is not None:
        v = v.where(F.col("label").isin(*labels))
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("embedding")
            offsets = col.offsets.to_numpy()
            b = b.filter(pa.array(np.diff(offsets) == len(q)))
            if not b.num_rows:
                continue
            m = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            norm = np.linalg.norm(m, axis=1)
            sims = np.where(norm == 0, 0.0, m @ q / np.where(norm == 0, 1.0, norm))
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            top = np.lexsort((ids, -sims))[:k]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(top)), b.column("label").take(pa.array(top)), pa.array(sims[top])], ["vec_id", "label", "similarity"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    found = v.select("vec_id", "label", "embedding").mapInArrow(near, f"vec_id {kinds['vec_id']}, label {kinds['label']}, similarity double")
    return found.orderBy(F.desc("similarity"), "vec_id").limit(k)


def group_vote(nearest: DataFrame, group: str = "label") -> DataFrame:
    """(group, votes, best, wins): votes of the nearest rows by group; all groups with most votes win."""
    v = nearest.groupBy(group).agg(F.count("*").alias("votes"), F.max("similarity").alias("best"))
    top = v.agg(F.max("votes").alias("most"))
    return v.join(F.broadcast(top), F.col("votes") == F.col("most"), "left").select(group, "votes", "best", F.col("most").isNotNull().alias("wins"))  # top has one row


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k nearest vectors of each query other than itself, of the same `within` only if a column is named.

    Queries come in blocks; every block meets each block of the vectors once, in a matrix product, and leaves k
    rows a query there, from which the final k are taken. Ties fall to the smaller vec_id.
    """
    group = F.col(within).cast("string") if within else F.lit("")
    q = queries.where("embedding is not null").select(group.alias("group"), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("spread"), F.struct("vec_id", "embedding").alias("q"))
    v = vectors.where("embedding is not null").select(group.alias("group"), "vec_id", "embedding")
    blocks = q.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("n_blocks"))
    parts = v.groupBy("group").agg(F.ceil(F.count("*") / VECTOR_BLOCK).alias("n_parts"))
    sizes = blocks.join(parts, "group")
    packed = q.join(sizes, "group").groupBy("group", F.pmod("spread", "n_blocks").alias("block")).agg(F.collect_list("q").alias("qs"), F.first("n_parts").alias("n_parts"))  # about QUERY_BLOCK rows each
    one = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1))).drop("n_parts")
    keyed = v.join(sizes, "group").select("group", "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), "n_parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("block"))

    def near(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "vec_id", "similarity"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=cols).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})
        qs = [q for r in right["qs"] for q in r]
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        a = unit(np.array([q["embedding"] for q in qs], float))
        b = unit(np.stack(left["embedding"].to_numpy()).astype(float))
        ids = left["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, sims = ids[order], a @ b[order].T
        out = []
        for q, s in zip(qs, sims):
            s = np.where(ids == q["vec_id"], -2.0, s)
            top = np.argsort(-np.round(s, 12), kind="stable")[:k]
            out += [(q["vec_id"], ids[i], s[i]) for i in top if s[i] > -2]
        return pd.DataFrame(out, columns=cols)

    keys = ["group", "block", "part"]
    found = keyed.groupBy(*keys).cogroup(one.groupBy(*keys)).applyInPandas(near, "query_id bigint, vec_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len, n_docs, total_len): one row per word of a document, in order of words.

    Written as a table, a search reads only the parts whose range of words holds its terms. len is the document's
    number of words; n_docs and total_len are sums over all documents that have a text, the same in every row. The
    range of a word that very many documents hold is split by document.
    """
    known = docs.where("text is not null")
    w = known.select("doc_id", words(F.col("text")).alias("w"))
    counted = staged(w.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").cast("int").alias("tf")), "words")  # ranges are sampled from it
    sums = counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint").alias("total_len")).crossJoin(known.agg(F.count("*").alias("n_docs")))
    ordered = counted.crossJoin(F.broadcast(sums))  # sums has one row
    return ordered.select("term", "doc_id", "tf", "len", "n_docs", "total_len").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def bm25(index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score) of documents that hold any of the terms, from their postings; document counts and lengths are of all documents, also where a filter follows."""
    terms = list(dict.fromkeys(terms))
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf, mean = F.col("tf"), F.col("total_len") / F.col("n_docs")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
    return hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(part).alias("score"))  # df has a row per term


def term_rank(index: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score): every term adds 0.1 * sum of 1 / i^2 over its occurrences, over 1.644934 and the number of terms. Terms of one letter don't count."""
    terms = [t for t in dict.fromkeys(terms) if len(t) > 1]
    gain = F.aggregate(F.sequence(F.lit(1), F.col("tf")), F.lit(0.0), lambda s, i: s + 1.0 / (i * i)) / 1.644934 * 0.1
    return index.where(F.col("term").isin(*terms)).groupBy("doc_id").agg((F.sum(gain) / len(terms)).alias("score"))


def topk(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score", digits: int = 9) -> DataFrame:
    """The k best rows with their rank; ties by key."""
    best = scored.orderBy(F.desc(F.round(score, digits)), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, digits)), key)))  # k rows


def fuse(vector: DataFrame, lexical: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (key, vector_rank, lexical_rank, fused_score, rank); at ties the vector list's order counts first."""
    v, x = vector.select(key, F.col("rank").alias("vector_rank")), lexical.select(key, F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(x, key, "full").withColumn("fused_score", part("vector_rank") + part("lexical_rank"))
    order = [F.desc(F.round("fused_score", 12)), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), F.col(key)]
    return both.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(index: DataFrame, vectors: DataFrame, query: list[float], terms: list[str], k: int, mode: str = "hybrid") -> DataFrame:
    """Search by vectors and words (postings): both lists hold 2 k candidates. Modes: hybrid (BM25), hybrid_rank (term ranks), bm25_only, rank_only, vector_only."""
    lexical = term_rank if "rank" in mode else bm25
    if mode == "vector_only":
        near = vector_topk(vectors, query, k).withColumnsRenamed({"vec_id": "doc_id", "similarity": "score"})
        return topk(near, k, digits=15).select("doc_id", F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("lexical_rank"), F.col("score").alias("fused_score"), "rank")
    if mode.endswith("_only"):
        return topk(lexical(index, terms), k).select("doc_id", F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("lexical_rank"), F.col("score").alias("fused_score"), "rank")
    near = vector_topk(vectors, query, 2 * k).withColumnsRenamed({"vec_id": "doc_id", "similarity": "score"})
    return fuse(topk(near, 2 * k, digits=15), topk(lexical(index, terms), 2 * k), k)


def word_overlap(question: str, texts: pd.Series) -> pd.Series:
    """A stand-in for a scoring model: the share of the question's words that a text holds."""
    asked = set(re.findall(r"[^\W_]+", question.lower()))
    return texts.map(lambda t: len(asked & set(re.findall(r"[^\W_]+", t.lower()))) / max(1, len(asked)))


def rerank(candidates: DataFrame, question: str, k: int, scorer: Callable[[str, pd.Series], pd.Series] = word_overlap) -> DataFrame:
    """The k candidates (doc_id, text, rank, ...) that a scorer likes best, with its score and their new rank.

    The scorer sees texts up to 24,000 characters (the model's limit) and may leave scores null: such rows drop
    out. Where it gives no score at all, the first k stay in their order.
    """

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return scorer(question, s.fillna("")).astype(float)

    scored = candidates.withColumn("score", score(F.substring("text", 1, 24_000))).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    any_score = F.max(F.col("score").isNotNull()).over(Window.partitionBy())  # candidates are a search's few rows
    kept = scored.withColumn("__any", any_score).where("not __any or score is not null")
    order = [F.desc(F.round("score", 9)), F.when(F.col("__any"), F.lit(0)).otherwise(F.col("rank")), F.col("doc_id")]
    best = kept.withColumn("__rank", F.row_number().over(Window.orderBy(*order))).where(F.col("__rank") <= k)
    return best.drop("__any", "rank").withColumnRenamed("__rank", "rank")


def hash_embedding(texts: pd.Series, dim: int = 64) -> pd.Series:
    """Signed feature hashing of words, of length 1; a stand-in where no model is at hand."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % dim] += 1 if h >> 63 else -1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return pd.Series(out)


def embed(df: DataFrame, text: Column, embedder=hash_embedding, dim: int = 64) -> DataFrame:
    """Adds `embedding` by a function of a pandas Series of texts; null texts are embedded as empty ones."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return embedder(s, dim)

    return df.withColumn("embedding", run(F.coalesce(text, F.lit(""))))


def mean_pool(vectors: Column, start: Column, end: Column) -> Column:
    """Mean of the vectors of the positions start to end (without end) of an array of vectors."""
    span = F.slice(vectors, start + 1, F.greatest(F.lit(1), end - start))
    total = F.aggregate(span, F.transform(F.element_at(span, 1), lambda x: x * 0.0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(span))
