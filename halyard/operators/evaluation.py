"""Measures of retrieval and answers, and sources resolved to the messages they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, query: str, rank: str, hit) -> DataFrame:
    """(query, first_rank): the best rank of a hit, null where there is none."""
    return results.groupBy(query).agg(F.min(F.when(hit, F.col(rank))).cast("bigint").alias("first_rank"))


def recall_and_mrr(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, total, hits, recall, mrr); misses count in both. With by, a row 'total' over all is added."""
    agg = [F.count("*").alias("total"), F.count("first_rank").alias("hits"), F.avg(F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall"), F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr")]
    if not by:
        return hits.agg(*agg)
    names = [F.when(F.grouping(c) == 1, "total").otherwise(F.col(c).cast("string")).alias(f"__{c}") for c in by]
    out = hits.rollup(*by).agg(*agg, *names)
    return out.drop(*by).withColumnsRenamed({f"__{c}": c for c in by})


def vote_recall(votes: DataFrame, by: list[str], query: str = "query_id", most: int | None = None) -> DataFrame:
    """(by, total, hits, recall) of votes (query, by, group, expected, rank of the group by votes): a query is a hit if its
    expected group ranks first, or within `most`. A row 'total' over all is added."""
    hit = F.max((F.col("group") == F.col("expected")) & (F.col("rank") <= (most or 1)))
    per = votes.groupBy(query, *by).agg(F.coalesce(hit, F.lit(False)).alias("hit"))
    names = [F.when(F.grouping(c) == 1, "total").otherwise(F.col(c).cast("string")).alias(f"__{c}") for c in by]
    out = per.rollup(*by).agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("recall"), *names)
    return out.drop(*by).withColumnsRenamed({f"__{c}": c for c in by})


def canonical_source(results: DataFrame, attachments: DataFrame, strategy: str | None = None) -> DataFrame:
    """Adds email_id: an email is its own source, an attachment that of the smallest email_id that carries it; unknown
    ones stay null. strategy names a column: summaries of attachments bear their message's id already."""
    owner = attachments.where("sha256 is not null").groupBy("sha256").agg(F.min("email_id").alias("__email"))
    joined = results.join(owner, (F.col("source_type") == "attachment") & (F.col("source_id") == F.col("sha256")), "left")
    own = F.col("source_type") == "email"
    if strategy:
        own = own | (F.col(strategy) == "summary")
    return joined.withColumn("email_id", F.when(own, F.col("source_id")).otherwise(F.col("__email"))).drop("__email", "sha256")


def resolve_filter(values: list[str] | None, allowed: list[str], default: list[str]) -> list[str] | None:
    """Chosen values in lower case, each once, in order; none given: the default; "all" among them: no filter (None)."""
    chosen = list(dict.fromkeys(v.lower() for v in values or default))
    if "all" in chosen:
        return None
    if wrong := [v for v in chosen if v not in allowed]:
        raise ValueError(f"not among {allowed}: {wrong}")
    return chosen
