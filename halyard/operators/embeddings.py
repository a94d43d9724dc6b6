"""Vectors of chunks: by themselves, below their document's summary, pooled from the document's tokens, and of summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.text import strip
from halyard.operators.retrieval import embed, hash_embedding

#: What a provider of token vectors gives for a text: the tokens' (start, end) in it, and a row of numbers for each.
TokenEmbedder = Callable[[str], tuple[list[tuple[int, int]], np.ndarray]]
#: What stands between a summary and the text below it.
BELOW_SUMMARY, BEFORE_TEXT = "\n\n", "\n\n---\n\n"


def below_summary(summary: Column, chunk: Column) -> Column:
    """The text that is embedded for a chunk: its document's summary and the chunk; the chunk alone where there is no summary."""
    s = F.nullif(strip(summary), F.lit(""))
    return F.coalesce(F.concat(s, F.lit(BELOW_SUMMARY), chunk), chunk)


def context_embedded(chunks: DataFrame, summaries: DataFrame, embedder=hash_embedding, dim: int = 64) -> DataFrame:
    """Chunks (id, chunk_index, text) with the embedding of their text below their document's summary (id, summary; unique); the stored text stays bare."""
    return embed(chunks.join(summaries, "id", "left"), below_summary(F.col("summary"), F.col("text")), embedder, dim).drop("summary")


def summary_embedded(summaries: DataFrame, embedder=hash_embedding, dim: int = 64) -> DataFrame:
    """(source_id, chunk_index, text, embedding): a message's summary (email_id, summary) is one chunk that bears the message's id; blank ones are left out."""
    rows = summaries.select(F.col("email_id").alias("source_id"), F.lit(0).alias("chunk_index"), strip(F.col("summary")).alias("text")).where("text <> ''")
    return embed(rows, F.col("text"), embedder, dim)


def word_vectors(text: str, dim: int = 16) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A stand-in for a model's token vectors: words with their hashed vectors, each with a share of the word before."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    v = np.array(hash_embedding(pd.Series([text[i:j] for i, j in spans]), dim).tolist()).reshape(-1, dim)
    return spans, v + 0.5 * np.vstack([np.zeros((1, dim)), v[:-1]]) if len(v) else v


def pooled(spans: list[tuple[int, int]], vectors: np.ndarray, pieces: list[tuple[int, int]]) -> list[list[float]]:
    """The mean of the vectors of the tokens that each piece (start, end) of the text touches; zeros where it touches none.

    Spans rise; tokens of no length (marks of a model) aren't touched. A server may give fewer vectors than there are
    tokens: the rest doesn't count.
    """
    n = len(vectors)
    real = [k for k, (a, b) in enumerate(spans[:n]) if b > a]
    starts, ends = np.array([spans[k][0] for k in real]), np.array([spans[k][1] for k in real])
    total = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors[real], axis=0)]) if real else np.zeros((1, vectors.shape[1]))
    out = []
    for a, b in pieces:
        lo, hi = (int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))) if real else (0, 0)
        out.append(((total[hi] - total[lo]) / (hi - lo)).tolist() if hi > lo else [0.0] * vectors.shape[1])
    return out


def late_embedded(docs: DataFrame, chunks: DataFrame, embedder: TokenEmbedder = word_vectors) -> DataFrame:
    """(id, chunk_index, embedding): chunks pooled from the token vectors of their whole document below its summary.

    docs: id (unique), text (as chunked: without white space at its ends), summary; chunks: id, chunk_index, start, n_chars. A document's text meets the
    list of its own chunks' places once; pooled vectors aren't scaled to length 1.
    """
    places = chunks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "start", "n_chars"))).alias("places"))  # of one document

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                head = f"{r.summary.strip()}{BEFORE_TEXT}" if isinstance(r.summary, str) and r.summary.strip() else ""
                spans, vectors = embedder(head + r.text)
                at = [(len(head) + x["start"], len(head) + x["start"] + x["n_chars"]) for x in r.places]
                rows += [(r.id, x["chunk_index"], v) for x, v in zip(r.places, pooled(spans, np.asarray(vectors, float), at))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "embedding"]).astype({"chunk_index": "int32"})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.where("text is not null").join(places, "id").select("id", "text", "summary", "places").mapInPandas(run, f"id {kind}, chunk_index int, embedding array<double>")
