"""Overlapping chunks of texts that prefer to end at paragraphs, lines, sentences, words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size, overlap and the part of a window searched for an end, in characters, and ends by preference.
SIZE, OVERLAP, TAIL = 1500, 200, 450
ENDS = ("\n\n", "\n", ". ", "! ", "? ", " ")


def cuts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a stripped text; ends are before white space that the chunk ends with."""
    n, out, at = len(text), [], 0
    if n <= SIZE:
        return [(0, n)] if n else []
    while n - at > SIZE:
        far = at + SIZE
        low = far - TAIL
        end = next((k + len(e) for e in ENDS if (k := text.rfind(e, low, far)) >= 0), far)
        out.append((at, end))
        at = end - OVERLAP if end - OVERLAP > at else end
    return [*out, (at, n)]


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, text in zip(b["id"], b["text"]):
            s = text.strip()
            rows += [(key, k, i, s[i:j].rstrip()) for k, (i, j) in enumerate(cuts(s))]
        yield pd.DataFrame(rows, columns=["id", "chunk_index", "start", "text"]).astype({"chunk_index": "int32", "start": "int32"})


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, chunk_index, start, text, n_chars, token_estimate); null and blank texts have no chunks."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")
    out = rows.mapInPandas(_chunk_batches, "id string, chunk_index int, start int, text string")
    return out.withColumns({"n_chars": F.length("text"), "token_estimate": F.expr("length(text) div 4").cast("int")})
