"""Personal information inside free text: found by a character-level tagger, replaced by typed placeholders.

A bidirectional LSTM with CRF transitions (pii_model) tags the characters of whole texts, batch by batch on the
executors; its path is decoded over all windows at once. Each tagged span is then settled by the exact form of its kind (pii_patterns): where it begins and
ends, and whether it can be of its kind at all. Spans the tagger doesn't touch aren't looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import pii_model as M
from halyard.llm import pii_patterns as P

AROUND = 60


def weights() -> dict[str, np.ndarray]:
    from halyard.llm.pii_train import WEIGHTS

    with np.load(WEIGHTS) as z:
        return {k: np.ascontiguousarray(z[k]) for k in z.files}


def settle(text: str, start: int, end: int, kind: str) -> list[tuple[int, int, str]]:
    """The exact (start, end, kind) that a tagged stretch of a text stands for; a document's number may have been taken for one to dial."""
    if kind == "person":
        return [(i, j, kind) for i, j in _person(text, start, end)]
    lo, hi = max(0, start - AROUND), min(len(text), end + AROUND)
    for form in (kind, "id_number") if kind == "phone" else (kind,):
        found = [(lo + i, lo + j) for i, j in P.exact(text[lo:hi], form)]
        found = [(i, j) for i, j in found if min(j, end) - max(i, start) >= 0.5 * min(j - i, end - start)]
        if form != kind:
            found = [(i, j) for i, j in found if P.ID_LABEL.search(text, max(0, i - 40), i)]
        if found:
            return [(i, j, form) for i, j in found]
    i, j = start, end
    while i < j and not text[i].isalnum() and text[i] not in "+(":
        i += 1
    while j > i and not text[j - 1].isalnum():
        j -= 1
    s = text[i:j]
    digits = sum(c.isdigit() for c in s)
    good = {
        "email": ("@" in s or "at" in s.lower()) and len(s) > 6,
        "id_number": digits >= 5 and len(s) >= 7 and not re.fullmatch(r"[A-Z]{2}[-/]?\w{5,6}", s),  # that is a reference's form
        "phone": digits >= 8,
        "address": len(s) >= 8 and digits > 0 and sum(c.isalpha() for c in s) >= 5,
    }[kind]
    return [(i, j, kind)] if good else []


def _person(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Names within a tagged stretch: whole words, without titles, not those of ships."""
    runs: list[list[tuple[int, int]]] = []
    for i, j in P.name_tokens(text, start, end):
        over = min(j, end) - max(i, start)
        if over < 0.5 * (j - i) or text[i].islower():
            continue
        gap = text[runs[-1][-1][1] : i] if runs else None
        if gap is not None and gap in (" ", "\n", ", ", ",\n", ",", "  "):
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    out = []
    for run in runs:
        i, j = run[0][0], run[-1][1]
        if (m := P.TITLES.match(text, i)) and m.end() < j:
            i = m.end()
        if text[i:j].rstrip(".").isupper() and len(text[i:j].rstrip(".")) < 3 or P.SHIP.search(text[max(0, i - 12) : i]):
            continue
        if j - i >= 2:
            out.append((i, j))
    return out


def find(texts: list[str], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of every text, in order and without overlaps."""
    gap = "\n\n"
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]]) if len(texts) else np.empty(0, np.int64)
    labels = M.tag(p, M.encode(gap.join(texts)))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, j, k in M.spans(labels):
        n = int(np.searchsorted(starts, i, "right")) - 1
        i, j = i - int(starts[n]), min(j - int(starts[n]), int(sizes[n]))
        if i >= j:
            continue
        t, have = texts[n], out[n]
        for a, b, kind in settle(t, i, j, P.KINDS[k - 1]):
            if not have or a >= have[-1][1]:
                have.append((a, b, kind))
            elif (a, b) != have[-1][:2] and b - a > have[-1][1] - have[-1][0] and (len(have) < 2 or a >= have[-2][1]):
                have[-1] = (a, b, kind)
    return out


def replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a placeholder such as [EMAIL] in place of each span."""
    out, at = [], 0
    for i, j, kind in spans:
        out += [text[at:i], f"[{kind.upper()}]"]
        at = j
    return "".join([*out, text[at:]])


#: Characters tagged at a time.
CHUNK = 1 << 21


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def _find_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            texts, fields, ids = b["text"].tolist(), b["field_name"].tolist(), b["rec_id"].tolist()
            rows = set()
            for lo, hi in _chunks(texts):
                for n, spans in enumerate(find(texts[lo:hi], p), lo):
                    rows.update((fields[n], ids[n], kind, texts[n][i:j]) for i, j, kind in spans)
            yield pd.DataFrame(list(rows), columns=["field_name", "rec_id", "pii_kind", "span"])

    return run


def _replace_batches(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            texts, done = b["text"].tolist(), []
            for lo, hi in _chunks(texts):
                done += [replace(t, s) for t, s in zip(texts[lo:hi], find(texts[lo:hi], p))]
            yield pd.DataFrame({"field_name": b["field_name"], "rec_id": b["rec_id"], "text": done})

    return run


def texts_of(emails: DataFrame, docling: DataFrame) -> DataFrame:
    """(field_name, rec_id, text): the fields that hold free text, every message and file once; null and empty texts are left out."""
    e = emails.select("email_id", "body_cleaned", "from_addr").dropDuplicates(["email_id"])
    pairs = F.array(F.struct(F.lit("body_cleaned").alias("field_name"), F.col("body_cleaned").alias("text")), F.struct(F.lit("from_addr").alias("field_name"), F.col("from_addr").alias("text")))
    fields = e.select(F.col("email_id").alias("rec_id"), F.explode(pairs).alias("f")).select("f.field_name", "rec_id", "f.text")
    files = docling.groupBy("sha256").agg(F.min("markdown").alias("text")).select(F.lit("markdown").alias("field_name"), F.col("sha256").alias("rec_id"), "text")
    return fields.unionByName(files).where("text is not null and text <> ''")


def found_spans(texts: DataFrame) -> DataFrame:
    """Distinct (field_name, rec_id, pii_kind, span) of (field_name, rec_id, text) rows. What is broadcast are the tagger's weights (under 0.3 MB)."""
    shared = texts.sparkSession.sparkContext.broadcast(weights())
    return texts.select("field_name", "rec_id", "text").where("text is not null").mapInPandas(_find_batches(shared), "field_name string, rec_id string, pii_kind string, span string").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(field_name, rec_id, text) with placeholders; texts without personal information stay as they are."""
    shared = texts.sparkSession.sparkContext.broadcast(weights())
    return texts.select("field_name", "rec_id", "text").where("text is not null").mapInPandas(_replace_batches(shared), "field_name string, rec_id string, text string")
