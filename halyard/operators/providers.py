"""Model calls as row operators: a provider is any picklable function of texts; failures become rows, never failed jobs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.text import extraction_mode, real_length, strip

Provider = Callable[[str], str]
#: Fixed value: characters a token is estimated at before a call.
CHARS_PER_TOKEN = 3
#: Fixed value: signs that end a line.
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def first_sentences(prompt: str, n: int = 2) -> str:
    """The default completion where no model is at hand: the first sentences after the prompt's head."""
    body = prompt.split("\n\n", 1)[-1].strip()
    return " ".join(re.split(r"(?<=[.!?])\s+", body)[:n])


def complete(df: DataFrame, key: str, prompt: Column, provider: Provider = first_sentences, least: int = 1, retries: int = 3) -> DataFrame:
    """(key, text, input_tokens, output_tokens, status, error): status is ok, error, or skipped for null prompts and those with fewer than `least` characters besides white space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b["key"], b["prompt"]):
                if p is None or len(re.sub(r"\s", "", p)) < least:
                    rows.append((k, None, 0, 0, "skipped", None))
                    continue
                error = None
                for _ in range(retries):
                    try:
                        text = provider(p)
                        rows.append((k, text, len(p) // CHARS_PER_TOKEN, len(text) // CHARS_PER_TOKEN, "ok", None))
                        break
                    except Exception as e:  # noqa: BLE001  whatever a provider raises
                        error = f"{type(e).__name__}: {e}"[:200]
                else:
                    rows.append((k, None, len(p) // CHARS_PER_TOKEN, 0, "error", error))
            yield pd.DataFrame(rows, columns=["key", "text", "input_tokens", "output_tokens", "status", "error"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), prompt.alias("prompt")).mapInPandas(run, f"key {kind}, text string, input_tokens int, output_tokens int, status string, error string")
    return out.withColumnRenamed("key", key)


class ContextOverflow(Exception):
    """A provider's word that a text and its answer don't fit the model's window."""


#: Characters that a file must hold to be sent, and those that are sent to be classified.
LEAST_CHARS, CLASSIFIED_CHARS = 50, 25_000


def extract(files: DataFrame, key: str, text: str, full: Provider = first_sentences, classify: Provider = first_sentences, threshold: int = 6000) -> DataFrame:
    """(key, mode, status, n_sent, output, error): the whole text goes to `full` where the router lets it, else its beginning to `classify`.

    A text that overflows the model's window after all is classified; one with too few characters besides placeholders
    is skipped. Errors become rows. key is unique; null texts are skipped.
    """
    rows = files.select(F.col(key).alias("key"), F.col(text).alias("text"), extraction_mode(F.length(text), threshold).alias("mode"), real_length(F.col(text)).alias("real"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, mode, real in zip(b["key"], b["text"], b["mode"], b["real"]):
                if t is None or real < LEAST_CHARS:
                    out.append((k, None, "skipped", 0, None, None))
                    continue
                sent = t if mode == "full" else t[:CLASSIFIED_CHARS]
                try:
                    try:
                        answer = (full if mode == "full" else classify)(sent)
                    except ContextOverflow:
                        if mode != "full":
                            raise
                        mode, sent = "classify", t[:CLASSIFIED_CHARS]
                        answer = classify(sent)
                    out.append((k, mode, "ok", len(sent), answer, None))
                except Exception as e:  # noqa: BLE001  whatever a provider raises
                    out.append((k, mode, "error", len(sent), None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["key", "mode", "status", "n_sent", "output", "error"])

    kind = files.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, mode string, status string, n_sent int, output string, error string").withColumnRenamed("key", key)


def reformulated(question: Column, provider: Callable[[pd.Series], pd.Series]) -> Column:
    """A provider's wording of a question; the question itself where that is null or blank."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return provider(s)

    return F.coalesce(F.nullif(strip(run(F.coalesce(question, F.lit("")))), F.lit("")), question)


def labelled_line(text: Column, label: str) -> Column:
    """The rest of the last line that begins with a label and a colon, in any case; null where it is blank or missing. Every sign that ends a line counts, also those of whole texts."""
    lines = F.regexp_replace(text, LINE_END, "\n")
    found = F.regexp_extract_all(lines, F.lit(rf"(?imU)^[\s&&[^\n]]*{label}:([^\n]*)$"), F.lit(1))
    return F.nullif(strip(F.when(F.size(found) > 0, F.element_at(found, -1))), F.lit(""))


def judgement(text: Column) -> tuple[Column, Column]:
    """(score from 1 to 5, reasoning) of an answer's judgement, null where they are missing."""
    score = F.nullif(F.regexp_extract(text, r"(?U)SCORE:\s*([1-5])", 1), F.lit("")).cast("int")
    return score, F.nullif(strip(F.regexp_extract(text, r"(?U)REASONING:\s*([^\n]+)", 1)), F.lit(""))
