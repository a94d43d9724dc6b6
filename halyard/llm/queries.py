"""Registered queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import email_layout, encoding_repair, mixing, page_noise, pii, shared_spans, tokenization
from halyard.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of scanning noise in each file's markdown."""
    return page_noise.found_noise(table(spark, d, "docling", "sha256", "markdown"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Files' markdown in continuous paragraphs of whole, rightly read words."""
    return page_noise.repaired_files(table(spark, d, "docling", "sha256", "markdown"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of emails that hold characters produced by a wrong decoding."""
    return encoding_repair.garbled_fields(table(spark, d, "emails"), "email_id", ["subject", "body_text"]).withColumnRenamed("record_id", "email_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled fields with their text restored as far as it can be."""
    found = encoding_repair.restored_fields(table(spark, d, "emails"), "email_id", ["subject", "body_text"])
    return found.where("garbled").select(F.col("record_id").alias("email_id"), "field_name", "restored")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of email bodies that their sender didn't newly write."""
    return email_layout.lines_not_new(table(spark, d, "emails"))


def p3_reduced(spark: SparkSession, d: str) -> DataFrame:
    """Email bodies reduced to the newly written text."""
    return email_layout.reduced(table(spark, d, "emails"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in messages, sender fields and files."""
    return pii.found_spans(pii.texts_of(table(spark, d, "emails"), table(spark, d, "docling", "sha256", "markdown")))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with typed placeholders."""
    return pii.redacted(pii.texts_of(table(spark, d, "emails"), table(spark, d, "docling", "sha256", "markdown")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenization.encode_texts(table(spark, d, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ids of each document decode to its text."""
    docs = table(spark, d, "documents", "doc_id", "text")
    back = tokenization.decode_ids(tokenization.encode_texts(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("exact"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """How often each document stands in each mix."""
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target shares and those reached, in tokens."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with an equal span of 200 or more code points."""
    return shared_spans.sharing_pairs(table(spark, d, "documents", "doc_id", "text"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    return shared_spans.shared_part(table(spark, d, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_reduced": p3_reduced,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_shared": p8_shared,
}
SQL: dict[str, str] = {}
