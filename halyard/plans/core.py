"""Registered queries of the general operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import timestamps
from halyard.plans import reference
from halyard.sources.tables import table


def _sent_records(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of records in their mailbox's order of arrival: a parsed message arrived with its first export, one that isn't in emails counts as last."""
    emails = table(spark, d, "emails").select("email_id", "mailbox", "sent_at", F.date_format(F.col("ingested_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ord"))
    arrival = emails.where("email_id is not null").groupBy("email_id").agg(F.min("ord").alias("ord"))
    parsed = table(spark, d, "parsed_eml", "email_id", "mailbox", "sent_at").join(arrival, "email_id", "left").withColumn("ord", F.coalesce("ord", F.lit("~")))
    one = lambda df, kind: df.select(F.lit(kind).alias("record_type"), F.col("email_id").alias("record_id"), F.col("mailbox").alias("source"), "ord", F.col("sent_at").alias("value"))
    return one(emails, "emails").unionByName(one(parsed, "parsed_eml"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of sent_at that denote exactly one instant, as microseconds UTC."""
    return timestamps.one_instant(timestamps.normalise(_sent_records(spark, d), table(spark, d, "mailboxes")))


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every sent_at with the format and instant chosen along its mailbox's order of arrival."""
    return timestamps.normalise(_sent_records(spark, d), table(spark, d, "mailboxes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_normalised": p4_normalised} | reference.QUERIES
SQL: dict[str, str] = dict(reference.SQL)
