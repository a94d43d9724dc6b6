"""Texts that a model is shown: prompts of a message with its files, and the context of a search's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.text import letter_label, strip


def attachment_prompts(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(email_id, prompt): direction, date, the message's summary and the text of all its files in order.

    messages: email_id (unique), direction, date, summary; files: email_id, ord, file_name, content. A list holds the
    files of one message; null contents count as empty.
    """
    one = F.struct("ord", F.concat(F.lit("--- Attachment: "), F.coalesce("file_name", F.lit("")), F.lit(" ---\n"), F.coalesce(strip(F.col("content")), F.lit(""))).alias("t"))
    parts = files.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("files"))
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    block = F.when(F.col("files").isNotNull(), F.concat(F.lit("\n\n"), "files")).otherwise("")
    prompt = F.concat(F.lit("Direction: "), c("direction"), F.lit("\nDate: "), c("date"), F.lit("\n\nEmail summary:\n"), strip(c("summary")), block)
    return messages.join(parts, "email_id", "left").select("email_id", prompt.alias("prompt"))


def _lines(rows: DataFrame, order: list[str], text: Column, glue: str = "\n") -> DataFrame:
    """One row with all texts in order: for the few rows of a search."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), glue).alias("text"))


def build_context(hits: DataFrame, winners: DataFrame, fixtures: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row (context): the winning groups' fixture texts in order of votes, then the hits below their messages.

    hits: group, message (null where unknown), source_type, similarity, text, rank (unique); winners: group, place
    (unique); fixtures: group, summary; summaries: message, summary. Hits stand by (group, message), the group of the
    best similarity first and at ties by first appearance; inside by rank. Groups are labelled A, B, ... and messages
    e1, e2, ... in the order in which they appear. Without hits and fixtures only the heading of the sources is given.
    The results of one search are few, so windows over all of them are small.
    """
    shown = winners.join(fixtures.where("summary is not null"), "group").select("group", "summary", F.row_number().over(Window.orderBy("place")).alias("n"))
    same = Window.partitionBy("group", "message")
    h = hits.withColumns({"best": F.max("similarity").over(same), "first": F.min("rank").over(same)})
    h = h.withColumn("block", F.dense_rank().over(Window.orderBy(F.desc("best"), "first")))
    late = h.groupBy("group").agg(F.min("block").alias("b")).join(shown.select("group"), "group", "left_anti")
    counted = shown.agg(F.count("*").alias("k"))
    late = late.crossJoin(counted).select("group", (F.row_number().over(Window.orderBy("b")) + F.col("k")).alias("n"))
    labels = shown.select("group", "n", F.lit(True).alias("fixture")).unionByName(late.select("group", F.col("n").cast("int"), F.lit(False).alias("fixture")))
    labels = labels.withColumn("label", letter_label(F.col("n") - 1))
    known = h.where("message is not null").groupBy("message").agg(F.min("block").alias("b"))
    known = known.select("message", F.concat(F.lit("e"), F.row_number().over(Window.orderBy("b"))).alias("e"))
    rows = h.join(labels.select("group", "label"), "group").join(known, "message", "left").join(summaries.withColumnRenamed("summary", "__s"), "message", "left")
    rows = rows.withColumns({"no": F.row_number().over(Window.orderBy("block", "rank")), "head": F.row_number().over(Window.partitionBy("block").orderBy("rank")) == 1, "tail": F.row_number().over(Window.partitionBy("block").orderBy(F.desc("rank"))) == 1})
    title = F.concat(F.lit("[VOYAGE "), "label", F.lit(" | "), F.when(F.col("message").isNull(), "(no email)").otherwise(F.concat(F.lit("EMAIL "), "e")), F.lit("]\n"))
    above = F.when(F.col("head"), F.concat(title, F.when(F.col("__s").isNotNull(), F.concat(F.lit("THREAD SUMMARY: "), "__s", F.lit("\n"))).otherwise(""))).otherwise("")
    body = F.concat(above, F.lit("CHUNK "), F.col("no").cast("string"), F.lit(" ["), "source_type", F.lit("] (similarity "), F.format_string("%.4f", F.col("similarity")), F.lit("): "), F.coalesce("text", F.lit("")), F.when(F.col("tail"), "\n").otherwise(""))
    sources = _lines(rows, ["no"], body)
    sheets = _lines(shown.withColumn("label", letter_label(F.col("n") - 1)), ["n"], F.concat(F.lit("["), "label", F.lit("]\n"), "summary", F.lit("\n")))
    both = sheets.select(F.col("text").alias("a")).crossJoin(sources.select(F.col("text").alias("b")))
    text = F.concat(F.when(F.col("a") != "", F.concat(F.lit("=== VOYAGE FIXTURES ===\n"), "a", F.lit("\n"))).otherwise(""), F.lit("=== SOURCES ===\n"), "b")
    return both.select(strip(text).alias("context"))
