"""Threads of messages: connected components over replies, references and shared subjects with shared people.

Messages with equal subject and a common participant are linked to the first of them instead of pair by pair, so
the links grow with the messages. Components are found by alternating large and small stars (Kiveris et al., 2014):
each step links a node's neighbours to the smallest of them, and the links are written out after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.text import normalize_subject, uuid5
from halyard.sources.staging import discard, staged

#: Fixed value: namespace of thread ids.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): every node with the smallest id of its component. links: a, b in any direction, with repeats.

    The smallest neighbours are partial minima; each node's links meet their one minimum in a join that can be split
    where a node has very many.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    size = lambda df: df.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
    seen = None
    while (now := size(edges)) != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = staged(small.distinct(), "links")
        discard(edges, large)
        edges = new
    return nodes.select("id").distinct().join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def thread_links(messages: DataFrame) -> DataFrame:
    """(a, b) ids of messages and of what links them: a reply or reference to a known message, or a subject with a participant.

    messages: id, group_key, message_id, in_reply_to, reference_ids, subject, people (array). A message id that
    several messages bear stands for the last of them by id.
    """
    known = messages.where("message_id is not null").groupBy("group_key", "message_id").agg(F.max("id").alias("b"))
    asked = messages.select("group_key", F.col("id").alias("a"), F.explode(F.array_union(F.coalesce("reference_ids", F.array().cast("array<string>")), F.array("in_reply_to"))).alias("message_id")).where("message_id is not null")
    replies = asked.join(known, ["group_key", "message_id"]).select("a", "b")
    topic = normalize_subject(F.col("subject"))
    by_person = messages.select("group_key", F.col("id").alias("a"), topic.alias("topic"), F.explode(F.array_distinct(F.transform("people", lambda p: F.lower(p)))).alias("person")).where("topic <> '' and person is not null and person <> ''")
    keys = ["group_key", "topic", "person"]
    first = by_person.groupBy(*keys).agg(F.min("a").alias("b"))
    met = by_person.join(first, keys).where("a <> b").select("a", "b")
    return replies.unionByName(met)


def threads(messages: DataFrame) -> DataFrame:
    """(id, thread_id, thread_size): a thread is named by the version 5 UUID of group, subject and first message.

    The first message of a thread is the earliest by sent_at (a missing one comes first), then by id.
    """
    roots = components(messages, thread_links(messages))
    rows = messages.select("id", "group_key", "sent_at", normalize_subject(F.col("subject")).alias("topic")).join(roots, "id")
    first = rows.groupBy("root").agg(F.min(F.struct(F.coalesce(F.unix_micros("sent_at"), F.lit(0)).alias("t"), "id", "group_key", "topic")).alias("x"), F.count("*").alias("thread_size"))
    name = F.concat_ws("|", F.coalesce("x.group_key", F.lit("")), F.coalesce(F.nullif(F.col("x.topic"), F.lit("")), F.col("x.id")), F.col("x.id"))
    return rows.join(first, "root").select("id", uuid5(NAMESPACE, name).alias("thread_id"), "thread_size")


def earlier_in_thread(messages: DataFrame) -> DataFrame:
    """(id, prior_count, prior_chars) by thread, earlier first and missing times last: running counts, not collected texts."""
    w = Window.partitionBy("thread_id").orderBy(F.col("sent_at").asc_nulls_last(), "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return messages.select("id", (F.row_number().over(w) - 1).cast("bigint").alias("prior_count"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint").alias("prior_chars"))
