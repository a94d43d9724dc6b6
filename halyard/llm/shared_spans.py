"""Long exact spans shared between records: seed and extend over winnowed anchors.

Any window of `least` code points holds `least - K + 1` runs of K code points; winnowing keeps of these the
one with the smallest hash, which depends on the window's text alone. Two texts that share such a window
therefore share an anchor inside it, and the window lies within `least - K` code points around the anchor. So
each anchor that several texts hold takes the stretch around it along; stretches meet at their anchor and are
extended both ways: hashes only propose, characters decide. An anchor that very many places hold meets on the
hashes (128 bits) of the whole windows around it instead, which is as exact and makes no pairs by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.sources.staging import staged

LEAST = 200
K = 100
CHUNK = 1 << 18
#: Places an anchor may stand at before texts meet on whole windows around it.
HOT = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:] = base
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def winnow(texts: list[str], least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, position, hash) of the anchors of many texts at once; texts shorter than `least` have none."""
    w = least - k + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = np.empty(0, np.int64)
    n = int(sizes.sum())
    if n < least:
        return empty, empty, empty
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
    h = _mix((prefix[k:] - prefix[:-k]) * _powers(_inverse(_BASE), n - k + 1))
    at = np.arange(len(h), dtype=np.int64)
    # Windows of w hashes by doubling; of equal hashes the rightmost is kept.
    val, arg, width = h, at, 1
    while width * 2 <= w:
        left = val[:-width] < val[width:]
        val, arg = np.where(left, val[:-width], val[width:]), np.where(left, arg[:-width], arg[width:])
        width *= 2
    if w > width:
        off = w - width
        left = val[:-off] < val[off:]
        arg = np.where(left, arg[:-off], arg[off:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(arg)]
    inside = np.arange(len(arg)) + least <= ends[owner]
    kept = np.zeros(len(h), bool)
    kept[arg[inside]] = True
    pos = np.flatnonzero(kept)
    hashes = h[pos].view(np.int64)
    who = np.searchsorted(ends, pos, "right")
    local = pos - starts[who]
    return who, local, hashes


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        at, parts = 0, []
        while at < len(texts):  # some 256 thousand code points at a time, so that the arrays stay in the cache
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK):
                n += len(texts[end])
                end += 1
            w, p, h = winnow(texts[at:end])
            parts.append((w + at, p, h))
            at = end
        who, pos, h = (np.concatenate(x) for x in zip(*parts)) if parts else winnow([])
        offsets = np.searchsorted(who, np.arange(len(texts) + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(pos.astype(np.int32))], ["h", "pos"])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), b.column("n"), pa.ListArray.from_arrays(pa.array(offsets), items)], ["doc_id", "same", "n", "anchors"])


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, rep, n; reps: rep, n, anchors). Equal texts form one class, named by its smallest doc_id."""
    same = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    long = docs.select("doc_id", "text").where(F.length("text") >= LEAST).withColumn("same", same).withColumn("n", F.length("text"))
    found = staged(long.select("doc_id", "same", "n", "text").mapInArrow(_anchor_batches, "doc_id bigint, same binary, n int, anchors array<struct<h:bigint,pos:int>>"), "anchors")
    keys = found.select("doc_id", "same", "n")
    members = staged(keys.join(keys.groupBy("same").agg(F.min("doc_id").alias("rep")), "same").select("doc_id", "rep", "n").distinct(), "members")
    firsts = members.where("doc_id = rep").select("doc_id")
    return members, found.join(firsts, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "anchors")


_SPOT = "h bigint, g bigint, rep bigint, pos int, off int, ctx string"


def _spot_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text the stretches around its anchors that few hold (off: where the anchor begins in ctx) and the
    hashes h and g of all windows of LEAST code points that hold one of the others (ctx is null)."""
    for b in batches:
        parts = []
        for rep, text, few, at in zip(b["rep"], b["text"], b["few"], b["many"]):
            rows = [(x["h"], 0, rep, x["pos"], min(x["pos"], LEAST - K), text[max(0, x["pos"] - LEAST + K) : x["pos"] + LEAST]) for x in few]
            parts.append(pd.DataFrame(rows, columns=["h", "g", "rep", "pos", "off", "ctx"]))
            if len(at):
                n = len(text)
                starts = np.unique(np.concatenate([np.arange(max(0, p - LEAST + K), min(p, n - LEAST) + 1) for p in at]))
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                hashes = []
                for base in (_BASE, _BASE2):
                    prefix = np.zeros(n + 1, np.uint64)
                    np.cumsum((codes + np.uint64(1)) * _powers(base, n), out=prefix[1:])
                    hashes.append(_mix((prefix[starts + LEAST] - prefix[starts]) * _powers(_inverse(base), n)[starts]).view(np.int64))
                parts.append(pd.DataFrame({"h": hashes[0], "g": hashes[1], "rep": np.int64(rep), "pos": starts.astype(np.int32), "off": np.int32(0), "ctx": None}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def spots(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches around anchors that at most HOT places hold, windows around the others) of all texts whose anchors others hold.

    The counts of anchors are sums made before the shuffle; anchors meet them in a join that can be split where one
    anchor is in a third of all texts. Each text is shuffled once.
    """
    anchors = reps.select("rep", F.explode("anchors").alias("x")).select("rep", "x.h", "x.pos")
    counts = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    held = staged(counts.where("lo < hi").select("h", "n"), "shared_anchors")
    few = F.when(F.col("n") <= HOT, F.struct("h", "pos"))
    many = F.when(F.col("n") > HOT, F.col("pos"))
    own = anchors.join(held, "h").groupBy("rep").agg(F.collect_list(few).alias("few"), F.collect_set(many).alias("many"))  # a text's own anchors
    texts = docs.select(F.col("doc_id").alias("rep"), "text").where("text is not null")
    out = staged(own.join(texts, "rep").select("rep", "text", "few", "many").mapInPandas(_spot_batches, _SPOT), "spots")
    return out.where("ctx is not null"), out.where("ctx is null").select("h", "g", "rep", "pos")


def _common(x: str, y: str) -> int:
    """Length of the common start of two texts."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return next(i for i in range(n) if x[i] != y[i])


def extend(x: str, i: int, y: str, j: int, k: int = K) -> tuple[int, int]:
    """(code points to the left, to the right) by which the equal runs x[i:i+k] and y[j:j+k] go on alike; (-k, 0) where the runs differ."""
    if x[i : i + k] != y[j : j + k]:
        return -k, 0
    return _common(x[:i][::-1], y[:j][::-1]), _common(x[i + k :], y[j + k :])


def _class_spans(places: list, intervals: bool) -> set[tuple[int, ...]]:
    """Of the places that hold one anchor (at most HOT): (a, b) of the texts that share a span of LEAST around it, or
    (text, start, end) of what they share there. Equal stretches are compared once."""
    groups: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for x in places:
        groups.setdefault((x["off"], x["ctx"]), []).append((x["rep"], x["pos"]))
    every = list(groups.items())
    out: set[tuple[int, ...]] = set()

    def meet(us: list, vs: list, left: int, right: int) -> None:
        if intervals:
            first, second = {a for a, _ in us}, {b for b, _ in vs}
            out.update((a, p - left, p + K + right) for a, p in us if second - {a})
            out.update((b, p - left, p + K + right) for b, p in vs if first - {b})
        else:
            out.update((min(a, b), max(a, b)) for a, _ in us for b, _ in vs if a != b)

    for n, ((i, x), us) in enumerate(every):
        if len(x) >= LEAST and len(us) > 1:
            meet(us, us, i, len(x) - i - K)
        for (j, y), vs in every[n + 1 :]:
            left, right = extend(x, i, y, j)
            if left + K + right >= LEAST:
                meet(us, vs, left, right)
    return out


def _classes(few: DataFrame, intervals: bool) -> DataFrame:
    names = ["rep", "s", "e"] if intervals else ["a", "b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list({r for places in b["places"] for r in _class_spans(places, intervals)}), columns=names).astype("int64")

    places = few.groupBy("h").agg(F.collect_list(F.struct("rep", "pos", "off", "ctx")).alias("places"))  # at most HOT
    return places.select("places").mapInPandas(run, ", ".join(f"{c} bigint" for c in names)).distinct()


def class_pairs(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b), a < b: different texts with an equal span of at least LEAST code points.

    Windows that the same texts hold bring the same pairs, so of these one is taken.
    """
    few, many = spots(docs, reps)
    held = staged(many.select("h", "g", "rep").distinct(), "windows")
    who = F.xxhash64("rep")
    sets = held.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(who).alias("x"), F.sum(F.shiftrightunsigned(who, 20)).alias("y"))
    one = staged(sets.where("lo < hi").groupBy("n", "lo", "hi", "x", "y").agg(F.min(F.struct("h", "g")).alias("w")).select("w.h", "w.g"), "sets")
    kept = held.join(one, ["h", "g"], "left_semi")
    left, right = kept.select("h", "g", F.col("rep").alias("a")), kept.select("h", "g", F.col("rep").alias("b"))
    met = left.join(right, ["h", "g"]).where("a < b").select("a", "b")
    return _classes(few, False).unionByName(met).distinct()


def sharing_pairs(docs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of records with an equal span of at least LEAST code points.

    Null texts and texts shorter than LEAST share nothing; equal texts share all; doc_id is unique, rows
    that repeat it count once; other columns are ignored; an empty table gives no pairs.
    """
    docs = docs.select("doc_id", "text")
    members, reps = text_classes(docs)
    pairs = class_pairs(docs, reps)
    same = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).groupBy("a", "b").count().where("count > 1").select("a", "b")
    left = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    every = pairs.unionByName(same).join(left, "a").join(right, "b").where("a <> b or x < y")
    return every.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_part(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each text stands elsewhere too, in spans of at least LEAST.
    No pairs of records are made.

    Null texts have n_chars null, 0 shared characters and share 0.0; so have blank ones with their length.
    """
    docs = docs.select("doc_id", "text")
    members, reps = text_classes(docs)
    few, many = spots(docs, reps)
    held = many.groupBy("h", "g").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("h", "g")
    whole = many.join(held, ["h", "g"], "left_semi").select("rep", F.col("pos").cast("bigint").alias("s"), (F.col("pos") + LEAST).cast("bigint").alias("e"))
    parts = _classes(few, True).unionByName(whole)
    before = F.max("e").over(Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    covered = parts.withColumn("from", F.greatest("s", F.coalesce(before, F.lit(0)))).where("e > from").groupBy("rep").agg(F.sum(F.col("e") - F.col("from")).alias("covered"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    per = members.join(sizes, "rep").join(covered, "rep", "left").select("doc_id", F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"))
    every = docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars")).join(per, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0).cast("bigint"))
    return every.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))
