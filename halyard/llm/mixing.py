"""Mixing sources to target weights: cube-method balanced sampling over a corpus.

Every source of a mix needs r = size x share / tokens copies of itself. All its records are taken floor(r)
times; the fraction that is left is an inclusion probability, the same for all records of the source. The
flight moves these probabilities along the null space of the constraints (tokens and number of records of the
source stay as they are) until each is 0 or 1 but for two; it runs in blocks of records, then over what the
blocks left and a small reserve, and a landing decides the last two by the smallest deviation in tokens, which
swaps within the reserve make smaller still.
"""

from __future__ import annotations

import bisect
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.sources.staging import staged
from halyard.llm.tokenization import token_counts

BLOCK = 4096
#: Records of a source (about so many) that wait for the landing, so that it can come near in tokens.
RESERVE = 128
SEED = 20
_EPS = 1e-9


def flight(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Probabilities after the flight: sum(pi) and sum(pi * size) are kept, all but at most two are 0 or 1."""
    pi = list(pi)
    waiting = [i for i, p in enumerate(pi) if _EPS < p < 1 - _EPS]
    for i, p in enumerate(pi):
        if p <= _EPS or p >= 1 - _EPS:
            pi[i] = float(round(p))
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1.0, -1.0)
        else:
            return pi
        up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(active, u) if x)
        down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            pi[i] += step * x
        for i in list(active):
            if pi[i] <= _EPS or pi[i] >= 1 - _EPS:
                pi[i] = float(round(pi[i]))
                active.remove(i)


def land(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """0 or 1 for the units that the flight left: the choice nearest in tokens, then in number, to what was expected."""
    left = [i for i, p in enumerate(pi) if _EPS < p < 1 - _EPS]
    tokens, count = sum(pi[i] * size[i] for i in left), sum(pi[i] for i in left)
    best = None
    for bits in range(1 << len(left)):
        chosen = [i for k, i in enumerate(left) if bits >> k & 1]
        key = (abs(sum(size[i] for i in chosen) - tokens), abs(len(chosen) - count), rng.random())
        if best is None or key < best[0]:
            best = (key, set(chosen))
    return [float(i in best[1]) if i in left else p for i, p in enumerate(pi)]


def exchange(pi: list[float], size: list[float], target: float) -> list[float]:
    """Decided units with one taken and one left swapped, if that brings the tokens nearer to the target; up to four times.

    The swaps aren't drawn by chance, so they move the units' inclusion probabilities a little from those asked for.
    """
    pi = list(pi)
    for _ in range(4):
        off = target - sum(p * s for p, s in zip(pi, size))
        inside, outside = [i for i, p in enumerate(pi) if p == 1], sorted((i for i, p in enumerate(pi) if p == 0), key=size.__getitem__)
        sizes = [size[i] for i in outside]
        best = (abs(off), None, None)
        for i in inside:
            k = bisect.bisect_left(sizes, size[i] + off)
            for j in (k - 1, k):
                if 0 <= j < len(sizes) and abs(off - sizes[j] + size[i]) < best[0]:
                    best = (abs(off - sizes[j] + size[i]), i, outside[j])
        if best[1] is None:
            break
        pi[best[1]], pi[best[2]] = 0.0, 1.0
    return pi


def _fly(last: bool, salt: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        first = pdf.iloc[0]
        rng = random.Random(f"{SEED}|{salt}|{first.mix_id}|{first.source}|{first.doc_id}")
        order = list(range(len(pdf)))
        rng.shuffle(order)
        p, s = pdf["pi"].to_numpy()[order].tolist(), pdf["n_tokens"].to_numpy()[order].tolist()
        target = sum(x * y for x, y in zip(p, s))
        p = flight(p, s, rng)
        if last:
            p = exchange(land(p, s, rng), s, target)
        out = pdf.iloc[order].copy()
        out["pi"] = p
        return out

    return run


_UNIT = "mix_id string, source string, doc_id bigint, n_tokens bigint, pi double, whole bigint, in_source bigint"


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, stated_share, target_share, max_repeats, tokens, n_docs, repeats) of every stated source of every mix.

    Shares are weights: null or negative ones count as 0 and those of the sources that have tokens are
    normalised; repeats is the (fractional) number of copies of the source. The size of a mix is the largest
    that its caps allow; where no source has a cap it is that of its sources together. A source that is
    stated twice in a mix has the sum of its shares and the smallest cap.
    """
    t = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("w"), F.min("max_repeats").cast("bigint").alias("max_repeats")
    )
    t = t.join(sizes, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0).cast("bigint")), "n_docs": F.coalesce("n_docs", F.lit(0).cast("bigint"))})
    mix = Window.partitionBy("mix_id")
    usable = (F.col("tokens") > 0) & (F.col("w") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    t = t.withColumn("share", F.when(usable, F.col("w") / F.sum(F.when(usable, F.col("w"))).over(mix)).otherwise(0.0))
    limit = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(mix)
    t = t.withColumn("size", F.coalesce(limit, F.sum(F.when(usable, F.col("tokens")).cast("double")).over(mix)))
    repeats = F.when(usable, F.col("size") * F.col("share") / F.col("tokens")).otherwise(0.0)
    repeats = F.when(F.col("max_repeats").isNotNull(), F.least(repeats, F.col("max_repeats").cast("double"))).otherwise(repeats)
    return t.select("mix_id", "source", F.when(F.sum("w").over(mix) > 0, F.col("w") / F.sum("w").over(mix)).otherwise(0.0).alias("stated_share"), F.col("share").alias("target_share"), "max_repeats", "tokens", "n_docs", F.round(repeats, 12).alias("repeats"))


def _sizes(units: DataFrame) -> DataFrame:
    return units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def _units(docs: DataFrame) -> DataFrame:
    counts = token_counts(docs.select("doc_id", "source", "text").withColumn("doc", F.struct("doc_id", "source")), "doc")
    return staged(counts.select("doc.doc_id", "doc.source", F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0 and source is not null").dropDuplicates(["doc_id"]), "units")


def select(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats): how often each record stands in each mix, at least once.

    Records without source or tokens (null, empty texts) are in no mix; a repeated doc_id counts once; other
    columns are ignored; empty tables give no rows. No record is repeated more than its source's max_repeats.
    """
    return _select(_units(docs), targets)


def _select(units: DataFrame, targets: DataFrame) -> DataFrame:
    sizes = _sizes(units)
    wanted = plan(sizes, targets).where("repeats > 0").select("mix_id", "source", F.floor("repeats").cast("bigint").alias("whole"), (F.col("repeats") - F.floor("repeats")).alias("pi"), F.col("n_docs").alias("in_source"))
    every = units.join(wanted, "source")
    open_ = every.where("pi > 0").select("mix_id", "source", "doc_id", "n_tokens", "pi", "whole", "in_source")
    fixed = every.where("pi = 0").select("mix_id", "source", "doc_id", "n_tokens", F.col("whole").alias("repeats"))
    decided = [fixed]
    salt = 0
    waits = F.pmod(F.xxhash64("doc_id", F.lit("reserve")), F.col("in_source")) < RESERVE
    reserve, left = open_.where(waits), open_.where(~waits)
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("in_source") / BLOCK))
        cut = left.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt)), blocks))
        flown = staged(cut.groupBy("mix_id", "source", "block").applyInPandas(_fly(False, salt), _UNIT + ", block bigint").drop("block"), "flown")
        decided.append(flown.where("pi = 0 or pi = 1").select("mix_id", "source", "doc_id", "n_tokens", (F.col("whole") + F.col("pi")).cast("bigint").alias("repeats")))
        rest = flown.where("pi > 0 and pi < 1")
        left = rest.drop("in_source").join(rest.groupBy("mix_id", "source").agg(F.count("*").alias("in_source")), ["mix_id", "source"]).select("mix_id", "source", "doc_id", "n_tokens", "pi", "whole", "in_source")
        salt += 1
        if (left.agg(F.max("in_source")).first()[0] or 0) <= BLOCK:
            break
    landed = left.unionByName(reserve).groupBy("mix_id", "source").applyInPandas(_fly(True, salt), _UNIT)
    decided.append(landed.select("mix_id", "source", "doc_id", "n_tokens", (F.col("whole") + F.col("pi")).cast("bigint").alias("repeats")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.where("repeats > 0")


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached: one row per stated source of each mix, also where it is missing from the records."""
    units = _units(docs)
    chosen = _select(units, targets)
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("size_tokens"), F.sum("repeats").alias("size_docs"), F.max("repeats").alias("most_repeats"))
    p = plan(_sizes(units), targets).join(got, ["mix_id", "source"], "left")
    zero = F.lit(0).cast("bigint")
    size = F.coalesce("size_tokens", zero)
    total = F.sum(size).over(Window.partitionBy("mix_id"))
    return p.select(
        "mix_id", "source", "stated_share", "target_share", "max_repeats", size.alias("size_tokens"), F.coalesce("size_docs", zero).alias("size_docs"),
        F.coalesce("most_repeats", zero).alias("most_repeats"), F.when(total > 0, size / total).otherwise(0.0).alias("reached_share"),
    )
