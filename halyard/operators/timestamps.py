"""Mixed timestamp formats and time zones: one UTC instant per value, chosen along each source's record order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.timestamps import interpretations
from halyard.sources.staging import staged

FORMAT_SWITCH = 1.0
BACKWARD_JUMP = 2.0
JUMP_US = 86_400_000_000


def _tables(options: list[list[tuple[str, int]]], before: tuple[str, int] | None) -> tuple[list[int], list[list[int]]]:
    """Viterbi's costs of the last record's readings and, for each record but the first, the best reading before.

    Costs are whole microseconds of a jump of one day, so that sums are exact wherever a path is taken up.
    """
    switch = round(FORMAT_SWITCH * JUMP_US)

    def step(a: tuple, b: tuple) -> int:
        return switch * (a[0] != b[0]) + round(BACKWARD_JUMP * min(10 * JUMP_US, max(0, a[1] - b[1])))

    cost = [step(before, x) if before else 0 for x in options[0]]
    back: list[list[int]] = []
    for prev, here in zip(options, options[1:]):
        row, nxt = [], []
        for x in here:
            c, k = min((cost[i] + step(p, x), i) for i, p in enumerate(prev))
            row.append(k)
            nxt.append(c)
        back.append(row)
        cost = nxt
    return cost, back


def _trace(options: list, back: list[list[int]], last: int, k: int) -> list[tuple[str, int]]:
    """The path that ends with reading k of record `last`."""
    path = [options[last][k]]
    for i in range(last - 1, -1, -1):
        k = back[i][k]
        path.append(options[i][k])
    return path[::-1]


def best_path(options: list[list[tuple[str, int]]], before: tuple[str, int] | None = None) -> list[tuple[str, int]]:
    """Viterbi over the records of one source; every list holds a record's readings (at least one).

    The cost of a path counts changes of format and jumps back in time (in days, at most 10 a step).
    `before` is the last chosen reading. Ties fall to the earlier reading of the list.
    """
    cost, back = _tables(options, before)
    return _trace(options, back, len(options) - 1, min(range(len(cost)), key=cost.__getitem__))


def settled_path(options: list[list[tuple[str, int]]], before: tuple[str, int] | None = None) -> list[tuple[str, int]]:
    """The part of the path that no later record can change: up to where the paths to all readings of the last record meet."""
    _, back = _tables(options, before)
    ends = set(range(len(options[-1])))
    for last in range(len(options) - 1, -1, -1):
        if len(ends) == 1:
            return _trace(options, back, last, ends.pop())
        ends = {back[last - 1][k] for k in ends} if last else set()
    return []


#: A run of records with several readings is looked through for a settled part when it has grown to this many.
LOOK = 4096
DONE, OPEN, EDGE = 0, 1, 2
_KEYS = ["path", "ord", "record_id", "value"]
_OUT = {"record_type": "string", "record_id": "string", "format": "string", "sent_us": "bigint", "n_readings": "int"}
_STAGED = "kind int, path string, ord string, value string, home_zone string, date_order string, " + ", ".join(f"{c} {k}" for c, k in _OUT.items())


def _decide(batches: Iterator[pd.DataFrame], whole: bool) -> Iterator[pd.DataFrame]:
    """Rows come sorted by path and order. A record with a single reading is in every path, so the sequence
    falls apart there: only runs of records with several readings are held back.

    Where the rows are a part of the whole order (whole is false), the runs at both its ends stay open: they
    are passed on together with the edges beside them, the records nearest to them whose reading is known.
    With whole, the open runs and edges of all parts come in order; the rows of edges were given out before.
    """
    path, before, edge, rows, runs, look = None, None, None, [], [], LOOK
    started, first = whole, True  # started: what precedes in this path is known

    def row(kind: int, r: tuple, x: tuple | None, n: int) -> tuple:
        return (kind, *(r[:5] if kind != DONE else (None,) * 5), r[5], r[6], x[0] if x else None, x[1] if x else None, n)

    def readings(n: list) -> int:
        return len({y[1] for y in n})

    def give(n: int, chosen: list) -> list[tuple]:
        """The first n held rows with their readings."""
        nonlocal before, edge, rows, runs, look
        out = [row(DONE, r, x, readings(o)) for r, x, o in zip(rows[:n], chosen, runs)]
        if n:
            before, edge = chosen[n - 1], rows[n - 1]
        rows, runs, look = rows[n:], runs[n:], LOOK
        return out

    def close(after: list | None) -> list[tuple]:
        return give(len(runs), best_path(runs + ([after] if after else []), before)) if runs else []

    for batch in batches:
        out: list[tuple] = []
        for b in batch.itertuples(index=False):
            r = tuple(x if isinstance(x, str) else None for x in b[:7])  # path, ord, value, home_zone, date_order, record_type, record_id
            if r[0] != path:
                out += close(None)
                path, before, edge, started, first = r[0], None, None, whole or not first, False
            fixed = whole and b.kind == EDGE
            options = [(b.format, int(b.sent_us))] if fixed else interpretations(*r[2:5])
            if not options:
                out.append(row(DONE, r, None, 0))
            elif len(options) > 1 and not started:
                out.append(row(OPEN, r, None, 0))
            elif len(options) > 1:
                rows.append(r)
                runs.append(options)
                if len(runs) >= look:
                    chosen = settled_path(runs, before)
                    out += give(len(chosen), chosen)
                    look = max(LOOK, 2 * len(runs))
            else:
                out += close(options)
                if not started:
                    out.append(row(EDGE, r, options[0], 0))
                before, edge, started = options[0], r, True
                if not fixed:
                    out.append(row(DONE, r, before, 1))
        yield _frame(out)
    if whole:
        yield _frame(close(None))
    else:
        yield _frame(([row(EDGE, edge, before, 0)] if edge else []) + [row(OPEN, r, None, 0) for r in rows])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _decide(batches, False)


def _joints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return (df[list(_OUT)] for df in _decide(batches, True))


def _frame(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["kind", "path", "ord", "value", "home_zone", "date_order", *_OUT])
    return df.astype({"sent_us": "Int64"})


def normalise(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per record: its chosen format, instant (microseconds UTC) and number of instants it can denote.

    A source that states its order of day and month has only readings in that order; of the others all count.
    A value with one reading is settled by it, so the path only chooses where a value can mean several instants.

    records: record_type, record_id, source, ord, value (other columns are ignored); sources: mailbox,
    home_zone, date_order. The rows of a source are put in order over as many partitions as needed, so a
    source with a third of all rows is split. Runs of values with several readings at a cut stay open; those
    rows alone, with the known readings beside them, are put together again and decided, so that the path is
    that over the whole source wherever it was cut. Null, empty or unreadable values give a row with null
    instant and 0 readings; repeated records are read once; an empty table gives no rows.
    """
    known = sources.select(F.col("mailbox").alias("source"), "home_zone", "date_order").where("source is not null").groupBy("source").agg(F.min("home_zone").alias("home_zone"), F.min("date_order").alias("date_order"))
    one = records.groupBy("record_type", "record_id", "source", "value").agg(F.min("ord").alias("ord"))
    one = one.join(known, "source", "left")
    ordered = one.withColumn("path", F.concat_ws("|", "record_type", "source")).repartitionByRange("path", "ord", "record_id").sortWithinPartitions("path", "ord", "record_id", "value")
    parts = ordered.select("path", "ord", "value", "home_zone", "date_order", "record_type", "record_id").mapInPandas(_parts, _STAGED)
    parts = staged(parts, "timestamps")
    joints = parts.where(f"kind <> {DONE}").repartition("path").sortWithinPartitions(*_KEYS)
    joints = joints.select("path", "ord", "value", "home_zone", "date_order", "record_type", "record_id", "kind", "format", F.col("sent_us").cast("string").alias("sent_us"))
    return parts.where(f"kind = {DONE}").select(*_OUT).unionByName(joints.mapInPandas(_joints, ", ".join(f"{c} {k}" for c, k in _OUT.items())))


def one_instant(normalised: DataFrame) -> DataFrame:
    """The records whose value denotes exactly one instant under its source's declarations."""
    return normalised.where("n_readings = 1 and sent_us is not null").select("record_type", F.col("record_id").alias("email_id"), "sent_us").distinct()
