import pytest

from halyard.functions.timestamps import interpretations
from halyard.operators.timestamps import best_path, normalise, one_instant

H = 3_600_000_000


def us(value, home="UTC", order="dmy"):
    return sorted({x[1] for x in interpretations(value, home, order)})


@pytest.mark.parametrize(
    "value, home, order, expected",
    [
        ("2024-01-05T19:06:12Z", None, None, [1704481572000000]),
        ("2024-01-24 11:08:19[Europe/Athens]", None, None, [1706087299000000]),
        ("2024-02-25 21:42:36 America/New_York", None, None, [1708915356000000]),
        ("Thu Jan 11 05:41:00 2024", "UTC", "dmy", [1704951660000000]),
        ("18/Jan/2024 15:26:47 UTC+04:00", None, None, [1705577207000000]),
        ("Sun, 22 Jun 2025 05:54:09 +0530 (local)", None, None, [1750551849000000]),
        ("1704731578", None, None, [1704731578000000]),
        ("1704915324398", None, None, [1704915324398000]),
        ("1705305727907194", None, None, [1705305727907194]),
        ("01-05-2024 05:40:13", "UTC", "mdy", [1704433213000000]),
        ("01-05-2024 05:40:13", "UTC", "dmy", [1714542013000000]),
        ("28. Januar 2024, 20:54:51 Uhr", "UTC", "dmy", [1706475291000000]),
        ("12 de abril de 2024 21:35", "UTC", "dmy", [1712957700000000]),
        ("16 janvier 2024 à 08:03:52", "UTC", "dmy", [1705392232000000]),
        ("22. februar 2024 kl. 22:39", "UTC", "dmy", [1708641540000000]),
        ("19.02.24 9:12:53 PM", "UTC", "dmy", [1708377173000000]),
        ("2024-07-19 03:00 CST", "America/Chicago", "mdy", [1721379600000000]),
        ("20240115T131157Z", None, None, [1705324317000000]),
        ("20240115", "UTC", "dmy", []),
        ("2024-01-13", "UTC", "dmy", []),
        ("31.02.2025 10:15", "UTC", "dmy", []),
        ("Mon, 99 Foo 2025 25:61:00 +0000", "UTC", "dmy", []),
        ("2024-03-10 02:18", "America/New_York", "mdy", []),
        ("2024-01-10 23:54", None, None, []),
        ("n/a", "UTC", "dmy", []),
        ("", "UTC", "dmy", []),
        (None, "UTC", "dmy", []),
        ("9" * 5000, "UTC", "dmy", []),
    ],
)
def test_readings(value, home, order, expected):
    assert us(value, home, order) == expected


def test_hour_that_occurs_twice_has_two_readings():
    assert [b - a for a, b in [us("2025-10-26 02:30", "Europe/Berlin")]] == [H]


def test_path_avoids_jumps_back_and_format_switches():
    day = 86_400_000_000
    options = [[("a", 10 * day)], [("b", 2 * day), ("a", 11 * day)], [("a", 12 * day)]]
    assert best_path(options)[1] == ("a", 11 * day)


def test_table(spark):
    rows = [
        ("emails", "a", "m1", "1", "01/02/2024 10:00"), ("emails", "a", "m1", "2", "01/02/2024 10:00"), ("emails", "b", None, "3", "01/02/2024 10:00"),
        ("emails", "c", "m1", "4", None), ("emails", "d", "m2", "5", "25/10/2026, 01:54:11"), ("emails", "e", None, "6", "2024-01-05T19:06:12Z"),
        ("emails", "f", "m1", "7", "01/31/2024 10:00"), ("emails", "g", "m1", "8", " " * 300 + "2024-01-05T19:06:12Z" + " (" + "x" * 5000 + ")"),
    ]
    df = spark.createDataFrame(rows, "record_type string, record_id string, source string, ord string, value string")
    zones = spark.createDataFrame([("m1", "UTC", "dmy"), ("m2", "Europe/London", "dmy"), (None, "UTC", "mdy")], "mailbox string, home_zone string, date_order string")
    n = normalise(df, zones)
    assert {r.record_id: r.n_readings for r in n.collect()} == {"a": 1, "b": 0, "c": 0, "d": 2, "e": 1, "f": 0, "g": 1}
    assert {(r.email_id, r.sent_us) for r in one_instant(n).collect()} == {("a", 1706781600000000), ("e", 1704481572000000), ("g", 1704481572000000)}
    assert normalise(df.limit(0), zones).count() == 0


def _mailbox(n, seed):
    """Values of one mailbox in order of arrival, most of them with several readings."""
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(seed)
    t, rows = datetime(2024, 1, 1, 8), []
    forms = ["%d/%m/%Y %H:%M", "%m/%d/%Y %H:%M", "%d.%m.%Y %H:%M", "%Y-%m-%dT%H:%M:%SZ", "%m-%d-%Y %H:%M"]
    for i in range(n):
        t += timedelta(hours=rnd.choice([1, 5, 30, -20]))
        rows.append((f"{i:06d}", rnd.choice(["n/a", None]) if rnd.random() < 0.05 else t.strftime(rnd.choices(forms, [8, 4, 4, 1, 4])[0])))
    return rows


@pytest.mark.parametrize("look", [8, 4096])
def test_paths_do_not_depend_on_cuts(monkeypatch, look):
    import pandas as pd

    from halyard.operators import timestamps

    monkeypatch.setattr(timestamps, "LOOK", look)
    records = [("a", "UTC", None, _mailbox(150, 1)), ("e", "UTC", "dmy", _mailbox(150, 1)), ("b", "Europe/Berlin", None, _mailbox(150, 2)), ("c", None, None, _mailbox(9, 3)), ("d", "UTC", "mdy", [(f"{i}", "03/04/2024 10:00") for i in range(9)])]
    rows = [(p, i, v, home, order, "emails", f"{p}{i}") for p, home, order, box in records for i, v in box]
    expected = {}
    for p, home, order, box in records:
        read = [(f"{p}{i}", o) for i, v in box if (o := interpretations(v, home, order))]
        expected |= {k: (x[0], x[1]) for (k, _), x in zip(read, best_path([o for _, o in read]))} if read else {}
    columns = ["path", "ord", "value", "home_zone", "date_order", "record_type", "record_id"]
    for size in (1, 2, 3, 7, 40, 1000):
        cut = [pd.DataFrame(rows[i : i + size], columns=columns) for i in range(0, len(rows), size)]
        staged = pd.concat([df for part in cut for df in timestamps._parts(iter([part]))])
        joints = staged[staged.kind != timestamps.DONE].sort_values(["path", "ord"], kind="stable")[[*columns, "kind", "format", "sent_us"]]
        out = pd.concat([staged[staged.kind == timestamps.DONE], *timestamps._joints(iter([joints]))])
        assert sorted(out.record_id) == sorted(r[6] for r in rows)
        assert {r.record_id: (r.format, r.sent_us) for r in out.itertuples() if isinstance(r.format, str)} == expected


def test_table_does_not_depend_on_partitions(spark):
    rows = [("emails", f"{i}", "m", i, v) for i, v in _mailbox(400, 5)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, source string, ord string, value string")
    zones = spark.createDataFrame([("m", "UTC", None)], "mailbox string, home_zone string, date_order string")
    read = [(i, o) for i, v in _mailbox(400, 5) if (o := interpretations(v, "UTC", None))]
    expected = {i: x[1] for (i, _), x in zip(read, best_path([o for _, o in read]))}
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.record_id: r.sent_us for r in normalise(df, zones).collect() if r.sent_us is not None} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])


def test_found_instants_are_the_only_declared_ones(spark):
    """The registered query against each value's readings by themselves, on whole tables, however the rows are cut."""
    import os

    import __spark_entry__ as entry

    d = next((x for x in ("/root/testdata/sf0.1", "/root/testdata/sf0.01") if os.path.exists(x)), None)
    if d is None:
        pytest.skip("no test tables")
    zones = {r.mailbox: (r.home_zone, r.date_order) for r in spark.read.parquet(f"{d}/mailboxes.parquet").collect()}
    expected = set()
    for kind in ("emails", "parsed_eml"):
        for r in spark.read.parquet(f"{d}/{kind}.parquet").select("email_id", "mailbox", "sent_at").collect():
            found = {x[1] for x in interpretations(r.sent_at, *zones.get(r.mailbox, (None, None)))}
            if len(found) == 1:
                expected.add((kind, r.email_id, found.pop()))
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {tuple(r) for r in entry.queries()["p4_found"](spark, d).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept[1])
