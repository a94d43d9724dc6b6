import pytest
from pyspark.sql import functions as F

from halyard.functions import text as T


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_keys_and_names(spark):
    assert column(spark, T.normalize_subject, ["RE: Fw: é Hello  World\n", "  ", None, "aw:x"]) == ["é hello world", "", None, "x"]
    assert column(spark, T.folder_key, ["Orrin Curlew - v1 - Desk", "M/V Foo - x", "A.B"]) == ["ORRIN_CURLEW_1", "MV_FOO", "AB"]
    assert column(spark, lambda c: T.name_key(c, F.lit(3)), ["M/V Foo", None]) == ["M_V_FOO_3", "3"]
    assert column(spark, T.safe_filename, ["a b/ç.pdf", "..", None, "x" * 300]) == ["a_b_.pdf", "attachment", "attachment", "x" * 180]
    assert column(spark, T.query_text, ["What's é-new, now?"]) == ["what s é new now"]
    assert column(spark, lambda c: T.has_text(F.lit("application/pdf"), c), ["a.ZIP", "a.tar.gz", ".zip", "a.pdf", None]) == [False, False, True, True, True]
    assert column(spark, T.size_tier, [0, 30_000, 30_001, 95_001, 300_001, None], "int") == ["small", "small", "medium", "large", "huge", None]


def test_uuid5(spark):
    import uuid

    names = ["", "a|b|ç", "x" * 500]
    ns = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    assert column(spark, lambda c: T.uuid5(ns.hex, c), names) == [str(uuid.uuid5(ns, n)) for n in names]


@pytest.mark.parametrize(
    "body, expected",
    [
        ("Hello\n\n> quoted\nmore", "Hello"),
        ("Text\nFrom: a@b\nSent: today\n\nold", "Text"),
        ("From: a@b\nSent: today\nold", "From: a@b\nSent: today\nold"),
        ("TO: Santos\nFM: Kandla\ntext", "TO: Santos\nFM: Kandla\ntext"),
        ("a\n-----Original Message-----\nb", "a"),
        ("a\nOn Monday X wrote: b", "a"),
    ],
)
def test_quotes(body, expected):
    assert T.before_quote(body) == expected


def test_contacts():
    assert T.without_contacts("a\nTel: +1 2\n\nx@y.com\n\nb") == "a\nb"
    assert T.without_contacts("a\nTel: +1 2\nb") == "a\nTel: +1 2\nb"


def test_clean_body(spark):
    bodies = ["<p>Hi&nbsp;there</p><br>x  ,y\r\n----\r\n", "This mail is confidential", "", None, "a\n\nThis is for the intended recipient only.\n\nb", "Subject: x\nok"]
    assert column(spark, T.clean_body, bodies) == ["Hi\xa0there\n\nx,y", None, "", None, "a\n\nb", "ok"]


def test_answers_and_labels(spark):
    got = column(spark, T.first_json_object, ['```json\n{"a": 1}\n```', '[{"a": 2}, {"b": 3}]', 'so: {"a": {"b": 4}} ok', "none", None, "{broken"])
    assert got == ['{"a": 1}', '{"a":2}', '{"a": {"b": 4}}', None, None, None]
    ask = lambda c: T.acceptable_question(c, ["email", "thread"], F.lit("Orrin Gannet"), F.lit("ORRIN_1"))
    assert column(spark, ask, ["When did orrin gannet sail?", "Which email names Orrin Gannet?", "When?", None, "emails of ORRIN_1"]) == [True, False, False, False, True]
    assert column(spark, T.letter_label, [0, 25, 26, 701], "int") == ["A", "Z", "AA", "ZZ"]
    assert column(spark, T.megabytes, [1_048_576, 0, None], "bigint") == ["1.0 MB", "0.0 MB", None]
    assert column(spark, lambda c: T.short_time(c.cast("timestamp")), ["2024-01-02 00:00:00", "2024-01-02 03:04:05"]) == ["2024-01-02", "2024-01-02 03:04"]
