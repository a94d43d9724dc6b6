import re

from halyard.plans.reference import QUERIES

SCHEMA = "doc_id bigint, lang string, source string, n_chars bigint, text string"


def documents(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_words_of_every_language(spark, tmp_path):
    texts = ["ΟΔΥΣΣΕΎΣ, Σ ΟΔΟΣ!", "İSTANBUL Işık", "ÉTÉ à l'ŒUVRE", "ПРИВЕТ, Ёж", "港口 ÀÉ", "ﾃｽﾄ ＡＢＣ", "Straße ẞ", "Ǆ ǅ", None, "", "  x Y "]
    langs = ["el", "tr", "fr", "ru", "zh", "ja", "de", None, None, "es", "pl"]
    d = documents(spark, tmp_path, [(i, lang, "s", 1, t) for i, (lang, t) in enumerate(zip(langs, texts))])
    got = {r.doc_id: r.words for r in QUERIES["query_words_whole"](spark, d).collect()}
    rule = lambda t: t and re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", t)).strip().lower()
    assert got == {i: rule(t) for i, t in enumerate(texts)}


def parsed(text):
    """The rule for an answer of two labelled lines: the last of each label counts."""
    got = {}
    for line in map(str.strip, text.splitlines()):
        for label in ("DOCUMENT_TYPE:", "SUMMARY:"):
            if line.upper().startswith(label):
                got[label] = line.split(":", 1)[1].strip() or None
    return got.get("DOCUMENT_TYPE:"), got.get("SUMMARY:")


TEXTS = [
    "x" * 5000 + " end\nmore",
    "first\n" + "y" * 60 + "\nSummary: the last one wins\nrest",
    "first\r\n" + "y" * 60 + "\r  DOCUMENT_TYPE: invoice  summary: by other ends\x0brest",
    "a" * 45 + "\x85Summary: \nrest",
    "\n\n  \n" + "é" * 50 + " late\n",
    "z" * 50 + " summary: within a line",
    None,
    "",
]


def test_parsers_read_whole_texts(spark, tmp_path):
    d = documents(spark, tmp_path, [(i, "en", "src", i, t) for i, t in enumerate(TEXTS)])
    got = {r.doc_id: (r.document_type, r.summary) for r in QUERIES["parsed_classifications_whole"](spark, d).collect()}
    assert got == {i: parsed(f"document_type: draft\nDOCUMENT_TYPE: src\nSummary: {t or ''}") for i, t in enumerate(TEXTS)}
    judged = {r.doc_id: (r.score, r.reasoning) for r in QUERIES["judgements_whole"](spark, d).collect()}
    why = lambda t: m[1].strip() or None if (m := re.search(r"REASONING:\s*(.+)", f"REASONING: {t or ''}")) else None
    assert judged == {i: (i % 7 if 1 <= i % 7 <= 5 else None, why(t)) for i, t in enumerate(TEXTS)}
    [whole] = QUERIES["judged_by_language_whole"](spark, d).collect()
    assert (whole.n, whole.good, whole.explained) == (8, 2, 6)


def test_parsers_agree_with_sql(spark, tmp_path):
    import duckdb

    from halyard.plans.reference import SQL

    d = documents(spark, tmp_path, [(i, "en", "src", i, t) for i, t in enumerate(TEXTS)])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    for name in ("parsed_classifications_whole", "judgements_whole", "judged_by_language_whole"):
        assert sorted(map(tuple, QUERIES[name](spark, d).collect())) == sorted(db.execute(SQL[name]).fetchall())
