import os
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.operators import chunking, evaluation, retrieval, threads, upserts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a", "old"), (2, "b", None)], "k int, v string, w string")
    u = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    new = u.select("k", "v", F.lit(None).cast("string").alias("w"), "o")
    assert rows(upserts.upsert(t, new, ["k"], [F.desc("o")]).select("k", "v")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(upserts.insert_or_ignore(t, new, ["k"], [F.asc("o")]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "e")]
    assert rows(upserts.replace_children(t, t.limit(0), spark.createDataFrame([(1,)], "k int"), "k").select("k")) == [(2,)]
    assert rows(upserts.set_once(t, spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string"), ["k"], "w").select("k", "w")) == [(1, "old"), (2, "y")]
    e = spark.createDataFrame([(1, "new", "error"), (2, "new", "ok")], "k int, v string, status string")
    assert rows(upserts.keep_on_error(t.select("k", "v", F.lit("ok").alias("status")), e, ["k"], ["v"])) == [(1, "a", "error"), (2, "new", "ok")]


def test_numbered_names(spark):
    f = spark.createDataFrame([("g", "a.pdf", "x", 1), ("g", "a.pdf", "y", 2), ("g", "a.pdf", "x", 3), ("g", "b", "z", 4), ("g", "b", "w", 5), ("g", "b", None, 6)], "g string, n string, s string, id int")
    assert rows(upserts.numbered_names(f, "g", F.col("n"), "s", "id")) == [("g", "w", "b_1"), ("g", "x", "a.pdf"), ("g", "y", "a_1.pdf"), ("g", "z", "b")]


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(120)]
    links = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(70)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60, 90)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = threads.components(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(links, "a string, b string"))
    assert rows(got) == sorted((n, find(n)) for n in nodes)


def test_threads(spark):
    schema = "id string, group_key string, message_id string, in_reply_to string, reference_ids array<string>, subject string, people array<string>, sent_at timestamp"
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, n)
    data = [
        ("a", "g", "<1>", None, None, "Noon", ["x@y"], t(2)), ("b", "g", "<2>", "<1>", [], "other", ["q@y"], t(3)), ("c", "g", None, None, ["<2>"], "third", [None], t(4)),
        ("d", "g", "<4>", None, None, "Re: noon", ["X@Y"], t(1)), ("e", "h", "<5>", "<1>", None, "noon", ["x@y"], t(1)), ("f", "g", None, None, None, None, None, None), ("h", "g", None, None, None, "noon", ["z@y"], t(1)),
    ]
    got = {r.id: (r.thread_id, r.thread_size) for r in threads.threads(spark.createDataFrame(data, schema)).collect()}
    assert {got[k][0] for k in "abcd"} == {got["a"][0]} and got["a"][1] == 4
    assert len({got[k][0] for k in "aefh"}) == 4


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=6000))
def test_chunks_cover_the_text(text):
    s = text.strip()
    got = chunking.cuts(s)
    assert (not s) == (not got)
    assert all(j - i <= chunking.SIZE and i < j for i, j in got)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(got, got[1:]))
    if got:
        assert got[0][0] == 0 and got[-1][1] == len(s)


def test_chunk_ends():
    text = "x" * 1200 + "\n\n" + "y" * 100 + ". " + "z" * 400
    assert chunking.cuts(text)[0] == (0, 1202)
    assert chunking.cuts("x" * 2000) == [(0, 1500), (1300, 2000)]


def test_fuse_and_topk(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "doc_id bigint, rank int")
    x = spark.createDataFrame([(2, 1), (3, 2)], "doc_id bigint, rank int")
    assert [r.doc_id for r in retrieval.fuse(v, x, 10).orderBy("rank").collect()] == [2, 1, 3]


def test_batch_topk_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 20)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(90)] + [(900, None)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in retrieval.batch_topk(df, df.where("vec_id % 10 = 0 and embedding is not null"), 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == list(np.argsort(-s)[:4])
    assert retrieval.batch_topk(df, df.limit(0), 4).count() == 0


def test_measures(spark):
    h = spark.createDataFrame([("a", 1, "x"), ("b", None, "x"), ("c", 4, "y")], "q string, first_rank bigint, g string")
    got = {r.g: (r.total, r.hits, round(r.recall, 3), round(r.mrr, 3)) for r in evaluation.recall_and_mrr(h, ["g"]).collect()}
    assert got == {"x": (2, 1, 0.5, 0.5), "y": (1, 1, 1.0, 0.25), "total": (3, 2, 0.667, 0.417)}


def test_pool_and_embedding(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "v array<array<double>>")
    assert df.select(retrieval.mean_pool(F.col("v"), F.lit(1), F.lit(3)).alias("x")).first().x == [4.0, 5.0]
    e = retrieval.embed(spark.createDataFrame([("a b",), (None,)], "t string"), F.col("t")).collect()
    assert abs(sum(x * x for x in e[0].embedding) - 1) < 1e-9 and sum(map(abs, e[1].embedding)) == 0


def test_mailbox_and_stream(spark, tmp_path):
    from halyard.sources.mailbox import pairs, read_mailbox
    from halyard.streaming import ingest

    box = tmp_path / "root" / "Orrin Curlew - v1 - Desk" / "IN"
    box.mkdir(parents=True)
    (box / "a.eml").write_text("Subject: Hi\nFrom: A <a@x.example>\nTo: b@x.example, C <c@x.example>\nDate: Tue, 09 Jan 2024 07:25:42 +0400\nMessage-Id: <1@x>\nReferences: <0@x> <9@x>\n\nHello\n")
    (box / "b.eml").write_text("Subject: x\nDate: nonsense\n\nHello\n")
    (box / "a.json").write_text("{}")
    ok, missing = pairs(spark, str(tmp_path / "root"))
    assert ok.count() == 1 and missing.count() == 1
    got = {r.eml_path[-5:]: r for r in read_mailbox(spark, str(tmp_path / "root")).collect()}
    a = got["a.eml"]
    assert (a.voyage_key, a.direction, a.subject, a.to_addr, a.message_id, a.reference_ids, a.body_text, a.sent_us) == ("ORRIN_CURLEW_1", "in", "Hi", ["b@x.example", "c@x.example"], "<1@x>", ["<0@x>", "<9@x>"], "Hello\n", 1704770742000000)
    assert got["b.eml"].error
    data = spark.createDataFrame([(1, "a")], "k int, v string")
    data.write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest(spark, str(tmp_path / "in"), data.schema, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen == [1]


def test_providers(spark):
    from halyard.operators import providers

    def picky(p):
        if "boom" in p:
            raise ValueError("no")
        return p.upper()

    df = spark.createDataFrame([("a", "head\n\nhello"), ("b", "boom"), ("c", None), ("d", " ")], "id string, p string")
    got = {r.id: (r.text, r.status) for r in providers.complete(df, "id", F.col("p"), picky).collect()}
    assert got == {"a": ("HEAD\n\nHELLO", "ok"), "b": (None, "error"), "c": (None, "skipped"), "d": (None, "skipped")}
    assert providers.first_sentences("head\n\nOne. Two! Three.") == "One. Two!"
    assert providers.complete(df.limit(0), "id", F.col("p")).count() == 0


def test_hybrid_modes_and_filter(spark):
    import pytest

    docs = spark.createDataFrame([(1, "pilot pilot rate"), (2, "rate"), (3, None), (4, "")], "doc_id bigint, text string")
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (5, 0, [0.9, 0.1])], "vec_id bigint, label int, embedding array<double>")
    run = lambda mode: [r.doc_id for r in retrieval.hybrid(retrieval.postings(docs), v, [1.0, 0.0], ["pilot", "rate"], 3, mode).orderBy("rank").collect()]
    assert run("vector_only") == [1, 5, 2] and run("bm25_only")[0] == 1 and run("rank_only") == [1, 2]
    assert run("hybrid")[0] == 1 and set(run("hybrid_rank")) == {1, 2, 5}
    assert evaluation.resolve_filter(None, ["a"], ["a"]) == ["a"] and evaluation.resolve_filter(["B", "b"], ["a", "b"], []) == ["b"] and evaluation.resolve_filter(["all"], ["a"], []) is None
    with pytest.raises(ValueError):
        evaluation.resolve_filter(["x"], ["a"], [])


def test_fixture_sheet(spark, tmp_path):
    from halyard.sources.tables import read_fixtures

    (tmp_path / "f.csv").write_text("Vessel_Name,VOYAGE_NO,Quantity\nM/V Foo,3,NaN\nBar,4,2.5\n")
    got = [tuple(r) for r in read_fixtures(spark, str(tmp_path / "f.csv")).orderBy("voyage_no").collect()]
    assert got == [("M/V Foo", 3, None, "M_V_FOO_3"), ("Bar", 4, 2.5, "BAR_4")]


def test_components_of_a_long_chain_and_a_hub(spark):
    n = 300
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(n)] + [("h", f"x{i}") for i in range(200)]
    nodes = sorted({x for link in links for x in link} | {"alone"})
    got = {r.id: r.root for r in threads.components(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: "alone" if x == "alone" else "h" if x[0] in "hx" else "0000" for x in nodes}
    empty = spark.createDataFrame([], "a string, b string")
    assert threads.components(spark.createDataFrame([("q",)], "id string"), empty).collect() == [("q", "q")]


def test_rerank_by_a_given_scorer(spark):
    import pandas as pd

    rows = spark.createDataFrame([(1, "one two", 1), (2, "three", 2), (3, None, 3)], "doc_id bigint, text string, rank int")
    some = lambda q, texts: texts.map(lambda t: {"three": 0.9, "one two": 0.4}.get(t))
    none = lambda q, texts: pd.Series([None] * len(texts), dtype=float)
    order = lambda df: [(r.doc_id, r["rank"]) for r in df.orderBy("rank").collect()]
    assert order(retrieval.rerank(rows, "q", 5, some)) == [(2, 1), (1, 2)]
    assert order(retrieval.rerank(rows, "q", 2, none)) == [(1, 1), (2, 2)]
    assert order(retrieval.rerank(rows, "two", 1)) == [(1, 1)] and order(retrieval.rerank(rows.limit(0), "q", 2)) == []


def test_search_over_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 1, None), (4, 1, [1.0]), (5, 1, [-1.0, 0.0]), (6, 1, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, label bigint, embedding array<float>")
    got = [(r.vec_id, r.similarity) for r in retrieval.vector_topk(v, [3.0, 0.0], 9).collect()]
    assert got == [(1, 1.0), (6, 1.0), (2, 0.0), (5, -1.0)]
    assert retrieval.vector_topk(v.limit(0), [3.0, 0.0], 9).count() == 0


def test_context_of_a_search(spark):
    from halyard.operators.contexts import attachment_prompts, build_context

    hits = spark.createDataFrame([("g1", "m1", "email", 0.5, "a", 1), ("g2", None, "file", 0.9, "b", 2), ("g1", "m1", "file", 0.4, "c", 3), ("g3", "m2", "email", 0.9, "d", 4)], "group string, message string, source_type string, similarity double, text string, rank int")
    winners = spark.createDataFrame([("g3", 1), ("g1", 2), ("g9", 3)], "group string, place int")
    sheets = spark.createDataFrame([("g1", "sheet 1"), ("g3", "sheet 3"), ("g2", "sheet 2")], "group string, summary string")
    notes = spark.createDataFrame([("m1", "note 1")], "message string, summary string")
    expected = "=== VOYAGE FIXTURES ===\n[A]\nsheet 3\n\n[B]\nsheet 1\n\n=== SOURCES ===\n[VOYAGE C | (no email)]\nCHUNK 1 [file] (similarity 0.9000): b\n\n[VOYAGE A | EMAIL e1]\nCHUNK 2 [email] (similarity 0.9000): d\n\n[VOYAGE B | EMAIL e2]\nTHREAD SUMMARY: note 1\nCHUNK 3 [email] (similarity 0.5000): a\nCHUNK 4 [file] (similarity 0.4000): c"
    assert build_context(hits, winners, sheets, notes).collect() == [(expected,)]
    assert build_context(hits.limit(0), winners.limit(0), sheets, notes).collect() == [("=== SOURCES ===",)]
    messages = spark.createDataFrame([("m1", "in", "d", " s "), ("m2", None, None, None)], "email_id string, direction string, date string, summary string")
    files = spark.createDataFrame([("m1", 2, "b.pdf", None), ("m1", 1, "a.pdf", " text ")], "email_id string, ord int, file_name string, content string")
    got = dict(attachment_prompts(messages, files).collect())
    assert got["m1"] == "Direction: in\nDate: d\n\nEmail summary:\ns\n\n--- Attachment: a.pdf ---\ntext\n--- Attachment: b.pdf ---\n"


def test_staged_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from halyard.sources import staging

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        staging.shared_folder(Cluster())
    df = staging.staged(spark.range(3), "three")
    path = df._halyard_path.removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    staging.discard(df)
    assert not os.path.exists(path)


def test_pooled_vectors_against_a_loop():
    import numpy as np

    from halyard.operators.embeddings import pooled

    spans, v = [(0, 0), (0, 3), (4, 8), (9, 12), (13, 15)], np.arange(8, dtype=float).reshape(4, 2)  # the server cut the last token off
    pieces = [(0, 3), (0, 9), (2, 5), (3, 4), (12, 15), (0, 20)]
    expected = []
    for a, b in pieces:
        rows = [v[k] for k, (i, j) in enumerate(spans[:4]) if j > i and j > a and i < b]
        expected.append(np.mean(rows, axis=0).tolist() if rows else [0.0, 0.0])
    assert pooled(spans, v, pieces) == expected and pooled([], np.zeros((0, 2)), [(0, 5)]) == [[0.0, 0.0]]


def test_embeddings_of_chunks_and_summaries(spark):
    from halyard.operators import embeddings

    docs = spark.createDataFrame([("d", "one two three four", " head "), ("e", "five", None), ("n", None, None)], "id string, text string, summary string")
    chunks = spark.createDataFrame([("d", 0, 0, 7, "one two"), ("d", 1, 8, 10, "three four"), ("e", 0, 0, 4, "five")], "id string, chunk_index int, start int, n_chars int, text string")
    late = {(r.id, r.chunk_index): r.embedding for r in embeddings.late_embedded(docs, chunks).collect()}
    spans, v = embeddings.word_vectors("head\n\n---\n\none two three four")
    assert late["d", 0] == pytest.approx(((v[1] + v[2]) / 2).tolist()) and late["d", 1] == pytest.approx(((v[3] + v[4]) / 2).tolist()) and len(late) == 3
    ctx = {(r.id, r.chunk_index): (r.text, r.embedding) for r in embeddings.context_embedded(chunks, docs.select("id", "summary")).collect()}
    import pandas as pd

    assert ctx["d", 0] == ("one two", retrieval.hash_embedding(pd.Series(["head\n\none two"]))[0]) and ctx["e", 0] == ("five", retrieval.hash_embedding(pd.Series(["five"]))[0])
    notes = spark.createDataFrame([("m", " text "), ("b", " "), ("x", None)], "email_id string, summary string")
    assert [(r.source_id, r.chunk_index, r.text) for r in embeddings.summary_embedded(notes).collect()] == [("m", 0, "text")]


def test_extraction_falls_back(spark):
    from halyard.operators import providers

    def full(t):
        if "long" in t:
            raise providers.ContextOverflow
        if "bad" in t:
            raise RuntimeError("down")
        return "full"

    rows = [("a", "x" * 60), ("b", "long" + "x" * 60), ("c", "short"), ("d", None), ("e", "bad" + "x" * 60), ("f", "y" * 30_000), ("g", "<!-- image -->" * 20)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {r.k: (r["mode"], r.status, r.n_sent, r.output) for r in providers.extract(df, "k", "t", full, lambda t: "class").collect()}
    assert got == {"a": ("full", "ok", 60, "full"), "b": ("classify", "ok", 64, "class"), "c": (None, "skipped", 0, None), "d": (None, "skipped", 0, None), "e": ("full", "error", 63, None), "f": ("classify", "ok", 25_000, "class"), "g": (None, "skipped", 0, None)}
