import random

import pytest

from halyard.llm.shared_spans import extend, shared_part, sharing_pairs, winnow


def longest(x, y):
    """Brute force: length of the longest common substring."""
    best, row = 0, [0] * (len(y) + 1)
    for c in x:
        new = [0] * (len(y) + 1)
        for j, d in enumerate(y):
            if c == d:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def corpus():
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh éñ漢😀\n") for _ in range(n))
    core, edge = word(200), word(199)
    return {
        1: word(50) + core + word(90), 2: core + word(300), 3: word(500), 4: edge + word(60), 5: word(40) + edge, 6: core, 7: core,
        8: None, 9: "", 10: " " * 30, 11: "a" * 260, 12: "b" + "a" * 230 + "c", 13: "xy" * 150, 14: "z" + "yx" * 120, 15: "a" * 199, 16: core[:199],
        20: core[:150] + "#" + edge + edge[:40], 21: core[:150] + "$" + edge + edge[:40], 22: "1" + core[:150] + "%" + core[151:],
        17: "abc" * 90 + word(20) + core, 18: word(10) + "bca" * 80,
    }


def test_pairs_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(1, docs[1], "x")], "doc_id bigint, text string, rep string")
    found = {tuple(r) for r in sharing_pairs(df).collect()}
    expected = {(i, j) for i in docs for j in docs if i < j and docs[i] and docs[j] and longest(docs[i], docs[j]) >= 200}
    assert found == expected and (11, 12) in found and (13, 14) in found and (6, 7) in found
    assert sharing_pairs(df.limit(0)).count() == 0


def test_common_formula_brings_no_pairs(spark, monkeypatch):
    """Many texts with a stretch shorter than the threshold meet only where they share a whole window."""
    from halyard.llm import shared_spans

    monkeypatch.setattr(shared_spans, "HOT", 1)
    docs = corpus()
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    formula = word(180)
    docs |= {100 + i: word(80) + formula + word(60) for i in range(12)} | {200: docs[1], 201: "q" + formula + "x" * 30, 202: "z" + formula + "x" * 30}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    found = {tuple(r) for r in sharing_pairs(df).collect()}
    assert found == {(i, j) for i in docs for j in docs if i < j and docs[i] and docs[j] and longest(docs[i], docs[j]) >= 200}
    assert (201, 202) in found
    monkeypatch.setattr(shared_spans, "HOT", 64)
    assert {tuple(r) for r in sharing_pairs(df).collect()} == found
    part = {r.doc_id: r.shared_chars for r in shared_part(df).collect()}
    monkeypatch.setattr(shared_spans, "HOT", 1)
    assert {r.doc_id: r.shared_chars for r in shared_part(df).collect()} == part
    assert part == {k: covered(x, [y for i, y in docs.items() if i != k and y]) if x else 0 for k, x in docs.items()}


def test_one_anchor_in_thousands_of_texts(spark):
    """A passage shorter than the threshold, and one as long, in very many texts: no pairs by the first, shares by the second."""
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    short, long = word(190), word(230)
    docs = [(i, word(60) + short + word(60)) for i in range(3_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    assert sharing_pairs(df).count() == 0
    df = spark.createDataFrame([(i, word(60) + long + word(60)) for i in range(3_000)], "doc_id bigint, text string").repartition(8)
    assert shared_part(df).where("shared_chars between 230 and 240").count() == 3_000


def test_part(spark):
    docs = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in shared_part(df).collect()}
    assert len(got) == len(docs)
    assert got[1].shared_chars >= 200 and got[1].n_chars == 340 and got[3].shared_chars == 0 and got[6].share == 1.0
    assert got[8].n_chars is None and got[8].share == 0.0 and got[9].share == 0.0
    assert got[11].shared_chars == 230 or got[11].shared_chars == 260


def test_every_window_has_an_anchor_and_it_depends_on_the_window_alone():
    rnd = random.Random(1)
    x = "".join(rnd.choice("abcd") for _ in range(3000))
    _, pos, h = winnow([x, x[700:1700]])
    first = {(p, v) for w, p, v in zip(*winnow([x]))}
    second = {(p + 700, v) for w, p, v in zip(*winnow([x[700:1700]]))}
    assert second <= first
    at = sorted(p for p, _ in first)
    assert max(b - a for a, b in zip(at, at[1:])) <= 101


@pytest.mark.parametrize("a, b, n", [(0, 0, 130), (50, 7, 200), (300, 1, 1000)])
def test_extend(a, b, n):
    rnd = random.Random(a)
    s = "".join(rnd.choice("pqrst") for _ in range(n))
    x, y = "0" * a + s + "1", "2" * b + s + "3" * 9
    for at in (0, (n - 100) // 2, n - 100):
        assert extend(x, a + at, y, b + at) == (at, n - 100 - at)
    assert extend("a" * 200, 0, "b" * 200, 0)[0] < 0


def covered(x, others):
    """Brute force: characters of x in windows of 200 that another text holds."""
    marks = set()
    for i in range(len(x) - 199):
        if any(x[i : i + 200] in y for y in others):
            marks.update(range(i, i + 200))
    return len(marks)


def test_long_periodic_stretches_are_covered(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    unit, bars = word(37), "-" * 60 + word(40)
    docs = {
        1: word(30) + "-" * 1000 + word(30), 2: word(10) + "-" * 300 + word(20), 3: "Z" + unit * 40 + word(5), 4: word(9) + (unit * 9)[5:260],
        5: bars * 12, 6: word(3) + (bars * 5)[11:320] + word(8), 7: word(40) + "xy" * 400 + word(200), 8: "xy" * 101 + word(9),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in shared_part(df).collect()}
    assert got == {k: covered(x, [y for i, y in docs.items() if i != k]) for k, x in docs.items()} and got[1] >= 1000
