import random

from halyard.llm.mixing import flight, land, select, shares


def test_flight_keeps_the_balance():
    rng = random.Random(2)
    size = [float(rng.randint(1, 900)) for _ in range(500)]
    pi = [rng.random() for _ in size]
    out = flight(pi, size, rng)
    assert abs(sum(out) - sum(pi)) < 1e-6 and abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-3
    assert sum(0 < p < 1 for p in out) <= 2
    assert all(p in (0.0, 1.0) for p in land(out, size, rng))


def test_flight_gives_each_unit_its_probability():
    size = [5.0, 9.0, 2.0, 7.0, 7.0, 3.0]
    taken = [0.0] * 6
    for s in range(4000):
        rng = random.Random(s)
        for i, p in enumerate(flight([0.3] * 6, size, rng)):
            taken[i] += p / 4000
    assert all(abs(t - 0.3) < 0.03 for t in taken)


def test_mix(spark):
    rnd = random.Random(5)
    rows = [(i, "big" if i % 10 else "small", " ".join(["cargo"] * rnd.randint(1, 30))) for i in range(600)] + [(900, None, "x"), (901, "big", None), (902, "big", ""), (3, "big", "cargo")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "big", 3.0, None), ("m", "small", 1.0, 2), ("m", "none", 1.0, 1), ("m", "zero", 0.0, 1), ("free", "big", 0.5, None)], "mix_id string, source string, target_share double, max_repeats int")
    chosen = select(docs, targets).collect()
    assert len({(r.mix_id, r.doc_id) for r in chosen}) == len(chosen)
    assert all(r.repeats <= 2 for r in chosen if r.source == "small") and not {900, 901, 902} & {r.doc_id for r in chosen}
    got = {(r.mix_id, r.source): r for r in shares(docs, targets).collect()}
    assert abs(got["m", "big"].reached_share - 0.75) < 0.01 and abs(got["m", "small"].reached_share - 0.25) < 0.01
    assert got["m", "small"].most_repeats == 2 and got["m", "none"].size_tokens == 0 and got["free", "big"].reached_share == 1.0
    assert select(docs.limit(0), targets).count() == 0 and select(docs, targets.limit(0)).count() == 0
