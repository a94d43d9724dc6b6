import numpy as np
import pytest

from halyard.llm import pii
from halyard.llm import pii_model as M
from halyard.llm import pii_patterns as P
from halyard.llm.pii_train import label


@pytest.fixture(scope="module")
def model():
    return pii.weights()


def test_gradients():
    rng = np.random.default_rng(0)
    p = M.new(6, 4)
    p["trans"] = rng.normal(size=(4, 4)).astype("f4")
    ids, y = rng.integers(0, 60, (12, 5)), rng.integers(0, 4, (12, 5))
    _, g = M.loss_and_gradients(p, ids, y)
    for k in ("trans", "first", "bias", "wf", "wb"):
        i = tuple(0 for _ in p[k].shape)
        losses = []
        for e in (1e-2, -1e-2):
            q = dict(p)
            q[k] = p[k].copy()
            q[k][i] += e
            losses.append(M.loss_and_gradients(q, ids, y)[0])
        assert abs((losses[0] - losses[1]) / 0.02 - g[k][i]) < 2e-3


def test_fast_states_are_those_of_training(model):
    ids = np.random.default_rng(1).integers(0, M.SIZE, (40, 7))
    for d in "fb":
        assert np.abs(M._states(ids, model["x" + d], model["u" + d]) - M._run(ids, model["x" + d], model["u" + d])[0]).max() < 1e-4


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    e, tr, first = rng.normal(size=(5, 3, 3)).astype("f4"), rng.normal(size=(3, 3)).astype("f4"), rng.normal(size=3).astype("f4")
    got = M.viterbi(e, tr, first)
    for b in range(3):
        score = lambda path: first[path[0]] + sum(e[t, b, k] for t, k in enumerate(path)) + sum(tr[i, j] for i, j in zip(path, path[1:]))
        assert tuple(got[:, b]) == max(itertools.product(range(3), repeat=5), key=score)


def test_path_in_blocks_is_the_path_over_the_whole(monkeypatch):
    """Whatever the emissions, decoding in blocks gives Viterbi's path over one sequence."""
    import numpy as np

    rnd = np.random.default_rng(7)
    monkeypatch.setattr(M, "BLOCK", 8)
    for n in (1, 7, 8, 15, 16, 17, 64, 200, 333):
        e, trans, first = rnd.normal(size=(n, 6)).astype(np.float32), rnd.normal(scale=3, size=(6, 6)).astype(np.float32), rnd.normal(size=6).astype(np.float32)
        score = lambda y: first[y[0]] + e[np.arange(n), y].sum() + trans[y[:-1], y[1:]].sum()
        whole, got = M.viterbi(e[:, None, :], trans, first)[:, 0], M.decode(e, trans, first)
        assert abs(score(got) - score(whole)) < 1e-3 and (got != whole).sum() == 0


def test_windows_agree_with_one_run(model, monkeypatch):
    text = "Dear Zofia,\n\nPlease call Ms Stavvik on +44 20 7946 0591 or mail zofia_stavvik@kestwick.example.\n\n" * 30
    ids = M.encode(text)
    whole = M.viterbi(M.emissions(model, ids[:, None]), model["trans"], model["first"])[:, 0]
    assert (M.tag(model, ids) != whole).mean() < 0.002


TEXT = """Dear Zofia,

Please call Ms Stavvik on (020) 7946 0591. The crew change form lists Radu Pelzenko, passport no. G85493023, next of kin reachable on +61 491 570 657.
Send the originals to João Wyrfeldt, Suite 40, 64 Rope House, 3011 AB Rotterdam, ref. VB787605; copy zofia_stavvik [at] kestwick [dot] example in future.
MV Käthe Lindansky will shift to berth 30 at 03:10. Account 5844 4662 6637 was credited. IMO 9320524, MMSI 258264933.

Rgds

Zofia
Kestwick Tankers"""


def test_kinds(model):
    got = {(k, TEXT[i:j]) for i, j, k in pii.find([TEXT], model)[0]}
    assert got == {
        ("person", "Zofia"), ("person", "Stavvik"), ("phone", "(020) 7946 0591"), ("person", "Radu Pelzenko"), ("id_number", "G85493023"), ("phone", "+61 491 570 657"),
        ("person", "João Wyrfeldt"), ("address", "Suite 40, 64 Rope House, 3011 AB Rotterdam"), ("email", "zofia_stavvik [at] kestwick [dot] example"),
    }
    red = pii.replace(TEXT, pii.find([TEXT], model)[0])
    assert red.startswith("Dear [PERSON],") and "Account 5844 4662 6637" in red and "[ADDRESS], ref." in red


def test_held_out_accuracy(model):
    """Names and numbers that no training text holds, in sentences of its kind."""
    rng = np.random.default_rng(5)
    given, sur = ["Zofia", "Henrik", "Paloma", "Kwame"], ["Bjelvik", "Quellenko", "Treskarra", "Morrmark"]
    hit = total = extra = 0
    for _ in range(60):
        g, s = rng.choice(given), rng.choice(sur)
        phone = f"+44 7700 900{rng.integers(100, 999)}"
        t = f"Hi {g},\n\nPlease note {g} {s} of Harrowmere Bulk signed for the seals at 10:{rng.integers(10, 59)}; my direct line is {phone} and my address is {g.lower()}.{s.lower()}@harrowmere.example.\n\nBrgds,\n{g} {s}\nDirector"
        want = {("person", g), ("person", f"{g} {s}"), ("phone", phone), ("email", f"{g.lower()}.{s.lower()}@harrowmere.example")}
        got = {(k, t[i:j]) for i, j, k in pii.find([t], model)[0]}
        hit, total, extra = hit + len(got & want), total + len(want), extra + len(got - want)
    assert hit / total > 0.97 and extra / total < 0.02


def test_labels():
    y = label("Hi Zoë, ask ULVEWICZ, Benoît or K. Dœrvik on 203.555.0166 about MV Zoë Dœrvik", {"zoë", "benoît"}, {"ulvewicz", "dœrvik"})
    t = "Hi Zoë, ask ULVEWICZ, Benoît or K. Dœrvik on 203.555.0166 about MV Zoë Dœrvik"
    assert [(t[i:j], P.KINDS[k - 1]) for i, j, k in M.spans(y)] == [("Zoë", "person"), ("ULVEWICZ, Benoît", "person"), ("K. Dœrvik", "person"), ("203.555.0166", "phone")]


def test_table(spark):
    e = spark.createDataFrame([("1", TEXT, "Zofia Stavvik <zofia_stavvik@kestwick.example>", "a"), ("1", TEXT, "Zofia Stavvik <zofia_stavvik@kestwick.example>", "b"), ("2", None, None, "c"), ("3", "", "", "d"), ("4", "Hi Zofia,\n" * 20_000, None, "e")], "email_id string, body_cleaned string, from_addr string, span string")
    m = spark.createDataFrame([("k", "Attention: Pieter Lindoulis, Greywater Survey", 1), ("k", "Attention: Pieter Lindoulis, Greywater Survey", 2), ("n", None, 1)], "sha256 string, markdown string, text int")
    texts = pii.texts_of(e, m)
    got = [tuple(r) for r in pii.found_spans(texts).collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] != "body_cleaned"} == {("from_addr", "1", "person", "Zofia Stavvik"), ("from_addr", "1", "email", "zofia_stavvik@kestwick.example"), ("markdown", "k", "person", "Pieter Lindoulis")}
    assert {g[1:] for g in got if g[1] == "4"} == {("4", "person", "Zofia")}
    red = {(r.field_name, r.rec_id): r.text for r in pii.redacted(texts).collect()}
    assert red["markdown", "k"] == "Attention: [PERSON], Greywater Survey" and red["from_addr", "1"] == "[PERSON] <[EMAIL]>"
    assert pii.found_spans(pii.texts_of(e.limit(0), m.limit(0))).count() == 0
