import os
import random

import pytest

from halyard.llm import tokenization as T

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    return T.Bpe(T.vocabulary())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.vocabulary(), special_tokens={})


def test_blocks_give_the_ids_of_the_whole(bpe, reference, monkeypatch):
    monkeypatch.setattr(T, "OPEN", 64)
    monkeypatch.setattr(T, "STEP", 7)
    rnd = random.Random(3)
    for _ in range(150):
        letters = rnd.choice(["a", "ab", "0123456789", " \n", "-=", "aeiou st", "漢字éß", "' sltrevmd", "  \t\nx1!", "😀a "])
        s = "".join(rnd.choice(letters) * rnd.choice([1, 1, 5, 60]) for _ in range(rnd.randint(1, 250)))
        out, stream, i = [], T.Transducer(bpe), 0
        while i < len(s):
            k = rnd.randint(1, 90)
            stream.push(s[i : i + k], out)
            i += k
        stream.close(out)
        assert out == reference.encode_ordinary(s)
        d = T.Decoder(bpe.bytes_of)
        assert d.push(out) + d.close() == s


def test_lookahead_suffices_for_any_merge_list(monkeypatch):
    """Tokens emitted by the lookahead against merging the whole piece by the definition, over random merge lists."""
    rnd = random.Random(5)
    for trial in range(200):
        letters = b"ab" if trial % 2 else b"abc"
        ranks = {bytes([c]): i for i, c in enumerate(letters)}
        for _ in range(rnd.randint(2, 25)):
            t = rnd.choice(list(ranks)) + rnd.choice(list(ranks))
            if len(t) < 12:
                ranks.setdefault(t, len(ranks))
        own = T.Bpe(ranks)
        monkeypatch.setattr(T, "STEP", rnd.choice([1, 2, 5]))
        for _ in range(20):
            raw = bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) if rnd.random() < 0.7 else rnd.choice([letters[:1], letters[:2]]) * 40
            out, run, early = [], T.Piece(own), 0
            run.push(raw, out)
            early = len(out)
            run.close(out)
            assert out == own.merge(raw) and (early or len(raw) <= max(own.lookahead.values()) + 12)


def test_long_piece_needs_little_memory(bpe, reference):
    s = "ab" * 20_000
    run, out, most = T.Piece(bpe), [], 0
    for i in range(0, len(s), 1000):
        run.push(s[i : i + 1000].encode(), out)
        most = max(most, len(run.raw))
    run.close(out)
    assert out == reference.encode_ordinary(s) and most <= max(bpe.lookahead.values()) + bpe.longest


def test_text_of_20_mb_needs_constant_memory(bpe):
    import tracemalloc

    block = "Berth 12 at Kårstø is free, the pilot boards at 06:40.\n\n  Laytime: 71 hours – " * 200
    stream, n, fed = T.Transducer(bpe), 0, 0
    tracemalloc.start()
    try:
        while fed < 20_000_000:
            out = []
            stream.push(block, out)
            n, fed = n + len(out), fed + len(block.encode())
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    stream.close(out)
    assert n > 4_000_000 and peak < 8_000_000


def test_neighbours_against_merging():
    """Whether two tokens stay apart, from how their edges grow, against merging their bytes by the definition, over random merge lists."""
    rnd, apart, merged = random.Random(11), 0, 0
    for trial in range(150):
        letters = b"ab" if trial % 2 else b"abc"
        ranks = {bytes([c]): i for i, c in enumerate(letters)}
        for _ in range(rnd.randint(2, 25)):
            t = rnd.choice(list(ranks)) + rnd.choice(list(ranks))
            if len(t) < 12:
                ranks.setdefault(t, len(ranks))
        if trial % 3 == 0:  # any order of ranks
            ranks = dict(zip(ranks, rnd.sample(range(len(ranks)), len(ranks))))
        own = T.Bpe(ranks)
        standing = [i for i, b in own.bytes_of.items() if own.merge(b) == [i]]
        assert [i for i in own.bytes_of if own.stands(i)] == standing
        for a in standing:
            for b in standing:
                expected = own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b]
                assert own.adjacent(a, b) == expected
                apart, merged = apart + expected, merged + (not expected)
    assert apart > 5000 and merged > 5000


def test_new_pieces_cost_no_merging_of_pairs(bpe, reference):
    """p7_selection, p6_ids: distinct numbers are most of a corpus's distinct pieces; a token is merged once, not each pair of tokens."""
    rnd = random.Random(12)
    text = " ".join(f"{rnd.randint(10_000, 999_999)}" for _ in range(5000))
    own, merges = T.Bpe(bpe.ranks, bpe.lookahead), []
    plain = own.merge
    own.merge = lambda raw, *trace: merges.append(raw) or plain(raw, *trace)
    assert own.encode(text) == reference.encode_ordinary(text)
    assert len(merges) == len(set(merges)) and set(merges) <= bpe.ranks.keys()


def test_known_words_are_not_split_again(bpe, reference):
    own, seen = T.Bpe(bpe.ranks, bpe.lookahead), []
    split = own.pieces
    own.pieces = lambda text: seen.append(len(text)) or split(text)
    text = "The vessel's laytime of 71.5 hours (12,340 MT) ended at Kårstø.\n\n  " * 500
    assert own.encode(text) == reference.encode_ordinary(text)
    assert sum(seen) < 1000 < len(text)


def test_no_piece_crosses_a_word(bpe, reference):
    rnd = random.Random(13)
    for _ in range(3000):
        letters = rnd.choice(["a1 '", "x5²½ ", "é9, \n", "3٣४ a", "'sdt 1", "\xa07\u3000 b", "漢5字 。", "0!m³ \t", "\x1c! 4a", "\ud800 5x"])
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40)))
        if not T._SEPARATORS(s):
            words = T._WORDS(s)
            assert "".join(words) == s and [p for w in words for p in bpe.pieces(w)] == bpe.pieces(s)
        if "\ud800" not in s:
            assert bpe.encode(s) == reference.encode_ordinary(s)


def test_kept_ids_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 10)
    made = []
    kept = T._Made(lambda t: made.append(t) or (len(made),), len)
    for i in range(200):
        kept["hot"], kept[f"{i}"], kept["x" * 65]
        assert len(kept) + len(kept.old) <= 20
    assert made.count("hot") == 1 and made.count("7") == 1 and made.count("x" * 65) == 200 and kept["7"] != kept["hot"] and made.count("7") == 2


def test_counts_of_tokens(spark, reference):
    texts = ["Kårstø – 12 m³", "", None, "x" * 300 + " 1" * 7000, "Kårstø – 12 m³"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = T.token_counts(df)
    assert counts.dtypes == [("doc_id", "bigint"), ("n_tokens", "int")]
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {i: len(reference.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert "ids" not in counts._jdf.queryExecution().optimizedPlan().toString() and T.token_counts(df.limit(0)).count() == 0


def test_every_text_goes_through_the_transducer(bpe, reference):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    texts = [t for t in pq.read_table(path, columns=["text"])["text"].to_pylist() if t]
    own = T.Bpe(bpe.ranks, bpe.lookahead)
    assert [own.encode(t) for t in texts] == [reference.encode_ordinary(t) for t in texts]
    assert own.texts == len(texts) and own.runs >= len({p for t in texts for p in own.pieces(t)})


def test_table(spark, reference):
    texts = ["Kårstø – 12 m³", "", None, "<|endoftext|>", "x" * 300 + " 1" * 70_000, "Kårstø – 12 m³"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("x", "ids")
    got = {r.doc_id: r.ids for r in T.encode_texts(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in T.decode_ids(T.encode_texts(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert T.encode_texts(df.limit(0)).count() == 0
