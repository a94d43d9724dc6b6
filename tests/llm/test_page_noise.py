import random

from halyard.llm import page_noise as P

WORDS = "the stevedores during night logged wind force and stopped cargo from vessel last three cargoes were sulphuric acid remaining supplier reference measured agents before start berth expected free around while tanks being inspected load discharge side figures compared for period filter element ring".split()


class Known(P.Answers):
    """Answers over a small vocabulary, looked up at once."""

    def __init__(self, words, pairs=None):
        super().__init__(words, None, pairs)
        self.lexicon = P.Lexicon(words)

    def find(self, form, before="", after=""):
        return self.lexicon.find(form, self.words.get(form, 1))


def lexicon():
    return Known({w: 500 for w in WORDS}, {("the", "stevedores"): 90, ("load", "and"): 9, ("o", "ring"): 9, ("discharge", "side"): 9})


def least_weight(word, form, others, most):
    """Brute force: the least weight of edits that turn a word into a form, other edits first; None beyond the bounds."""
    edits = {(a, b): P.WEAK if (a, b) in P._WEAK else P.KNOWN for a, b in P.CONFUSIONS}
    best = {(0, 0): {(0, 0)}}
    for i in range(len(word) + 1):
        for j in range(len(form) + 1):
            for o, e in best.get((i, j), ()):
                steps = [(1, 1, 0, 0)] if i < len(word) and j < len(form) and word[i] == form[j] else []
                if i < len(word) and j < len(form):
                    steps += [(1, 1, 1, 0)] + ([(1, 1, 0, P.WEAK)] if not form[j].isalpha() else [])
                steps += [(1, 0, 1, 0)] if i < len(word) else []
                steps += [(0, 1, 1, 0)] if j < len(form) else []
                steps += [(len(a), len(b), 0, w) for (a, b), w in edits.items() if len(a) < 3 and word.startswith(a, i) and form.startswith(b, j)]
                for di, dj, do, de in steps:
                    if o + do <= others and e + de <= most:
                        best.setdefault((i + di, j + dj), set()).add((o + do, e + de))
    found = best.get((len(word), len(form)))
    return min(o * P.OTHER + e for o, e in found) if found else None


def test_retrieval_is_complete():
    rnd = random.Random(1)
    for letters in ("abcd", "rnmicluh", "eco0l1i"):
        words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))): 1 for _ in range(120)}
        lex = P.Lexicon(words)
        for _ in range(25):
            form = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
            for others, most in ((0, 2), (1, 5), (2, 7)):
                expected = {w: x for w in words if (x := least_weight(w, form, others, most)) is not None}
                assert lex.within(form, others, most) == expected


def test_candidates_are_all_within_reach_and_ranked():
    words = {"modern": 900, "minimum": 900, "vessel": 900, "vessels": 800, "communication": 700, "morning": 500, "mining": 40}
    lex = P.Lexicon(words)
    for form in ("rnodem", "rninirnurn", "v3ssel", "cornrnunication", "rnorning", "mornlng", "rninlng"):
        expected = {w for w in words if w != form and least_weight(w, form, *P.reach(form)) is not None}
        found = lex.find(form)
        assert {w for w, _ in found} == expected and [c for _, c in found] == sorted(c for _, c in found)
    best = lambda form: lex.find(form)[0][0]
    assert [best(x) for x in ("rnodem", "rninirnurn", "v3ssel", "cornrnunication")] == ["modern", "minimum", "vessel", "communication"]
    assert [w for w, _ in lex.find("rninlng", 2)] == ["mining"] and lex.find("rninlng", 3) == []


def test_one_plain_word_is_misread_if_its_neighbours_say_so():
    words = {w: 500 for w in WORDS}
    text = "stopped cargo frorn vessel"
    assert P.noise(text, Known(words)) == []
    assert P.noise(text, Known(words, {("cargo", "from"): 7})) == P.noise(text, Known(words, {("from", "vessel"): 7})) == ["ocr"]


def test_long_words_and_numerals_are_read_whole():
    head, tail = "a" * 200, "b" * 200
    lex = Known({head + tail: 500})
    assert [text for *_, text in P.divided(f"{head}-\n{tail}", lex)] == [head + tail]
    assert P._pageno("cxlix") == ("roman", 149) and P._pageno("iiix") is None


def test_kinds():
    lex = lexicon()
    assert P.noise("During the riight the stevedores l0gged wind force", lex) == ["ocr"]
    assert P.noise("wind force and stop-\nped cargo from the vessel, rema-\nining", lex) == ["hyphen"]
    clean = "# Report AB123456\n\nBoth load-\nand discharge-\nside figures were compared for the period 10-\n17 March, see filter element 4S0-l4 and O-\nring XX/12.\n\nBerth:\n23\n\nTanks in use:\n4\n\n| a | 1 |\n|---|---|\n| b | 2 |\n"
    assert P.noise(clean, lex) == [] and P.repair(clean, lex) == clean
    assert P.noise(None, lex) == P.noise("", lex) == P.noise(" \n ", lex) == P.noise("<!-- image -->", lex) == []


PAGES = """Report DE/482154
# Report XX/1

During the night the stevedores logged wind force and stopped cargo from
- 1 -
Report DE/482154
the vessel, while tanks were being inspected.

## Remarks

## Remarks
- 2 -
Report DE/482154"""


def test_furniture_and_reflow():
    lex = lexicon()
    assert P.noise(PAGES, lex) == ["header", "pageno"]
    assert P.repair(PAGES, lex) == "# Report XX/1\n\nDuring the night the stevedores logged wind force and stopped cargo from the vessel, while tanks were being inspected.\n\n## Remarks\n\n## Remarks"
    beside = "text of one page\n\nReport DE/482154    Page 1 of 2\n\ntext of another page\n\nPage 2 of 2    Report DE/482154\n"
    assert P.noise(beside, lex) == ["header", "pageno"]
    assert P.noise("i\n\ntext\n\nii\n\ntext", lex) == ["pageno"]


def test_repair_of_words():
    lex = lexicon()
    assert P.repair("The stevedores l0gged wind force ancl stop-\nped cargo fr0m", lex) == "The stevedores logged wind force and stopped cargo from"


def test_table(spark):
    text = "During the night the stevedores logged wind force and stopped cargo from the vessel"
    rows = [(f"k{i}", text, i) for i in range(40)] + [("bad", "During the riight the stcvedores logged wind force and stop-\nped cargo", 1), ("bad", "During the riight the stcvedores logged wind force and stop-\nped cargo", 2), ("n", None, 1), ("e", "", 1)]
    df = spark.createDataFrame(rows, "sha256 string, markdown string, word int")
    assert sorted(map(tuple, P.found_noise(df).collect())) == [("bad", "hyphen"), ("bad", "ocr")]
    got = {r.sha256: r.repaired for r in P.repaired_files(df).collect()}
    assert got["bad"] == "During the night the stevedores logged wind force and stopped cargo" and got["k1"] == text and got["n"] is None and got["e"] == ""
    assert P.found_noise(df.limit(0)).count() == 0
