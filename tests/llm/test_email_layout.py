from halyard.llm.email_layout import lines_not_new, newly_written, not_new, read, reduced


def split(marked):
    """Lines that begin with # are expected not to be new."""
    lines = marked.strip("\n").split("\n")
    return "\n".join(x[2:] for x in lines), [i for i, x in enumerate(lines) if x.startswith("#")]


CASES = [
    ("zofia.stav@kestwick.example", """
  Dear Priya,

  Samples were sealed at 18:47.
  > 42% of the parcel is pumpable, the rest needs stripping.
  On arrival the pilot wrote: draft 11.3 m, all fast 21:44.
  Date: 8 May, tide 4.9 m, draft 10.5 m
  The confidential clause 13 of the recap stays as agreed.

# Rgds

# Zofia Stav
# Havørn Rederi
# ☎ +33 1 99 00 61 27

# If it reached you by mistake, tell us and erase
# every copy.

# On Jan 9, 2024, at 1:00 PM, Käthe Ulvinho
# <ku@x.example> wrote:
# > Hi,
# > text of theirs
# > > older
"""),
    ("a.b@x.example", """
# On Mon, 1 Apr 2024 at 04:05, Jørgen Bjelvik wrote:
# > Good day Fatima

  Berth 10 is free.

# >
# > The last cargoes were palm olein.
#
"""),
    ("paloma.dor@x.example", """
# From: Leila Eskewicz <leskewicz@sundrypoint.invalid>
# Sent: 10 April 2026 06:23
# To: henrik@x.example

# Hi Henrik,

# Noon position.

# Best regards,

# Leila Eskewicz
# Tel: +44 20 7946 0671

  Umber Passage arrived at Huelva roads yesterday.
# Best regards,
# Paloma Dor
"""),
    ("k@x.example", """
  See below.

# BR/KW

# ---- Replied Message ----
# | From | Zofia<z@x.example> |
# | Date | 02/18/2025 17:41 |
# Hi Ingrid,

# Berth 30 is free.
"""),
    ("k@x.example", """
  Voilà.
# Sent from my phone

# Am 01.02.2024 um 05:09 schrieb Rajesh Brandewicz:
# KW> Hallo
# KW>
# KW> Text
"""),
]


def test_grammar():
    for sender, marked in CASES:
        body, expected = split(marked)
        expected = [i for i in expected if body.split("\n")[i].strip()]
        assert not_new(body, sender) == expected, marked
        assert not_new(body.replace("\n", "\r\n"), sender) == expected


def test_history_without_marks_is_found_in_the_answered_message():
    parent = "Dear all,\n\nBerth 44 at Køge is expected free on 21 August around 15:08,\nafter the shore line was cleared."
    body = "Berth 44 at Køge is expected free on\n21 August around 15:08, after the shore line was cleared.\n\nRgds\nJo\n\nHi Jo,\n\nNoted with thanks, we will send a pilot."
    assert not_new(body, "x@y.example", parent) == [0, 1, 3, 4]


def test_answer_below_a_message_without_sign_off():
    body = "From: A B <a@x.example>\nSent: today\nTo: me@x.example\n\nHi,\n\nThe hoses were off at noon today.\n\nWe will send another pilot tomorrow.\n-- \nMe"
    assert not_new(body, "me@x.example", "Hi,\n\nThe hoses were off at noon today.") == [0, 1, 2, 4, 6, 9, 10]
    assert not_new(body, "me@x.example", None, "We will send another pilot tomorrow.") == [0, 1, 2, 4, 6, 9, 10]
    assert not_new(body, "me@x.example") == [0, 1, 2, 4, 6, 8, 9, 10]


def test_edges():
    assert not_new(None) == [] and not_new("") == [] and not_new("\n \n") == [] and newly_written(None) is None
    assert newly_written("Hi,\n\n\n\ntext\n-- \nMe") == "Hi,\n\ntext"
    assert len(not_new("> a\n" * 20_000)) == 20_000


def test_table(spark):
    rows = [
        ("1", "a@x.example", "Text\n\nRgds\nAnn", None, None, "m1", 1), ("1", "a@x.example", "Text\n\nRgds\nAnn", None, None, "m1", 2), ("9", "a@x.example", "Text\n\nRgds\nAnn", None, None, "m1", 2),
        ("2", "b@x.example", "> Text\n> more\n\nYes", "", "m1", "m2", 3), ("3", None, None, None, "lost", None, 4),
    ]
    df = spark.createDataFrame(rows, "email_id string, from_addr string, body_text string, body_cleaned string, in_reply_to string, message_id string, parent int")
    found = [tuple(r) for r in lines_not_new(df).collect()]
    assert sorted(found) == [("1", "body_text", 2), ("1", "body_text", 3), ("2", "body_text", 0), ("2", "body_text", 1), ("9", "body_text", 2), ("9", "body_text", 3)]
    assert {r.email_id: r.new_text for r in reduced(df).collect()} == {"1": "Text", "9": "Text", "2": "Yes", "3": None}
    assert lines_not_new(df.limit(0)).count() == 0


def test_nested_quotes_and_forwards_form_a_tree():
    body = "Please see below.\n\nRgds\nAnn\n\n-----Original Message-----\nFrom: Bo Berg <bo@x.example>\nSent: today\nTo: ann@x.example\n\nAs asked.\n\nOn Mon, 1 Apr 2024 at 04:05, Cy Dahl wrote:\n> Text of Cy\n> > older text\n> >\n> > From: Ed <ed@x.example>\n> > Sent: before\n> > To: cy@x.example\n> >\n> > oldest text\n> more of Cy"
    root = read(body.split("\n"))
    kinds = {(x.kind, x.depth) for x in root.walk()}
    assert {("body", 0), ("letter", 0), ("forward", 1), ("letter", 1), ("quote", 2), ("body", 2), ("letter", 2), ("quote", 3), ("body", 3), ("forward", 4), ("letter", 4)} <= kinds
    oldest = next(x for x in root.walk() if x.kind == "letter" and x.depth == 4)
    assert [body.split("\n")[i] for i in oldest.text] == ["> > oldest text"]
    assert not_new(body, "ann@x.example") == [i for i, x in enumerate(body.split("\n")) if x.strip() and i > 0]


def test_depth_has_no_bound():
    assert not_new(">" * 50_000 + " a\n" + "> b\n" * 3) == [0, 1, 2, 3]
    deep = "\n".join(">" * k + " text" for k in range(1, 300))
    assert len(not_new(deep)) == 299
    heads = "From: A <a@x.example>\nSent: now\nTo: b@x.example\n\ntext\n\n" * 3000
    assert len(not_new("See below.\n\nRgds\nBo\n\n" + heads, "bo@x.example")) == 3000 * 4 + 2


def test_unseen_notice_below_a_signature():
    body = "Berth 10 is free.\n\nRgds\nAnn Berg\n\nThis communication was sent by an operator regulated abroad; rely on it at your own peril."
    assert not_new(body, "ann.berg@x.example") == [2, 3, 5]
    other = "Berth 10 is free.\n\nRgds\nAnn Berg\n\nRely on figures from abroad at your own peril,\nand ask a lawyer first."
    assert not_new(other, "ann.berg@x.example") == [2, 3, 5, 6]


def test_notices_are_known_by_their_recurrence(spark):
    """Sentences that stand below the signatures of several senders are notices also where no sign-off precedes them; others are text."""
    rows = [(f"{i}", f"p{i % 3}@x.example", f"Berth {i} is free at last.\n\nRgds\nAnn\n\nRely on figures from abroad at your own peril.", None, None, f"m{i}") for i in range(9)]
    rows += [("a", "q@x.example", "Berth 77 is taken.\n\nRely on figures from abroad at your own peril.", None, None, "ma"), ("b", "q@x.example", "Berth 77 is taken.\n\nFigures from home will do for now.", None, None, "mb")]
    df = spark.createDataFrame(rows, "email_id string, from_addr string, body_text string, body_cleaned string, in_reply_to string, message_id string")
    got = {}
    for r in lines_not_new(df).collect():
        got.setdefault(r.email_id, []).append(r.line_no)
    assert sorted(got["a"]) == [2] and "b" not in got and sorted(got["0"]) == [2, 3, 5]


def test_message_with_many_answers_is_split(spark, monkeypatch):
    from halyard.llm import email_layout

    monkeypatch.setattr(email_layout, "ANSWERS", 4)
    asked = "The hoses were off at noon today, and the pilot was waiting outside."
    rows = [("p", "a@x.example", asked, None, None, "m")] + [(f"{i}", "b@x.example", f"{asked}\n\nRgds\nJo\n\nHi Jo,\n\nNoted, berth {i} it is.", None, "m", None) for i in range(40)]
    df = spark.createDataFrame(rows, "email_id string, from_addr string, body_text string, body_cleaned string, in_reply_to string, message_id string")
    assert lines_not_new(df).groupBy("email_id").count().where("count = 3").count() == 40
