"""Noise in text from scanned pages: words divided over lines, misread letters, running headers and page numbers.

A vocabulary with document counts is taken from the whole corpus. Each distinct form outside it is looked up once
for all texts: the vocabulary's trie is walked together with the form's Levenshtein automaton, in which a known
misreading (`rn` for `m`) is one edit of small weight and any other edit one of large weight. All words within a
weight that grows with the form's length are candidates. They are ranked by weight, counts and the words on both
sides; forms and candidates meet the texts by joins. Page furniture is found by its layout and repetition over
the pages, taken out, and the paragraphs are set anew.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.sources.staging import staged

#: A word belongs to the vocabulary if it stands in this share of the documents, and in at least so many. So there
#: are no more words than an average document has different ones, divided by the share, however large the corpus.
MIN_SHARE, MIN_DOCS = 0.0005, 3
#: Words of one trie; a vocabulary with more is looked up part by part.
PART = 500_000
#: A form counts as misread if the word it stands for is so many times as frequent.
RATIO = 15

# Letters (left) and what scanners read instead.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("l", "1"), ("i", "l"), ("l", "i"), ("i", "1"), ("s", "5"), ("s", "§"), ("r", "¦"), ("a", "á"), ("b", "8"), ("g", "9"), ("g", "q"),
    ("n", "ri"), ("m", "rn"), ("rn", "m"), ("ri", "n"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("vv", "w"), ("t", "f"), ("f", "t"), ("v", "y"), ("y", "v"), ("h", "b"), ("b", "h"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("h", "li"), ("li", "h"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("i", "!"), ("l", "|"), ("i", "|"), ("z", "2"), ("t", "†"), ("c", "¢"), ("e", "€"), ("k", "lc"), ("in", "m"), ("m", "in"),
    ("i", "í"), ("e", "é"), ("o", "ó"), ("ffi", "ﬃ"), ("ff", "ﬀ"), ("q", "g"), ("j", "i"), ("i", "j"), ("o", "6"), ("a", "4"), ("t", "7"), ("d", "ci"),
]
#: Misreadings of a letter as another plain letter say little about a short form by themselves.
_WEAK = {("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("g", "q"), ("q", "g"), ("j", "i"), ("i", "j"), ("i", "í"), ("e", "é"), ("o", "ó"), ("in", "m"), ("m", "in"), ("ri", "n"), ("rn", "m"), ("li", "h"), ("h", "b"), ("b", "h"), ("f", "t"), ("y", "v")}
#: Weights of edits, in halves: a known misreading, a weak one or a sign in place of a letter. Any other edit weighs
#: more than all of these that are allowed.
KNOWN, WEAK, OTHER = 2, 3, 1024
#: What another edit adds to a candidate's cost: more than all known misreadings that a form can have may add.
UNKNOWN = 100.0

_SYMBOLS = "0-9§¦|!¢€†ﬀ-ﬄ"
_TOKEN = re.compile(rf"[^\W\d_][^\W_]*(?:[{_SYMBOLS}]+[^\W_]*)*|[{_SYMBOLS}]+[^\W\d_][^\W_]*(?:[{_SYMBOLS}]+[^\W_]*)*")
_SKIP = re.compile(r"(?<!\S)[^\s@]+@\S+|<[^>\n]{0,80}>|https?://\S+|\b(?:[A-ZÀ-Þ0-9]{1,4}[-/]?\d{3,}\w*|\d[\w.,:/°′-]*|[A-Z]{1,3}\d\w*)")
_MARKS = "-‐‑¬­"
_END = re.compile(rf"[{_MARKS}][ \t]*\r?\n(?:[ \t]*\r?\n)*[ \t]*")
_TOKEN_SIGNS = frozenset("0123456789§¦|!¢€†ﬀﬁﬂﬃﬄ")
_TAIL = re.compile(rf"(?:[^\W_]|[{_SYMBOLS}])+")
_SUSPENDED = set("and or und oder og eller et ou y e o i a bis to och en és и или και ή".split())
_PAGE_WORD = r"(?:page|seite|side|sida|página|pagina|pág\.?|strona|str\.|стр\.|p\.|pg\.?|blad|σελ\.?)"
_NUM = r"[\dOolISB]{1,4}"
_PAGENO = [
    ("of", re.compile(rf"{_PAGE_WORD}\s*({_NUM})\s*(?:of|von|av|af|de|sur|z|из|/|di|van)\s*{_NUM}", re.I)),
    ("word", re.compile(rf"{_PAGE_WORD}\s*({_NUM})", re.I)),
    ("dash", re.compile(rf"[-–—]\s*({_NUM})\s*[-–—]")),
    ("bracket", re.compile(rf"[\[(]\s*({_NUM})\s*[\])]")),
    ("slash", re.compile(r"(\d{1,4})\s*/\s*\d{1,4}")),
    ("bare", re.compile(r"(\d{1,4})")),
    ("roman", re.compile(r"([ivxlcIVXLC1]{1,7})")),
]
#: The signs that a page number can end with.
_LAST = frozenset("0123456789OolISBivxlcIVXLC-–—])")
_BESIDE = re.compile(r"^(?P<left>\S.*?)[ \t]{3,}(?P<right>\S.*)$")
_LETTERS = re.compile(r"[^\W\d_]{3}")
_DIGIT = str.maketrans("OolISB", "001158")
_CANON = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("fi", "ﬁ")]
_CANON_CHARS = str.maketrans({"c": "e", "l": "i", "1": "i", "|": "i", "!": "i", "0": "o", "5": "s", "§": "s", "¦": "r", "8": "b", "á": "a", "à": "a", "í": "i", "é": "e", "ó": "o", "f": "t", "y": "v", "b": "h", "6": "o", "9": "g", "q": "g", "ﬁ": "u", "j": "i"})


def canonical(line: str) -> str:
    """One form for all that scanners make of the same line."""
    s = re.sub(r"\s+", " ", line.strip().lower())
    for a, b in _CANON:
        s = s.replace(a, b)
    return s.translate(_CANON_CHARS)


def _roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [v[c] for c in s.lower().replace("1", "i")]
    return sum(-a if i + 1 < len(n) and a < n[i + 1] else a for i, a in enumerate(n))


def _as_roman(n: int) -> str:
    out = ""
    for v, c in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + c * (n // v), n % v
    return out


def _pageno(s: str) -> tuple[str, int] | None:
    s = s.strip()
    if not s or s[-1] not in _LAST and not s[-1].isdigit():
        return None
    for style, p in _PAGENO:
        if m := p.fullmatch(s):
            if style == "roman":
                n = _roman(m[1])
                return (style, n) if _as_roman(n) == m[1].lower().replace("1", "i") else None
            d = m[1].translate(_DIGIT)
            return (style, int(d)) if d.isdigit() else None
    return None


def furniture(text: str) -> tuple[set[int], set[int], list[str]]:
    """(lines with page numbers, lines of running headers, lines of the text without them where both share a line)."""
    lines = text.split("\n")
    n = len(lines)
    rest = [x.rstrip("\r") for x in lines]
    full = lambda k, step: next((j for j in range(k + step, n if step > 0 else -1, step) if rest[j].strip()), -1)
    found: list[tuple[int, str, int, str]] = []  # line, style, value, what else stands on the line
    for i, s in enumerate(rest):
        s = s.strip()
        if not s or s[0] in "|#<":
            continue
        if p := _pageno(s):
            k = full(i, -1)
            if p[0] in ("bare", "slash", "roman") and k >= 0 and rest[k].rstrip().endswith(":"):
                continue
            found.append((i, p[0], p[1], ""))
        elif ("   " in s or "\t" in s) and (m := _BESIDE.match(s)):
            for side, other in (("right", "left"), ("left", "right")):
                if (p := _pageno(m[side])) and len(m[other].strip()) > 5:
                    found.append((i, p[0], p[1], m[other].strip()))
                    break
    # Running lines: the same line on at least two pages, standing between the text of two pages.
    beside = {i: o for i, _, _, o in found if o}
    numbered = {i for i, *_ in found}
    width = max((len(x.strip()) for x in rest if x.strip() and x.strip()[0] not in "#|<"), default=0)
    lone: list[tuple[int, str]] = []  # lines that may be running lines, and whether they end by themselves
    texts: dict[str, list[int]] = {}
    for i, s in enumerate(rest):
        body = beside.get(i, "" if i in numbered else s.strip())
        if len(body) < 8 or body[0] in "#|<*->" or body[-1] in ":.,;?!" or not _LETTERS.search(body):
            continue
        if i in numbered or not _wrapped(rest, i, width) or _interrupts(rest, i):
            texts.setdefault(canonical(body), []).append(i)
        else:
            lone.append((i, body))
    header: set[int] = set()
    if any(len(where) > 1 for where in texts.values()):
        full_lines = Counter(canonical(body) for _, body in lone)
        for key, good in texts.items():
            if len(good) >= 2 and len(good) >= 0.6 * (len(good) + full_lines[key]):
                header.update(good)
    # Page numbers: one style, rising.
    number: set[int] = set()
    styles: dict[str, list[tuple[int, int]]] = {}
    for i, style, v, _ in found:
        styles.setdefault("of" if style == "word" and any(f[1] == "of" for f in found) else style, []).append((i, v))
    if "roman" in styles:  # a first page's i may be read as 1
        styles["roman"] = sorted(styles["roman"] + [x for x in styles.get("bare", []) if x[1] == 1])
    for style, where in styles.items():
        run = _rising(where)
        if len(run) >= 2:
            number.update(i for i, _ in run)
        elif len(run) == 1:
            i = run[0][0]
            near = i in header or any(j in header for j in (full(i, -1), full(i, 1)))
            if style in ("of", "word", "dash") or near:
                number.add(i)
    header = {i for i in header if i not in number or i in beside}
    kept = [x for i, x in enumerate(rest) if i not in number and i not in header]
    return number, header, kept


def _wrapped(rest: list[str], i: int, width: int) -> bool:
    """Whether a line ends because the next word had no room, as lines of a paragraph do; a running line ends by itself."""
    if i + 1 >= len(rest):
        return False
    after = rest[i + 1].strip()
    return bool(after) and after[0] not in "#|<" and len(rest[i].strip()) + 1 + len(after.split()[0]) > width


def _interrupts(rest: list[str], i: int) -> bool:
    """Whether a line stands between two parts of one sentence."""
    up, down = rest[i - 1].strip() if i else "", rest[i + 1].strip() if i + 1 < len(rest) else ""
    return up[-1:].isalnum() and down[:1].islower() and rest[i].strip()[:1].isupper()


def _rising(where: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of a sequence that rises by at most a few pages at a time."""
    best: list[list[tuple[int, int]]] = []
    for i, v in where:
        prev = max((b for b in best if 0 < v - b[-1][1] <= 3), key=len, default=[])
        best.append([*prev, (i, v)])
    return max(best, key=len, default=[])


def reach(form: str) -> tuple[int, int]:
    """(other edits, weight of known misreadings) within which words are candidates: both grow with the form's length."""
    n = len(form)
    return (0, KNOWN) if n < 4 else (n // 12 + 1, KNOWN * (1 + n // 4) + 1)


#: Ligatures are read as their letters.
_LIGATURES = str.maketrans({"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})


def _rules(backwards: bool) -> tuple[dict[str, list[tuple[str, int]]], dict[str, list[tuple[str, str, int]]]]:
    """(by what was read: letter and weight; by a word's second letter: first letter, what was read, weight)."""
    one: dict[str, list[tuple[str, int]]] = {}
    two: dict[str, list[tuple[str, str, int]]] = {}
    for a, b in CONFUSIONS:
        weight = WEAK if (a, b) in _WEAK else KNOWN
        a, b = (a[::-1], b[::-1]) if backwards else (a, b)
        if len(a) == 1:
            one.setdefault(b, []).append((a, weight))
        elif len(a) == 2:
            two.setdefault(a[1], []).append((a[0], b, weight))
    return one, two


class Lexicon:
    """A vocabulary as tries of the words read forwards and backwards."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = words
        self.tries: list[dict] = [{}, {}]
        for w in words:
            for node, letters in zip(self.tries, (w, w[::-1])):
                for c in letters:
                    node = node.setdefault(c, {})
                node[""] = w
        self.rules = _rules(False), _rules(True)

    def within(self, form: str, others: int, most: int) -> dict[str, int]:
        """All words that at most so many other edits, and known misreadings of at most this weight, turn into the
        form; with the least weight, in which each other edit is OTHER.

        Either the form's first half has at most half of the other edits or its second half has less than half of
        them: so one walk goes forwards with few in the first half, one backwards with few in the last half, and
        together they find every word.
        """
        half = len(form) // 2
        found = self._walk(0, form, others, most, half, others // 2)
        if others:
            for w, weight in self._walk(1, form[::-1], others, most, len(form) - half, others - others // 2 - 1).items():
                if weight < found.get(w, weight + 1):
                    found[w] = weight
        return found

    def _walk(self, way: int, form: str, others: int, most: int, half: int, cap: int) -> dict[str, int]:
        """The trie walked together with the automaton. Its states are places in the form, held as bits, one set for each weight."""
        n = len(form)
        one, two = self.rules[way]
        exact: dict[str, int] = {}
        other: dict[str, dict[tuple[int, int], int]] = {}  # by letter of the word: (places taken, weight) to places
        strange = 0  # places of signs that are no letters
        for j, c in enumerate(form):
            exact[c] = exact.get(c, 0) | 1 << j
            strange |= (not c.isalpha()) << j
            for size in (1, 2):
                for a, weight in one.get(form[j : j + size], ()) if j + size <= n else ():
                    moves = other.setdefault(a, {})
                    moves[size, weight] = moves.get((size, weight), 0) | 1 << j
        pairs: dict[str, list[tuple[str, int, int, int]]] = {}
        for last, rules in two.items():
            for first, b, weight in rules:
                if at := sum(1 << j for j in range(n) if form.startswith(b, j)):
                    pairs.setdefault(last, []).append((first, at, len(b), weight))
        full, end, low = (1 << n + 1) - 1, 1 << n, (1 << half) - 1
        last, few = others * OTHER, (cap + 1) * OTHER

        def close(state: dict[int, int]) -> dict[int, int]:
            """Letters that the form has too many; places of the first half are only kept with few other edits."""
            for weight in sorted(state):
                bits, heavier = state[weight], weight + OTHER
                while heavier < last + OTHER and bits:
                    bits = bits << 1 & full
                    state[heavier] = state.get(heavier, 0) | bits
                    heavier += OTHER
            return {w: b for w, bits in state.items() if (b := bits if w < few else bits & ~low)}

        found: dict[str, int] = {}
        stack = [(self.tries[way], close({0: 1}), "", {})]
        while stack:
            node, state, before, older = stack.pop()
            for c, child in node.items():
                if c == "":
                    weight = min((w for w, bits in state.items() if bits & end), default=-1)
                    if weight >= 0:
                        found[child] = weight
                    continue
                new: dict[int, int] = {}
                same, moves = exact.get(c, 0), other.get(c)
                for weight, bits in state.items():
                    left = most - weight % OTHER
                    if b := bits & same:
                        new[weight] = new.get(weight, 0) | b << 1
                    if moves:
                        for (size, add), at in moves.items():
                            if add <= left and (b := bits & at):
                                new[weight + add] = new.get(weight + add, 0) | b << size
                    if strange and left >= WEAK and (b := bits & strange):
                        new[weight + WEAK] = new.get(weight + WEAK, 0) | b << 1
                    if weight < last:
                        new[weight + OTHER] = new.get(weight + OTHER, 0) | (bits | bits << 1) & full
                if older:
                    for first, at, size, add in pairs.get(c, ()):
                        if first == before:
                            for weight, bits in older.items():
                                if add <= most - weight % OTHER and (b := bits & at):
                                    new[weight + add] = new.get(weight + add, 0) | b << size
                if new and (new := close(new)):
                    stack.append((child, new, c, state))
        return found

    def find(self, form: str, count: int = 1) -> list[tuple[str, float]]:
        """(word, cost) of all words that a form can be a misreading of, the best first. A word must be RATIO times as
        frequent as the form. Its cost is the number of edits, another edit than a known misreading counting as UNKNOWN,
        less a share of its count's logarithm."""
        plain = form.translate(_LIGATURES)
        out = []
        for w, weight in self.within(plain, *reach(form)).items():
            n = self.words[w]
            if w != form and n >= RATIO * count:
                known = max(weight % OTHER, KNOWN if plain != form else 0)
                out.append((w, known / 2 + UNKNOWN * (weight // OTHER) - 0.15 * math.log10(n)))
        return sorted(out, key=lambda x: (x[1], x[0]))


def _coded(text: str, start: int, end: int) -> bool:
    """Whether a token is part of an address, code, number or markup, and not a word with one wrong sign."""
    digits = sum(c.isdigit() for c in text[start:end])
    if digits > 1 and 2 * digits >= end - start:
        return True
    lo, hi = start, end
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    near = text[lo:hi]
    if "@" in near or near.startswith(("<", "http")) or near.endswith("-->"):
        return True
    if any(m.start() < end - lo and m.end() > start - lo for m in _SKIP.finditer(near)):
        t = text[start:end]  # "l0gged", "1umpsum" look like codes
        return not (sum(c.islower() for c in t) >= 3 and sum(c.isdigit() for c in t) <= 2)
    return False


def unknown_tokens(text: str, known: Container[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, token, token before, token after) of the words of a text that aren't known; addresses, codes and numbers aren't words."""
    before, held = "", None
    for m in _TOKEN.finditer(text):
        t = m.group()
        low = t.lower()
        if held:
            yield *held, low
            held = None
        if low not in known and not _coded(text, m.start(), m.end()):
            held = (m.start(), m.end(), t, before)
        before = low
    if held:
        yield *held, ""


def _head(text: str, end: int, least: int = 0) -> int:
    """Where the token that ends here begins."""
    start = end
    while start > least and ((c := text[start - 1]).isalnum() or c in _TOKEN_SIGNS):
        start -= 1
    return start


def _whole(text: str) -> list[str]:
    """Lower-case words of a text without those that a line end divides."""
    parts, at = [], 0
    for m in _END.finditer(text):
        if (start := _head(text, m.start(), at)) < m.start() and (end := _TAIL.match(text, m.end())):
            parts.append(text[at:start])
            at = end.end()
    return [t.lower() for t in _TOKEN.findall(_SKIP.sub(" ", " ".join([*parts, text[at:]])))]


class Answers:
    """What one text needs to know of the corpus: the vocabulary, candidates of its forms, counts of pairs of words.

    Without candidates and counts it notes down what is asked.
    """

    def __init__(self, words: dict[str, int], readings: dict[str, list[tuple[str, float]]] | None = None, pairs: dict[tuple[str, str], int] | None = None) -> None:
        self.words = words
        self.readings, self.pairs = readings or {}, pairs or {}
        self.forms: set[tuple[str, str, str]] = set()
        self.asked: set[tuple[str, str]] = set()

    def find(self, form: str, before: str = "", after: str = "") -> list[tuple[str, float]]:
        self.forms.add((before, form, after))
        return self.readings.get(form, [])

    def pair(self, a: str, b: str) -> int:
        self.asked.add((a, b))
        return self.pairs.get((a, b), 0)


def misread(token: str, known: Answers, before: str = "", after: str = "") -> tuple[str, bool] | None:
    """(the word that a token stands for in the token's case, whether the token or its neighbours prove it); None where it is a word or stands for none.

    The candidates are ranked by cost less the logarithms of how often they stand beside the same neighbours. One
    that known misreadings don't explain is only taken if it stands beside both.
    """
    low = token.lower()
    if low in known.words or len(low) < 3 and token.isalpha():
        return None
    ranked = []
    for w, cost in known.find(low, before, after):
        left, right = known.pair(before, w), known.pair(w, after)
        ranked.append((cost - 0.3 * math.log10(1 + left) - 0.3 * math.log10(1 + right), w, cost < UNKNOWN / 2, left, right))
    if not ranked:
        return None
    _, best, explained, left, right = min(ranked)
    if not explained and not (left and right):
        return None
    proven = not token.isalpha() or explained and bool(left or right)
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return best.upper(), proven
    return (best.capitalize() if token[:1].isupper() or token[:1] in "058" and best[:1].isalpha() and _starts(token) else best), proven


def _starts(token: str) -> bool:
    """A digit in place of a capital: what follows it is in lower case and the digit looks like a capital letter."""
    return token[0] in "58" and token[1:2].islower()


def _divisions(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, left part, mark, right part, sign before) wherever a mark at a line end stands between two parts of a word."""
    for m in _END.finditer(text):
        start, end = _head(text, m.start()), _TAIL.match(text, m.end())
        if start < m.start() and end:
            yield start, end.end(), text[start : m.start()], m[0][0], end[0], text[start - 1 : start]


def _one_word(left: str, mark: str, tail: str, before: str, known: Answers) -> bool:
    """Whether the mark isn't part of the word."""
    words = known.words
    if not any(c.isalpha() for c in left) or not any(c.isalpha() for c in tail):
        return False
    low, end, joined = left.lower(), tail.lower(), (left + tail).lower()
    if end in _SUSPENDED and joined not in words:
        return False
    if before and (before.isalnum() or before in "-/@.") and mark == "-" and joined not in words:
        return False
    if mark != "-":
        return True
    pair = known.pair(low, end)
    if joined in words or any(cost < UNKNOWN / 2 for _, cost in known.find(joined)):
        return not (low in words and end in words and pair > words.get(joined, 0))
    if pair or not tail[:1].islower() or (low in words and end in words) or len(left) < 2 or len(tail) < 2 and len(left) < 4:
        return False
    return not (low in words and len(low) > 3 or any(c.isupper() for c in tail))


def divided(text: str, known: Answers) -> list[tuple[int, int, str]]:
    """(start, end, whole word) of the words that a line end divides by a mark that isn't part of them."""
    return [(start, end, left + tail) for start, end, left, mark, tail, before in _divisions(text) if _one_word(left, mark, tail, before, known)]


def observed(text: str | None, words: Container[str]) -> tuple[bool, bool, list[tuple[str, str, str, str]], list[tuple[str, str, str]]]:
    """What a text shows before anything is asked: (running headers, page numbers, divisions, unknown tokens with their neighbours)."""
    if not text or not text.strip():
        return False, False, [], []
    number, header, kept = furniture(text)
    return bool(header), bool(number), [x[2:] for x in _divisions("\n".join(kept))], [x[2:] for x in _unknown_spots(text, words)]


def kinds(header: bool, number: bool, divisions: list, unknown: list, known: Answers) -> list[str]:
    """The kinds of noise, given a text's observations and the answers to them."""
    out = ["hyphen"] if any([_one_word(*x, known) for x in divisions]) else []
    out += (["header"] if header else []) + (["pageno"] if number else [])
    # A plain word that none of its neighbours supports may be a rare word: it takes two of these.
    found = [x for token, before, after in unknown if (x := misread(token, known, before, after))]
    return out + (["ocr"] if sum(1.0 if proven else 0.5 for _, proven in found) >= 1 else [])


def noise(text: str | None, known: Answers) -> list[str]:
    """Kinds of noise in a text, of hyphen, ocr, header and pageno; none for null, empty and blank texts."""
    return kinds(*observed(text, known.words), known)


def _unknown_spots(text: str, words: Container[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """Unknown tokens that no line end divides."""
    for i, j, t, before, after in unknown_tokens(text, words):
        if text[j : j + 1] in tuple(_MARKS) and text[j + 1 : j + 2] in ("\n", "\r"):
            continue
        if (up := _up(text, i)) and up in _MARKS:
            continue
        yield i, j, t, before, after


def _misread_spans(text: str, known: Answers) -> list[tuple[int, int, str]]:
    return [(i, j, found[0]) for i, j, t, before, after in _unknown_spots(text, known.words) if (found := misread(t, known, before, after))]


def repair(text: str | None, known: Answers) -> str | None:
    """The text in continuous paragraphs, without page furniture and with whole, rightly read words. A text without noise is returned as it is."""
    if not noise(text, known):
        return text
    _, _, kept = furniture(text)
    body = "\n".join(kept)
    parts, at = [], 0
    for i, j, w in divided(body, known):
        if i >= at:
            parts += [body[at:i], w]
            at = j
    body = "".join([*parts, body[at:]])
    parts, at = [], 0
    for i, j, w in _misread_spans(body, known):
        parts += [body[at:i], w]
        at = j
    return reflow("".join([*parts, body[at:]]))


def _up(text: str, i: int) -> str:
    """The last sign of the lines above, where only blanks stand before a place in its line; else nothing."""
    while i and text[i - 1] in " \t":
        i -= 1
    if not i or text[i - 1] != "\n":
        return ""
    while i and text[i - 1].isspace():
        i -= 1
    return text[i - 1] if i else ""


def reflow(text: str) -> str:
    """Joins the lines of each paragraph and paragraphs that a page break cut; headings, tables, lists and labels keep their lines."""
    out: list[str] = []
    gap = 0
    for line in text.split("\n"):
        s = line.rstrip()
        if not s.strip():
            gap += 1
            continue
        plain = not re.match(r"\s*(?:[#|<>]|[-*] |\d+\. |[^\W\d_][^.]{0,40}:\s*$|(?:Tel|Attention|Signed)\b)", s)
        if out and plain and out[-1] and not re.match(r"\s*[#|<>]", out[-1]):
            up = out[-1]
            ends = up[-1] in ".?!:|"
            if gap == 0 and len(up.split("\n")[-1]) > 30 and not up.endswith(":") or gap and not ends and s.lstrip()[:1].islower() and len(up) > 30:
                out[-1] = up + " " + s.strip()
                gap = 0
                continue
        if out and gap:
            out.append("")
        out.append(s)
        gap = 0
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out))



# Over the corpus


def _word_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        count: Counter = Counter()
        for t in b["markdown"]:
            words = _whole(t)
            count.update(("", w) for w in set(words))
            count.update(set(zip(words, words[1:])))
        yield pd.DataFrame([(a, w, n) for (a, w), n in count.items()], columns=["before", "word", "n"])


_SEEN = "sha256 string, header boolean, number boolean, divisions array<struct<left:string,mark:string,tail:string,before:string>>, unknown array<struct<token:string,before:string,after:string>>, forms array<struct<a:string,form:string,z:string>>, pairs array<struct<a:string,z:string>>"


def _see_batches(words):
    """What each file shows, and what it asks: unknown forms with the tokens beside them, and pairs of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["sha256"], b["markdown"]):
                known = Answers(words.value)
                seen = observed(t, known.words)
                kinds(*seen, known)
                rows.append((k, *seen, list(known.forms), list(known.asked)))
            yield pd.DataFrame(rows, columns=["sha256", "header", "number", "divisions", "unknown", "forms", "pairs"])

    return run


def _look_up(forms: DataFrame, words: dict[str, int], explained: bool = False) -> DataFrame:
    """(form, word, cost) of the candidates of all forms (form, n); a large vocabulary is gone through in parts."""
    spark, out = forms.sparkSession, None
    every = sorted(words)
    for at in range(0, max(1, len(every)), PART):
        part = spark.sparkContext.broadcast({w: words[w] for w in every[at : at + PART]})

        def run(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            lex = Lexicon(part.value)
            for b in batches:
                rows = [(form, w, cost) for form, n in zip(b["form"], b["n"]) for w, cost in lex.find(form, n) if not explained or cost < UNKNOWN / 2]
                yield pd.DataFrame(rows, columns=["form", "word", "cost"])

        found = forms.mapInPandas(run, "form string, word string, cost double")
        out = found if out is None else out.unionByName(found)
    return out


def vocabulary(counts: DataFrame, n_docs: int) -> dict[str, int]:
    """The corpus's words with their document counts: those frequent enough, without frequent misreadings of others. See MIN_SHARE for the bound of what is collected."""
    spark = counts.sparkSession
    least = max(MIN_DOCS, MIN_SHARE * n_docs)
    frequent = counts.where((F.col("before") == "") & (F.col("n") >= least)).select(F.col("word").alias("form"), "n")
    words = {r.form: r.n for r in frequent.collect()}
    wrong = _look_up(frequent.repartition(2 * spark.sparkContext.defaultParallelism), words, explained=True).select("form").distinct()
    drop = {r.form for r in wrong.collect()}
    return {w: n for w, n in words.items() if w not in drop}


def _answered(files: DataFrame) -> tuple[DataFrame, DataFrame, object]:
    """(what each file shows, (sha256, readings, pairs) with the answers to what it asks, the broadcast vocabulary).

    Distinct forms are looked up once each; candidates and counts of pairs reach the files by joins, and a file
    gets back no more than its own questions' answers.
    """
    docs = files.where("markdown is not null and markdown <> ''")
    counts = staged(docs.select("markdown").mapInPandas(_word_batches, "before string, word string, n bigint").groupBy("before", "word").agg(F.sum("n").alias("n")), "words")
    words = vocabulary(counts, docs.count())
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(words)
    seen = staged(docs.select("sha256", "markdown").mapInPandas(_see_batches(shared), _SEEN), "seen")
    asks = seen.select("sha256", F.explode("forms").alias("x")).select("sha256", "x.a", "x.form", "x.z")
    forms = asks.select("sha256", "form").distinct().groupBy("form").agg(F.count("*").alias("n"))
    readings = staged(_look_up(forms.repartition(2 * spark.sparkContext.defaultParallelism, "form"), words), "readings")
    spots = staged(asks.join(readings, "form"), "spots")
    left = spots.where("a <> ''").select("sha256", F.col("a").alias("before"), "word")
    right = spots.where("z <> ''").select("sha256", F.col("word").alias("before"), F.col("z").alias("word"))
    apart = seen.select("sha256", F.explode("pairs").alias("x")).select("sha256", F.col("x.a").alias("before"), F.col("x.z").alias("word"))
    pairs = left.unionByName(right).unionByName(apart).distinct().join(counts.where("before <> ''"), ["before", "word"])
    pairs = pairs.groupBy("sha256").agg(F.collect_list(F.struct("before", "word", "n")).alias("counts"))
    own = spots.groupBy("sha256").agg(F.collect_set(F.struct("form", "word", "cost")).alias("readings"))
    return seen, own.join(pairs, "sha256", "full"), shared


def _answers(words: dict[str, int], readings, counts) -> Answers:
    found: dict[str, list[tuple[str, float]]] = {}
    for r in readings if readings is not None else ():
        found.setdefault(r["form"], []).append((r["word"], r["cost"]))
    return Answers(words, found, {(r["before"], r["word"]): r["n"] for r in counts} if counts is not None else {})


def _files(docling: DataFrame) -> DataFrame:
    """Repeated rows of a file hold one text; of several the smallest counts."""
    return docling.groupBy("sha256").agg(F.min("markdown").alias("markdown"))


def found_noise(docling: DataFrame) -> DataFrame:
    """(sha256, noise_kind), distinct. Null, empty and placeholder-only texts have none; other columns are ignored."""
    seen, answers, shared = _answered(staged(_files(docling), "files"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                divisions = [(x["left"], x["mark"], x["tail"], x["before"]) for x in r.divisions]
                unknown = [(x["token"], x["before"], x["after"]) for x in r.unknown]
                rows += [(r.sha256, x) for x in kinds(r.header, r.number, divisions, unknown, _answers(shared.value, r.readings, r.counts))]
            yield pd.DataFrame(rows, columns=["sha256", "noise_kind"])

    some = seen.where("header or number or size(divisions) > 0 or size(unknown) > 0").drop("forms", "pairs")
    return some.join(answers, "sha256", "left").mapInPandas(run, "sha256 string, noise_kind string")


def repaired_files(docling: DataFrame) -> DataFrame:
    """(sha256, repaired): one row per file; null stays null."""
    files = staged(_files(docling), "files")
    _, answers, shared = _answered(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.sha256, repair(r.markdown, _answers(shared.value, r.readings, r.counts))) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["sha256", "repaired"])

    return files.join(answers, "sha256", "left").mapInPandas(run, "sha256 string, repaired string")
