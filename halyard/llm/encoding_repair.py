"""Garbled text from wrong character encodings: which fields hold it, and the text restored where it can be.

Round trips: a run of characters outside ASCII is encoded again under the encodings it may wrongly have been
read with, decoded strictly under the encoding that was meant, over several layers, and the result is taken
when the cost of garbling drops. In all encodings tried ASCII stands for itself, so what one wrong decoding
made of a character always lies inside one such run; a run's cost also sees the two characters around it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 was read with, in the order they are tried.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1254", "iso8859_15", "iso8859_2", "cp852", "cp866", "koi8_r", "cp1253", "iso8859_7", "cp1257")
#: Pairs of single-byte encodings: read with the first, meant to be the second.
PAIRS = tuple(
    (a, b)
    for a, bs in {
        "cp1252": ("cp1250", "iso8859_2", "cp1251", "koi8_r", "cp1253", "iso8859_7", "mac_roman", "cp850", "cp437", "cp1254", "cp1257", "cp866"),
        "latin-1": ("iso8859_2", "cp1250", "cp1251", "koi8_r", "iso8859_7", "cp1253", "mac_roman", "cp850", "cp437"),
        "cp437": ("cp1252", "latin-1", "iso8859_2", "cp1250"), "cp850": ("cp1252", "latin-1", "iso8859_2", "cp1250"), "mac_roman": ("cp1252", "latin-1", "cp1250", "iso8859_2"),
        "cp1250": ("cp1252", "iso8859_2"), "iso8859_2": ("cp1252", "cp1250"), "cp1251": ("cp1252", "koi8_r", "cp866", "cp1250"), "koi8_r": ("cp1251", "cp1252"), "cp866": ("cp1251", "cp1252"), "cp1253": ("cp1252",), "iso8859_7": ("cp1252",),
    }.items()
    for b in bs
)
#: Cost of taking a run that strictly decodes as UTF-8 for text: by chance that hardly happens.
STRICT = 2.0

_LATIN = set("àâäáãåæçćčďéèêëęėěğíìîïıłńñňóòôöõøœőřśšşșťțúùûüůűýźżžßąđ")
_LATIN |= {c.upper() for c in _LATIN if len(c.upper()) == 1}
_PUNCT = set("–—‘’“”„…«»‹›•·′″−×☎✓✔→≈≤≥√€£¥°±²³¹º¿¡§©®™½¼¾µ№‐‑   ")
# Letters outside ASCII of languages in Latin script.
ALPHABETS = [
    set(a + a.upper().replace("SS", ""))
    for a in ("äöüß", "àâæçéèêëîïôœùûüÿ", "áéíóúüñ", "áâãàçéêíóôõú", "àèéìíîòóùú", "ąćęłńóśźż", "æøåäöé", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ", "çğıöşüâîû", "áðéíóúýþæö", "āčēģīķļņšūž", "ąčęėįšųūž", "čćđšž", "åäöõüšž", "áéíóúàèìòù")
]
#: Letters that are words by themselves.
_WORDS = set("àáâéèêíìóòôöúùåäæøëïÀÁÂÉÈÊÍÌÓÒÔÖÚÙÅÄÆØËÏ" "авикосуяАВИКОСУЯ" "οηήόώὁΟΗΉ")
_CYRILLIC = {chr(c) for c in range(0x410, 0x450)} | set("ёЁіїєґІЇЄҐ")
_GREEK = {chr(c) for c in range(0x391, 0x3CF)} | set("άέήίόύώΆΈΉΊΌΎΏϊϋΐΰ")
_CJK = lambda c: "　" <= c <= "ヿ" or "一" <= c <= "鿿" or "＀" <= c <= "￯" or "가" <= c <= "힣"
_RUN = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});")


def _script(c: str) -> str:
    if "a" <= c <= "z" or "A" <= c <= "Z" or c in _LATIN:
        return "l"
    if c in _CYRILLIC:
        return "c"
    if c in _GREEK:
        return "g"
    if c.isdigit():
        return "d"
    if _CJK(c):
        return "j"
    return "o" if c.isalpha() and c not in "µºª" else " "


def _own(c: str, a: str, b: str) -> float:
    """Cost of one character between its neighbours (blank where there is none)."""
    if c == "�" or "\x80" <= c <= "\x9f" or "" <= c <= "":
        return 4.0
    s, sa, sb = _script(c), _script(a), _script(b)
    if c == "μ" and not a.isalpha():
        return 0.0
    if s in "lcg":
        cost = 0.0
        if (s != sa and sa in "lcg") or (s != sb and sb in "lcg"):
            cost += 2.0
        if ord(c) > 127 and c.isupper() and not ("A" <= b <= "Z" and a.islower()) and (a.islower() or (a.isupper() and b.islower() and ord(a) > 127)):
            cost += 1.5
        if a.isupper() and c.islower() and b.isupper():
            cost += 1.0
        if ord(c) > 127 and c not in _WORDS and a.isspace() and b.isspace():
            cost += 1.5
        return cost
    if s == "j":
        return 0.0
    if s == "d":  # digits outside ASCII, superscripts among them
        return 0.0 if c in _PUNCT and not (sa in "lcg" and sb in "lcg") else 2.0
    if s == "o":  # letters of other scripts are at home among themselves
        return 2.0 if not 0x530 <= ord(c) < 0x2000 or sa in "lcg" or sb in "lcg" else 0.0
    letters = (sa in "lcgo") + (sb in "lcgo")
    if c in "’‐‑·":
        return 0.0 if c != "·" or letters < 2 else 2.0
    if c == "µ":
        return 2.0 if sa in "lcgo" else 0.0
    if c in "²³¹":
        return 2.0 if sb in "lcgo" else 0.0
    if c in "°":
        return 2.0 if sa in "lcgo" and sb in "lcgo" else 0.0
    if c in "º":
        return 0.0 if not sb.strip() else 2.0
    if c in "¿¡":
        return 2.0 if sa in "lcgo" else 0.0
    if c in "–—…":
        return 0.7 if letters == 2 else 0.0
    if c in "“”„«»‘‹›":
        return 1.5 if letters == 2 else 0.0
    if c in "   ​﻿⁠":
        return 0.0
    if c == "­":
        return 1.0
    if c in "≤≥≈√" and sa in "lcgo":
        return 2.0
    if c in _PUNCT:
        return 2.0 if letters == 2 else 1.0 if letters and c not in "€£¥™®©√✓✔→☎•×µ" else 0.0
    if "─" <= c <= "▟" or c in "⌐¬╬ⁿ∙¦¨¯¸´ƒ‰†‡ˆ˜¤˙˚˛˝ﬁﬂ◊∂∑∏∫Ω∞≠∆⁄ªΠ":
        return 3.0 if letters or c in a + b else 1.5
    return 1.5 if letters == 2 else 0.5


def cost(run: str, before: str = " ", after: str = " ") -> float:
    """How garbled a run of characters outside ASCII looks between the characters around it."""
    s = before + run + after
    total = sum(_own(s[i], s[i - 1], s[i + 1]) for i in range(1, len(s) - 1))
    letters = [c for c in run if _script(c) == "l"]
    if len(letters) >= 3 and len(letters) >= 0.8 * len(run) and not any(a.issuperset(letters) for a in ALPHABETS):  # no one language has all these in a row
        total += len(letters)
    return total


def _common(s: str) -> bool:
    return all(c in _LATIN or c in _PUNCT or c in _CYRILLIC or c in _GREEK or _CJK(c) or ord(c) < 128 for c in s)


def _encode(s: str, encoding: str) -> bytes | None:
    """Bytes that, read with an encoding, show as s; C1 controls stand for bytes that cp1252 and its like leave free."""
    try:
        return s.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in s:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def _layer(text: str) -> Iterator[tuple[str, str]]:
    """(decoded text, encoding) of all strict decodings as UTF-8."""
    for enc in READ_AS:
        if (raw := _encode(text, enc)) is not None:
            try:
                s = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _common(s) or _RUN.search(s) and any(_encode(s, e) for e in READ_AS[:2]):
                yield s, enc


def _total(text: str, before: str, after: str) -> float:
    """The garbling cost of a text: that of its characters, and STRICT more where it is valid UTF-8 in another encoding."""
    return cost(text, before, after) + STRICT * (_RUN.search(text) is not None and next(_layer(text), None) is not None)


@lru_cache(1 << 17)
def run_verdict(run: str, before: str, after: str) -> tuple[bool, str, tuple[str, str] | None]:
    """(garbled, restored run, pair of encodings of the first layer). The run is unchanged where it can't be restored.

    Layer by layer the decoding with the least cost is followed to the end (each makes the text shorter); that layer
    is taken whose cost is the least, if it is less than the run's own.
    """
    text, here = run, _total(run, before, after)
    best, step, first = (here, run), None, None
    while options := [(_total(s, before, after), s, (enc, "utf-8")) for s, enc in _layer(text) if not _single(s, enc, here)]:
        low, text, step = min(options, key=lambda x: x[0])
        first = first or step
        if low < best[0]:
            best = low, text
    if best[1] == run:
        first = None
        for a, b in PAIRS if here >= 1.5 else ():
            raw = _encode(run, a)
            if raw is None:
                continue
            try:
                s = raw.decode(b)
            except UnicodeDecodeError:
                continue
            if s != run and all(_script(x) in "lcg" or x in "’–°³±²€" for x in s) and (c := cost(s, before, after)) <= here - 1.5 and c < min(1, best[0]):
                best, first = (c, s), (a, b)
    garbled = first is not None or "�" in run or any("\x80" <= c <= "\x9f" for c in run) or here >= 2.9
    return garbled, best[1], first


def _single(s: str, encoding: str, here: float) -> bool:
    """One Cyrillic letter out of an encoding in which many pairs of signs are one: that says little by itself."""
    return encoding in ("mac_roman", "cp1251", "koi8_r", "cp866") and len(s) == 1 and s in _CYRILLIC and here - STRICT < 2


#: First signs of a pair whose second one, a no-break space, became a blank or was lost.
_LEADS = "ÃÂâÄÅÐÑ"


def unescape(text: str) -> str:
    """Entities that name characters outside ASCII become these; &amp; and the like stay."""
    if "&" not in text:
        return text
    return _ENTITY.sub(lambda m: c if len(c := html.unescape(m.group())) == 1 and ord(c) > 127 else m.group(), text)


def _with_lost(run: str, before: str, after: str) -> tuple | None:
    """The verdict of a run before blanks that were the rest of a sign: it is garbled, though not restorable, if it
    decodes at less cost with a rest put in their place."""
    if len(run) == 1 and (before.isupper() or before == "-"):
        return None
    for rest in ("\xa0", "\x80\x99") if len(after) == 2 and after.isspace() else ("\xa0",):
        garbled, text, first = run_verdict(run + rest, before, " ")
        if garbled and first and first[1] == "utf-8" and len(text) <= len(run):
            return True, run_verdict(run[:-1], before, run[-1])[1] + run[-1] if len(run) > 1 else run, None
    return None


def repair(text: str | None) -> tuple[bool, str | None]:
    """(garbled, text restored as far as it can be). Null and empty texts are returned as they are."""
    if not text or (text.isascii() and "&" not in text):
        return False, text
    plain = unescape(text)
    out, at, garbled, pairs = [], 0, False, Counter()
    size = len(plain)
    spans = []
    for m in _RUN.finditer(plain):
        i, j = m.span()
        before, after = plain[i - 1] if i else " ", plain[j] if j < size else " "
        v = _with_lost(m.group(), before, plain[j : j + 2]) if plain[j - 1] in _LEADS and after.isspace() else None
        v = v or run_verdict(m.group(), before, after)
        spans.append((i, j, v))
        if v[0]:
            garbled = True
            if v[2] and v[2][1] != "utf-8":
                pairs[v[2]] += 1
    if not garbled:
        return False, text
    if pairs:  # single bytes: letters that look right by themselves belong to the same wrong decoding
        a, b = pairs.most_common(1)[0][0]
        at_first = min(i for i, _, v in spans if v[2] and v[2][1] != "utf-8")
        at_last = max(j for _, j, v in spans if v[2] and v[2][1] != "utf-8")
        for k, (i, j, v) in enumerate(spans):
            if at_first <= i and j <= at_last and (v[2] is None or v[2][1] != "utf-8") and (raw := _encode(plain[i:j], a)) is not None:
                try:
                    s = raw.decode(b)
                except UnicodeDecodeError:
                    continue
                if _common(s):
                    spans[k] = (i, j, (True, s, (a, b)))
    for i, j, (bad, s, _) in spans:
        out.append(plain[at:i])
        out.append(s if bad else plain[i:j])
        at = j
    out.append(plain[at:])
    return True, "".join(out)


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = [repair(t) for t in b["text"]]
        yield pd.DataFrame({"record_id": b["record_id"], "field_name": b["field_name"], "garbled": [x[0] for x in done], "restored": [x[1] for x in done]})


def _mark_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [repair(t)[0] for t in b["text"]]
        yield b.loc[keep, ["record_id", "field_name"]]


def _fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per record and field that holds a character outside ASCII or an entity; the rest can't be garbled."""
    one = df.select(F.col(key).alias("record_id"), *[F.col(f).alias(f"__{i}") for i, f in enumerate(fields)])
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"__{i}").alias("text")) for i, f in enumerate(fields)])
    rows = one.select("record_id", F.explode(F.filter(pairs, lambda p: p["text"].rlike(r"[^\x00-\x7f]|&[#A-Za-z]"))).alias("f"))
    return rows.select("record_id", "f.field_name", "f.text")


def garbled_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Distinct (record_id, field_name) whose text holds characters produced by a wrong decoding.

    Null, empty and pure ASCII texts are never garbled; repeated rows count once; other columns are ignored.
    """
    return _fields(df, key, fields).mapInPandas(_mark_batches, "record_id string, field_name string").distinct()


def restored_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(record_id, field_name, garbled, restored) of every field that isn't plain ASCII; restored equals the text where nothing was garbled."""
    return _fields(df, key, fields).mapInPandas(_repair_batches, "record_id string, field_name string, garbled boolean, restored string").distinct()
