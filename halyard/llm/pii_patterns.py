"""Exact forms of personal information: they label the texts that the tagger is trained on, and settle where a
tagged span begins and ends."""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "person")

_HOST = r"[\w§¦]+(?:-\n?[\w§¦]+)*"
_LOCAL = r"[^\W_][\w.+'%§¦-]*"
_AT, _DOT = r"(?:@|\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?)", r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?)"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_HOST}(?:{_DOT}{_HOST})+|\s(?:at|AT)\s{_HOST}(?:\s(?:dot|DOT)\s{_HOST})+)")
_D = r"[\dOolISB]"
PHONE = re.compile(
    rf"(?<![\w/.,-])(?:\+{_D}{{1,3}}|00{_D}{{2}}|\(0?{_D}{{2,4}}\)|0{_D}{{1,4}}|{_D}{{3}}(?=[.-]{_D}{{3}}[.-]{_D}{{4}}(?!\w)))(?:(?:[ ]?[-./ ]?[ ]?|[-./ ]?\n)\(?{_D}{{2,}}\)?){{1,7}}(?![\w/])"
)
ID = re.compile(
    rf"(?<![\w/-])(?:[A-Z]{{1,2}}\d{_D}{{6,7}}|SB-{_D}{{6}}|{_D}{{5}}-[A-Z]{{2}}|{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|[A-Z]{_D}{{2}}[ \n]{_D}{{3}}[ \n]{_D}{{3}}[ \n]{_D}{{2}}|[A-Z]{{3}}\d{_D}{{5}}[A-Z])(?![\w-])"
)
ID_LABEL = re.compile(r"(?:passport(?:\s+no\.?)?|seaman['’]s\s+book|\bCDC(?:\s+no\.?)?|social\s+security\s+(?:number|no\.?)|national\s+ID|driving\s+licen[cs]e|identity\s+card)[\s:.(|]*$", re.I)
_U = r"[A-ZÀ-ÞĀ-ŽȘȚ]"
_WORD = rf"{_U}[\w’'§¦-]*"
_S = r"[ \n]"
_STREETS = "Road|Street|Lane|House|Row|Wharf|Quay|Avenue|Square|Terrace|Drive|Close|Court|Way|Dock|Pier|Parade|Hill|Place|Gardens"
STREET = re.compile(
    rf"(?<![\w/])(?:(?:Suite|Unit|Flat|Floor|Level){_S}\w{{1,4}},{_S})?(?:\d{{1,4}}[a-z]?{_S}(?:{_WORD}{_S}){{1,2}}(?:{_STREETS})\b|\d{{1,4}}{_S}(?:rue|avenue|quai|boulevard|place|impasse|chemin){_S}(?:(?:du|de|des|de{_S}la|de{_S}l’)?{_S}?)(?:{_WORD}){_S}?(?:{_WORD})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino){_S}(?:(?:de|del|los|las|la|el){_S}){{0,2}}{_WORD}(?:{_S}{_WORD})?,?{_S}\d{{1,4}}[a-z]?|(?:ul|al|os|pl)\.{_S}{_WORD}(?:{_S}{_WORD})?{_S}\d{{1,4}}[a-z]?(?:/\d{{1,4}})?"
    rf"|(?:Rua|Avenida|Travessa|Largo|Praça){_S}(?:(?:da|do|das|dos|de){_S})?{_WORD}(?:{_S}{_WORD})?,?{_S}\d{{1,4}}[a-z]?|{_U}[\w§¦]*(?:stra(?:ß|ss)e|gasse|weg|allee|platz|ufer|damm|veien|vegen|gata|gaten|gate|brygga|kaia|plassen|gatan|vägen|straat|kade|laan){_S}\d{{1,4}}[a-z]?\b)"
)
TOWN = re.compile(
    rf",{_S}(?:(?:\d{{4}}{_S}[A-Z]{{2}}|\d{{4,6}}|\d{{2}}-\d{{3}}|[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}){_S}(?:Le{_S}|La{_S}|Den{_S})?{_WORD}(?:{_S}(?:am|an{_S}der|de|sur){_S}{_WORD})?|(?:Le{_S}|La{_S})?{_WORD}(?:,{_S}[A-Z]{{2}}{_S}\d{{5}}(?:-\d{{4}})?)?)(?![\w])"
)
_NOT_TOWN = re.compile(r"(?i),\s(?:and|ref|our|the|please|attn|tel|file|next|mob|owners|charterers|e-?mail)\b")
TITLES = re.compile(rf"(?:(?:Mr|Ms|Mrs|Miss|Mx|Dr|Capt|Captain|Master|Chief{_S}Engineer|Chief{_S}Officer|Second{_S}Officer|C/E|C/O|2/O|Herr|Frau|Fru|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora|Senhor|Senhora|Pan|Pani|Eng|Engineer|Officer|Bosun|Pilot|Kapitän|Kaptein|Capitán|Commandant|Prof)\.?{_S})+")
SHIP = re.compile(r"(?:\b(?:M/?[VT]|m/?[vt]|M/S|S/S|(?i:vessel|tug|barge|schiff|skipet|navire|buque|navio|statek|судно))\s+)$")
NAME = re.compile(rf"(?:{_WORD}|{_U}\.)(?:(?:,?{_S})(?:{_WORD}|{_U}\.))*")
_ODD = "\x80-\xbf\u2018-\u2026\u2030\u2039\u203a\u20ac\u2122\u02c6\u02dc\u221a\u2202\u220f\u2211\u222b\u2248\u2260\u2264\u2265\u221e\u2500-\u259f\ufffd"  # what wrong decodings leave within names
_NAME_TOKEN = re.compile(rf"{_U}\.(?!\w)|[^\W\d_{_ODD}][\w’'§¦{_ODD}-]*(?:[|!](?=[^\W\d_])[\w’'§¦{_ODD}-]*)*|[{_ODD}]+[^\W\d_][\w’'§¦{_ODD}-]*")


def addresses(text: str) -> list[tuple[int, int]]:
    """Streets with house number, with postcode and town where they follow."""
    out = []
    for m in STREET.finditer(text):
        end = m.end()
        t = TOWN.match(text, end)
        if t and not _NOT_TOWN.match(text, end):
            end = t.end()
        out.append((m.start(), end))
    return out


def phones(text: str) -> list[tuple[int, int]]:
    """Telephone numbers with prefix: 8 to 15 digits that begin as numbers to dial do."""
    out = []
    for m in PHONE.finditer(text):
        s = m.group()
        n = sum(c.isdigit() or c in "OolISB" for c in s)
        before = text[max(0, m.start() - 12) : m.start()].lower()
        if re.match(rf"{_D}{{1,2}}[./-]{_D}{{1,2}}[./-](?:[2Z][0O])?{_D}{{2}}(?![\w])", s) or re.search(r"(?:account|imo|mmsi|no\.|chart)\s*$", before):
            continue
        if 8 <= n <= 15 and sum(c.isdigit() for c in s) >= 0.6 * n and not re.fullmatch(r"\d+[.,]\d+|\d{2}\.\d{2}\.\d{4}", s):
            out.append((m.start(), m.end()))
    return out


def exact(text: str, kind: str) -> list[tuple[int, int]]:
    """All spans of a text that have the exact form of a kind other than person."""
    if kind == "address":
        return addresses(text)
    if kind == "phone":
        return phones(text)
    return [m.span() for m in (EMAIL if kind == "email" else ID).finditer(text)]


def name_tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Tokens that can belong to a name and overlap [start, end)."""
    lo, hi = max(0, start - 30), min(len(text), end + 30)
    return [(m.start(), m.end()) for m in _NAME_TOKEN.finditer(text, lo, hi) if m.start() < end and m.end() > start]
