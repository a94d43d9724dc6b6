"""Reading of one timestamp as written: every valid interpretation of a value.

A value has no interpretation when it lacks a time of day, is impossible, or its wall clock
time never occurs in its zone; it has several when day and month can change places, when its
wall clock time occurs twice, or when its zone letters mean several zones.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names (first letters are enough where no other month shares them).
MONTHS = {
    1: "january jan januar janvier janv enero ene janeiro stycznia styczeń января январь gennaio januari",
    2: "february feb februar février fevrier févr febrero fevereiro lutego luty февраля февраль febbraio februari",
    3: "march mar märz maerz mrz mars marzo março marco marca marzec марта март maart",
    4: "april apr avril avr abril abr kwietnia kwiecień апреля апрель aprile",
    5: "may mai mayo maio maj maja мая май maggio mei",
    6: "june jun juni juin junio junho czerwca czerwiec июня июнь giugno",
    7: "july jul juli juillet juil julio julho lipca lipiec июля июль luglio",
    8: "august aug août aout agosto ago sierpnia sierpień августа август augustus",
    9: "september sep sept septembre septiembre setembro set września wrzesień сентября сентябрь settembre",
    10: "october oct oktober okt octobre octubre outubro out października październik октября октябрь ottobre",
    11: "november nov novembre noviembre novembro listopada listopad ноября ноябрь",
    12: "december dec desember des dezember dez décembre decembre déc diciembre dic dezembro grudnia grudzień декабря декабрь dicembre",
}
MONTH_OF = {w: m for m, ws in MONTHS.items() for w in ws.split()}
# Minutes east of UTC that zone letters stand for; several where letters are shared.
LETTERS = {
    "Z": (0,), "UT": (0,), "UTC": (0,), "GMT": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360),
    "CET": (60,), "CEST": (120,), "MEZ": (60,), "MESZ": (120,), "EET": (120,), "EEST": (180,), "MSK": (180,),
    "EST": (-300,), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,), "MST": (-420,), "MDT": (-360,),
    "PST": (-480,), "PDT": (-420,), "IST": (330, 60, 120), "SGT": (480,), "JST": (540,), "KST": (540,),
    "HKT": (480,), "GST": (240,), "AEST": (600,), "AEDT": (660,), "ACST": (570,), "AWST": (480,),
}
HOME_LETTERS = {"Asia/Singapore": {"SGT": 480}, "Asia/Dubai": {"GST": 240}, "Asia/Kolkata": {"IST": 330}}

_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?(?:\s*(?:Uhr|h|klo))?"
_ZONE = r"(?:\s*(?:\[?(?P<zn>[A-Za-z]+(?:/[A-Za-z_+-]+)+)\]?|\[(?P<zb>[A-Z]{1,5})\]|(?:UTC|GMT)?(?P<zo>[+\-−]\d{2}(?::?\d{2})?)|(?P<zl>[A-Z]{1,5}))(?:\s*\([^()]*\))?)?"
_W = r"[^\W\d_]+"
_PATTERNS = [
    ("iso", rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:T|,?\s+){_TIME}{_ZONE}"),
    ("basic", rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,](?P<f>\d{{1,9}}))?(?P<ap>)?{_ZONE}"),
    ("numeric", rf"(?:{_W}\.?,?\s+)?(?P<a>\d{{1,2}})(?P<sep>[./-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}),?\s+(?:{_W}\.?\s+)?{_TIME}{_ZONE}"),
    ("day-month", rf"(?:{_W}\.?,?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|º)?\.?[\s/-]+(?:de\s+)?(?P<mn>{_W})\.?,?[\s/-]+(?:de\s+)?(?P<y>\d{{4}}|\d{{2}}),?\s+(?:{_W}\.?\s+)?{_TIME}{_ZONE}"),
    ("month-day", rf"(?:{_W}\.?,?\s+)?(?P<mn>{_W})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+(?:{_W}\.?\s+)?{_TIME}{_ZONE}"),
    ("ctime", rf"{_W}\.?,?\s+(?P<mn>{_W})\s+(?P<d>\d{{1,2}})\s+{_TIME}(?:\s+(?P<zl>[A-Z]{{1,5}})|\s+(?P<zo>[+-]\d{{4}}))?\s+(?P<y>\d{{4}})(?P<zn>)?(?P<zb>)?"),
]
_COMPILED = [(n, re.compile(p, re.IGNORECASE if n != "basic" else 0)) for n, p in _PATTERNS]
_EPOCH = datetime(1970, 1, 1)
_US = timedelta(microseconds=1)


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _wall(t: datetime, zone: ZoneInfo) -> list[int]:
    """Instants (microseconds) at which the clocks of a zone show t: none, one or two."""
    found = set()
    for fold in (0, 1):
        z = t.replace(tzinfo=zone, fold=fold)
        u = z.astimezone(timezone.utc)
        if u.astimezone(zone).replace(tzinfo=None) == t:
            found.add((u.replace(tzinfo=None) - _EPOCH) // _US)
    return sorted(found)


@lru_cache(4096)
def _letters(letters: str, home: str | None, year: int) -> tuple[int, ...]:
    """Offsets in minutes that zone letters stand for; those of the home zone come first."""
    letters = letters.upper()
    if letters in ("Z", "UT", "UTC", "GMT"):
        return (0,)
    if home and (zone := _zone(home)):
        if letters in HOME_LETTERS.get(home, {}):
            return (HOME_LETTERS[home][letters],)
        for month in (1, 7):
            t = datetime(year, month, 1, tzinfo=zone)
            if t.tzname() == letters:
                return (int(t.utcoffset().total_seconds() // 60),)
    return LETTERS.get(letters, ())


def _number(s: str) -> list[tuple[str, int]] | None:
    """Digits alone: None where they form a date (which the patterns read)."""
    n = len(s)
    if n in (8, 12, 14) and 1900 <= int(s[:4]) < 2100 and 1 <= int(s[4:6]) <= 12 and 1 <= int(s[6:8]) <= 31:
        return None
    if 9 <= n <= 11:
        return [("epoch-s", int(s) * 1_000_000)]
    if 12 <= n <= 14:
        return [("epoch-ms", int(s) * 1_000)]
    if 15 <= n <= 17:
        return [("epoch-us", int(s))]
    return []


def interpretations(value: str | None, home: str | None = None, order: str | None = None) -> list[tuple[str, int]]:
    """All (format, microseconds UTC) that a value can mean.

    home is the IANA zone of the value's source, order its `dmy` or `mdy`; either may be None. Where the
    order is known, days and months in digits have no other reading; else both count. A value without zone
    information has no reading if home is None.
    """
    if value is None or not (s := value.strip()):
        return []
    if s.isdigit() and s.isascii() and (out := _number(s)) is not None:
        return out
    for name, pattern in _COMPILED:
        if m := pattern.fullmatch(s):
            break
    else:
        return []
    g = m.groupdict()
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if g["ap"]:
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + 12 * (g["ap"].lower() == "p")
    micro = int((g["f"] or "").ljust(6, "0")[:6] or 0)
    year = int(g["y"]) + 2000 * (len(g["y"]) == 2)
    if name == "numeric":
        dates = [("dmy", int(g["b"]), int(g["a"])), ("mdy", int(g["a"]), int(g["b"]))]
        name += g["sep"]
    elif g.get("mn"):
        dates = [("", MONTH_OF.get(g["mn"].lower(), 0), int(g["d"]))]
    else:
        dates = [("", int(g["m"]), int(g["d"]))]
    out: dict[tuple[str, int], None] = {}
    for o, month, day in dates:
        if o and order and o != order:
            continue
        try:
            t = datetime(year, month, day, hour, minute, second, micro)
        except ValueError:
            continue
        local = (t - _EPOCH) // _US
        if z := g.get("zo"):
            z = z.replace("−", "-").replace(":", "")
            off = int(z[1:3]) * 60 + int(z[3:] or 0)
            found = [local - (off if z[0] == "+" else -off) * 60_000_000] if off <= 15 * 60 else []
        elif z := g.get("zn"):
            found = _wall(t, zone) if (zone := _zone(z)) else []
        elif z := g.get("zb") or g.get("zl"):
            found = [local - off * 60_000_000 for off in _letters(z, home, year)]
        else:
            found = _wall(t, zone) if home and (zone := _zone(home)) else []
        for us in found:
            out[(name + o, us)] = None
    return list(out)
