"""Text functions on columns: cleaning of message bodies, keys and names, tokens, gates.

Regular expressions run inside the JVM; only the parts that walk over lines or tags are small Arrow functions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Header labels by language.
HEADER_LABELS = (
    "From", "To", "Cc", "Bcc", "Sent", "Date", "Subject", "Reply-To",
    "De", "Para", "Enviado", "Fecha", "Asunto",
    "Von", "An", "Gesendet", "Datum", "Betreff",
    "Exp[eé]diteur", "Destinataire", "Envoy[eé]", "Objet",
    "Fra", "Til", "Sendt", "Dato", "Emne",
    "Aan", "Verzonden", "Onderwerp",
    "Da", "Inviato", "Oggetto",
)
# Phrases of which one makes a paragraph a legal notice.
LEGAL_TRIGGERS = (
    r"confidential(?:ity)?",
    r"intended\s+recipient",
    r"attorney[\- ]client(?:\s+privilege[d]?)?",
    r"legally\s+privileged",
    r"think\s+before\s+(?:you\s+)?print",
    r"consider\s+the\s+environment",
    r"save\s+(?:a\s+)?tree[s]?",
    r"scanned\s+for\s+(?:any\s+)?virus(?:es)?",
    r"virus[\- ]free",
    r"free\s+of\s+(?:any\s+known\s+)?virus(?:es)?",
    r"(?:e[\- ]?mail|message)\s+(?:and\s+any\s+attachments\s+)?(?:is|are)\s+confidential",
    r"disclaimer\s*[:\-]",
    r"opinions[^.]{0,80}do\s+not\s+necessarily\s+represent",
    r"GDPR",
    r"personal\s+data\s+protection",
    r"please\s+(?:do\s+not\s+)?(?:print|forward|copy)\s+this\s+(?:e[\- ]?mail|message)",
    r"unauthori[sz]ed\s+(?:use|disclosure|copying|distribution)",
)
# Forms of a line with contact details.
CONTACT_LINES = (
    r"^\s*(?:Tel|Phone|Mobile|Mob|Direct|Cell|Fax|M|T|P|F)\s*[:.]\s*[+\d]",
    r"^\s*\+\d[\d\s().\-]{6,}\s*$",
    r"^\s*\(\d{2,5}\)\s*\d[\d\s\-]{5,}\s*$",
    r"^\s*(?:E[\- ]?mail|Email)\s*[:.]\s*\S+@\S+",
    r"^\s*[\w.\-+]+@[\w.\-]+\.\w{2,}\s*$",
    r"^\s*(?:Master|Chief\s+Officer|Captain|Operator|Operations\s+Manager|Senior\s+Manager|Manager|Charterer|Charter\s+Broker|Shipbroker|Broker|Agent|Director|Managing\s+Director|CEO|CFO|COO|CTO)\s*$",
    r"\bIMO\s*[:#]?\s*\d{6,7}\b",
    r"\bMMSI\s*[:#]?\s*\d{8,9}\b",
    r"^\s*(?:https?://|www\.)\S+\s*$",
    r"^\s*M\s*/\s*V\s+\S",
    r"^\s*MV\s+\S",
)
# Lines from which on a body is quoted.
QUOTE_MARKERS = (
    r"\s*>",
    r"\s*-{3,}\s*(?:Original\s+Message|Forwarded\s+message|Forwarded\s+by|Replied\s+Message)\b",
    r"\s*_{8,}\s*$",
    r"\s*On\b.{1,300}\bwrote\s*:",
    r"\s*Le\b.{1,300}\b(?:a\s+écrit|wrote)\s*:",
)
# File types that hold no text.
NO_TEXT_PREFIXES = ("image/", "video/")
NO_TEXT_TYPES = (
    "application/zip", "application/x-zip-compressed", "application/x-zip", "application/x-rar-compressed", "application/vnd.rar", "application/x-rar",
    "application/x-7z-compressed", "application/x-tar", "application/gzip", "application/x-gzip", "application/x-bzip2",
)
NO_TEXT_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".xz", ".lz", ".lzma")
SUBJECT_PREFIX = r"^(\s*(re|fw|fwd|sv|vs|tr|aw)\s*:\s*)+"
PLACEHOLDER = r"<!--[^>]*-->|\s+"
HEADER_RE = r"^[ \t]*(?:" + "|".join(HEADER_LABELS) + r")[ \t]*:[ \t].*$"
LEGAL_RE = r"\b(" + "|".join(LEGAL_TRIGGERS) + r")\b"
SIZE_TIERS = ((30_000, "small"), (95_000, "medium"), (300_000, "large"))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends and no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_headers(c: Column) -> Column:
    return F.regexp_replace(c, "(?imud)" + HEADER_RE, "")


def without_legal_notices(c: Column) -> Column:
    """Paragraphs that hold no trigger, joined by one blank line."""
    return F.array_join(F.filter(F.split(c, r"\n[ \t]*\n", -1), lambda p: ~p.rlike("(?i)" + LEGAL_RE)), "\n\n")


def tidy_space(c: Column) -> Column:
    """Runs of blanks to one, none at line ends or before punctuation, at most one blank line, no white space of any kind at the ends; empty becomes null."""
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    c = F.regexp_replace(c, r"[ \t]+(\n|\z)", "$1")
    c = F.regexp_replace(c, r" +([,.;:!?])", "$1")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), F.lit(""))


class _Text(HTMLParser):
    BLOCKS = frozenset("p div tr li ul ol h1 h2 h3 h4 h5 h6 blockquote pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.mute = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.out.append("\n")
        self.mute += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BLOCKS:
            self.out.append("\n\n")
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.out.append(data)


def html_text(s: str) -> str:
    """Text of markup (paragraph ends become blank lines), entities resolved, decorative lines emptied."""
    if re.search(r"<[A-Za-z/!][^>]{0,300}>", s):
        p = _Text()
        p.feed(s)
        p.close()
        s = "".join(p.out)
    return re.sub(r"(?m)^[ \t]*[-=*_]{3,}[ \t]*$", "", html.unescape(s))


_MARKER = re.compile("|".join(QUOTE_MARKERS), re.IGNORECASE)
_HEADER = re.compile(r"\s*(From|To|Cc|Bcc|Sent|Date|Subject|Reply-To)\s*:\s*\S", re.IGNORECASE)
_CONTACT = re.compile("|".join(CONTACT_LINES), re.IGNORECASE)
_STRONG = ("from", "sent", "date")


def before_quote(s: str) -> str:
    """The lines above the first quote marker, or above a block of two headers within six lines that follows other text."""
    lines = s.split("\n")
    heads = [_HEADER.match(x) for x in lines]
    shape = "".join("h" if h else "x" if x.strip() else "b" for h, x in zip(heads, lines))
    cut = next((i for i, x in enumerate(lines) if _MARKER.match(x)), len(lines))
    i = shape.find("h")
    while 0 <= i < cut:
        run = re.match("[hb]*", shape[i : i + 6]).group()
        strong = any(h and h[1].lower() in _STRONG for h in heads[i : i + len(run)])
        if run.count("h") >= 2 and strong and re.search("[hx]", shape[:i]):
            cut = i
            break
        i = shape.find("h", i + len(run))
    return s if cut >= len(lines) else "\n".join(lines[:cut]).rstrip()


def without_contacts(s: str) -> str:
    """Drops stretches of contact lines (blank lines don't end them) that hold at least two."""
    lines = s.split("\n")
    shape = "".join("b" if not x.strip() else "c" if _CONTACT.search(x) else "x" for x in lines)
    drop = {i for m in re.finditer("c[bc]*", shape) if m.group().count("c") > 1 for i in range(*m.span())}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop)


def _mapped(f: Callable[[str], str], c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x) if isinstance(x, str) and x else x)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def above_quote(c: Column) -> Column:
    return _mapped(lambda x: before_quote(html_text(x)), c)


def drop_contacts(c: Column) -> Column:
    return _mapped(without_contacts, c)


def clean_body(c: Column) -> Column:
    """A message body without markup, quotes, stray headers, legal notices and signatures. Null and empty stay; all removed gives null."""
    cleaned = tidy_space(drop_contacts(without_legal_notices(without_headers(above_quote(unix_lines(c))))))
    return F.when(c.isNull() | (c == ""), c).otherwise(cleaned)


def normalize_subject(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(F.regexp_replace(c, "(?i)" + SUBJECT_PREFIX, ""), r"\s+", " ")))


def folder_key(c: Column) -> Column:
    """Key of a folder "NAME - vN - ..." : name in capitals, blanks to _, other signs dropped, _N appended."""
    name = F.regexp_replace(F.replace(F.upper(F.trim(F.split_part(c, F.lit(" - "), F.lit(1)))), F.lit(" "), F.lit("_")), "[^A-Z0-9_]", "")
    n = F.regexp_extract(F.trim(F.split_part(c, F.lit(" - "), F.lit(2))), r"(?i)^v(\d+)$", 1)
    return F.when(n != "", F.concat(name, F.lit("_"), n)).otherwise(name)


def name_key(name: Column, number: Column) -> Column:
    """Key of a name and a number: runs of other signs to _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.concat_ws("_", name, number.cast("string"))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def safe_filename(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("attachment")), 1, 180)


def query_text(c: Column) -> Column:
    """Lower-case words of a query, punctuation as blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]+", " ")), r"\s+", " "))


def words(c: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def real_length(c: Column) -> Column:
    """Characters besides placeholders and white space."""
    return F.length(F.regexp_replace(c, PLACEHOLDER, ""))


def has_text(mime: Column, name: Column) -> Column:
    """Whether a file's name and type let it hold text: extension first, then type; unknown types may."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./\\][^/\\]*(\.[^./\\]*)$", 1))
    m = F.lower(mime)
    by_type = F.when(mime.isNull() | (mime == ""), True).otherwise(~(m.startswith(NO_TEXT_PREFIXES[0]) | m.startswith(NO_TEXT_PREFIXES[1]) | m.isin(*NO_TEXT_TYPES)))
    return F.when(ext.isin(*NO_TEXT_EXTENSIONS), False).otherwise(by_type)


def size_tier(chars: Column) -> Column:
    c = F.when(chars <= SIZE_TIERS[0][0], SIZE_TIERS[0][1])
    for most, name in SIZE_TIERS[1:]:
        c = c.when(chars <= most, name)
    return F.when(chars.isNotNull(), c.otherwise("huge"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name, from built-in functions."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def first_json_object(c: Column) -> Column:
    """The JSON object of an answer as text: code fences removed, the first of a list, or what stands between the outer braces; null where none is valid."""
    s = F.regexp_replace(c, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", "")
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.ltrim(x).startswith("{"), x)
    inner = F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(valid(F.trim(s)), valid(F.get_json_object(s, "$[0]")), valid(inner))


def acceptable_question(question: Column, banned: list[str], name: Column, key: Column) -> Column:
    """Whether a question holds none of the banned words and names its group, in any case."""
    free = ~question.rlike(r"(?iU)\b(" + "|".join(banned) + r")\b")
    low = F.lower(question)
    named = F.coalesce(low.contains(F.lower(name)), F.lit(False)) | F.coalesce(low.contains(F.lower(key)), F.lit(False))
    return F.coalesce(free & named, F.lit(False))


def megabytes(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f MB", c / 1_048_576))


def letter_label(n: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 0, 1, ... up to ZZ."""
    one = lambda x: F.char(F.lit(65) + x)
    return F.when(n < 26, one(n)).otherwise(F.concat(one(F.floor(n / 26) - 1), one(n % 26)))


def short_time(c: Column) -> Column:
    """Date and minute, the date alone at midnight."""
    return F.when(F.date_format(c, "HH:mm:ss") == "00:00:00", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))


def under_root(c: Column, old: str, new: str) -> Column:
    """A path with one root replaced by another; other paths stay."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c)


def extraction_mode(chars: Column, threshold: int = 6000, system_chars: int = 2000, answer_tokens: int = 2500, window: int = 32_768) -> Column:
    """`full` where a text of so many characters fits a model's window beside its instructions and answer, else `classify`; also from
    a threshold on (-1: none). Three characters are taken for a token and 400 tokens kept free. Null stays null."""
    over = F.floor((chars + system_chars) / 3) + answer_tokens + 400 > window
    if threshold != -1:
        over = over | (chars >= threshold)
    return F.when(chars.isNotNull(), F.when(over, "classify").otherwise("full"))
