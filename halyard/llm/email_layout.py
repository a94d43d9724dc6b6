"""Quoted history and signatures in emails: which lines of a body its sender newly wrote.

A body is read by a recursive layout grammar over its lines into a tree, and only nodes that the sender authored
are serialised:

    body     := (letter | quote | forward)*
    letter   := greeting? (text | quote)* signoff? notice*
    quote    := intro? marked lines, which without their marks are a body one level deeper
    forward  := (separator | header-block | intro) letter (forward | quote)*     (history without marks)
    signoff  := closing name-lines? | "--" lines | "name | title | phone" | device line
    notice   := paragraph of which sentences recur in such a place below the signatures of several senders, or
                which speaks of confidentiality, liability and the like there

A letter without marks or header of its own is given to the sender unless its lines stand in the message it
answers, or another person signed it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.encoding_repair import repair
from halyard.sources.staging import staged

#: Answers to one message that meet its text in one part.
ANSWERS = 256
#: Keys of notices (8 bytes each) that are broadcast at most; more are joined.
BROADCAST = 200_000

# Words that mail programs and people put around messages.
HEADER_WORDS = (
    "from sent to cc bcc subject date importance attachments reply-to von gesendet an betreff datum kopie de envoyé à objet date fra sendt til emne kopi "
    "enviado para asunto fecha enviada enviado assunto data od wysłano do temat od kogo от отправлено кому тема дата копия από στάλθηκε προς θέμα ημερομηνία da inviato oggetto van verzonden aan onderwerp från skickat ämne 发件人 发送时间 收件人 主题"
).split()
FROM_WORDS = set("from von de fra od от από da van från 发件人".split())
CLOSINGS = (
    "best regards|kind regards|warm regards|regards|rgds|brgds|bgds|many thanks|thanks and best regards|thanks and regards|thanks|thank you|yours sincerely|yours faithfully|yours truly|sincerely|cheers|best wishes|best|all the best|"
    "mit freundlichen grüßen|mit freundlichen gruessen|freundliche grüße|viele grüße|beste grüße|liebe grüße|mfg|vg|lg|"
    "cordialement|bien à vous|bien cordialement|salutations distinguées|meilleures salutations|med vennlig hilsen|vennlig hilsen|mvh|hilsen|beste hilsen|med venlig hilsen|"
    "saludos cordiales|un saludo|saludos|atentamente|cordiales saludos|cumprimentos|atenciosamente|com os melhores cumprimentos|abraços|melhores cumprimentos|pozdrawiam|z poważaniem|serdecznie pozdrawiam|"
    "с уважением|с наилучшими пожеланиями|всего доброго|με εκτίμηση|με φιλικούς χαιρετισμούς|cordiali saluti|met vriendelijke groet|med vänliga hälsningar|此致|敬具|よろしくお願いします|br|b rgds|b/rgds|kr"
)
DEVICE = (
    r"sent from my \w+|sent from (?:outlook|mail|yahoo)\b.*|get (?:the mail app|outlook) for .*|von unterwegs gesendet|(?:von meinem|gesendet von).*(?:gesendet|handy|telefon|iphone)?|sendt fra (?:mobilen|min \w+)|"
    r"envoyé de mon \w+|enviado desde mi \w+|enviado do meu \w+|wysłano z \w+.*|отправлено с .*|στάλθηκε από το .*|skickat från min \w+|verzonden vanaf .*"
)
# Stems that legal and company notices of any firm use.
NOTICE_STEMS = (
    "confidential|disclaimer|privileged|addressee|intended recipient|unauthori|liability|no responsibility|malware|virus|unsubscribe|personal data|this e-mail|this email|this message|this mail|this communication|paper copy|the environment|external sender|registered office|general terms|"
    "vertraulich|empfänger bestimmt|weitergabe|sitz der gesellschaft|diese nachricht|diese e-mail|taushet|denne e-posten|ved en feil|confidentiel|destinataire|ce message|ce courriel|pensez à|conditions générales|confidencial|destinatario|este correo|este mensaje|"
    "antes de imprimir|esta mensagem|destinatário|poufn|ta wiadomość|niniejsza wiadomość|конфиденц|это сообщение|это письмо|настоящее сообщение|настоящее письмо|εμπιστευτικ|το παρόν μήνυμα"
)
#: A sentence is taken for one of a notice if it stands so often in a notice's place, and there by so large a share of its places.
NOTICE_PLACES, NOTICE_SHARE = 6, 0.75
TITLES = "claims handler|director|shipbroker|master|agent|port captain|operations manager|senior operator|chartering manager|demurrage analyst|crewing officer|technical superintendent|manager|officer|broker|operator|superintendent|assistant|executive|surveyor|coordinator"

_MARK = re.compile(r"[ \t]{0,3}(?:>|\||:(?=[ >|:]|$)|[^\W\d_a-zß-öø-ÿ]{1,3}>)")
_TABLE = re.compile(r"[ \t]*\|\s*(?:from|date|subject|to|cc|sent|von|an|betreff|datum|de|objet|fra|til|emne|para|asunto|assunto|od|do|temat)\s*\|.*\|\s*$", re.I)
_HEADER = re.compile(rf"\s*\*?({'|'.join(sorted(map(re.escape, HEADER_WORDS), key=len, reverse=True))})\*?\s?:\*?(?:\s|$)", re.I)
_SEPARATOR = re.compile(r"\s*(?:[-=_*~]{2,}\s?[^\W\d_][^\n]{2,40}?\s?[-=_*~]{2,}|_{6,}|-{10,}|={6,}|begin forwarded message:|forwarded message:|anfang der weitergeleiteten nachricht:|début du message réexpédié\s?:|videresendt melding:)\s*$", re.I)
_INTRO_END = re.compile(r"(?:\b(?:wrote|writes|schrieb|skrev|écrit|escribió|escreveu|napisał(?:a|\(a\))?|пишет|написал(?:а|\(а\))?|έγραψε|ha scritto|schreef)\b[^:]{0,80}:|\bskrev [^:]{2,120}:|\bschrieb [^:]{2,120}:|\bwrote on [\d./-]+.{0,20}:)\s*$", re.I)
_INTRO_FULL = re.compile(r"\s*(?:quoting .{2,120}\(.{6,30}\)\s*:|on .{6,120} wrote\s?:|.{2,80} wrote on .{6,40}:|am .{6,120} schrieb .{2,120}:|den .{6,120} skrev .{2,120}:|le .{6,120} a écrit\s?:|el .{6,120} escribió\s?:|em .{6,120} escreveu\s?:|(?:w )?dniu .{6,120} napisał.{0,6}\s?:|.{6,140} (?:пишет|написал(?:а|\(а\))?)\s?:|(?:στις|την) .{6,120} έγραψε\s?:|.{6,160} (?:έγραψε|napisał(?:a|\(a\))?)\s?:)\s*$", re.I)
_INTRO_HEAD = re.compile(r"\s*(?:on|am|den|le|el|em|w dniu|dnia|στις|quoting|\d{1,2}[./]\d)\b.{5,140}$", re.I)
_CLOSING = re.compile(rf"\s*(?:(?:{CLOSINGS})\s*[,.!]?\s*(?://.*|[^\W\d_]{{2,3}})?|(?:br|rgds|brgds)\s*/\s*[^\W\d_]{{2,3}}|/\s?[^\W\d_]{{2,3}})\s*$", re.I)
_PIPE = re.compile(r"\s*[^\W\d_][\w.’' -]{1,40} \| [^|]{2,40} \| [^|]*\d[^|]*$")
_DEVICE = re.compile(rf"\s*(?:{DEVICE})\s*$", re.I)
_STEM = re.compile(NOTICE_STEMS)
_DEVICE_FIRST = frozenset("sgveowоσSGVEOWОΣ")
_PHONE = re.compile(r"(?:\+|\(?0|\b)\d[\d\s()/.-]{6,}\d\s*$")
_LABEL = re.compile(r"\s*(?:tel|t|m|e|p|f|mob|mobile|direct|phone|fax|e-?mail|☎|web|www)\s*[.:]?\s*(?:\+|\(|\d|\S+@)", re.I)
_GREETING = re.compile(
    r"\s*(?:(?:hi|hello|dear|good (?:day|morning|afternoon|evening)|greetings|hei|hallo|god (?:morgen|dag)|kjære|guten (?:tag|morgen)|sehr geehrte[rn]?|liebe[rn]?|bonjour|chers?|chère|hola|buenos días|buenas tardes|estimad[oa]s?|olá|bom dia|prezad[oa]s?|caros?|dzień dobry|szanown[ia]|witam|добрый день|уважаем\w+|здравствуйте|καλημέρα|αγαπητ\w+|ciao|beste|hej)\b[^.?!\d]{0,50}[,:!.]?(?: – hope all is well\.)?|gents\s*,|all\s*,|[A-ZÀ-ÞĄ-Ž][\w-]{1,14},)\s*$",
    re.I,
)
_NAME = re.compile(r"\s*([A-ZÀ-ÞĀ-ŽŁŚȘ][\w’'.-]+(?: [A-ZÀ-ÞĀ-ŽŁŚȘ][\w’'.-]+){0,3})\s*$")
_FOLD = str.maketrans({"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "a", "Æ": "a", "œ": "o", "Œ": "o", "ß": "s", "đ": "d", "ı": "i", "å": "a"})


def fold(s: str) -> str:
    """Lower-case letters a to z only."""
    s = unicodedata.normalize("NFKD", s.translate(_FOLD))
    return re.sub(r"[^a-z]", "", s.lower())


def _signed_by(name: str, sender: str) -> bool | None:
    """Whether a signature's name fits the sender's address; None where neither can be told."""
    if not name or "@" not in sender:
        return None
    words = [fold(w) for w in re.split(r"[\s.]+", name) if fold(w)]
    local = fold(re.sub(r".*<", "", sender).split("@")[0])
    shown = [fold(w) for w in re.split(r"[\s,.\"]+", sender.split("<")[0]) if fold(w)] if "<" in sender else []
    if not words or not local:
        return None
    if len(words) > 1:
        last = words[-1]
        return last in local or last[:6] in local or last in shown
    raw = re.sub(r".*<", "", sender).split("@")[0].lower()
    parts = [fold(x) for x in re.split(r"[._-]", raw) if fold(x)]
    w = words[0]
    if w in parts or w in shown or local.startswith(w):
        return True
    if shown or any(len(p) == 1 for p in parts):
        return w in shown or w[0] in [p for p in parts if len(p) == 1]
    return local.startswith(w[0]) if len(parts) == 1 else False


def _squash(s: str) -> str:
    return " ".join(s.split()).casefold()


def _unmark(line: str) -> str:
    while m := _MARK.match(line):
        line = line[m.end() :]
    return line


def _is_signature_line(s: str) -> bool:
    """A short line such as a name, title, company, street, phone or address of a signature."""
    s = s.strip()
    if not s or len(s) > 75:
        return False
    if _PHONE.search(s) or _LABEL.match(s) or "@" in s or _PIPE.match(s):
        return True
    if s[-1] in ".?!:;" or len(s) > 60:
        return False
    words = s.split()
    return len(words) <= 10 and (s[0].isupper() or s[0].isdigit() or s[0] in "-–(" or len(words) <= 2 or words[0] in ("ul.", "al.", "os."))


def _blocks(numbers: list[int]) -> list[list[int]]:
    """Line numbers in runs without gaps."""
    out: list[list[int]] = []
    for i in numbers:
        if out and i == out[-1][-1] + 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W_]+")


def _keys(lines: list[str]) -> list[tuple[int, int]]:
    """For each sentence of a paragraph two hashes: of its first and of its last four words, numbers apart."""
    out = []
    for s in _SENTENCE.split(" ".join(lines).casefold()):
        words = [w for w in _WORD.findall(s) if not w.isdigit()]
        if len(words) >= 3:
            out.append((_hash("<" + " ".join(words[:4])), _hash(">" + " ".join(words[-4:]))))
    return out


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def sentence_places(body: str | None) -> tuple[list[int], list[int]]:
    """(keys of sentences in a notice's place, keys of the others) of a body: below a sign-off, or above the greeting.

    This first look only tells the places apart roughly; what a notice is, is decided over all bodies.
    """
    below: list[int] = []
    other: list[int] = []
    if not body:
        return below, other
    blocks: list[list[str] | None] = []  # paragraphs without marks; None where marked lines stand between
    block: list[str] = []
    for line in body.split("\n"):
        line = line.rstrip()
        mark = bool(line) and _MARK.match(line) is not None
        if line and not mark:
            block.append(line)
            continue
        if block:
            blocks.append(block)
            block = []
        if mark and (not blocks or blocks[-1] is not None):
            blocks.append(None)
    if block:
        blocks.append(block)
    low = False
    for n, block in enumerate(blocks):
        if block is None:
            low = False
            continue
        first = block[0]
        if _HEADER.match(first) or _SEPARATOR.match(first) or _INTRO_FULL.match(first):
            low = False
            continue
        if _GREETING.match(first):
            low = False
        at = next((k for k, x in enumerate(block) if len(x) < 60 and (_CLOSING.match(x) or _DEVICE.match(x) or _PIPE.match(x) or x.strip() == "--")), len(block))
        if at:
            top = n == 0 and at == len(block) and len(blocks) > 1 and blocks[1] is not None and _GREETING.match(blocks[1][0])
            (below if low or top else other).extend(k for pair in _keys(block[:at]) for k in pair)
        if at < len(block):
            low = True
            rest = at + 1
            while rest < len(block) and _is_signature_line(block[rest]):
                rest += 1
            below.extend(k for pair in _keys(block[rest:]) for k in pair)
    return below, other


class Node:
    """A node of a body's tree: body, letter, quote or forward. Line numbers are those of the whole body."""

    def __init__(self, kind: str, depth: int, lines: list[int] | None = None) -> None:
        self.kind, self.depth = kind, depth
        self.lines = lines or []  # introducing and header lines
        self.children: list[Node] = []
        self.first = 0  # of quotes: the first marked line
        # of letters
        self.origin = ""
        self.quoted = False  # written by somebody else
        self.text: list[int] = []
        self.off: list[int] = []  # closing, signature and notices
        self.name = ""
        self.below = False  # below a letter that was signed off before the marked lines
        self.copied: set[int] = set()
        self.weak = False  # below marked lines within history: the sender's only if signed so

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += reversed(x.children)


def _initials(letter: Node, lines: list[str], sender: str) -> bool:
    """Whether a letter's sign-off bears initials that fit the sender's name or address."""
    for i in letter.off:
        if m := re.match(r"\s*(?:br|rgds|brgds)?\s*/?\s?([^\W\d_]{2})\s*$", lines[i], re.I):
            a, b = (fold(c) for c in m[1])
            words = [fold(w) for w in re.split(r"[\s,._\"<>@-]+", sender.split("@")[0]) if fold(w)]
            first = {w[0] for w in words}
            return bool(a and b) and ((a in first and b in first) or any(w[0] == a and b in w[1:3] for w in words))
    return False


class _Reader:
    """Reads the lines of one body at one depth into a tree; quotes are left for readers one level deeper."""

    def __init__(self, node: Node, numbers: list[int], lines: list[str], notices: Container[int]) -> None:
        self.node, self.numbers, self.lines, self.notices = node, numbers, lines, notices
        self.n = len(lines)
        self.i = 0
        self.phase, self.content = "text", 0  # phase: text, closing (no name yet), off (signature), off-short, device, notice
        self.blank = [not x or x.isspace() for x in lines]
        self.marked = [m is not None and not b for m, b in zip(map(_MARK.match, lines), self.blank)]
        self.table = [x.lstrip()[:1] == "|" and _TABLE.match(x) is not None for x in lines]
        self.intro = [False] * self.n
        self.header_end: dict[int, int] = {}
        self.quotes: list[tuple[Node, list[int]]] = []
        self._introductions()
        self.shown = self._shown()

    # Lines

    def _next(self, i: int) -> int:
        return next((k for k in range(i, self.n) if not self.blank[k]), self.n)

    def _introductions(self) -> None:
        """Introducing lines, separators and header blocks, and where each ends."""
        n, lines, blank, marked, table, intro = self.n, self.lines, self.blank, self.marked, self.table, self.intro

        def take(i: int, j: int) -> int:
            intro[i:j] = [True] * (j - i)
            self.header_end[i] = j
            return j

        i = 0
        while i < n:
            if blank[i] or marked[i] and not table[i]:
                i += 1
                continue
            s = lines[i]
            colon = s.rstrip().endswith(":")
            if table[i]:
                i = take(i, next((j for j in range(i, n) if not table[j]), n))
            elif (colon or s.lstrip()[0] in "-=_*~") and (_SEPARATOR.match(s) or colon and _INTRO_FULL.match(s)):
                i = take(i, i + 1)
            elif i + 1 < n and not blank[i + 1] and not marked[i + 1] and lines[i + 1].rstrip().endswith(":") and _INTRO_HEAD.match(s) and (_INTRO_END.search(lines[i + 1]) and len(lines[i + 1]) < 120 and _INTRO_FULL.match(s.rstrip() + " " + lines[i + 1].strip())):
                i = take(i, i + 2)
            elif colon and _INTRO_HEAD.match(s) and (k := self._next(i + 1)) < n and marked[k] and k <= i + 2:
                i = take(i, i + 1)
            elif ":" in s and _HEADER.match(s):
                j, words = i, []
                while j < n and not blank[j] and (h := _HEADER.match(lines[j])):
                    words.append(h[1].lower())
                    j += 1
                i = take(i, j) if len(words) >= 2 and words[0] in FROM_WORDS else i + 1
            else:
                i += 1

    def _shown(self) -> list[bool]:
        """Marked lines of quotes; a lone one that no introduction precedes is the writer's own (">42 % ...")."""
        n, lines, blank, marked, intro = self.n, self.lines, self.blank, self.marked, self.intro
        shown = [False] * n
        total = sum(marked)
        if not total:
            return shown
        for i in range(n):
            if not marked[i] or intro[i]:
                continue
            near = (i > 0 and (marked[i - 1] or intro[i - 1])) or (i + 1 < n and marked[i + 1])
            before = next((k for k in range(i - 1, -1, -1) if not blank[k]), -1)
            after = next((k for k in range(i + 1, n) if not blank[k]), -1)
            near = near or (before >= 0 and intro[before])
            lone = re.match(r"\s*>\s?\d", lines[i])
            if near or (not lone and (total > 1 or (before >= 0 and marked[before]) or (after >= 0 and marked[after]))):
                shown[i] = True
        # A mail program that wraps long marked lines leaves their rest without a mark.
        for i in range(1, n):
            if shown[i - 1] and not shown[i] and not blank[i] and not intro[i] and not marked[i] and not _CLOSING.match(lines[i]):
                long = marked[i - 1] and len(lines[i - 1]) >= 50 or not marked[i - 1]
                j = i
                while j < n and not blank[j] and not marked[j] and not intro[j]:
                    j += 1
                if marked[i - 1] and i + 1 < n and marked[i + 1]:
                    shown[i] = True
                    continue
                open_end = lines[i - 1].rstrip()[-1:] not in ".?!:,;"
                if long and (lines[i].lstrip()[:1].islower() or open_end or (j < n and marked[j]) or not marked[i - 1]):
                    shown[i] = True
        return shown

    def _notice(self, i: int, first: bool) -> bool:
        """Whether a paragraph begins here that is a notice."""
        if not first or _CLOSING.match(self.lines[i]):
            return False
        j = i
        while j < self.n and not self.blank[j] and not self.shown[j]:
            j += 1
        block = self.lines[i:j]
        if self.notices and (keys := _keys(block)) and 2 * sum(a in self.notices or b in self.notices for a, b in keys) >= len(keys):
            return True
        if self.phase == "text":  # above a letter only
            k = self._next(j)
            if self.content or k >= self.n or not _GREETING.match(self.lines[k]):
                return False
        return _STEM.search(" ".join(block).casefold()) is not None and not _GREETING.match(block[0])

    # The grammar

    def body(self) -> list[tuple[Node, list[int]]]:
        """body := (letter | quote | forward)*; gives the quotes and the places of their lines."""
        where, begin = self.node, {"origin": "top"}
        while begin is not None:
            head = begin.pop("head", None)
            if head is not None:  # within a forward another one is what that message forwarded or answered
                forward = Node("forward", where.depth + 1, [self.numbers[k] for k in head])
                where.children.append(forward)
                where = forward
            elif not begin.get("quoted"):  # the sender, or somebody not known yet, goes on
                where = self.node
            begin = self.letter(where, begin)
        return self.quotes

    def quote(self, letter: Node, head: tuple[int, int] | None = None) -> None:
        """quote := intro? marked lines; the lines run on over blanks."""
        rows, k = [], self.i
        while k < self.n and (self.blank[k] or self.shown[k]):
            if self.shown[k]:
                rows.append(k)
            k += 1
        node = Node("quote", letter.depth + 1, [self.numbers[j] for j in range(*head)] if head else [])
        node.first = self.numbers[rows[0]]
        letter.children.append(node)
        self.quotes.append((node, rows))
        self.i = rows[-1] + 1

    def letter(self, where: Node, begin: dict) -> dict | None:
        """letter := greeting? (text | quote)* signoff? notice*; gives how the next letter begins, None at the end."""
        cur = Node("letter", where.depth)
        for k, v in begin.items():
            setattr(cur, k, v)
        where.children.append(cur)
        self.phase, self.content = "text", 0
        n, lines, blank, shown, table = self.n, self.lines, self.blank, self.shown, self.table
        off, text, number = cur.off, cur.text, self.numbers
        after_quote = lambda origin: {"origin": origin, "quoted": cur.quoted, "weak": cur.quoted, "below": bool(cur.off)}
        while self.i < n:
            i = self.i
            if blank[i]:
                self.i += 1
                continue
            if i in self.header_end:
                end = self.header_end[i]
                nxt = self._next(end)
                if nxt in self.header_end and (table[nxt] or _HEADER.match(lines[nxt]) or _SEPARATOR.match(lines[nxt])):
                    end2 = self.header_end[nxt]
                    k = self._next(end2)
                    self.i = end2
                    return {"origin": "shown" if k < n and shown[k] else "header", "quoted": True, "head": [*range(i, end), *range(nxt, end2)]}
                self.i = end
                if nxt < n and shown[nxt]:  # the quote that follows bears marks; below a header it is what that message quoted
                    block = bool(_HEADER.match(lines[end - 1]) or _SEPARATOR.match(lines[end - 1]) or table[end - 1])
                    if self.phase != "text" or block:
                        cur.lines += [number[k] for k in range(i, end)]
                        return after_quote("header-shown" if block else "after-quote")
                    if cur.origin == "shown":
                        cur.lines += [number[k] for k in range(i, end)]
                        return {"origin": "after-quote"}
                    self.i = nxt
                    self.quote(cur, (i, end))
                    continue
                return {"origin": "header", "quoted": True, "head": list(range(i, end))}
            if shown[i]:
                if self.phase in ("off", "notice", "closing"):
                    return after_quote("after-quote") | ({"quoted": False} if cur.origin == "shown" else {})
                if cur.origin == "shown":
                    return {"origin": "after-quote"}
                self.quote(cur)
                continue
            s = lines[i]
            first = i == 0 or blank[i - 1] or shown[i - 1] or self.intro[i - 1]
            if self._notice(i, first):
                while self.i < n and not blank[self.i] and not shown[self.i] and self.i not in self.header_end and not (len(lines[self.i]) < 30 and _CLOSING.match(lines[self.i])):
                    off.append(number[self.i])
                    self.i += 1
                if self.phase != "text":
                    self.phase = "notice"
                continue
            if s.lstrip()[0] in _DEVICE_FIRST and _DEVICE.match(s):
                off.append(number[i])
                self.phase = "notice" if self.phase != "text" else "device"
                self.i += 1
                continue
            if self.phase == "device":
                self.phase = "off"
            if len(s) < 60 and _CLOSING.match(s):
                if self.phase in ("off", "notice") and text:
                    return {"origin": "after", "quoted": False if cur.quoted or cur.origin == "top" else cur.quoted}
                off.append(number[i])
                self.phase = "off-short" if re.match(r"\s*(?:/\s?\w{2,3}|br\s*/|rgds \w{2}\s*$|.*//)", s, re.I) else "closing"
                self.i += 1
                continue
            pipe = " | " in s and _PIPE.match(s)
            if pipe or s.strip() == "--":
                if pipe and not cur.name:
                    cur.name = s.split("|")[0].strip()
                off.append(number[i])
                self.phase = "off" if pipe else "closing"
                self.i += 1
                continue
            if self.phase == "closing":
                if _is_signature_line(s):
                    if not cur.name and (m := _NAME.match(s)):
                        cur.name = m[1]
                    off.append(number[i])
                    self.phase = "off"
                    self.i += 1
                    continue
                self.phase = "notice"
            elif self.phase == "off":
                if not first and _is_signature_line(s) or first and (_LABEL.match(s) or _PHONE.search(s) and len(s) < 40 or re.fullmatch(rf"\s*(?:{TITLES}).{{0,45}}", s, re.I)):
                    off.append(number[i])
                    self.i += 1
                    continue
            # Text. After a sign-off it begins another letter.
            greeting = first and _GREETING.match(s) is not None
            if self.phase in ("off", "notice", "closing", "off-short") or (greeting and self.content > 0):
                if self.phase == "off-short" and not first and not greeting and _is_signature_line(s):
                    off.append(number[i])
                    self.i += 1
                    continue
                return {"origin": "greet" if greeting else "after"}
            text.append(number[i])
            self.content += not greeting
            self.i += 1
        return None


def read(lines: list[str], notices: Container[int] = frozenset()) -> Node:
    """The tree of a body. Quotes are bodies one level deeper, or as many levels as all their lines share."""
    root = Node("body", 0)
    todo = [(root, list(range(len(lines))), lines)]
    while todo:
        node, numbers, view = todo.pop()
        for quote, rows in _Reader(node, numbers, view, notices).body():
            level, at = 0, [0] * len(rows)  # where each line goes on without the marks that all bear; rests of wrapped lines bear none
            while True:
                marks = [_MARK.match(view[k], p) for k, p in zip(rows, at)]
                if level and not all(m or not p for m, p in zip(marks, at)) or not any(marks):
                    break
                level, at = level + 1, [m.end() if m else p for m, p in zip(marks, at)]
            inner = Node("body", quote.depth + level - 1)
            quote.children.append(inner)
            todo.append((inner, [numbers[k] for k in rows], [view[k][p:].lstrip(" ") if p else view[k] for k, p in zip(rows, at)]))
    return root


def top_letters(root: Node) -> list[Node]:
    """The letters that stand in a body itself or its forwards, in order; those inside quotes are history."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.kind == "letter":
            out.append(x)
        todo += [c for c in reversed(x.children) if c.kind != "quote"]
    return out


def _settle(root: Node, lines: list[str], sender: str, source: str, kept: str) -> set[int]:
    """Settles which letters the sender wrote; gives further lines of the sender's inside one that somebody else wrote.

    source is the squashed text of the answered message, kept what an earlier cleaner left of this one. History
    that stands in the answered message or that somebody else signed isn't new.
    """
    letters = top_letters(root)
    for x in letters:
        if x.weak and x.text and _GREETING.match(lines[x.text[0]]) and _signed_by(x.name, sender):
            x.quoted = False
    free = [x for x in letters if not x.quoted and (x.text or x.off)]
    if source:
        for x in free:
            own = [i for i in x.text if not _GREETING.match(lines[i])]
            for block in _blocks(own):  # paragraphs of the answered message; a letter that has no other is that message
                parts = [_squash(lines[i]) for i in block]
                text = " ".join(parts)
                if len(text) >= 30 and (text in source or sum(len(t) for t in parts if len(t) >= 20 and t in source) >= 0.7 * len(text)):
                    x.copied.update(block)
            if own and x.copied.issuperset(own):
                x.quoted = True
    left = [x for x in free if not x.quoted]
    if len(left) > 1:
        fits = [_signed_by(x.name, sender) for x in left]
        if any(fits):
            for x, f in zip(left, fits):
                if f is False:
                    x.quoted = True
    if not any(x.text for x in free if not x.quoted):  # all else is history: the last text below it may be the sender's
        last = next((x for x in reversed(letters) if x.weak and x.text), None)
        signed = _signed_by(last.name, sender) if last else False
        if last and last is [x for x in letters if x.text][-1] and signed is not False and (signed or last.below or _GREETING.match(lines[last.text[0]]) or _initials(last, lines, sender)):
            last.quoted = False
    fresh: set[int] = set()
    if not any(x.text for x in letters if not x.quoted):
        fresh = _tail(letters, lines, sender, source, kept)
    top = letters[0]
    if not top.quoted and top.text:  # below a letter and a header there is only history
        later = False
        for x in letters[1:]:
            later = later or x.origin.startswith("header")
            x.quoted = x.quoted or later
        for x in letters[1:] if top.off else []:  # what follows the signature at once, without greeting or sign-off of its own, is a notice
            if x.origin != "after" or x.off or any(c.first < x.text[-1] for c in x.children if x.text):
                break
            x.quoted = True
    return fresh


def _tail(letters: list[Node], lines: list[str], sender: str, source: str, kept: str) -> set[int]:
    """Lines of the sender's that go on from a quoted message which wasn't signed off: those after the last that
    stands in the answered message, or those that an earlier cleaner kept while it dropped the message's header."""
    last = next((x for x in reversed(letters) if x.text), None)
    if last is None or last.origin != "header" or _signed_by(last.name, sender) is False:
        return set()
    text = [i for i in last.text if len(_squash(lines[i])) >= 12]
    known = [i for i in text if source and _squash(lines[i]) in source]
    if known and text[-1] > known[-1]:
        return {i for i in last.text if i > known[-1]}
    if kept and not any(_HEADER.match(x) or _SEPARATOR.match(x) for x in kept.split("\n")):
        squashed = _squash(kept)
        mine = [i for i in text if _squash(lines[i]) in squashed]
        if mine and len(mine) < len(text) and mine[-1] == text[-1] and all(i in mine for i in text if i >= mine[0]):
            return {i for i in last.text if i >= mine[0]}
    return set()


def _restored(body: str | None) -> str:
    """A text as it was before a wrong decoding, with LF line ends and as many lines as before."""
    if not body:
        return ""
    fixed = repair(body)[1]
    if fixed is not body and fixed.count("\n") != body.count("\n"):
        fixed = body
    return "\n".join([x.rstrip("\r") for x in fixed.split("\n")]) if "\r" in fixed else fixed


def _source(parent: str) -> str:
    return _squash(" ".join([_unmark(x) for x in parent.split("\n")])) if parent else ""


def _not_new(body: str, sender: str, source: str, kept: str, notices: Container[int]) -> list[int]:
    """The same as not_new of texts that are restored already."""
    if not body:
        return []
    lines = body.split("\n")
    root = read(lines, notices)
    new = _settle(root, lines, sender, source, kept)
    for x in top_letters(root):  # serialise the sender's nodes
        if not x.quoted:
            new.update(i for i in x.text if i not in x.copied)
    return [i for i, x in enumerate(lines) if i not in new and x and not x.isspace()]


def not_new(body: str | None, sender: str | None = None, parent: str | None = None, cleaned: str | None = None, notices: Container[int] = frozenset()) -> list[int]:
    """Numbers of the lines (pieces between LF, from 0) that the sender didn't newly write; blank lines never count.

    Null and empty bodies give none. Texts that a wrong decoding garbled are read as restored. parent is the
    body of the answered message, cleaned what an earlier cleaner made of this one; either helps where layout
    alone doesn't tell where history without marks ends. notices are the keys of sentences that recur in notices.
    """
    return _not_new(_restored(body), sender or "", _source(_restored(parent)), _restored(cleaned), notices)


def _kept(body: str | None, drop: list[int]) -> str | None:
    if body is None:
        return None
    out = set(drop)
    kept = "\n".join(x.rstrip("\r") for i, x in enumerate(body.split("\n")) if i not in out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^\s+$", "", kept)).strip()


def newly_written(body: str | None, sender: str | None = None, parent: str | None = None, cleaned: str | None = None) -> str | None:
    """The body's newly written lines; runs of blank lines become one. Null stays null."""
    return _kept(body, not_new(body, sender, parent, cleaned))


_PLACES = "email_id string, sender bigint, below array<bigint>, other array<bigint>"


def _place_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [sentence_places(t) for t in b["body_text"]]
        who = [_hash((s or "").casefold()) for s in b["from_addr"]]
        yield pd.DataFrame({"email_id": b["email_id"], "sender": who, "below": [x for x, _ in found], "other": [x for _, x in found]})


def with_notices(one: DataFrame, emails: DataFrame) -> DataFrame:
    """Adds `notices` to the messages (each once, in emails perhaps repeated): keys of their sentences that recur as notices over the corpus.

    A key counts as a notice's if it stands in such a place at least NOTICE_PLACES times, in messages of more than
    one sender, and hardly anywhere else. Only hashes are shuffled; they are counted with partial sums, and a
    message gets back no more than its own.
    """
    bodies = emails.select("email_id", "from_addr", "body_text").where("body_text is not null")
    places = staged(bodies.mapInPandas(_place_batches, _PLACES).dropDuplicates(["email_id"]), "sentences")
    rows = places.select(F.explode("below").alias("k"), "sender", F.lit(1).alias("low")).unionByName(places.select(F.explode("other").alias("k"), F.lit(None).cast("bigint").alias("sender"), F.lit(0).alias("low")))
    counts = rows.groupBy("k").agg(F.sum("low").alias("low"), F.count("*").alias("n"), F.min("sender").alias("lo"), F.max("sender").alias("hi"))
    notices = staged(counts.where(f"low >= {NOTICE_PLACES} and lo < hi and low >= {NOTICE_SHARE} * n").select("k"), "notices")
    known = F.broadcast(notices) if notices.count() <= BROADCAST else notices
    every = places.select("email_id", F.explode(F.concat("below", "other")).alias("k"))
    own = every.join(known, "k", "left_semi").groupBy("email_id").agg(F.collect_set("k").alias("notices"))  # of one message each
    return one.join(own, "email_id", "left")


def with_parents(emails: DataFrame) -> DataFrame:
    """(email_id, from_addr, body_text, body_cleaned, parent, notices): every message once, with the text of the one it answers.

    A message that stands in several mailboxes has one text, that of its smallest email_id. Who answers whom is
    found over keys alone; answers to nothing don't take part, so that their null keys don't meet in one task. A
    message with many answers is split over as many parts as it needs.
    """
    one = emails.select("email_id", "from_addr", "body_text", "body_cleaned").dropDuplicates(["email_id"])
    keys = emails.select("email_id", "message_id", "in_reply_to")
    known = keys.where("message_id is not null").groupBy(F.col("message_id").alias("in_reply_to")).agg(F.min("email_id").alias("asked"))
    links = staged(keys.where("in_reply_to is not null").select("email_id", "in_reply_to").join(known, "in_reply_to").select("email_id", "asked").distinct(), "answers")
    parts = links.groupBy("asked").agg(F.ceil(F.count("*") / ANSWERS).alias("parts"))
    many = parts.where("parts > 1")
    texts = emails.select(F.col("email_id").alias("asked"), F.col("body_text").alias("parent")).where("body_text is not null").join(parts, "asked").dropDuplicates(["asked"])
    texts = texts.select("asked", "parent", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    asked = links.join(many, "asked", "left").select("email_id", "asked", F.coalesce(F.pmod(F.xxhash64("email_id"), "parts"), F.lit(0).cast("bigint")).alias("part"))
    answers = asked.join(texts, ["asked", "part"]).select("email_id", "parent").dropDuplicates(["email_id"])
    return with_notices(one, emails).join(answers, "email_id", "left")


def _mark_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, fields, numbers = [], [], []
        for r, found in _found(b):
            for f, lines in zip(("body_text", "body_cleaned"), found):
                ids += [r.email_id] * len(lines)
                fields += [f] * len(lines)
                numbers += lines
        yield pd.DataFrame({"email_id": ids, "field_name": fields, "line_no": pd.Series(numbers, dtype="int32")})


def _found(b: pd.DataFrame) -> Iterator[tuple[object, tuple[list[int], list[int]]]]:
    for r in b.itertuples(index=False):
        text, cleaned, source = _restored(r.body_text), _restored(r.body_cleaned), _source(_restored(r.parent))
        notices = frozenset(r.notices) if r.notices is not None else frozenset()
        sender = r.from_addr or ""
        yield r, (_not_new(text, sender, source, cleaned, notices), _not_new(cleaned, sender, source, "", notices))


def lines_not_new(emails: DataFrame) -> DataFrame:
    """(email_id, field_name, line_no) of every line of body_text and body_cleaned that the sender didn't newly write."""
    return with_parents(emails).mapInPandas(_mark_batches, "email_id string, field_name string, line_no int")


def _reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(r.email_id, _kept(r.body_text, x), _kept(r.body_cleaned, y)) for r, (x, y) in _found(b)]
        yield pd.DataFrame(rows, columns=["email_id", "new_text", "new_cleaned"])


def reduced(emails: DataFrame) -> DataFrame:
    """(email_id, new_text, new_cleaned): both bodies reduced to what the sender newly wrote."""
    return with_parents(emails).mapInPandas(_reduce_batches, "email_id string, new_text string, new_cleaned string")
