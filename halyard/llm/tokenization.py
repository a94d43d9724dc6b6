"""Encoding of a corpus with a public byte-level BPE, as a streaming transducer with bounded lookahead.

A text is fed block by block. The pre-tokeniser's last piece stays open until what follows can't change it. Of
the bytes of a piece only the last token of every prefix is tracked; a token is emitted once the piece has gone
on for the lookahead that suffices for the merge list, or has ended, and what was emitted is forgotten.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pre-tokeniser of byte_bpe_50k, as its description states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points fed at a time, and how many of an open piece are kept as text before its bytes go on by themselves.
BLOCK, OPEN = 1 << 14, 1 << 12
#: Bytes of a piece between looks for tokens that are stable.
STEP = 1 << 6
#: Bytes of a piece after which the state of the transducer is remembered for pieces that begin alike.
HEAD = 4
#: Entries of the caches, and bytes of the pieces (characters of the words) that are cached.
CACHE, CACHED = 1 << 18, 64
_NONE = 1 << 30
DEFAULT_FOLDER = "/opt/tokenizers"

_CLASSES = tuple((c, regex.compile(p)) for c, p in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+"), ("P", r"[^\s\p{L}\p{N}]+")))

#: White space and what follows it; digits stand by themselves between ASCII characters. No piece goes on from one into the next.
_WORDS = re.compile(r"\s*(?:[0-9]++(?![^\x00-\x7f])|[^\s0-9]++(?<![^\x00-\x7f])|\S+)|\s+").findall
#: These are white space for `re`, but not for the pre-tokeniser.
_SEPARATORS = re.compile(r"[\x1c-\x1f]").search


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def sufficient_lookahead(ranks: dict[bytes, int]) -> dict[int, int]:
    """For every token the bytes after its end that can still undo it; what comes later can't.

    The merge of u and v to a token is only undone from the right by an earlier merge of x and y, where x is an
    end of v; whether y is there at that time depends on its own bytes and on what can undo it by merges earlier
    still. Going through the merges by rank, the reach of x is the greatest size of such a y with what lies beyond.
    """
    reach: dict[int, int] = {}
    best: dict[bytes, int] = {}  # reach of an end x by the merges so far
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        far = max((best.get(v[i:], 0) for _, v in splits for i in range(len(v))), default=0)
        for u, v in splits:
            best[u] = max(best.get(u, 0), len(v) + far)
        reach[rank] = far
    return {rank: max(reach[rank], best.get(token, 0)) for token, rank in ranks.items()}  # it may itself be taken by a later merge


class _Made(dict):
    """Ids of strings, made when first asked for; of those asked for last between CACHE and twice as many stay."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], size: Callable[[str], int]) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        if (ids := self.old.get(text)) is None:
            ids = self.make(text)
        if self.size(text) <= CACHED:
            if len(self) >= CACHE:
                self.old = self.copy()
                self.clear()
            self[text] = ids
        return ids


class Bpe:
    """A vocabulary with its merges and sufficient lookahead; caches are bounded."""

    def __init__(self, ranks: dict[bytes, int], lookahead: dict[int, int] | None = None) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.lookahead = lookahead or sufficient_lookahead(ranks)
        self.words = _Made(self._word, len)
        self.cache = _Made(self._piece, lambda p: len(p.encode("utf-8", "surrogatepass")))
        self.fits: dict[tuple[int, int], bool] = {}
        self.ends: dict[int, tuple | None] = {}
        self.begun: dict[bytes, list[int]] = {}
        sizes = defaultdict(set)  # of the tokens that end with these three bytes, or are these one or two
        for t in ranks:
            sizes[t[-3:]].add(len(t))
        self.sizes = {t: tuple(sorted(n | {k for k in (1, 2) if k < len(t) and t[-k:] in ranks}, reverse=True)) for t, n in sizes.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.match = regex.compile(PATTERN).match
        self.texts = self.runs = 0  # texts and distinct pieces that went through the transducer

    def merge(self, raw: bytes, trace: list | None = None) -> list[int]:
        """Ids of a few bytes by the definition: of all adjacent pairs the one of the lowest rank is merged, again and again.

        trace: gets the rank of each merge, the bytes that are now first, or None if they are as before, and the same for the last.
        """
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) < _NONE:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if trace is not None:
                trace.append((low, parts[0] if i == 0 else None, parts[-1] if i == len(parts) - 1 else None))
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return [ranks[p] for p in parts]

    def edges(self, token: int) -> tuple | None:
        """How a token's first and its last bytes grow while it is merged: (highest rank up to the change, bytes then), in turn.

        None if its bytes aren't encoded as that token.
        """
        if token in self.ends:
            return self.ends[token]
        trace: list = []
        if self.merge(self.bytes_of[token], trace) != [token]:
            self.ends[token] = None
            return None
        found = []
        for side in (1, 2):
            steps, high = [], -1
            for step in trace:
                high = max(high, step[0])
                if step[side] is not None:
                    steps.append((high, step[side]))
                    high = -1
            found.append((*steps, (_NONE, b"")))
        v = self.ends[token] = tuple(found)
        return v

    def stands(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        return self.edges(token) is not None

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the tokens a and b, which stand, stay apart when they are merged together.

        Until a merge crosses the border, each side goes its own way: of the next merge of a, the one across the
        border and the next of b the lowest is done, of equal ones the leftmost. Merges that leave the edges as
        they are count as one with the highest rank among them, which alone can let the other side go first.
        """
        get = self.ranks.get
        left, right = self.edges(a)[1], self.edges(b)[0]
        x, y = self.bytes_of[a][-1:], self.bytes_of[b][:1]
        i = j = 0
        while True:
            across, own, other = get(x + y, _NONE), left[i][0], right[j][0]
            if across < own and across <= other:
                return False
            if own <= other:
                if own == _NONE:
                    return True
                x = left[i][1]
                i += 1
            else:
                y = right[j][1]
                j += 1

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece that is there as a whole."""
        ids: list[int] = []
        raw = text.encode("utf-8", "surrogatepass")
        run = Piece(self)
        if (whole := self.ranks.get(raw)) is not None and self.stands(whole):
            ids.append(whole)
        else:
            run.whole(raw, ids)
        return tuple(ids)

    def _word(self, text: str) -> tuple[int, ...]:
        """Ids of a word: no piece goes on beyond it or begins before."""
        if text.isascii() and text[text[0] == " " :].isdigit():  # one piece
            return self._piece(text)
        return tuple(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        stream = Transducer(self)
        for i in range(0, len(text), BLOCK):
            stream.push(text[i : i + BLOCK], out)
        stream.close(out)
        return out


class Piece:
    """Tokens of one piece whose bytes arrive bit by bit.

    The encoding of a prefix ends with the one token that ends there, is itself the encoding of its bytes and
    stays apart from the last token of the encoding before it. So the last token of every prefix gives the
    encodings of all prefixes. A token whose sufficient lookahead has gone by is the same whatever follows: it is
    emitted with all before it, and their bytes are forgotten.
    """

    __slots__ = ("bpe", "raw", "last", "before")

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.raw = b""
        self.last: list[int] = []  # token that ends after byte i + 1
        self.before = -1  # last token emitted
        bpe.runs += 1

    def push(self, raw: bytes, out: list[int]) -> None:
        for i in range(0, len(raw), STEP):
            self._feed(raw[i : i + STEP])
            self._emit(out)

    def whole(self, raw: bytes, out: list[int]) -> None:
        """All bytes of a piece and its end."""
        begun, head = self.bpe.begun, raw[:HEAD]
        if (last := begun.get(head)) is None:
            self._feed(head)
            if len(begun) >= CACHE:
                begun.clear()
            begun[head] = self.last.copy()
        else:
            self.raw, self.last = head, last.copy()
        for i in range(HEAD, len(raw), STEP):
            if i > HEAD:
                self._emit(out)
            self._feed(raw[i : i + STEP])
        self.close(out)

    def _feed(self, raw: bytes) -> None:
        bpe, last, before = self.bpe, self.last, self.before
        get, sizes, fits, ends = bpe.ranks.get, bpe.sizes.get, bpe.fits, bpe.ends
        fit = fits.get
        at = len(self.raw)
        self.raw = raw = self.raw + raw
        for end in range(at + 1, len(raw) + 1):
            tail = raw[end - 3 if end > 3 else 0 : end]
            for n in sizes(tail) or sizes(tail[-2:]) or (1,):
                start = end - n
                if start < 0 or (token := get(raw[start:end])) is None:
                    continue
                if n > 1 and (ends[token] if token in ends else bpe.edges(token)) is None:
                    continue
                left = last[start - 1] if start else before
                if left >= 0:
                    if (ok := fit((left, token))) is None:
                        if len(fits) >= CACHE:
                            fits.clear()
                        ok = fits[left, token] = bpe.adjacent(left, token)
                    if not ok:
                        continue
                last.append(token)
                break

    def _path(self, end: int) -> tuple[list[int], list[int]]:
        """Tokens of the prefix and where they end."""
        ids, ends = [], []
        while end > 0:
            ids.append(self.last[end - 1])
            ends.append(end)
            end -= len(self.bpe.bytes_of[ids[-1]])
        return ids[::-1], ends[::-1]

    def _emit(self, out: list[int]) -> None:
        """Emits up to the last token that the bytes after it can't undo; the encoding before it then stands, too."""
        n, far = len(self.last), self.bpe.lookahead
        ids, ends = self._path(n)
        k = next((k for k in range(len(ids), 0, -1) if n - ends[k - 1] >= far[ids[k - 1]]), 0)
        if k:
            out.extend(ids[:k])
            self.before = ids[k - 1]
            self.raw, self.last = self.raw[ends[k - 1] :], self.last[ends[k - 1] :]

    def close(self, out: list[int]) -> None:
        out.extend(self._path(len(self.last))[0])
        self.raw, self.last, self.before = b"", [], -1


class Transducer:
    """Pre-tokeniser and merges over blocks of a text: memory doesn't grow with the text."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.buffer = ""
        self.run: Piece | None = None
        self.kind = None
        bpe.texts += 1

    def push(self, block: str, out: list[int]) -> None:
        self.buffer += block
        if self.run is not None and not self._run_on(out):
            return
        # White space that follows something else: what goes on can't change the pieces before it.
        text = self.buffer
        at = max(text.rfind(" "), text.rfind("\n"))
        while at > 0 and text[at - 1].isspace():
            at -= 1
        if at > 0:
            self._encode(text[:at], out)
            self.buffer = text[at:]
        if len(self.buffer) > OPEN:
            self._open(out)

    def _encode(self, text: str, out: list[int]) -> None:
        """Text that begins and ends with a piece. Words are looked up as a whole: no piece goes from other characters over to white space."""
        if _SEPARATORS(text):
            out.extend(chain.from_iterable(map(self.bpe.cache.__getitem__, self.bpe.pieces(text))))
        else:
            out.extend(chain.from_iterable(map(self.bpe.words.__getitem__, _WORDS(text))))

    def _open(self, out: list[int]) -> None:
        """A buffer without such a place: pieces that end well before its end are closed, the bytes of the open one go on by themselves."""
        text, at = self.buffer, 0
        while at < len(text) - 8:
            end = self.bpe.match(text, at).end()
            if end >= len(text) - 8:
                break
            out.extend(self.bpe.cache[text[at:end]])
            at = end
        self.buffer = text[at:]
        if len(self.buffer) > OPEN // 2:
            head = self.buffer[0] == " " and not self.buffer[1].isspace()
            self.run = Piece(self.bpe)
            self.kind = next(p for _, p in _CLASSES if p.match(self.buffer[head]))
            if head:
                self.run.push(b" ", out)
                self.buffer = self.buffer[1:]
            self._run_on(out)

    def _run_on(self, out: list[int]) -> bool:
        """Feeds what belongs to the open piece; True once it ended."""
        m = self.kind.match(self.buffer)
        end = m.end() if m else 0
        space = self.kind is _CLASSES[2][1]
        if end == len(self.buffer):  # the last character stays: it is where a run of white space may break
            keep = 1 if space else 0
            self.run.push(self.buffer[: end - keep].encode("utf-8", "surrogatepass"), out)
            self.buffer = self.buffer[end - keep :]
            return False
        keep = 1 if space and end > 0 else 0
        self.run.push(self.buffer[: end - keep].encode("utf-8", "surrogatepass"), out)
        self.run.close(out)
        self.buffer, self.run = self.buffer[end - keep :], None
        return True

    def close(self, out: list[int]) -> None:
        if self.run is not None:
            m = self.kind.match(self.buffer)
            if m and m.end() == len(self.buffer):
                self.run.push(self.buffer.encode("utf-8", "surrogatepass"), out)
                self.buffer = ""
            self.run.close(out)
            self.run = None
        self._encode(self.buffer, out)
        self.buffer = ""


class Decoder:
    """Ids to text, token by token: bytes of a character that isn't complete yet are held back."""

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("surrogatepass")

    def push(self, ids: Iterable[int]) -> str:
        return "".join([self.state.decode(self.bytes_of[i]) for i in ids])

    def close(self) -> str:
        return self.state.decode(b"", True)


def vocabulary(folder: str | None = None, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    return load_ranks(os.path.join(folder or os.environ.get("TOKENIZERS_DIR", DEFAULT_FOLDER), f"{name}.tiktoken"))


class _Shared:
    """What is broadcast; the tasks of one worker share its tables and bounded caches."""

    def __init__(self, ranks: dict[bytes, int], lookahead: dict[int, int]) -> None:
        self.ranks, self.lookahead, self.made = ranks, lookahead, None

    def bpe(self) -> Bpe:
        if self.made is None:
            self.made = Bpe(self.ranks, self.lookahead)
        return self.made


def _encoded(docs: DataFrame, key: str, text: str, folder: str | None, column: Callable[[Bpe, pa.Array], pa.Array], field: str) -> DataFrame:
    """(key, what column makes of the texts of a batch)."""
    spark: SparkSession = docs.sparkSession
    words = vocabulary(folder)
    shared = spark.sparkContext.broadcast(_Shared(words, sufficient_lookahead(words)))
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value.bpe()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), column(bpe, b.column(1))], [key, name])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, {field}")


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every text without special tokens; null and empty texts have an empty list.

    Every row gives a row, repeated ones too; other columns are ignored. What is broadcast is the public
    vocabulary (50,256 tokens, under 2 MB).
    """

    def run(bpe: Bpe, column: pa.Array) -> pa.Array:
        flat, offsets = array("i"), array("i", [0])
        for cell in column:
            if t := cell.as_py():
                flat.extend(bpe.encode(t))
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return _encoded(docs, key, text, folder, run, "ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts. The ids are counted where they are made."""

    def run(bpe: Bpe, column: pa.Array) -> pa.Array:
        return pa.array([len(bpe.encode(t)) if (t := cell.as_py()) else 0 for cell in column], pa.int32())

    return _encoded(docs, key, text, folder, run, "n_tokens int")


def decode_ids(encoded: DataFrame, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; a null list gives null, an empty one an empty text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in ranks.value.items()}
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                d = Decoder(bytes_of)
                out.append(None if ids is None else d.push(ids) + d.close())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
