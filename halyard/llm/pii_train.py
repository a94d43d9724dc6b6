"""Training of the tagger of personal information: python -m halyard.llm.pii_train TABLES_FOLDER.

The labelled rows are a bounded sample (MAX_EMAILS bodies, MAX_FILES files and as many sender fields). Spans
with an exact form are labelled by it; names by the address book and the senders' names. Texts are varied as
scanners and wrong decodings vary them, with their labels, so that the tagger knows such forms too.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

import numpy as np

from halyard.llm import pii_model as M
from halyard.llm import pii_patterns as P
from halyard.llm.encoding_repair import repair
from halyard.llm.page_noise import CONFUSIONS

MAX_EMAILS, MAX_FILES = 7000, 1800
_NAMED = re.compile(r"(?:\bb\w{2,3}k|\b[CE][DO0]C|\bn[o0]\.?)[\s:.(|>]*$", re.I)
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
_TOKEN = re.compile(r"(?<![\w′″°'’])[A-ZÀ-ÞĀ-ŽȘȚ](?:\.(?!\w)|[\w’'-]+)")


def names_of(display: list[str]) -> tuple[set[str], set[str]]:
    """(given names, surnames), folded, of names written as "Given Surname" or "Surname, Given"."""
    given, sur = set(), set()
    for d in display:
        d = d.strip().strip('"')
        if "," in d:
            b, a = (x.strip() for x in d.split(",", 1))
        else:
            a, _, b = d.rpartition(" ")
        if a and b and len(a.split()) == 1 and len(b.split()) == 1:
            given.add(a.casefold())
            sur.add(b.casefold())
    return given, sur


def label(text: str, given: set[str], sur: set[str]) -> np.ndarray:
    y = np.zeros(len(text), np.int8)
    for kind in ("email", "id_number", "phone", "address"):
        k = P.KINDS.index(kind) + 1
        for i, j in P.exact(text, kind):
            if kind == "id_number" and text[i:j].count("-") == 1 and not _NAMED.search(text, max(0, i - 40), i):
                continue  # a seaman's book's or CDC's number looks like a reference: its label tells
            if not y[i:j].any():
                y[i:j] = k
    kind_of = lambda t: "i" if t.endswith(".") else "g" if t.casefold() in given else "s" if t.casefold() in sur else ""
    tokens = [(m.start(), m.end(), kind_of(m.group())) for m in _TOKEN.finditer(text)]
    k = 0
    while k < len(tokens):
        i, j, c = tokens[k]
        if not c or y[i:j].any():
            k += 1
            continue
        run = [tokens[k]]
        while k + len(run) < len(tokens):
            a, b, d = tokens[k + len(run)]
            gap = text[run[-1][1] : a]
            if d and not y[a:b].any() and (gap in (" ", "\n") and not (run[-1][2] == d == "g" and gap == "\n") and len(run) < 3 or gap in (", ", ",\n") and run[-1][2] == "s" and d in "gi" and len(run) == 1):
                run.append(tokens[k + len(run)])
            else:
                break
        if any(r[2] != "i" for r in run) and not P.SHIP.search(text, max(0, run[0][0] - 12), run[0][0]):
            y[run[0][0] : run[-1][1]] = 5
        k += len(run)
    return y


def scanned(text: str, y: np.ndarray, rng: np.random.Generator, rate: float) -> tuple[str, np.ndarray]:
    out, lab, i = [], [], 0
    while i < len(text):
        if rng.random() < rate:
            for a, b in (CONFUSIONS[k] for k in rng.permutation(len(CONFUSIONS))[:12]):
                if text.startswith(a, i):
                    out.append(b)
                    lab += [int(y[i])] * len(b)
                    i += len(a)
                    break
            else:
                out.append(text[i])
                lab.append(int(y[i]))
                i += 1
            continue
        out.append(text[i])
        lab.append(int(y[i]))
        i += 1
    return "".join(out), np.array(lab, np.int8)


def garbled(text: str, y: np.ndarray, encoding: str, times: int = 1) -> tuple[str, np.ndarray]:
    out, lab = [], []
    for c, k in zip(text, y):
        s = c
        for _ in range(times):
            s = s.encode("utf-8").decode(encoding, "replace") if not s.isascii() else s
        out.append(s)
        lab += [int(k)] * len(s)
    return "".join(out), np.array(lab, np.int8)


def streams(folder: str, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    import pyarrow.parquet as pq

    rng = np.random.default_rng(seed)
    col = lambda t, c: [x for x in pq.read_table(f"{folder}/{t}.parquet", columns=[c])[c].to_pylist() if x]
    bodies, senders, files = col("emails", "body_cleaned"), col("emails", "from_addr"), col("docling", "markdown")
    bodies = [bodies[i] for i in rng.permutation(len(bodies))[:MAX_EMAILS]]
    files = [files[i] for i in rng.permutation(len(files))[:MAX_FILES]]
    shown = [s.split("<")[0].strip() for s in senders if "<" in s]
    given, sur = names_of(col("contacts", "display_name") + [s for s in shown if not re.search(r" [a-z]+$", s)])
    out = []
    for t in bodies + files + [senders[i] for i in rng.permutation(len(senders))[:MAX_EMAILS]]:
        bad, fixed = repair(t)
        t = fixed if bad else t
        y = label(t, given, sur)
        r = rng.random()
        if bad or r < 0.04:
            t, y = garbled(t, y, ("cp1252" if rng.random() < 0.3 else "latin-1", "latin-1", "mac_roman", "cp850")[int(rng.integers(4))], 1 + int(rng.random() < 0.2))
        elif r < 0.2:
            t, y = scanned(t, y, rng, 0.03)
        out.append((M.encode(t + "\n\n"), np.concatenate([y, np.zeros(2, np.int8)])))
    return out


def main(folder: str, hidden: int = 24, epochs: int = 12) -> None:
    data = streams(folder)
    print(sum(len(a) for a, _ in data), "characters", flush=True)
    p = M.train(data, 1 + len(P.KINDS), hidden, epochs, log=lambda s: print(s, flush=True))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:]))
