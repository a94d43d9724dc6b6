"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

The gates are the piecewise linear forms of the logistic function and the hyperbolic tangent, which keeps
decoding within a fraction of a microsecond a character. Texts are run as one stream cut into overlapping
windows; of every character the label from the window in which it stands farthest from an end is taken.
"""

from __future__ import annotations

import numpy as np

WINDOW, MARGIN, BATCH = 768, 32, 384
#: Characters of a block when the path over all windows is decoded.
BLOCK = 512

# Characters with a row of their own; the others share rows by what kind of character they are.
ALPHABET = "\n\t !\"#&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_`abcdefghijklmnopqrstuvwxyz|~°§¦–—’‘“”„′³²±☎€£" + "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿąćęłńóśźżĄĆĘŁŃŚŹŻčďěňřšťůžČŠŽāēģīķļņūėįųğışŞİșțăœŒ"


def _table() -> np.ndarray:
    import sys

    n = len(dict.fromkeys(ALPHABET))
    t = np.full(sys.maxunicode + 1, n, np.int16)
    for lo, hi, k in ((0x370, 0x400, 1), (0x400, 0x530, 2), (0x2E80, 0xE000, 3), (0x80, 0xC0, 4), (0x2500, 0x25A0, 5), (0x2000, 0x2300, 6)):
        t[lo:hi] = n + k
    for i in range(0x100, 0x250):
        t[i] = n + (7 if chr(i).isupper() else 8)
    for i, c in enumerate(dict.fromkeys(ALPHABET)):
        t[ord(c)] = i
    return t


TABLE = _table()
SIZE = int(TABLE.max()) + 1


def encode(text: str) -> np.ndarray:
    return TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def new(hidden: int, labels: int, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = hidden
    p: dict[str, np.ndarray] = {"trans": np.zeros((labels, labels)), "first": np.zeros(labels), "bias": np.zeros(labels)}
    for d in "fb":
        x = rng.normal(0, 0.3, (SIZE, 4 * h))
        x[:, h : 2 * h] += 0.25
        x[:, : 3 * h] += 0.5
        p["x" + d], p["u" + d], p["w" + d] = x, rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h)), rng.normal(0, 0.5 / np.sqrt(h), (h, labels))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(ids: np.ndarray, x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over ids (T, B); keep holds what the backward pass needs."""
    steps, b = ids.shape
    h4 = u.shape[1]
    n = h4 // 4
    z, zx, t1 = np.empty((b, h4), np.float32), np.empty((b, h4), np.float32), np.empty((b, n), np.float32)
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    out = np.empty((steps, b, n), np.float32)
    tape = []
    for t in range(steps):
        np.take(x, ids[t], axis=0, out=zx, mode="clip")
        np.matmul(h, u, out=z)
        z += zx
        s, g = z[:, : 3 * n], z[:, 3 * n :]
        np.maximum(s, 0, out=s)
        np.minimum(s, 1, out=s)
        np.maximum(g, -1, out=g)
        np.minimum(g, 1, out=g)
        before = c.copy() if keep else None
        np.multiply(c, z[:, n : 2 * n], out=c)
        np.multiply(z[:, :n], g, out=t1)
        np.add(c, t1, out=c)
        np.maximum(c, -1, out=t1)
        np.minimum(t1, 1, out=t1)
        h = out[t]
        np.multiply(t1, z[:, 2 * n : 3 * n], out=h)
        if keep:
            tape.append((z.copy(), before, c.copy(), t1.copy()))
    return out, tape


def _back(ids: np.ndarray, dout: np.ndarray, out: np.ndarray, tape: list, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, b = ids.shape
    n = u.shape[0]
    dx, du = np.zeros_like(x), np.zeros_like(u)
    dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    for t in range(steps - 1, -1, -1):
        z, before, c, tc = tape[t]
        i, f, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        d = dout[t] + dh
        dc = dc + d * o * (np.abs(c) < 1)
        dz = np.concatenate([dc * g, dc * before, d * tc, dc * i], axis=1)
        inside = np.concatenate([(z[:, : 3 * n] > 0) & (z[:, : 3 * n] < 1), np.abs(g) < 1], axis=1)
        dz *= np.where(inside, 1.0, 0.05)  # a little slope outside keeps closed gates teachable
        np.add.at(dx, ids[t], dz)
        if t:
            du += out[t - 1].T @ dz
        dh = dz @ u.T
        dc = dc * f
    return dx, du


def loss_and_gradients(p: dict, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood a character of the gold labels (T, B) and its gradients."""
    steps, b = ids.shape
    of, tf = _run(ids, p["xf"], p["uf"], True)
    ob, tb = _run(ids[::-1], p["xb"], p["ub"], True)
    e = of @ p["wf"] + ob[::-1] @ p["wb"] + p["bias"]
    k = e.shape[2]
    tr = p["trans"]
    alpha = np.empty_like(e)
    alpha[0] = e[0] + p["first"]
    for t in range(1, steps):
        v = alpha[t - 1][:, :, None] + tr[None]
        m = v.max(1)
        alpha[t] = m + np.log(np.exp(v - m[:, None]).sum(1)) + e[t]
    m = alpha[-1].max(1)
    logz = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
    beta = np.zeros_like(e)
    dtr = np.zeros_like(tr)
    for t in range(steps - 2, -1, -1):
        v = tr[None] + (e[t + 1] + beta[t + 1])[:, None, :]
        m = v.max(2)
        beta[t] = m + np.log(np.exp(v - m[:, :, None]).sum(2))
        dtr += np.exp(alpha[t][:, :, None] + v - logz[:, None, None]).sum(0)
    post = np.exp(alpha + beta - logz[None, :, None])
    one = np.eye(k, dtype=np.float32)[gold]
    score = (e * one).sum((0, 2)) + tr[gold[:-1], gold[1:]].sum(0) + p["first"][gold[0]]
    np.add.at(dtr, (gold[:-1], gold[1:]), -1)
    de = ((post - one) / (steps * b)).astype(np.float32)
    g = {"trans": dtr / (steps * b), "first": de[0].sum(0), "bias": de.sum((0, 1))}
    for d, o, tape, i, dd in (("f", of, tf, ids, de), ("b", ob, tb, ids[::-1], de[::-1])):
        g["w" + d] = np.einsum("tbh,tbk->hk", o, dd)
        g["x" + d], g["u" + d] = _back(i, dd @ p["w" + d].T, o, tape, p["x" + d], p["u" + d])
    return float((logz - score).sum() / (steps * b)), g


def train(streams: list[tuple[np.ndarray, np.ndarray]], labels: int, hidden: int = 24, epochs: int = 10, steps: int = 128, batch: int = 128, rate: float = 0.006, seed: int = 1, log=print) -> dict:
    """Adam over random windows of (ids, labels) streams."""
    rng = np.random.default_rng(seed)
    ids, gold = (np.concatenate(x) for x in zip(*streams))
    p = new(hidden, labels, seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    per = len(ids) // (steps * batch)
    n = 0
    for epoch in range(epochs):
        starts = rng.permutation(np.arange(0, len(ids) - 2 * steps, steps) + int(rng.integers(steps)))
        total = 0.0
        for j in range(per):
            at = starts[j * batch : (j + 1) * batch]
            if len(at) < batch:
                break
            w = at[None, :] + np.arange(steps)[:, None]
            loss, g = loss_and_gradients(p, ids[w], gold[w])
            total += loss
            n += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1.0, n / 100) * (1 - 0.9 * n / (per * epochs))
            for k, v in p.items():
                d = g[k] * scale
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                v -= (lr * (m1[k] / (1 - 0.9**n)) / (np.sqrt(m2[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        log(f"epoch {epoch}: {total / max(1, per):.5f}")
    return p


def _states(ids: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The states of _run, faster: the input gate's candidate g is carried as (g + 1) / 2, so that one clip to [0, 1] serves all gates."""
    steps, b = ids.shape
    n = u.shape[0]
    scale = np.concatenate([np.ones(3 * n), np.full(n, 0.5)]).astype(np.float32)
    x, u = x * scale + (1 - scale), u * scale
    z, zx, t1 = np.empty((b, 4 * n), np.float32), np.empty((b, 4 * n), np.float32), np.empty((b, n), np.float32)
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    out = np.empty((steps, b, n), np.float32)
    i, f, o, g = (z[:, k * n : (k + 1) * n] for k in range(4))
    for t in range(steps):
        np.take(x, ids[t], axis=0, out=zx, mode="clip")
        np.matmul(h, u, out=z)
        np.add(z, zx, out=z)
        np.clip(z, 0, 1, out=z)
        np.multiply(c, f, out=c)
        np.multiply(i, g, out=t1)
        np.add(t1, t1, out=t1)
        np.subtract(t1, i, out=t1)
        np.add(c, t1, out=c)
        np.clip(c, -1, 1, out=t1)
        h = out[t]
        np.multiply(t1, o, out=h)
    return out


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """(T, B, labels) of windows (T, B)."""
    e = _states(ids, p["xf"], p["uf"]) @ p["wf"]
    e += (_states(ids[::-1], p["xb"], p["ub"]) @ p["wb"])[::-1]
    e += p["bias"]
    return e


def viterbi(e: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Best labels (T, B) for emissions (T, B, labels). first holds the scores of the first labels, of all (labels) or of each
    column (labels, B); last, if given, the label with which each column ends."""
    steps, b, k = e.shape
    e = np.ascontiguousarray(e.transpose(0, 2, 1))
    back = np.empty((steps, k, b), np.int8)
    s = e[0] + (first if first.ndim == 2 else first[:, None])
    cand, win = np.empty((k, b), np.float32), np.empty((k, b), bool)
    for t in range(1, steps):
        best = s[0][None, :] + trans[0][:, None]
        arg = back[t]
        arg[:] = 0
        for q in range(1, k):
            np.add(s[q][None, :], trans[q][:, None], out=cand)
            np.greater(cand, best, out=win)
            np.maximum(best, cand, out=best)
            np.copyto(arg, q, where=win)
        s = best + e[t]
    out = np.empty((steps, b), np.int8)
    out[-1] = s.argmax(0) if last is None else last
    cols = np.arange(b)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, out[t], cols]
    return out


def _transfers(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(labels + 1, labels, B): the best score of each block from every label before it (the last row: from nothing) to every label at its end."""
    steps, b, k = e.shape
    e = np.ascontiguousarray(e.transpose(0, 2, 1))
    s = np.concatenate([trans, first[None, :]])[:, :, None] + e[0][None]
    cand = np.empty((k + 1, k, b), np.float32)
    for t in range(1, steps):
        best = s[:, 0, None, :] + trans[0][None, :, None]
        for q in range(1, k):
            np.add(s[:, q, None, :], trans[q][None, :, None], out=cand)
            np.maximum(best, cand, out=best)
        best += e[t][None]
        s = best
    return s


def decode(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of one whole sequence of emissions (n, labels): the same path as viterbi's over all of it.

    Blocks are scored at once for every pair of labels before and at their ends; the best chain of these pairs settles
    where the path stands at each block's end, and then all blocks are decoded at once.
    """
    n, k = e.shape
    m = n // BLOCK
    if m < 2:
        return viterbi(e[:, None, :], trans, first)[:, 0]
    blocks = e[: m * BLOCK].reshape(m, BLOCK, k).transpose(1, 0, 2)
    scores = _transfers(blocks, trans, first).astype(np.float64)
    v, chain = scores[k, :, 0], []
    for j in range(1, m):
        cand = v[:, None] + scores[:k, :, j]
        chain.append(cand.argmax(0))
        v = cand.max(0)
    tail, end = e[m * BLOCK :], None
    if len(tail):
        cand = v[:, None] + trans
        rest = viterbi(tail[:, None, :], trans, (cand.max(0) - v.max()).astype(np.float32))[:, 0]
        end = int(cand.argmax(0)[rest[0]])
    else:
        rest, end = np.empty(0, np.int8), int(v.argmax())
    ends = np.empty(m, np.int64)
    ends[-1] = end
    for j in range(m - 1, 0, -1):
        ends[j - 1] = chain[j - 1][ends[j]]
    begin = np.concatenate([first[:, None], trans[ends[:-1]].T], axis=1).astype(np.float32)
    return np.concatenate([viterbi(blocks, trans, begin, ends).T.reshape(-1), rest])


def tag(p: dict, ids: np.ndarray) -> np.ndarray:
    """Labels of a stream of characters: emissions come from overlapping windows, each character's from the window in which
    it stands furthest from an end; the CRF's path is then one over all of them."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int8)
    stride = WINDOW - 2 * MARGIN
    count = max(1, -(-(n - 2 * MARGIN) // stride))
    if count == 1:
        return decode(emissions(p, ids[:, None])[:, 0], p["trans"], p["first"])
    padded = np.zeros((count - 1) * stride + WINDOW, ids.dtype)
    padded[:n] = ids
    out = np.empty((len(padded), len(p["bias"])), np.float32)
    for a in range(0, count, BATCH):
        at = np.arange(a, min(a + BATCH, count)) * stride
        e = emissions(p, padded[at[None, :] + np.arange(WINDOW)[:, None]])
        if a == 0:
            out[:MARGIN] = e[:MARGIN, 0]
        out[at[0] + MARGIN : at[-1] + MARGIN + stride] = e[MARGIN:-MARGIN].transpose(1, 0, 2).reshape(-1, e.shape[2])  # the windows' middles lie side by side
    out[len(padded) - MARGIN :] = e[-MARGIN:, -1]
    return decode(out[:n], p["trans"], p["first"])


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, label) of the runs of equal labels other than 0."""
    if not len(labels):
        return []
    cut = np.flatnonzero(np.diff(labels)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]])
    keep = labels[starts] != 0
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), labels[starts[keep]].tolist()))
