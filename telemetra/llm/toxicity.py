"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector, the mean of hashed character-trigram vectors, and one number: how much more
often it occurs in toxic than in other training documents. A run of over 40 letters and digits, as in text without
separators, counts as words of 40 and a rest, so every one of them is read. A text is read in overlapping windows of WIDTH words;
each window gets a logit from the attention-pooled states of both directions, and a document's logit is its
highest one. Training passes the gradient through that window. A logistic curve on the logit and the number of
windows, fitted on training rows, makes it a probability; word counts used on one half of the training rows come
from the other half, so neither network nor curve sees a row through its own label.

Defined results: null, empty and blank texts get the share of toxic training rows; every window of a long text is
scored; repeated rows get equal scores; other columns are ignored; without enough labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, parts

#: A stride of half the width: any 20 words in a row lie together in some window.
WIDTH, STRIDE, HIDDEN, DIM = 40, 20, 8, 8
WORD_ROWS, TRIGRAM_ROWS = 1 << 13, 1 << 11
#: Words whose inputs a worker keeps; on reaching it the store is emptied.
KEPT_WORDS = 150_000
#: Windows that are scored at a time.
AT_ONCE = 2048
_WORD = re.compile(r"[^\W_]{1,40}")


@dataclass
class Model:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    odds: dict[str, float] = field(default_factory=dict)
    curve: list[float] = field(default_factory=list)
    prior: float = 0.5


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def _places(words: list[str]) -> Places:
    """Row of each word, rows of the trigrams of all words one after another, and where each word's begin."""
    rows, starts, tri = np.empty(len(words), np.int64), np.empty(len(words), np.int64), []
    crc = zlib.crc32
    for k, word in enumerate(words):
        raw = f"<{word}>".encode("utf-8", "replace")
        rows[k], starts[k] = crc(raw) % WORD_ROWS, len(tri)
        tri += [crc(raw[i : i + 3]) for i in range(len(raw) - 2)]
    return rows, np.array(tri, np.int64) % TRIGRAM_ROWS, starts


def _of(places: Places, which: np.ndarray) -> Places:
    """The places of some of the words."""
    rows, tri, starts = places
    n = np.diff(starts, append=len(tri))[which]
    at = np.cumsum(n) - n
    return rows[which], tri[np.arange(n.sum()) + np.repeat(starts[which] - at, n)], at


def vectors(places: Places, odds: np.ndarray, w: dict) -> np.ndarray:
    """A row of inputs for each word."""
    rows, tri, starts = places
    n = np.diff(starts, append=len(tri))
    means = np.add.reduceat(w["tri"][tri], starts, axis=0) / n[:, None]
    return np.concatenate([w["word"][rows], means, odds[:, None]], axis=1).astype(np.float32)


def _windows(n: int) -> list[int]:
    return [0] if n <= WIDTH else [*range(0, n - WIDTH, STRIDE), n - WIDTH]


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
    w = {"word": make(WORD_ROWS, DIM, scale=0.05), "tri": make(TRIGRAM_ROWS, DIM, scale=0.05)}
    for side in "fb":
        w |= {f"W{side}": make(2 * DIM + 1, 3 * HIDDEN), f"b{side}": make(3 * HIDDEN, scale=0.01), f"U{side}": make(HIDDEN, 3 * HIDDEN)}
    return w | {"A": make(2 * HIDDEN, HIDDEN), "v": make(HIDDEN), "o": make(2 * HIDDEN), "c": make(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gru(g: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
    """States (T, B, H) from input sums `g` (T, B, 3H); masked places pass the state on."""
    h = np.zeros((g.shape[1], HIDDEN), np.float32)
    states, kept = np.empty((*g.shape[:2], HIDDEN), np.float32), []
    for t in range(len(g)):
        s = h @ u
        zr = _sigmoid(g[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[t, :, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            kept.append((h, z, r, n, s))
        h = states[t] = new
    return states, kept


def _pool(states: np.ndarray, w: dict, mask: np.ndarray):
    e = np.tanh(states @ w["A"])
    a = e @ w["v"]
    if mask is not None:
        a = np.where(mask, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * states).sum(axis=0)
    return e, a, pooled, pooled @ w["o"] + w["c"][0]


def logits(gf: np.ndarray, gb: np.ndarray, w: dict, mask: np.ndarray | None) -> np.ndarray:
    """One logit for each window from its input sums in both directions."""
    f, _ = _gru(gf, w["Uf"], mask, False)
    b, _ = _gru(gb[::-1], w["Ub"], None if mask is None else mask[::-1], False)
    return _pool(np.concatenate([f, b[::-1]], axis=2), w, mask)[3]


def _backward(x: np.ndarray, mask: np.ndarray, y: np.ndarray, w: dict) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss over windows, with `x` (T, B, 2 DIM + 1) for the inputs."""
    f, kf = _gru(x @ w["Wf"] + w["bf"], w["Uf"], mask, True)
    b, kb = _gru((x @ w["Wb"] + w["bb"])[::-1], w["Ub"], mask[::-1], True)
    states = np.concatenate([f, b[::-1]], axis=2)
    e, a, pooled, out = _pool(states, w, mask)
    d = (_sigmoid(out) - y) / len(y)
    grads = {"o": pooled.T @ d, "c": np.array([d.sum()])}
    dp = d[:, None] * w["o"]
    da = (states * dp).sum(axis=2)
    da = a * (da - (a * da).sum(axis=0))
    grads["v"] = np.einsum("tb,tbh->h", da, e)
    de = da[:, :, None] * w["v"] * (1 - e * e)
    grads["A"] = np.einsum("tbi,tbj->ij", states, de)
    ds = a[:, :, None] * dp + de @ w["A"].T
    dx = np.zeros_like(x)
    for side, kept, dstates, m in (("f", kf, ds[:, :, :HIDDEN], mask), ("b", kb, ds[::-1, :, HIDDEN:], mask[::-1])):
        u, dg = w[f"U{side}"], np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
        du, dh = np.zeros_like(u), np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, s = kept[t]
            dh = dh + dstates[t]
            on = m[t][:, None]
            dn = dh * (1 - z) * (1 - n * n) * on
            dz = dh * (h - n) * z * (1 - z) * on
            dr = dn * s[:, 2 * HIDDEN :] * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], axis=1)
            dsum = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dsum
            dh = np.where(on, dh * z, dh) + dsum @ u.T
        dg = dg if side == "f" else dg[::-1]
        grads |= {f"U{side}": du, f"W{side}": np.einsum("tbi,tbj->ij", x, dg), f"b{side}": dg.sum(axis=(0, 1))}
        dx += dg @ w[f"W{side}"].T
    grads["x"] = dx
    return grads


def _odds(docs: list[tuple[int, list[str]]]) -> dict[str, float]:
    n = Counter(y for y, _ in docs)
    seen = {0: Counter(), 1: Counter()}
    for y, words in docs:
        seen[y].update(set(words))
    out = {}
    for word, k in seen[1].items():
        if k >= 2:
            ratio = np.log((k + 0.5) / (n[1] + 1)) - np.log((seen[0][word] + 0.5) / (n[0] + 1))
            if ratio > 0.5:
                out[word] = float(min(ratio, 4.0))
    return out


class _Inputs:
    """Rows of input sums, both directions together, for each word."""

    def __init__(self, model: Model):
        self.m, self.place = model, {}
        w = model.weights
        self.w = np.concatenate([w["Wf"], w["Wb"]], axis=1)
        self.bias = np.concatenate([w["bf"], w["bb"]])
        self.rows = np.empty((KEPT_WORDS + 1, 6 * HIDDEN), np.float32)
        self.rows[0] = self.bias

    def ids(self, words: list[str]) -> np.ndarray | None:
        place = self.place
        try:
            return np.array([place[x] for x in words])
        except KeyError:
            new = [x for x in {*words} if x not in place]
            first = len(place) + 1
            if first + len(new) > KEPT_WORDS + 1:
                return None
            place.update(zip(new, range(first, first + len(new))))
            odds = np.array([self.m.odds.get(x, 0.0) for x in new], np.float32)
            self.rows[first : first + len(new)] = vectors(_places(new), odds, self.m.weights) @ self.w + self.bias
            return np.array([place[x] for x in words])


def _best(texts: list[list[str]], model: Model, inputs: _Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (of one word or more): highest logit, its window's start, number of windows."""
    top, where, count = np.full(len(texts), -np.inf), np.zeros(len(texts), int), np.zeros(len(texts), int)
    rows, owner, starts, padded = [], [], [], False

    def flush() -> None:
        nonlocal rows, owner, starts
        if rows:
            ids = np.stack(rows, axis=1)
            g = inputs.rows[ids]
            mask = ids > 0
            out = logits(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], model.weights, None if mask.all() else mask)
            for o, s, z in zip(owner, starts, out):
                if z > top[o]:
                    top[o], where[o] = z, s
        rows, owner, starts = [], [], []

    for k, words in enumerate(texts):
        for at in range(0, len(words), 50_000):  # windows overlap across these bounds, too
            part = words[at : at + 50_000 + WIDTH - STRIDE]
            if at and len(part) <= WIDTH - STRIDE:
                break
            ids = inputs.ids(part)
            if ids is None:
                flush()
                inputs.place.clear()
                ids = inputs.ids(part)
            for s in _windows(len(ids)):
                row = ids[s : s + WIDTH]
                rows.append(row if len(row) == WIDTH else np.pad(row, (0, WIDTH - len(row))))
                owner.append(k)
                starts.append(at + s)
                count[k] += 1
                if len(rows) >= AT_ONCE:
                    flush()
    flush()
    return top, where, count


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, total_chars: int = 16_000_000, steps: int = 300, seed: int = 7) -> Model:
    """Fit on at most `per_class` labelled rows of each class outside the hold-out fold, of any length, see labelled_sample."""
    rows = [(zlib.crc32(f"half {d}".encode()) & 1, y, _words(t)) for d, y, t in labelled_sample(docs, labels, "toxic", per_class, total_chars)]
    rows = [r for r in rows if r[2]]
    y = np.array([r[1] for r in rows], np.float32)
    if min((y == 1).sum(), (y == 0).sum()) < 8:
        return Model()
    other = [_odds([(r[1], r[2]) for r in rows if r[0] != half]) for half in (0, 1)]
    w = _start(seed)
    texts = [r[2] for r in rows]
    rng = np.random.default_rng(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    halves = np.array([r[0] for r in rows])
    vocabulary = {x: k for k, x in enumerate(sorted({x for t in texts for x in t}))}
    coded = [np.array([vocabulary[x] for x in t]) for t in texts]
    places = _places([*vocabulary])
    told = [np.array([o.get(x, 0.0) for x in vocabulary], np.float32) for o in other]

    def tops(of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top, where, count = np.zeros(len(of)), np.zeros(len(of), int), np.zeros(len(of), int)
        for half in (0, 1):
            mine = [k for k, i in enumerate(of) if halves[i] == half]
            if mine:
                m = Model(w, other[half])
                top[mine], where[mine], count[mine] = _best([texts[of[k]] for k in mine], m, _Inputs(m))
        return top, where, count

    # at first the window with the most telling words stands for a text, later the one that the network ranks first
    chosen = [max(_windows(len(t)), key=lambda s: sum(other[h].get(x, 0) for x in t[s : s + WIDTH])) for t, h in zip(texts, halves)]
    for step in range(1, steps + 1):
        of = [*rng.choice(kinds[0], 16), *rng.choice(kinds[1], 16)]
        if step % 100 == 0:
            chosen = tops([*range(len(texts))])[1]
        x = np.zeros((WIDTH, len(of), 2 * DIM + 1), np.float32)
        mask = np.zeros((WIDTH, len(of)), bool)
        ids = np.zeros((WIDTH, len(of)), np.int64)
        for k, i in enumerate(of):
            part = coded[i][chosen[i] : chosen[i] + WIDTH]
            ids[: len(part), k], mask[: len(part), k] = part, True
            x[: len(part), k, 2 * DIM] = told[halves[i]][part]
        used, back = np.unique(ids[mask], return_inverse=True)
        mine = _of(places, used)
        x[mask, : 2 * DIM] = vectors(mine, np.zeros(len(used), np.float32), w)[back, : 2 * DIM]
        grads = _backward(x, mask, y[of], w)
        each = np.zeros((len(used), 2 * DIM), np.float32)
        np.add.at(each, back, grads.pop("x")[mask][:, : 2 * DIM])
        n = np.diff(mine[2], append=len(mine[1]))
        grads["word"], grads["tri"] = np.zeros_like(w["word"]), np.zeros_like(w["tri"])
        np.add.at(grads["word"], mine[0], each[:, :DIM])
        np.add.at(grads["tri"], mine[1], np.repeat(each[:, DIM:] / n[:, None], n, axis=0))
        for key, g in grads.items():
            m = moment[key]
            g = g + 1e-5 * w[key]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            rate = 0.01 * (1 - 0.8 * step / steps)
            w[key] = (w[key] - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    top, _, count = tops([*range(len(rows))])
    from .quality import _logistic

    curve = _logistic(np.column_stack([top, np.log(count), np.ones(len(top))]), y.astype(float))
    share = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 1)).agg(F.avg("toxic")).first()[0]
    return Model(w, _odds([(r[1], r[2]) for r in rows]), curve.tolist(), float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 300 kB of weights, and weights of words of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        inputs = _Inputs(m) if m.curve else None
        for part in parts(batches):
            s = np.full(len(part), m.prior)
            if inputs is not None:
                words = [_words(t) for t in part["text"].to_pylist()]
                some = [k for k, x in enumerate(words) if x]
                if some:
                    top, _, count = _best([words[k] for k in some], m, inputs)
                    s[some] = _sigmoid(np.column_stack([top, np.log(count), np.ones(len(top))]) @ np.array(m.curve))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
