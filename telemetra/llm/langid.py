"""Language of texts: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

A word gives itself and its character n-grams of 1 to 4 letters, with its ends marked; each is hashed into one of ROWS
embeddings of DIM numbers, and a text is the mean of all of its words' subwords. A linear layer and a softmax make it
probabilities. Embeddings and layer are trained by stochastic gradient descent in numpy. Of the training rows, those
of every fourth hash are held back: on them a temperature that depends on a text's length is fitted, so that a score is how
often such a prediction is right, and the score under which predictions are rejected is the least one over which
they are right in at least `precision` of cases.

As mean and layer are linear, a worker multiplies all embeddings by the layer once, and a word's sum is then kept.

Defined results: null texts, and texts without a letter, are `und` with score 0 and rejected; whole texts are read,
a run of over WORD letters as words of that many; ties between languages go to the first by name; without labelled rows all
texts are `und`; with one language every text with a letter is of that; repeated rows get equal results; an empty table is
empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PASSAGE, bound_batches, fold, parts

UND = "und"
BITS, DIM, WORD = 15, 16, 40
ROWS = 1 << BITS
NGRAMS = (1, 2, 3, 4)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words whose sums a worker keeps; on reaching it the store is emptied.
KEPT_WORDS = 200_000
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20
_WORDS = re.compile(rf"[^\W\d_]{{1,{WORD}}}")


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # embeddings times layer, one row a hash
    bias: np.ndarray | None = None
    heat: tuple[float, float] = (0.0, 0.0)  # log of the temperature: constant, and by log of the number of words
    doubt: float = 0.0  # what no score is nearer to 1 than: one error more than was seen in the rows held back
    reject: float = 0.0


def _letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def words(text: str) -> Iterator[list[str]]:
    """The words in lower case; those of a long text piece by piece, cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha() and end < at + 2 * PIECE:
            end += 1
        yield _WORDS.findall(text[at:end].lower())
        at = end


def subwords(said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): the hashed rows of the n-grams of each word and of the word itself, and where each word's begin."""
    c = np.frombuffer("".join(f"<{w}>" for w in said).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, said), np.int64, len(said)) + 2
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(c))  # characters to the word's end
    h, rows, there = np.zeros(len(c), np.uint64), np.zeros((len(c), len(NGRAMS) + 1), np.uint64), np.zeros((len(c), len(NGRAMS) + 1), bool)
    for k, n in enumerate(NGRAMS):  # a hash of n characters from that of one less
        h = h * _PRIME + np.append(c[n - 1 :], np.zeros(min(n - 1, len(c)), np.uint64))
        rows[:, k], there[:, k] = h + np.uint64(n), left >= n
    power = np.cumprod(np.full(WORD + 3, _PRIME))
    rows[first, -1], there[first, -1] = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(first, size)], first), True
    mixed = (rows ^ (rows >> np.uint64(29))) * _PRIME
    number = np.add.reduceat(there.sum(axis=1), first)
    return (mixed[there] >> np.uint64(64 - BITS)).astype(np.int64), np.cumsum(number) - number


def sample(docs: DataFrame, per_lang: int, max_chars: int) -> list[tuple[int, str, str]]:
    """(doc_id, lang, text) of at most `per_lang` training rows of each language, in order of a hash of the id.

    Only rows with a language and a letter outside hold-out fold 1. A text of over `max_chars` characters gives passages of
    PASSAGE characters from all over. Ids are ranked within their language first, with ranks taken in each task before
    the shuffle; texts of the chosen rows alone are read then.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id")) != 1))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = rows.select("doc_id", "lang", "h").withColumn("place", place).where(F.col("place") <= per_lang).select("doc_id", "lang", "h").distinct()
    n, many = F.length("text"), max(max_chars // PASSAGE, 1)
    spread = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.substring("text", (k * (n - PASSAGE) / max(many - 1, 1)).cast("int") + 1, F.lit(PASSAGE))))
    cut = rows.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).select("doc_id", "lang", F.when(n <= max_chars, F.col("text")).otherwise(spread).alias("text"))
    return sorted(tuple(r) for r in cut.dropDuplicates(["doc_id", "lang", "text"]).collect())  # per_lang rows of a language


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _told(z: np.ndarray, size: np.ndarray, heat: tuple[float, float], doubt: float) -> np.ndarray:
    """Probabilities from logits and log of the number of words."""
    return (1 - doubt) * _softmax(z * np.exp(heat[0] + heat[1] * size)[:, None]) + doubt / z.shape[1]


def _features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, shares, words) of a text: each hash with its share of all subwords."""
    seen = [w for piece in words(text) for w in piece]
    rows, n = np.unique(subwords(seen)[0], return_counts=True)
    return rows, n / n.sum(), len(seen)


def fit(docs: DataFrame, per_lang: int = 500, max_chars: int = 4000, epochs: int = 12, rate: float = 0.5, precision: float = 0.99, seed: int = 5) -> Model:
    """A model of the languages of `docs` (doc_id, text, lang), from at most `per_lang` rows of each outside the hold-out fold."""
    rows = sample(docs, per_lang, max_chars)
    langs = sorted({r[1] for r in rows})
    if not langs:
        return Model()
    y = np.array([langs.index(r[1]) for r in rows])
    feats = [_features(r[2]) for r in rows]
    rng = np.random.default_rng(seed)
    kept = np.array([zlib.crc32(f"held {r[0]}".encode()) % 4 != 0 for r in rows])
    train = np.flatnonzero(kept)
    if not len(train):
        train = np.arange(len(rows))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM))
    layer, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, share, _ = feats[i]
            mean = share @ emb[at]
            g = _softmax((mean @ layer + bias)[None])[0]
            g[y[i]] -= 1
            step = rate * (1 - done / steps)
            done += 1
            back = layer @ g
            layer -= step * np.outer(mean, g)
            bias -= step * g
            # a subword's share falls with a text's length; its step falls less, by the root of that
            emb[at] -= step * len(at) ** 0.5 * share[:, None] * back
    table = (emb @ layer).astype(np.float32)
    model = Model(langs, table, bias.astype(np.float32))
    check = np.flatnonzero(~kept)
    if len(langs) > 1 and len(check):
        z = np.array([feats[i][1] @ table[feats[i][0]] + bias for i in check])
        size = np.log1p([feats[i][2] for i in check])
        grid = [(a, b) for a in np.arange(-1.0, 3.01, 0.25) for b in np.arange(0.0, 0.81, 0.1)]
        model.doubt = 1 / (len(check) + 2)
        loss = lambda ab: round(-np.log(_told(z, size, ab, model.doubt)[np.arange(len(check)), y[check]]).mean(), 6)
        model.heat = min(grid, key=lambda ab: (loss(ab), ab))
        p = _told(z, size, model.heat, model.doubt)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
        order = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
        model.reject = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


class _Sums:
    """Sum and number of the subwords' rows of each word, of words met before and new ones."""

    def __init__(self, model: Model):
        self.m = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.rows, self.known = np.zeros((4096, len(self.m.langs) + 1)), 0

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """(logits, words) of a text with a letter."""
        total, n = np.zeros(len(self.m.langs) + 1), 0
        for piece in words(text):
            ids = np.fromiter(map(self.place.__getitem__, piece), np.int64, len(piece))
            if len(self.place) > self.known:
                new = list(islice(reversed(self.place), len(self.place) - self.known))[::-1]
                rows, starts = subwords(new)
                if len(self.place) > len(self.rows):
                    self.rows = np.concatenate([self.rows[: self.known], np.zeros((2 * len(self.place) - self.known, self.rows.shape[1]))])
                here = self.rows[self.known : len(self.place)]
                here[:, :-1] = np.add.reduceat(self.m.table[rows], starts)
                here[:, -1] = np.diff(starts, append=len(rows))
                self.known = len(self.place)
            total += self.rows[ids].sum(axis=0)
            n += len(piece)
            if len(self.place) > KEPT_WORDS:
                self.clear()
        return total[:-1] / total[-1] + self.m.bias, n


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted), one row per row of docs (doc_id, text); rejected ones have their language all the same."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS times the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = _Sums(m) if m.langs else None
        for part in parts(batches):
            lang, score = [], []
            for text in part["text"].to_pylist():
                if sums is None or not _letters(text):
                    lang.append(UND)
                    score.append(0.0)
                    continue
                z, n = sums.of(text)
                p = _told(z[None], np.log1p([n]), m.heat, m.doubt)[0]
                lang.append(m.langs[int(p.argmax())])
                score.append(float(p.max()))
            accepted = [x != UND and s >= m.reject for x, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and whether the calibrated threshold accepts the prediction."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "accepted")
