"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into
pieces, each piece is compressed with both and without any; the difference of the two sizes over their sum,
with the plain compression ratio that tells how much of a size is left to explain, goes through a logistic
curve fitted on labelled rows that neither dictionary has seen.

Defined results: null text counts as empty; an empty text gets the score of the curve at no evidence, the
share of good rows in the fitting sample; long texts are scored whole; repeated rows get equal scores; extra
columns of `docs` are ignored by `score` and kept by `keep_good`. An empty or one-sided label table gives 0.5 to all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, parts

PIECE_BYTES = 2048
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


class _Sizes:
    """Compressed sizes of a text: with the good dictionary, with the bad one, with none, and raw."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        def compressor(raw: bytes | None):
            flags = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            if raw is None:
                return zstd.ZstdCompressor(**flags)
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(dict_data=d, **flags)

        self.of = [compressor(good), compressor(bad), compressor(None)]

    def __call__(self, text: str) -> tuple[int, int, int, int]:
        raw = text.encode("utf-8", "replace")
        out = [0, 0, 0]
        for at in range(0, len(raw), PIECE_BYTES):
            piece = raw[at : at + PIECE_BYTES]
            for k, c in enumerate(self.of):
                out[k] += len(c.compress(piece))
        return (*out, len(raw))


def _features(sizes: np.ndarray) -> np.ndarray:
    g, b, p, n = (sizes[:, k].astype(float) for k in range(4))
    diff = (b - g) / np.maximum(b + g, 1)
    ratio = np.minimum(p / np.maximum(n, 1), 1.2)
    return np.column_stack([diff * 10, diff * np.abs(diff) * 40, ratio, np.log(ratio + 0.02), np.log1p(n) / 10, np.ones(len(g))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton's steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = np.where(y > 0, 1, -1) * (x @ w)
        return float(np.logaddexp(0, -z).sum() + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, total_chars: int = 6_000_000, dict_bytes: int = 65_536) -> Model:
    """Fit on at most `per_class` labelled rows of each class outside the hold-out fold, of any length, see labelled_sample."""
    import zstandard as zstd

    rows = labelled_sample(docs, labels, "quality", per_class, total_chars)
    mine = {0: [], 1: []}
    rest = []
    for doc_id, y, text in rows:
        if zlib.crc32(f"half {doc_id}".encode()) & 1:
            mine[y].append(text)
        else:
            rest.append((y, text))
    if min(len(mine[0]), len(mine[1]), sum(y for y, _ in rest), sum(1 - y for y, _ in rest)) < 5:
        return Model(b"", b"", [], 0.5)

    def dictionary(texts: list[str]) -> bytes:
        raw = [t.encode("utf-8", "replace") for t in texts]
        pieces = [r[at : at + PIECE_BYTES] for r in raw for at in range(0, len(r), PIECE_BYTES)]
        pieces = [p for p in pieces if len(p) >= 16]
        try:
            return zstd.train_dictionary(min(dict_bytes, max(1024, sum(map(len, pieces)) // 4)), pieces, k=64, d=8).as_bytes()
        except zstd.ZstdError:  # too little text for training: raw content serves as a dictionary
            return b"".join(pieces)[-dict_bytes:]

    good, bad = dictionary(mine[1]), dictionary(mine[0])
    measure = _Sizes(good, bad)
    y = np.array([r[0] for r in rest], float)
    x = _features(np.array([measure(t) for _, t in rest]))
    return Model(good, bad, _logistic(x, y).tolist(), float(y.mean()))


class _Scorer:
    """Scores of texts, for one task."""

    def __init__(self, model: Model):
        self.model, self.measure = model, _Sizes(model.good, model.bad) if model.weights else None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.measure is None:
            return np.full(len(texts), 0.5)
        sizes = np.array([self.measure(t or "") for t in texts]).reshape(-1, 4)
        s = 1 / (1 + np.exp(-np.clip(_features(sizes) @ np.array(self.model.weights), -30, 30)))
        return np.where(sizes[:, 3] == 0, self.model.prior, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row per row of `docs`; score is the chance that the text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of dict_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scorer(part["text"].to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for part in parts(batches):
            yield part.filter(pa.array(scorer(part["text"].to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
