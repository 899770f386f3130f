"""Centroid clustering of whole-number vectors, with exact distances for the centroids that block norms can't rule out.

A vector of integers is kept with a compressed form: its components divided by STEP, rounded to whole numbers, and
the norms of the rest in segments of SEGMENT components. By Cauchy and Schwarz, the rest's product with a centroid is at
most the sum over segments of norm times norm, so compressed vector and norms bound the distance to each centroid from
both sides. A centroid whose lower bound is over the least upper bound can't be nearest; all others get their exact
integer distance, so results are those of comparing everything.

Each round is one pass over the compressed table: tasks give sums by cluster, which Spark adds; what comes to the driver is
the sums of the k centroids, whatever the number of vectors. Rounds end early only when no centroid changes, as then none
would ever change again.

Defined results: vectors with another number of components than `dim`, with null, NaN or infinite ones, or with one
over LARGEST in size once it is an integer (distances would pass 64 bits) are left out; so are null embeddings; null
vec_ids are clustered but give no first centroid; rows that repeat a vec_id are vectors of their own; with fewer vectors
with an id than k there are as many centroids as those; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, parts, written

SEGMENT, STEP = 8, 16
LARGEST = 1 << 27
#: Rows whose distances are taken at a time.
AT_ONCE = 8192
#: What rounding can take from a sum of float64 products, as a share.
SLACK = 1e-9


def _norms(rows: np.ndarray) -> np.ndarray:
    """Norms of the segments of rows, none too small by rounding."""
    width = -rows.shape[1] % SEGMENT
    padded = np.pad(rows, ((0, 0), (0, width))).astype(float)
    return np.sqrt((padded.reshape(len(rows), -1, SEGMENT) ** 2).sum(axis=2)) * (1 + SLACK)


def integers(vectors: DataFrame, dim: int, scale: int = 1024) -> DataFrame:
    """(vec_id, v, norms, square): kept vectors as integers floor(scale * x), with the segment norms of what STEP leaves over and the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = part["e"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), dim)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * scale)
            good = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN, which nulls are, too
            v = x[good].astype(np.int64)
            rest = v - STEP * np.rint(v / STEP).astype(np.int64)
            cells = [part["vec_id"].filter(pa.array(good)), pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())]
            cells += [pa.array([r.tobytes() for r in _norms(rest).astype("<f4") * np.float32(1 + 1e-6)], pa.binary()), pa.array((v * v).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(cells, ["vec_id", "v", "norms", "square"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == dim)
    return rows.mapInArrow(run, "vec_id long, v binary, norms binary, square long")


def nearest(v: np.ndarray, norms: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, distance, exact distances taken) of rows of integers; ties go to the smaller cluster."""
    c = centroids.astype(float)
    coarse = STEP * np.rint(v / STEP)
    middle = square[:, None] + (centroids**2).sum(axis=1) - 2 * (coarse @ c.T)
    spread = 2 * (norms @ _norms(centroids).T)
    spread += SLACK * (np.abs(middle) + spread + square[:, None] + (c**2).sum(axis=1))
    upper = (middle + spread).min(axis=1)
    row, col = np.nonzero(middle - spread <= upper[:, None])
    exact = np.empty(len(row), np.int64)
    for s in range(0, len(row), AT_ONCE):
        d = v[row[s : s + AT_ONCE]] - centroids[col[s : s + AT_ONCE]]
        exact[s : s + AT_ONCE] = np.einsum("ij,ij->i", d, d)
    order = np.lexsort((col, exact, row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    return col[first], exact[first], len(row)


def _arrays(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(part)
    v = np.frombuffer(b"".join(part["v"].to_pylist()), "<i4").reshape(n, -1).astype(np.int64)
    norms = np.frombuffer(b"".join(part["norms"].to_pylist()), "<f4").reshape(n, -1).astype(float)
    return v, norms, part["square"].to_numpy(zero_copy_only=False)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        for at in range(0, len(part), AT_ONCE):
            yield part.slice(at, AT_ONCE)


def starts(table: DataFrame, seed: int, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; of rows with one id, in order of their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64)


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sum of components) of each cluster that has vectors, by one pass."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for part in _steps(batches):
            v, norms, square = _arrays(part)
            cluster, _, _ = nearest(v, norms, square, centroids)
            here = np.bincount(cluster, minlength=k)
            used = np.flatnonzero(here)
            n += here
            total[used] += np.add.reduceat(v[np.argsort(cluster, kind="stable")], (np.cumsum(here) - here)[used])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    found = table.select("v", "norms", "square").mapInArrow(run, "cluster long, n long, total array<long>")
    found = found.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found.collect()):  # k times dim numbers
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.x))
    return out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    table = written(integers(vectors, dim), "integers")
    centroids = starts(table, seed, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids.reshape(0, dim)
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, (n, total) in _sums(table, centroids).items():
            moved[cluster] = [x // n for x in total]
        if (moved == centroids).all():
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            cluster, distance, _ = nearest(*_arrays(part), centroids)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return written(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clustered"), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    found, centroids = clustered(vectors)
    names = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    named = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))  # k rows
    own = own.join(named, "cluster").crossJoin(own.agg(F.sum("s").alias("all")))  # one row
    own = own.select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
