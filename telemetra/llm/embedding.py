"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

The number of bits grows with the logarithm of the number of distinct vectors and the number of tables follows
from the wanted recall, 1 - MISS at the threshold. Buckets travel as 8-bit roundings of the unit vectors whose
rounding error is known: a pair is linked or dropped at once if that bound decides it, and otherwise its cosine
is computed in double precision from the vectors. A bucket of any size is cut into blocks and compared block pair
by block pair, so no task holds more than two blocks and none of its pairs is left out. What leaves a task of the pairs
decided there is not the pairs but each vector's number of links and edges that join the same components, at most one a
vector; only pairs within rounding of the threshold are given one by one.

Defined results: vectors that are null, zero or have null or non-finite components link with nothing; so do
vectors of different lengths; equal vectors form one class that is compared once, and its copies count in n_links;
null vec_ids get a null component and are kept; repeated rows count as other vectors; an empty table is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

MISS = 5e-4
BLOCK = 1024
#: Parts that the rows of one class of equal vectors are dealt into.
SALTS = 32


def shape(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for `n` distinct vectors."""
    bits = min(24, max(6, math.ceil(math.log2(max(n, 1) / 512))))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the index of a member of its component, after joining the ends of the edges (a, b)."""
    while len(a):
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]
        left = labels[a] != labels[b]
        a, b = a[left], b[left]
    return labels


def links(vectors: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, degrees, edges).

    members (vec_id, rep, many): usable vectors, the smallest id with the same vector, and how many have it;
    degrees (rep, near): other vectors linked with those of rep, the equal ones aside; edges (a, b): reps in one component.
    """
    good = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.size("v") > 0
    fine = fine & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = good.where("v is not null").where(fine).withColumn("same", F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    classes = written(good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("v").alias("v")), "vectors")
    # rows of a large class meet its representative in SALTS tasks
    salted = good.select("vec_id", "same", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    reps = salted.select("same", "salt").distinct().join(classes.select("same", "rep", "many"), "same")
    members = salted.join(reps, ["same", "salt"]).select("vec_id", "rep", "many")
    count = classes.count()
    bits, tables = shape(count, threshold)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for same, v in zip(batch.same, batch.v):
                v = np.asarray(v, float)
                v = v / np.abs(v).max()
                v = v / np.sqrt(v @ v)
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(len(v)).standard_normal((len(v), bits * tables))
                code = ((v @ planes[len(v)] > 0).reshape(tables, bits) @ (1 << np.arange(bits))).astype("<u4")
                step = np.abs(v).max() / 127
                q = np.rint(v / step).astype(np.int8)
                err = float(np.sqrt(((v - q * step) ** 2).sum()))
                rows.append((same, len(v), code.tolist(), code.tobytes(), q.tobytes(), step, err))
            yield pd.DataFrame(rows, columns=["same", "dim", "code", "codes", "q", "step", "err"])

    coded = written(classes.select("same", "v").mapInPandas(hashed, "same string, dim int, code array<long>, codes binary, q binary, step double, err double").join(classes.select("same", "rep", "many"), "same").drop("same"), "codes")
    slots = coded.select("rep", "dim", F.posexplode("code").alias("t", "code"))
    sizes = slots.groupBy("t", "dim", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    # every row goes to each pair of blocks that its own block is part of
    wide = coded.select("rep", "many", "dim", "codes", "q", "step", "err", F.posexplode("code").alias("t", "code")).join(sizes, ["t", "dim", "code"])
    wide = wide.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    wide = wide.select("t", "dim", "code", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep", "many", "codes", "q", "step", "err")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        t, x, y = int(batch.t.iloc[0]), int(batch.x.iloc[0]), int(batch.y.iloc[0])
        q = np.stack([np.frombuffer(b, np.int8) for b in batch.q]).astype(np.float32)
        codes = np.stack([np.frombuffer(b, "<u4") for b in batch.codes])
        step, err, rep, many = batch.step.to_numpy(), batch.err.to_numpy(), batch.rep.to_numpy(), batch.many.to_numpy(float)
        left = np.flatnonzero(batch.mine.to_numpy() == x)
        right = left if x == y else np.flatnonzero(batch.mine.to_numpy() == y)
        near, labels, unsure = np.zeros(len(rep)), np.arange(len(rep)), []
        unit = q * step[:, None].astype(np.float32)
        loosest = threshold - (2 * err.max() + err.max() ** 2) - 1e-3  # more than rounding takes from a linked pair
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            a, b = np.nonzero(unit[rows] @ unit[right].T >= loosest)
            a, b = rows[a], right[b]
            ok = (rep[a] < rep[b]) if x == y else (rep[a] != rep[b])
            a, b = a[ok], b[ok]
            for s in range(0, len(a), 65536):
                p, r = a[s : s + 65536], b[s : s + 65536]
                if t:  # a pair counts in the first table in which it meets
                    new = ~(codes[p, :t] == codes[r, :t]).any(axis=1)
                    p, r = p[new], r[new]
                cos = np.einsum("ij,ij->i", q[p], q[r], dtype=float) * step[p] * step[r]
                slack = err[p] + err[r] + err[p] * err[r] + 1e-6
                known, open_ = cos - slack >= threshold, np.abs(cos - threshold) <= slack
                unsure.append((rep[p[open_ & ~known]], rep[r[open_ & ~known]]))
                p, r = p[known], r[known]
                near += np.bincount(p, many[r], len(rep)) + np.bincount(r, many[p], len(rep))
                labels = _joined(labels, p, r)
        some, moved = np.flatnonzero(near), np.flatnonzero(labels != np.arange(len(labels)))
        a = np.concatenate([rep[some], rep[moved], *(u[0] for u in unsure)])
        b = np.concatenate([near[some].astype(np.int64), rep[labels[moved]], *(u[1] for u in unsure)])
        kind = np.repeat([0, 1, 2], [len(some), len(moved), len(a) - len(some) - len(moved)])
        return pd.DataFrame({"kind": kind.astype(np.int32), "a": a, "b": b})

    met = written(wide.groupBy("t", "dim", "code", "x", "y").applyInPandas(compare, "kind int, a long, b long"), "met")
    unit = classes.select("rep", "many", F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs))).alias("v"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unsure = met.where("kind = 2").select("a", "b").join(unit.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("many").alias("na")), "a").join(unit.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("many").alias("nb")), "b")
    exact = written(unsure.where(dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb")) >= threshold).select("a", "b", "na", "nb"), "exact")
    ends = exact.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("nb").alias("near")), F.struct(F.col("b").alias("rep"), F.col("na").alias("near")))).alias("e")).select("e.*")
    degrees = met.where("kind = 0").select(F.col("a").alias("rep"), F.col("b").alias("near")).unionByName(ends).groupBy("rep").agg(F.sum("near").alias("near"))
    return members, degrees, met.where("kind = 1").select("a", "b").unionByName(exact.select("a", "b"))


def digest(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The contract's columns, one row per row of `vectors`."""
    members, degrees, edges = links(vectors, threshold)
    members = written(members, "members")
    comp = connected_components(edges.unionByName(members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    near = written(members.select("rep", "many").distinct().join(degrees, "rep", "left").select("rep", (F.col("many") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "near")
    found = members.join(near, "rep").groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    found = found.join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = vectors.select("vec_id").join(found, "vec_id", "left")
    group = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), F.coalesce(F.col("vec_id") == group, F.lit(True)).alias("kept"))
