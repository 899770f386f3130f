"""Means of rotations and fits of poses: sums by Spark, a small eigenvalue problem per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _top(products: pd.Series) -> pd.Series:
    """The unit vector that belongs to the greatest eigenvalue of 4x4 numbers, its greatest entry positive."""

    def one(m) -> np.ndarray:
        v = np.linalg.eigh(np.asarray(m, float).reshape(4, 4))[1][:, -1]
        return v * np.sign(v[np.abs(v).argmax()])

    return products.map(one, na_action="ignore")


def mean_rotation(rows: DataFrame, by: list[str], quaternion: str) -> DataFrame:
    """(by, n, mean): the rotation nearest to a group's unit quaternions, of which q and -q are one.

    It belongs to the greatest eigenvalue of the sum of q q', ten numbers that are added up in part sums.
    """
    q = [F.col(quaternion)[k].cast("double") for k in range(4)]
    size = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    sums = rows.where(size > 0).groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(q[i] * q[j] / (size * size)).alias(f"_{i}{j}") for i in range(4) for j in range(i, 4)])
    full = F.array(*[F.col(f"_{min(i, j)}{max(i, j)}") for i in range(4) for j in range(4)])
    return sums.select(*by, "n", F.pandas_udf(_top, "array<double>")(full).alias("mean"))


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Poses of two arms with the same id, (on, left, right); ids that one of them lacks are left out, so none shifts the others."""
    return left.select(on, F.col("pose").alias("left")).join(right.select(on, F.col("pose").alias("right")), on)


def looked_up(cameras: DataFrame, calibration: DataFrame, identity: Column) -> DataFrame:
    """`cameras` (camera) with pose and source: hand-eye before successful extrinsics before the identity.

    calibration: (camera, hand_eye, extrinsics, success).
    """
    c = calibration.withColumn("_ext", F.when(F.col("success"), F.col("extrinsics")))
    out = cameras.join(c, "camera", "left")
    source = F.when(F.col("hand_eye").isNotNull(), "hand_eye").when(F.col("_ext").isNotNull(), "extrinsics").otherwise("identity")
    return out.select(*cameras.columns, F.coalesce("hand_eye", "_ext", identity).alias("pose"), source.alias("source"))
