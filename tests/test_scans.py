"""Scans with a carried state against loops, at stretches and batches of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import scans, summaries


def plain_smoothed(values, alpha):
    out, y = [], None
    for x in values:
        y = None if x is None else x if y is None else y + alpha * (x - y)
        out.append(y)
    return out


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_smoothed(spark, stretch):
    rng = np.random.default_rng(1)
    episodes = {k: [None if rng.random() < 0.15 else float(x) for x in rng.normal(size=n)] for k, n in ((1, 40), (2, 1), (3, 17), (None, 9))}
    episodes[4] = [None, None, None]
    rows = [(k, i, v, "x") for k, vs in episodes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "e long, i long, v double, y string").repartition(5)
    got = {(r.e, r.i): r.v for r in scans.smoothed(df, ["e"], ["i"], "v", 0.3, stretch).collect()}
    assert len(got) == len(rows)
    for k, vs in episodes.items():
        for i, want in enumerate(plain_smoothed(vs, 0.3)):
            assert got[k, i] == want if want is None else abs(got[k, i] - want) < 1e-12
    assert scans.smoothed(df.where("e > 99"), ["e"], ["i"], "v", 0.3).count() == 0


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def log_rotation(r):
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return np.zeros(3)
    return angle / (2 * np.sin(angle)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])


def exp_rotation(v):
    a = np.linalg.norm(v)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def test_smoothed_poses(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for e in range(3):
        at = None
        for i in range(25):
            if i == 9:
                rows.append((e, i, None))
                want[e, i], at = None, None
                continue
            t = np.eye(4)
            t[:3, :3], t[:3, 3] = (rotation(rng) if i % 5 else np.eye(3)), rng.normal(size=3)
            rows.append((e, i, t.ravel().tolist()))
            if at is None:
                at = t.copy()
            else:
                new = np.eye(4)
                new[:3, 3] = at[:3, 3] + 0.4 * (t[:3, 3] - at[:3, 3])
                new[:3, :3] = exp_rotation(0.4 * log_rotation(t[:3, :3] @ at[:3, :3].T)) @ at[:3, :3]
                at = new
            want[e, i] = at
    rows.append((9, 0, [1.0, None]))
    got = {(r.e, r.i): r.pose for r in scans.smoothed_poses(spark.createDataFrame(rows, "e long, i long, pose array<double>"), ["e"], ["i"], "pose", 0.4).collect()}
    assert got.pop((9, 0)) is None
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] is None if w is None else np.allclose(np.array(got[k]).reshape(4, 4), w, atol=1e-7)


def plain_lockstep(rows, within):
    out = []
    for e in {r[0] for r in rows}:
        streams = {}
        for _, s, t in sorted(r for r in rows if r[0] == e):
            streams.setdefault(s, []).append(t)
        at, k = dict.fromkeys(streams, 0), 0
        while all(at[s] < len(v) for s, v in streams.items()):
            now = {s: v[at[s]] - v[0] for s, v in streams.items()}
            behind = [s for s in now if max(now.values()) - now[s] > within]
            for s in behind:
                at[s] += 1
            if not behind:
                out += [(e, k, s, v[at[s]]) for s, v in streams.items()]
                k, at = k + 1, {s: i + 1 for s, i in at.items()}
    return sorted(out)


def test_lockstep(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(5):
        for s in "abcd"[: 1 + e % 4]:
            t = int(rng.integers(1 << 40))
            for step in rng.choice([30, 33, 36, 33, 70, 170], size=60 + 10 * e):
                rows.append((e, s, t))
                t += int(step)
    got = scans.lockstep(spark.createDataFrame(rows, "e long, s string, t long"), "e", "s", "t", 16)
    assert sorted((r.e, r.frame, r.s, r.t) for r in got.collect()) == plain_lockstep(rows, 16)
    assert len(plain_lockstep(rows, 16)) > 300


def test_numbers_follow_all_columns(spark):
    df = spark.range(5000).select(F.lit(1).alias("same"), F.xxhash64("id").alias("h"), "id").repartition(9)
    got = summaries.numbered(df, ["same", "h", "id"])
    want = [r.id for r in df.orderBy("h", "id").collect()]
    assert [r.id for r in got.orderBy("_k").collect()] == want
    assert sorted(r["_k"] for r in got.select("_k").collect()) == list(range(5000))
    assert summaries.numbered(df.where("id < 0"), ["h"]).count() == 0
