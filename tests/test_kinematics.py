"""Chains and calibrations against numpy on generated arms and rigs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import kinematics

pose_list = lambda t: [float(x) for x in np.asarray(t).ravel()]


def pose(rng, turn=1.0, shift=1.0):
    v = rng.normal(size=3)
    return kinematics._poses(np.concatenate([turn * v / np.linalg.norm(v) * rng.random(), shift * rng.normal(size=3)])[None])[0]


def dh(a, alpha, d, theta):
    ct, st, ca, sa = np.cos(theta), np.sin(theta), np.cos(alpha), np.sin(alpha)
    return np.array([[ct, -st * ca, st * sa, a * ct], [st, ct * ca, -ct * sa, a * st], [0, sa, ca, d], [0, 0, 0, 1]])


def test_forward_is_the_product_of_the_links(spark):
    rng, joints, frames, want = np.random.default_rng(1), [], [], {}
    for arm, n in (("l", 6), ("r", 7), ("unused", 2)):
        joints += [(arm, j, *map(float, rng.normal(size=4))) for j in range(n)]
    for f in range(40):
        arm = "lr"[f % 2]
        q = [float(x) for x in rng.normal(size=(4, 6, 7, 9)[f % 4])]
        frames.append((f, arm, q))
        t = np.eye(4)
        for _, j, a, alpha, d, theta in (x for x in joints if x[0] == arm):
            t = t @ dh(a, alpha, d, theta + (q[j] if j < len(q) else 0.0))
        want[f] = t
    frames += [(90, "none", [0.0]), (91, None, [0.0]), (92, "l", None)]
    js = spark.createDataFrame(joints, "arm string, joint int, a double, alpha double, d double, theta double").repartition(3)
    fs = spark.createDataFrame(frames, "f int, arm string, q array<double>").repartition(4)
    got = kinematics.forward(fs, js, "arm", ["f"]).collect()
    assert {r.f for r in got} == {*want, 92}
    for r in got:
        if r.f in want:
            assert np.allclose(np.array(r.pose).reshape(4, 4), want[r.f], atol=1e-12) and r.n == (6 if r.arm == "l" else 7)
    base, mount = pose(rng), pose(rng)
    half = np.diag([-1.0, -1.0, 1.0, 1.0])
    lit = lambda t: F.array(*map(F.lit, pose_list(t)))
    tips = spark.createDataFrame([(pose_list(want[0]), True), (pose_list(want[1]), False)], "tip array<double>, flip boolean")
    side = F.when(F.col("flip"), lit(base))
    seen = [np.array(r[0]).reshape(4, 4) for r in tips.select(kinematics.camera_pose(F.col("tip"), lit(mount), side, F.col("flip"))).collect()]
    assert np.allclose(seen[0], base @ want[0] @ mount @ half) and np.allclose(seen[1], want[1] @ mount)


def test_chained_odd(spark):
    one = pose_list(np.eye(4))
    rows = [(1, 2, one), (1, 1, one), (2, 1, None), (2, 2, one), (3, 1, one), (3, 1, one), (4, None, one)]
    got = {r.g: r.pose for r in kinematics.chained(spark.createDataFrame(rows, "g int, i int, t array<double>"), ["g"], "i", "t").collect()}
    assert got[1] == one and got[2] is None and got[3] is None


def rig(rng, n, noise):
    x, board = pose(rng, 2.0, 0.05), pose(rng, 1.0, 0.3)
    hands = [pose(rng, 2.5, 0.4) for _ in range(n)]
    seen = []
    for h in hands:
        t = np.linalg.inv(h @ x) @ board
        v = kinematics._vector(t)
        seen.append(kinematics._poses((v + noise * rng.normal(size=6))[None])[0])
    return x, hands, seen


def test_hand_eye_recovers_planted_cameras(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for g, (n, noise) in enumerate([(15, 0.0), (40, 1e-3), (3, 0.0), (2, 0.0)]):
        x, hands, seen = rig(rng, n, noise)
        want[g] = (x, 1e-8 if noise == 0 else 5e-3)
        rows += [(g, i, pose_list(h), pose_list(b)) for i, (h, b) in enumerate(zip(hands, seen))]
    about_z = [dh(0.1, 0.0, 0.2, k / 3) for k in range(6)]  # all about one axis: open
    rows += [(8, i, pose_list(h), pose_list(np.linalg.inv(h))) for i, h in enumerate(about_z)]
    rows += [(9, 0, None, pose_list(np.eye(4))), (0, 99, pose_list(np.eye(4)), [1.0])]
    got = {r.g: r for r in kinematics.hand_eye(spark.createDataFrame(rows, "g int, i int, hand array<double>, board array<double>"), ["g"], "i").collect()}
    assert [got[g].success for g in (0, 1, 2, 3, 8)] == [True, True, True, False, False] and 9 not in got
    assert got[0].n == 15 and got[3].pose is None
    for g in (0, 1, 2):
        assert np.allclose(np.array(got[g].pose).reshape(4, 4), want[g][0], atol=want[g][1])


def dense_fit(start, hand, k, point, pixel, huber):
    """Reweighted least squares over all sights at once."""
    p, lam, last = start.copy(), 1e-3, np.inf
    cost = lambda q: (lambda r: np.where(np.abs(r) <= huber, r * r, 2 * huber * np.abs(r) - huber**2).sum())(kinematics.reprojected(np.tile(q, (len(point), 1)), hand, point, k) - pixel)
    for _ in range(100):
        r = (kinematics.reprojected(np.tile(p, (len(point), 1)), hand, point, k) - pixel).ravel()
        jac = np.zeros((len(r), 13))
        for j in range(13):
            e = np.zeros(13)
            e[j] = 1e-6
            jac[:, j] = (kinematics.reprojected(np.tile(p + e, (len(point), 1)), hand, point, k) - kinematics.reprojected(np.tile(p - e, (len(point), 1)), hand, point, k)).ravel() / 2e-6
        w = np.minimum(1.0, huber / np.maximum(np.abs(r), 1e-300))
        h = jac.T @ (w[:, None] * jac)
        new = p - np.linalg.lstsq(h + lam * np.diag(np.diag(h)), jac.T @ (w * r), rcond=None)[0]
        if cost(new) < cost(p):
            p, lam = new, lam / 10
        else:
            lam *= 10
        if abs(last - cost(p)) < 1e-13 and lam > 1e3:
            break
        last = cost(p)
    return p


def test_bundle_fit_matches_a_dense_solver(spark):
    rng, rows, starts, want = np.random.default_rng(6), [], [], {}
    k = np.array([[600.0, 0, 320], [0, 610.0, 240], [0, 0, 1]])
    for g in range(3):
        x = np.concatenate([0.2 * rng.normal(size=3), 0.03 * rng.normal(size=3)])
        b = np.concatenate([0.2 * rng.normal(size=3), [0.1 * g, 0.0, 0.8]])
        truth = np.concatenate([x, b, [np.log(1.05)]])
        hand, point = [], []
        for _ in range(12):
            h = kinematics._poses(np.concatenate([0.25 * rng.normal(size=3), 0.08 * rng.normal(size=3)])[None])[0]
            for i in range(4):
                for j in range(3):
                    hand.append(h)
                    point.append([0.04 * i - 0.06, 0.04 * j - 0.04, 0.0])
        hand, point = np.array(hand), np.array(point)
        ks = np.tile(k, (len(point), 1, 1))
        pixel = kinematics.reprojected(np.tile(truth, (len(point), 1)), hand, point, ks) + 0.3 * rng.normal(size=(len(point), 2))
        pixel[:: 17] += 60.0  # wrong corners
        start = truth + np.concatenate([0.03 * rng.normal(size=12), [-np.log(1.05)]])
        want[g] = (dense_fit(start, hand, ks, point, pixel, 2.0), truth)
        rows += [(g, pose_list(h), pose_list(k), pose_list(p), pose_list(u)) for h, p, u in zip(hand, point, pixel)]
        starts.append((g, *[pose_list(kinematics._poses(v[None])[0]) for v in (start[:6], start[6:12])], float(np.exp(start[12]))))
    rows.append((7, *rows[0][1:]))  # without a start
    sights = spark.createDataFrame(rows, "g int, hand array<double>, k array<double>, point array<double>, pixel array<double>").repartition(4)
    got = kinematics.bundle_fit(sights, spark.createDataFrame(starts, "g int, camera array<double>, board array<double>, scale double"), ["g"]).collect()
    assert sorted(r.g for r in got) == [0, 1, 2]
    for r in got:
        p, truth = want[r.g]
        assert r.n == 144 and np.allclose(np.array(r.camera).reshape(4, 4), kinematics._poses(p[None, :6])[0], atol=1e-5)
        assert np.allclose(np.array(r.board).reshape(4, 4), kinematics._poses(p[None, 6:12])[0], atol=1e-5) and abs(r.scale - np.exp(p[12])) < 1e-5
        assert np.abs(np.array(r.camera).reshape(4, 4) - kinematics._poses(truth[None, :6])[0]).max() < 0.02


@pytest.mark.parametrize("angle", [0.0, 1e-9, 0.3, 3.1, np.pi])
def test_vectors_of_poses(angle):
    v = np.array([1.0, -2.0, 0.5]) / np.linalg.norm([1.0, -2.0, 0.5]) * angle
    t = kinematics._poses(np.concatenate([v, [1.0, 2.0, 3.0]])[None])[0]
    assert np.allclose(kinematics._poses(kinematics._vector(t)[None])[0], t, atol=1e-7)
