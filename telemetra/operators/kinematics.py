"""Chains of joints and the calibration of cameras on them: ordered products of matrices, and fits from sums over rows.

Fits take each group's normal equations as sums that Spark adds up; what is solved is a problem of a few numbers a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..scratch import written


def link(a: Column, alpha: Column, d: Column, theta: Column) -> Column:
    """The 4x4 pose of a joint's frame in the one before: turned by theta about z, moved by d along it and by a along x, turned by alpha about x."""
    ct, st, ca, sa, o = F.cos(theta), F.sin(theta), F.cos(alpha), F.sin(alpha), F.lit(0.0)
    return F.array(ct, -st * ca, st * sa, a * ct, st, ct * ca, -ct * sa, a * st, o, sa, ca, d, o, o, o, F.lit(1.0))


def chained(rows: DataFrame, by: list[str], order: str, pose: str) -> DataFrame:
    """(by, n, pose): the product of each group's 4x4 poses in order; the identity's place is taken by the first.

    A group is one chain, a few joints of one frame. A null pose, or two of one place in the order, give a null.
    """
    path = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(pose).alias("t"))))
    one = rows.groupBy(*by).agg(path.alias("_p"), F.count_distinct(order).alias("_d"))
    whole = (F.size("_p") == F.col("_d")) & F.forall("_p", lambda x: x["t"].isNotNull() & (F.size(x["t"]) == 16))
    start = F.array(*map(F.lit, geometry.IDENTITY))
    product = F.aggregate("_p", start, lambda s, x: geometry.matmul(s, x["t"]))
    return one.select(*by, F.size("_p").alias("n"), F.when(whole, product).alias("pose"))


def forward(frames: DataFrame, joints: DataFrame, arm: str, by: list[str]) -> DataFrame:
    """(by, arm, n, pose): the pose of an arm's tip from frames (by, arm, q: an angle a joint).

    joints: (arm, joint from 0, a, alpha, d, theta). Angles that a frame lacks count as 0, those beyond the arm's joints are ignored; an
    arm without joints gives no row. Every frame meets its arm's few joints, and is multiplied up by itself.
    """
    met = frames.join(joints.select(arm, "joint", "a", "alpha", "d", "theta"), arm)
    q = F.coalesce(F.try_element_at("q", F.col("joint") + 1), F.lit(0.0))
    return chained(met.withColumn("_t", link(F.col("a"), F.col("alpha"), F.col("d"), F.col("theta") + q)), [*by, arm], "joint", "_t")


def camera_pose(tip: Column, camera: Column, base: Column | None = None, flipped: Column | None = None) -> Column:
    """A wrist camera's pose: [base of the other arm] * tip * camera on the tip [* half a turn about z, for a camera that hangs upside down]."""
    half = F.array(*map(F.lit, (-1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    one = F.array(*map(F.lit, geometry.IDENTITY))
    before = [] if base is None else [F.coalesce(base, one)]
    after = [] if flipped is None else [F.when(flipped, half).otherwise(one)]
    return geometry.times(*before, tip, camera, *after)


def summed(rows: DataFrame, by: list[str], terms: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """(by, sums): the sums over each group of the numbers that `terms` gives for each row, m for all rows alike.

    `terms` gets the columns as arrays; tasks add up their own rows first, so what is shuffled is one list of m numbers a group and batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            frame = batch.select(by).to_pandas() if by else None
            group = frame.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(batch), int)
            columns = {n: _numbers(batch.column(n)) for n in batch.schema.names if n not in by}
            values = terms(columns)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            sums = np.add.reduceat(values[order], first, axis=0)
            yield pa.RecordBatch.from_arrays([*[batch.column(b).take(pa.array(order[first])) for b in by], pa.array(list(sums), pa.list_(pa.float64()))], [*by, "_v"])

    kinds = dict(rows.dtypes)
    parts = rows.mapInArrow(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "_v array<double>"]))
    added = parts.select(*by, F.posexplode("_v").alias("_i", "_x")).groupBy(*by, "_i").agg(F.sum("_x").alias("_x"))
    return added.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("sums"))  # m numbers


def _numbers(col: pa.Array) -> np.ndarray:
    """A column as an array; lists of one length as a matrix."""
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
    return col.to_numpy(zero_copy_only=False)


def _proper(r: np.ndarray) -> np.ndarray:
    """The rotation nearest to a matrix."""
    u, _, vt = np.linalg.svd(r)
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt


def hand_eye(views: DataFrame, by: list[str], order: str, least: int = 3) -> DataFrame:
    """(by, n, success, pose): the pose of a camera on a hand, from views (by, order, hand, board) of a board that stands still.

    hand: the hand's 4x4 pose in the base; board: the board's in the camera. Neighbouring views in order give motions A of the hand and B of the camera
    with A X = X B; so do each view and the first. The turn of X is the vector that the Kronecker system of all motions takes nearest to 0; its place follows
    from the same sums. Groups with fewer than `least` views, or whose motions leave X open (all about one axis), have no success and no pose.
    """
    known = views.where(" and ".join(f"{c} is not null and size({c}) = 16 and not exists({c}, x -> x is null or isnan(x))" for c in ("hand", "board")))
    known = known.select(*by, order, *[F.col(c).cast("array<double>").alias(c) for c in ("hand", "board")])
    w = Window.partitionBy(*by).orderBy(order)
    box = F.struct("hand", "board")
    both = known.select(*by, box.alias("_now"), F.lag(box).over(w).alias("_last"), F.when(F.row_number().over(w) > 2, F.first(box).over(w)).alias("_first"))
    both = both.select(*by, "_now", F.explode(F.array("_last", "_first")).alias("_then"))
    moved = both.where("_then is not null").select(*by, F.col("_then.hand").alias("h0"), F.col("_now.hand").alias("h1"), F.col("_then.board").alias("b0"), F.col("_now.board").alias("b1"))

    def terms(c: dict[str, np.ndarray]) -> np.ndarray:
        h0, h1, b0, b1 = (c[k].reshape(-1, 4, 4) for k in ("h0", "h1", "b0", "b1"))
        a, b = np.linalg.inv(h1) @ h0, b1 @ np.linalg.inv(b0)
        ra, rb, ta, tb = a[:, :3, :3], b[:, :3, :3], a[:, :3, 3], b[:, :3, 3]
        eye = np.eye(3)
        # A's turn times X minus X times B's, of X row by row
        k = np.einsum("nij,kl->nikjl", ra, eye).reshape(-1, 9, 9) - np.einsum("ij,nlk->nikjl", eye, rb).reshape(-1, 9, 9)
        m = ra - eye
        parts = [np.einsum("nki,nkj->nij", k, k), np.einsum("nki,nkj->nij", m, m), np.einsum("nki,nj->nkij", m, tb).transpose(0, 2, 1, 3), np.einsum("nki,nk->ni", m, ta)]
        return np.column_stack([np.ones(len(a)), *(p.reshape(len(a), -1) for p in parts)])

    def solved(s: np.ndarray) -> np.ndarray | None:
        normal, mm, mt, ma = s[1:82].reshape(9, 9), s[82:91].reshape(3, 3), s[91:118].reshape(3, 3, 3), s[118:]
        values, vectors = np.linalg.eigh(normal)
        if values[1] < 1e-6 * max(values[-1], 1e-300) or np.linalg.eigvalsh(mm)[0] < 1e-9 * max(np.trace(mm), 1e-300):
            return None
        x = vectors[:, 0].reshape(3, 3)
        turn = _proper(x * (np.sign(np.linalg.det(x)) or 1.0))
        # (A's turn - 1) t = turn * B's place - A's place
        t = np.linalg.solve(mm, np.einsum("ikj,kj->i", mt, turn) - ma)
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = turn, t
        return out.ravel()

    solve = F.pandas_udf(lambda v: v.map(lambda s: solved(np.asarray(s, float))), "array<double>")
    fit = summed(moved, by, terms).select(*by, solve("sums").alias("pose"))
    count = known.groupBy(*by).agg(F.count("*").alias("n"))
    out = count.join(fit, by, "left") if by else count.crossJoin(fit)  # one row
    good = (F.col("n") >= least) & F.col("pose").isNotNull()
    return out.select(*by, "n", good.alias("success"), F.when(good, F.col("pose")).alias("pose"))


def _turn(v: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors (n, 3)."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= k.transpose(0, 2, 1)
    small = angle < 1e-8
    safe = np.where(small, 1.0, angle)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * k + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (k @ k)


def _poses(p: np.ndarray) -> np.ndarray:
    """Poses (n, 4, 4) of rotation vectors and places (n, 6)."""
    out = np.tile(np.eye(4), (len(p), 1, 1))
    out[:, :3, :3], out[:, :3, 3] = _turn(p[:, :3]), p[:, 3:]
    return out


def _vector(pose: np.ndarray) -> np.ndarray:
    """Rotation vector and place of a pose."""
    q = pose[:3, :3]
    angle = np.arccos(np.clip((np.trace(q) - 1) / 2, -1, 1))
    axis = np.array([q[2, 1] - q[1, 2], q[0, 2] - q[2, 0], q[1, 0] - q[0, 1]])
    if angle > np.pi - 1e-4:  # nearly half a turn: the axis is the vector that the turn keeps
        keeps = np.linalg.eigh((q + q.T) / 2)[1][:, -1]
        axis = keeps * (np.sign(axis @ keeps) or 1.0)
    size = np.linalg.norm(axis)
    return np.concatenate([axis / size * angle if size > 1e-12 else np.zeros(3), pose[:3, 3]])


def reprojected(params: np.ndarray, hand: np.ndarray, point: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Pixels (n, 2) of board points, by parameters (n, 13): camera on hand, board in base (rotation vector and place each), log of the board's scale."""
    camera = hand @ _poses(params[:, :6])
    at = _poses(params[:, 6:12]) @ np.concatenate([point * np.exp(params[:, 12:]), np.ones((len(point), 1))], axis=1)[:, :, None]
    seen = (np.linalg.inv(camera) @ at)[:, :3, 0]
    uv = np.einsum("nij,nj->ni", k, seen)
    return uv[:, :2] / uv[:, 2:]


def bundle_fit(sights: DataFrame, starts: DataFrame, by: list[str], huber: float = 2.0, rounds: int = 30, scale: bool = True) -> DataFrame:
    """(by, n, camera, board, scale, rms, rounds): cameras on hands and boards in bases that fit all sights best.

    sights: (by, hand, k, point, pixel), a board's point seen at a pixel, with the hand's 4x4 pose and the camera's 9 intrinsics;
    starts: (by, camera, board, scale), a first guess for each group. Errors of over `huber` pixels count by their size, not its square. Each round takes
    the normal equations of all groups as sums over their sights, weighted anew, and moves each group's 13 numbers (12 without
    `scale`) by its own damped step, which is taken back where it doesn't help; parameters stay a table. Groups without a start are left out.
    """
    m = 13 if scale else 12
    free = np.arange(13) < m

    def begin(camera: pd.Series, board: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([_vector(np.reshape(a, (4, 4))), _vector(np.reshape(b, (4, 4))), [np.log(s)]]) for a, b, s in zip(camera, board, size)])

    def terms(c: dict[str, np.ndarray]) -> np.ndarray:
        p, hand, k = c["_p"], c["hand"].reshape(-1, 4, 4), c["k"].reshape(-1, 3, 3)
        r = reprojected(p, hand, c["point"], k) - c["pixel"]
        jac = np.zeros((len(p), 2, 13))
        for j in np.flatnonzero(free):
            step = np.zeros(13)
            step[j] = 1e-6
            jac[:, :, j] = (reprojected(p + step, hand, c["point"], k) - reprojected(p - step, hand, c["point"], k)) / 2e-6
        size = np.abs(r)
        weight = np.where(size <= huber, 1.0, huber / np.maximum(size, 1e-300))
        loss = np.where(size <= huber, r * r, 2 * huber * size - huber**2).sum(axis=1)
        h = np.einsum("nai,na,naj->nij", jac, weight, jac).reshape(len(p), -1)
        return np.column_stack([np.ones(len(p)), loss, (r * r).sum(axis=1), np.einsum("nai,na,na->ni", jac, weight, r), h])

    def moved(p: pd.Series, kept: pd.Series, damp: pd.Series, sums: pd.Series) -> pd.DataFrame:
        out = []
        for now, last, lam, s in zip(p, kept, damp, sums):
            now, s = np.asarray(now, float), np.asarray(s, float)
            old = None if last is None else np.asarray(last, float)  # parameters, sums of the best so far
            better = old is None or not (s[1] > old[14])
            if better:
                lam = lam if old is None else max(lam / 10, 1e-12)
                gain = np.inf if old is None else old[14] - s[1]
                old = np.concatenate([now, s])
            else:
                lam, gain = lam * 10, np.inf
            h, g = old[13 + 3 + 13 :].reshape(13, 13)[np.ix_(free, free)], old[13 + 3 : 13 + 16][free]
            step = np.zeros(13)
            step[free] = -np.linalg.lstsq(h + lam * np.diag(np.diag(h) + 1e-12), g, rcond=None)[0]
            done = bool(lam > 1e12 or np.abs(step).max() < 1e-10 or gain <= 1e-14 * max(s[1], 1e-300))
            out.append((old[:13] + step, old, lam, done))
        return pd.DataFrame(out, columns=["_p", "_best", "_damp", "_done"])

    rows = sights.select(*by, *[F.col(c).cast("array<double>").alias(c) for c in ("hand", "k", "point", "pixel")])
    state = starts.select(*by, F.pandas_udf(begin, "array<double>")("camera", "board", F.col("scale").cast("double")).alias("_p"))
    state = written(state.select("*", F.lit(None).cast("array<double>").alias("_best"), F.lit(1e-3).alias("_damp"), F.lit(False).alias("_done"), F.lit(0).alias("rounds")), "bundle")
    step = F.pandas_udf(moved, "_p array<double>, _best array<double>, _damp double, _done boolean")
    for _ in range(rounds):
        now = state.where("not _done")
        met = rows.join(now.select(*by, "_p"), by) if by else rows.crossJoin(now.select("_p"))  # one row
        sums = summed(met, by, terms)
        new = now.join(sums, by) if by else now.crossJoin(sums)  # one row
        new = new.withColumn("_m", step("_p", "_best", "_damp", "sums")).select(*by, "_m.*", (F.col("rounds") + 1).alias("rounds"))
        state = written(state.where("_done").select(*by, "_p", "_best", "_damp", "_done", "rounds").unionByName(new), "bundle")
        if state.where("not _done").isEmpty():
            break

    @F.pandas_udf("n long, camera array<double>, board array<double>, scale double, rms double")
    def told(best: pd.Series) -> pd.DataFrame:
        rows = [np.asarray(b, float) for b in best]
        return pd.DataFrame([(int(b[13]), _poses(b[None, :6])[0].ravel(), _poses(b[None, 6:12])[0].ravel(), float(np.exp(b[12])), float(np.sqrt(b[15] / b[13]))) for b in rows], columns=["n", "camera", "board", "scale", "rms"])

    return state.where("_best is not null").withColumn("_t", told("_best")).select(*by, "_t.*", "rounds")
