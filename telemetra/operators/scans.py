"""What a row's result owes to the results before it: scans that carry a small state over sorted rows.

Rows are dealt by key, sorted within each task by Spark, which spills, and then pass through a step function in Arrow
batches. Only the state of the present key and one batch are held, so a key may have any number of rows; its rows pass
through one task in order, as the state of one decides the next. Where a state can be summed up instead (`smoothed`), an
episode is cut into stretches that run side by side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import acos, isnan, sin, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .summaries import numbered

Step = Callable[[object, pa.RecordBatch], tuple[object, pa.RecordBatch | None]]
#: Rows of an episode that `smoothed` takes as one stretch.
STRETCH = 1 << 20


def scanned(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Step) -> DataFrame:
    """What `step` gives for the rows of each key, in order; `start` makes the state of a new key.

    A step gets its state and rows of one key, a part of them at a time, and gives the new state and a batch of `schema`
    or None. Null keys are a key like others.
    """
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in keys:  # a change between neighbours, nulls being equal
                col = batch.column(k)
                a, b = col.slice(0, len(col) - 1), col.slice(1)
                same = pc.equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
            cuts = [*np.flatnonzero(new), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                key = [part.column(k)[0].as_py() for k in keys]
                if now is None or key != now:
                    now, state = key, start()
                state, out = step(state, part)
                if out is not None and len(out):
                    yield out

    return sorted_rows.mapInArrow(run, schema)


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, stretch: int = STRETCH) -> DataFrame:
    """(keys, order, value) low-passed: each value is moved by `alpha` from the one before towards its own.

    A null stays null, and the next value begins anew. Rows are numbered by keys and order, and cut into stretches of `stretch`
    rows. Each is smoothed next to the others, as if there were 0 before it where a value goes on from the stretch before;
    what that one leaves at its end, times the share of it that is left at a row, is then added. The ends follow
    from one row a stretch.
    """
    dealt = numbered(rows.select(*keys, *order, F.col(value).cast("double").alias("_v")), [*keys, *order]).withColumn("_s", F.floor(F.col("_k") / stretch)).drop("_k")
    key, w = F.struct(*keys), Window.partitionBy(*keys).orderBy("_s")
    last = dealt.groupBy(*keys, "_s").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    goes_on = last.select(key.alias("_key"), F.col("_s").alias("_t"), F.lag("_last").over(w).isNotNull().alias("_on"))
    dealt = dealt.join(goes_on, (key == F.col("_key")) & (F.col("_s") == F.col("_t"))).drop("_key", "_t")

    def step(state: list | None, part: pa.RecordBatch) -> tuple[list, pa.RecordBatch]:
        y, left = state or ((0.0, 1.0) if part.column("_on")[0].as_py() else (None, 0.0))
        out, shares = [], []
        for x in part.column("_v").to_pylist():
            y = None if x is None else x if y is None else y + alpha * (x - y)
            left = 0.0 if x is None else left * (1 - alpha)
            out.append(y)
            shares.append(left)
        names = [*keys, *order, "_s"]
        return [y, left], pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(out, pa.float64()), pa.array(shares, pa.float64())], [*names, value, "_left"])

    kinds = dict(dealt.dtypes)
    typed = lambda names: ", ".join(f"`{n}` {kinds[n]}" for n in names)
    own = written(scanned(dealt, [*keys, "_s"], order, f"{typed([*keys, *order, '_s'])}, `{value}` double, _left double", lambda: None, step), "smoothed")
    ends = own.groupBy(*keys, "_s").agg(F.max_by(F.struct(F.col(value).alias("y"), F.col("_left").alias("k")), F.struct(*order)).alias("_end"))

    def follow(before: float | None, part: pa.RecordBatch) -> tuple[float | None, pa.RecordBatch]:
        told = []
        for e in part.column("_end").to_pylist():
            told.append(before)
            before = e["y"] + e["k"] * before if e["k"] and before is not None else e["y"]
        return before, pa.RecordBatch.from_arrays([*[part.column(n) for n in [*keys, "_s"]], pa.array(told, pa.float64())], [*keys, "_s", "_before"])

    ends = scanned(ends, keys, ["_s"], f"{typed([*keys, '_s'])}, _before double", lambda: None, follow)
    ends = ends.where("_before is not null").select(key.alias("_key"), F.col("_s").alias("_t"), "_before")
    out = own.join(ends, (key == F.col("_key")) & (F.col("_s") == F.col("_t")), "left")
    carried = F.when(F.col("_left") > 0, F.col("_left") * F.col("_before"))
    return out.select(*keys, *order, (F.col(value) + F.coalesce(carried, F.lit(0.0))).alias(value))


def _slerp(a: list[float], b: list[float], share: float) -> list[float]:
    """The unit quaternion that far on the shortest way from a to b."""
    d = sum(x * y for x, y in zip(a, b))
    b = b if d >= 0 else [-x for x in b]
    d = min(1.0, abs(d))
    if d > 1 - 1e-12:
        mixed = [x + share * (y - x) for x, y in zip(a, b)]
    else:
        angle = acos(d)
        u, v = sin((1 - share) * angle), sin(share * angle)
        mixed = [(u * x + v * y) / sin(angle) for x, y in zip(a, b)]
    n = sqrt(sum(x * x for x in mixed))
    return [x / n for x in mixed]


def _quaternion(r: np.ndarray) -> list[float]:
    """Unit quaternion (w, x, y, z) of a rotation, from the largest of its four squares."""
    m = r.reshape(3, 3)
    squares = [1 + m[0, 0] + m[1, 1] + m[2, 2], 1 + m[0, 0] - m[1, 1] - m[2, 2], 1 - m[0, 0] + m[1, 1] - m[2, 2], 1 - m[0, 0] - m[1, 1] + m[2, 2]]
    k = int(np.argmax(squares))
    s = 2 * sqrt(max(squares[k], 1e-300))
    off = [m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]]
    if k == 0:
        q = [s / 4, *(x / s for x in off)]
    else:
        i = k - 1
        q = [off[i] / s, 0.0, 0.0, 0.0]
        for j in range(3):
            q[j + 1] = s / 4 if j == i else (m[i, j] + m[j, i]) / s
    n = sqrt(sum(x * x for x in q))
    return [x / n for x in q]


def _matrix(q: list[float], xyz: list[float]) -> list[float]:
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), xyz[0], 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), xyz[1], 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), xyz[2], 0.0, 0.0, 0.0, 1.0]


def smoothed_poses(rows: DataFrame, keys: list[str], order: list[str], pose: str, alpha: float) -> DataFrame:
    """(keys, order, pose) of 4x4 poses low-passed: place and rotation are moved by `alpha` of the way from those before.

    A rotation goes along the shortest way to its own. A null pose, or one that isn't all numbers, stays null, and the next begins anew.
    """

    def step(state, part: pa.RecordBatch) -> tuple[object, pa.RecordBatch]:
        out = []
        for t in part.column(pose).to_pylist():
            if t is None or len(t) != 16 or any(x is None or isnan(x) for x in t):
                state = None
                out.append(None)
                continue
            m = np.array(t, float).reshape(4, 4)
            place, turn = [float(x) for x in m[:3, 3]], _quaternion(m[:3, :3])
            if state is None:
                state = (place, turn)
            else:
                state = ([a + alpha * (b - a) for a, b in zip(state[0], place)], _slerp(state[1], turn, alpha))
            out.append(_matrix(state[1], state[0]))
        names = [*keys, *order]
        return state, pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(out, pa.list_(pa.float64()))], [*names, pose])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in [*keys, *order]) + f", `{pose}` array<double>"
    return scanned(rows.select(*keys, *order, F.col(pose).cast("array<double>").alias(pose)), keys, order, schema, lambda: None, step)


def lockstep(rows: DataFrame, key: str, stream: str, t: str, within: int) -> DataFrame:
    """(key, frame, stream, t): frames that all streams of an episode have within `within` of each other.

    Times count from each stream's first. As long as the latest of the streams' present frames is more than `within`
    ahead of others, those move on. Rows come in order of elapsed time, so a waiting frame that is too far behind the present row
    can never be taken and goes at once: what is held is the frames within `within`, not the episode. An episode is
    done with the last frame of the stream that ends first.
    """
    timed = rows.select(key, stream, t).where(F.col(t).isNotNull() & F.col(stream).isNotNull())
    firsts = timed.groupBy(key, stream).agg(F.min(t).alias("_first"))
    known = Window.partitionBy(key)
    firsts = firsts.withColumn("_streams", F.count("*").over(known))
    firsts = firsts.select(F.col(key).alias("_k"), F.col(stream).alias("_n"), "_first", "_streams")
    timed = timed.join(firsts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(stream) == F.col("_n")))
    timed = timed.select(key, stream, t, (F.col(t) - F.col("_first")).alias("_e"), "_streams")

    def step(state, part: pa.RecordBatch):
        frame, waiting = state
        names, frames, streams, times = part.column(stream).to_pylist(), [], [], []
        n = part.column("_streams")[0].as_py()
        for name, at, e in zip(names, part.column(t).to_pylist(), part.column("_e").to_pylist()):
            waiting.setdefault(name, deque()).append((e, at))
            for q in waiting.values():
                while q and e - q[0][0] > within:
                    q.popleft()
            # heads within reach of each other are taken together; those behind were dropped above or are dropped now
            while len(waiting) == n and all(waiting.values()):
                late = max(q[0][0] for q in waiting.values())
                behind = [q for q in waiting.values() if late - q[0][0] > within]
                for q in behind:
                    while q and late - q[0][0] > within:
                        q.popleft()
                if not behind:
                    for name_, q in waiting.items():
                        frames.append(frame)
                        streams.append(name_)
                        times.append(q.popleft()[1])
                    frame += 1
        keys = pa.array([part.column(key)[0].as_py()] * len(frames), part.schema.field(key).type)
        out = [keys, pa.array(frames, pa.int64()), pa.array(streams, part.schema.field(stream).type), pa.array(times, part.schema.field(t).type)]
        return (frame, waiting), pa.RecordBatch.from_arrays(out, [key, "frame", stream, t])

    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, frame long, `{stream}` {kinds[stream]}, `{t}` {kinds[t]}"
    return scanned(timed, [key], ["_e", stream, t], schema, lambda: (0, {}), step)
