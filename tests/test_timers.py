"""Timers over several triggers, with silent, late and dead keys, against loops over all rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from telemetra.streaming import timers

HOLD, WARN, FORGET = 500, 2000, 10_000


def run(spark, tmp_path, rows, batches, make, name):
    """What `make` gives of rows (key, ms, value) that come in that many files, one a trigger; and the rows of its state."""
    size = -(-len(rows) // batches)
    for k in range(batches):
        part = rows[k * size : (k + 1) * size]
        spark.createDataFrame(part, "k string, ts long, v double").withColumn("ts", F.timestamp_millis("ts")).coalesce(1).write.parquet(str(tmp_path / name / f"b={k}"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name / "b=*"))
    q = make(timers.marked(stream, "ts", "1 second")).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    left = q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    told = [tuple(round(x.timestamp() * 1000) if hasattr(x, "timestamp") else x for x in r) for r in spark.table(name).collect()]
    return sorted(told), left


@pytest.fixture(scope="module")
def rows():
    rng, t, out = random.Random(3), 1_000_000, []
    for k in range(240):
        t += rng.choice([5, 100, 300, 300, 900, 4000])
        out.append((rng.choice("abc") if k < 120 else rng.choice("bcd"), t, rng.choice([None, 1.0, 2.0, 3.0])))
    out.append(("z", t + 60_000, None))  # far ahead: all others are silent
    return out


def silences(rows, mark):
    out = []
    for k in sorted({r[0] for r in rows}):
        times = sorted(t for a, t, _ in rows if a == k)
        for t, nxt in zip(times, [*times[1:], None]):
            gap = nxt - t if nxt is not None else mark + 1 - t
            out += [(k, t + after, state) for state, after in (("hold", HOLD), ("warn", WARN)) if gap > after]
            if nxt is not None and HOLD < gap <= FORGET:
                out.append((k, nxt, "back"))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_silence(spark, tmp_path, rows, batches):
    got, left = run(spark, tmp_path, rows, batches, lambda s: timers.silence(s, "k", "ts", HOLD, WARN, FORGET), f"silence{batches}")
    zone = got[0][1] - silences(rows, rows[-1][1] - 1000)[0][1]  # the collected stamps are in the driver's zone
    assert [(k, t - zone, s) for k, t, s in got] == silences(rows, rows[-1][1] - 1000)
    assert left == 1  # of the dead keys none is remembered


@pytest.mark.parametrize("batches", [1, 5])
def test_commanded_and_limited(spark, tmp_path, rows, batches):
    mark, want = rows[-1][1] - 1000, []
    for k in "abcd":
        acts = sorted((t, v) for a, t, v in rows if a == k and v is not None)
        for (t, v), nxt in zip(acts, [*acts[1:], None]):
            want.append((k, t, v, "new"))
            if (nxt[0] if nxt else mark + 1) - t > 1000:
                want.append((k, t + 1000, v, "held"))
    got, left = run(spark, tmp_path, rows, batches, lambda s: timers.commanded(s, "k", "ts", "v", 1000, FORGET), f"commanded{batches}")
    zone = got[0][1] - sorted(want)[0][1]
    assert [(k, t - zone, v, s) for k, t, v, s in got] == sorted(want) and left == 0
    want = []
    for k in "abcdz":
        last = None
        for t in sorted(t for a, t, _ in rows if a == k):
            if last is None or t - last > 2000:
                want.append((k, t))
                last = t
    got, left = run(spark, tmp_path, rows, batches, lambda s: timers.limited(s, "k", "ts", 2000), f"limited{batches}")
    assert [(k, t - zone) for k, t in got] == sorted(want) and left == 1


def test_late_rows_change_nothing(spark, tmp_path):
    rows = [("a", 10_000, 1.0), ("b", 10_000, 1.0), ("a", 9_500, 2.0), ("a", 10_300, 3.0), ("b", 40_000, 1.0), ("a", 12_000, 9.0)]
    got, _ = run(spark, tmp_path, rows, 6, lambda s: timers.silence(s, "k", "ts", HOLD, WARN, FORGET), "late")
    zone = got[0][1] - 10_800
    # the row at 9.5 s is older than the newest one; that at 12 s comes when the watermark is at 39 s
    assert [(k, t - zone, s) for k, t, s in got] == [("a", 10_800, "hold"), ("a", 12_300, "warn"), ("b", 10_500, "hold"), ("b", 12_000, "warn")]


@pytest.mark.parametrize("batches", [1, 3])
def test_null_actions_hold_nothing(spark, tmp_path, batches):
    # the watermark ends at 11.2 s: before 11.5 s, when a's command would be held, and which only rows without an action have passed
    rows = [("a", 10_500, 1.0), ("b", 10_000, 2.0), ("a", 12_000, None), ("b", 12_100, None), ("b", 12_150, 3.0), ("c", 12_200, None)]
    got, left = run(spark, tmp_path, rows, batches, lambda s: timers.commanded(s, "k", "ts", "v", 1000, FORGET), f"nulls{batches}")
    zone = got[0][1] - 10_500
    assert [(k, t - zone, v, s) for k, t, v, s in got] == [("a", 10_500, 1.0, "new"), ("b", 10_000, 2.0, "new"), ("b", 11_000, 2.0, "held"), ("b", 12_150, 3.0, "new")] and left == 2
