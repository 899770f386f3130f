"""Streams in several batches against loops over the same rows in order."""

import json
import os

import pytest

from telemetra.plans import catalog
from telemetra.streaming import observations, stateful

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def rows(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "cast(date_diff(microsecond, timestamp_ntz'1970-01-01', ts) as bigint) t", "event_type", "value")
    return sorted(map(tuple, e.collect()))


def by_user(rows):
    out = {}
    for u, t, kind, v in rows:
        out.setdefault(u, []).append((t, kind, v))
    return out


def test_limited(spark, rows):
    want = []
    for u, own in by_user(rows).items():
        last = None
        for t, _, _ in own:
            if last is None or t - last > 48 * HOUR:
                want.append((u, t))
                last = t
    assert sorted(map(tuple, catalog.QUERIES["stream_limited"](spark, SF).collect())) == sorted(want)


def test_held_and_assembled(spark, rows):
    held, assembled = [], []
    for u, own in by_user(rows).items():
        action, used, latest = None, False, {}
        for t, kind, v in own:
            latest[kind] = v
            if kind == "click":
                assembled.append((u, t, json.dumps(latest, sort_keys=True)))
            if kind == "purchase":
                action, used = (t, v), False
            elif action:
                held.append((u, t, action[1], "new" if not used else "on" if t - action[0] <= 24 * HOUR else "held"))
                used = True
    assert sorted(map(tuple, catalog.QUERIES["stream_held"](spark, SF).collect())) == sorted(held)
    assert sorted(map(tuple, catalog.QUERIES["stream_assembled"](spark, SF).collect())) == sorted(assembled)


def test_sessions_equal_the_closed_ones_of_the_batch(spark):
    batch = observations.sessions(spark.read.parquet(f"{SF}/events.parquet"), "ts", "user_id", "12 hours")
    told = lambda df: {(r.user_id, r.start): (r.last, r.n) for r in df.collect()}
    got, want = told(catalog.QUERIES["stream_sessions"](spark, SF)), told(batch)
    assert got.items() <= want.items() and len(got) > 0.9 * len(want)


def test_memory_outlives_batches(spark, tmp_path):
    """Rows in two batches give what they give in one."""
    parts = [[(1, 10, True, 0.0), (1, 5, False, 1.0)], [(1, 15, False, 3.0), (1, 20, True, 0.0), (1, 30, False, 0.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "u long, t long, frame boolean, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema("u long, t long, frame boolean, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.interpolated(stream, "u", "t", "value", "frame").writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("frames").collect())) == [(1, 10, 2.0), (1, 20, 2.0)]


def test_newest_and_watched(spark, tmp_path):
    for k, part in enumerate([[(1, 1, "a"), (2, 1, "b"), (1, 3, "c")], [(1, 2, "d"), (3, 1, "e")]]):
        spark.createDataFrame(part, "u long, t long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema("u long, t long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = observations.newest(stream, "u", "t").writeStream.format("memory").queryName("newest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = [(1, 3, "c"), (2, 1, "b"), (3, 1, "e")]
    assert sorted(map(tuple, spark.table("newest").select("u", "t", "v").collect())) == want
    observations.watched(stream, lambda df: df, str(tmp_path / "out"), "u", "t", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination(120)
    last = max(int(x) for x in os.listdir(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / str(last))).select("u", "t", "v").collect())) == want
