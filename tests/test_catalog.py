"""Each registered query of the catalog against its DuckDB counterpart, and the streams against batch results."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from telemetra.operators import poses, summaries, windows
from telemetra.plans import catalog
from telemetra.streaming import observations

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    rows = [tuple(round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "as_tuple") else str(x) for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_lockstep_against_loops(spark):
    rows = catalog.QUERIES["lockstep_sync"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('click', 'view')").toPandas()
    within, want = pd.Timedelta(hours=6), []
    for user, g in e.groupby("user_id"):
        streams = {k: sorted(x.ts) for k, x in g.groupby("event_type")}
        at, k = dict.fromkeys(streams, 0), 0
        while all(at[s] < len(v) for s, v in streams.items()):
            now = {s: v[at[s]] - v[0] for s, v in streams.items()}
            behind = [s for s in now if max(now.values()) - now[s] > within]
            for s in behind:
                at[s] += 1
            if not behind:
                want += [(user, k, s, int(v[at[s]].value // 1000)) for s, v in streams.items()]
                k += 1
                at = {s: i + 1 for s, i in at.items()}
    assert sorted((r.user_id, r.frame, r.event_type, r.t) for r in rows) == sorted(want) and want


def test_dashboard_of_customers_without_orders(spark, tmp_path):
    """Counts of kinds are null where no order tells its kind, as in SQL."""
    spark.sql("select id as c_custkey, concat('c', id) as c_name from range(4)").write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("select * from values (0L, 10L, 'O'), (1L, 10L, 'F'), (1L, 11L, null), (2L, 12L, null), (9L, 13L, 'P') as t(o_custkey, o_orderkey, o_orderstatus)").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["status_dashboard"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["status_dashboard"](spark, str(tmp_path)).collect())) == sorted(want)
    assert (3, "c3", 0, None, None, None) in want and (2, "c2", 1, None, None, None) in want


def test_mean_rotation(spark):
    def quaternion(axis, degrees):
        return [float(np.cos(np.radians(degrees) / 2)), *(float(x * np.sin(np.radians(degrees) / 2)) for x in axis)]

    rows = [("z", quaternion((0, 0, 1), d)) for d in (10, 20, 30)] + [("z", [-x for x in quaternion((0, 0, 1), 20)]), ("one", [0.0, 0.0, 2.0, 0.0]), ("one", None), ("one", [0.0] * 4)]
    got = {r.label: (r.n, r["mean"]) for r in poses.mean_rotation(spark.createDataFrame(rows, "label string, q array<double>"), ["label"], "q").collect()}
    assert got["z"][0] == 4 and np.allclose(got["z"][1], quaternion((0, 0, 1), 20))
    assert got["one"][0] == 1 and np.allclose(np.abs(got["one"][1]), [0, 0, 1, 0])
    assert catalog.QUERIES["mean_rotations"](spark, SF).count() > 0


def test_windows_keep_nulls_inside(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, None, 3.0, 4.0, 50.0])], "u int, k int, v double")
    w = {r["index"]: r.window for r in windows.clamped(rows, "u", ["k"], "v", 1, 1).collect()}
    assert w[0] == [1.0, 1.0, None] and w[1] == [1.0, None, 3.0] and w[4] == [4.0, 50.0, 50.0]
    assert [r["index"] for r in windows.usable(windows.clamped(rows, "u", ["k"], "v", 1, 1), 1, 1, 0.5).collect()] == [3, 4]


def test_combined_moments(spark):
    parts = spark.createDataFrame([("a", 100, 1e9, 1.0), ("a", 100, 1e9 + 1, 1.0), ("b", 1, 5.0, None), ("c", 0, None, None)], "g string, n long, mean double, std double")
    got = {r.g: (r.n, r["mean"], r.std) for r in summaries.combined(parts, ["g"]).collect()}
    assert abs(got["a"][2] - 1.1168) < 1e-3 and got["a"][1] == 1e9 + 0.5 and got["b"] == (1, 5.0, 0.0) and "c" not in got


def test_stream_equals_batch(spark, tmp_path):
    """Windows that the watermark has closed are those of the batch, row by row."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = observations.windowed(observations.once(stream, "ts", ["event_id"]), "ts", "event_type", "value", late=None).writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    told = lambda df: {(r.window.start, r.event_type): (r.n, round(r["mean"], 6)) for r in df.collect()}
    seen, batch = told(spark.table("seen")), told(observations.windowed(events, "ts", "event_type", "value"))
    last = max(k[0] for k in seen)
    assert seen == {k: v for k, v in batch.items() if k[0] <= last} and len(seen) > 0.9 * len(batch)
