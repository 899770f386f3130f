"""Walls, deletions and tracking reports on small fixtures with nulls, ties and empty tables."""

import numpy as np

from telemetra.operators import layouts, records

WALL = "layout int, normal array<double>, center array<double>, u array<double>, offset double, extent array<double>, z_extent array<double>, rgb array<double>, n_points long"
TABLE = "layout int, x0 double, x1 double, y0 double, y1 double, table_z double"


def wall(layout, normal, center, u, offset=0.6, extent=(-0.2, 0.9), n=100):
    return (layout, [float(x) for x in normal], [float(x) for x in center], [float(x) for x in u], offset, list(extent), [0.0, 1.0], [0.1, 0.2, 0.3], n)


def test_taped_walls(spark):
    end, side, floor = ((0, 1, 0), (0.3, -0.58, 0.4), (1, 0, 0)), ((-1, 0, 0), (0.95, 0, 0.4), (0, 1, 0)), ((0, 0, 1), (0.2, 0, 0), (0, 1, 0))
    rows = [wall(1, *end), wall(1, *side, n=70), wall(1, *floor), wall(2, *end), wall(2, *end), wall(2, *side), wall(3, *floor)]
    tables = spark.createDataFrame([(k, 0.0, 0.9, -0.6, 0.65, 0.05) for k in (1, 2, 3, 4)], TABLE)
    got = layouts.taped_walls(spark.createDataFrame(rows, WALL), tables, 1.2, 0.3).collect()
    mine = {r.wall: r for r in got if r.layout == 1}
    assert set(mine) == {"end", "far end", "side", "seen"} and all(r.problem is None for r in mine.values())
    for name, n, a, b, points in (("end", (0, 1, 0), (-0.2, -0.6), (0.92, -0.6), 100), ("far end", (0, -1, 0), (-0.2, 0.65), (0.92, 0.65), 0), ("side", (-1, 0, 0), (0.9, -0.62), (0.9, 0.67), 70)):
        r, u = mine[name], np.cross(n, [0, 0, 1])
        assert np.allclose(r.normal, n) and np.allclose(r.u, u) and np.isclose(r.offset, -(n[0] * a[0] + n[1] * a[1])) and r.n_points == points
        assert np.allclose(r.extent, sorted([u[:2] @ a, u[:2] @ b])) and np.allclose(r.center, [*((np.array(a) + b) / 2), 0.05 + 0.75])
        assert np.allclose(r.z_extent, [0.35, 1.25]) and r.rgb == [0.1, 0.2, 0.3]
    assert [r.problem for r in got if r.layout == 2] == ["expected one end and one side, found 2 and 1"] * 3
    assert [r.problem for r in got if r.layout == 3] == ["expected one end and one side, found 0 and 0"]
    assert layouts.taped_walls(spark.createDataFrame([], WALL), tables, 1.0, 0.2).count() == 0


def test_cascaded(spark):
    demos = spark.createDataFrame([(1, "raw/a", "conv/a"), (2, "raw/ab", None), (3, None, "conv/x"), (4, "raw/c", None)], "id long, raw_path string, converted_path string")
    results = spark.createDataFrame([("raw/a", 1), ("raw/a", 2), ("raw/ab", 3), (None, 4)], "raw_path string, n int")
    files = spark.createDataFrame([("raw/a/x.json",), ("raw/a/b/y.bin",), ("raw/ab/x.json",), ("conv/a/p",), ("conv/x/p",), ("raw/d/z",), (None,), ("top",)], "path string")
    gone = spark.createDataFrame([("raw/a",), ("raw/a",), ("raw/c",), ("raw/d",), ("raw/none",), (None,)], "raw_path string")
    out = {k: sorted(map(tuple, v.collect()), key=str) for k, v in records.cascaded(demos, results, files, gone).items()}
    assert [r[0] for r in out["demos"]] == [2, 3] and out["backup"] == sorted(map(tuple, demos.collect()), key=str)
    assert out["removed"] == [("conv/a/p",), ("raw/a/b/y.bin",), ("raw/a/x.json",), ("raw/d/z",)] and out["unknown"] == [("raw/none",)]
    assert out["files"] == [("conv/x/p",), ("raw/ab/x.json",), ("top",), (None,)] and [r[1] for r in out["results"]] == [3, 4]
    same = records.cascaded(demos, results, files, gone.where("false"))
    assert same["demos"].count() == 4 and same["files"].count() == 8 and same["removed"].count() == 0


def test_cascaded_broadcasts_nothing(spark):
    """Tables that seem small on disk stay out of the driver."""
    demos = spark.range(50).selectExpr("id", "concat('raw/', id) raw_path", "if(id % 3 = 0, concat('conv/', id), null) converted_path")
    files = demos.selectExpr("concat(raw_path, '/a') path")
    out = records.cascaded(demos, demos.select("raw_path"), files, demos.where("id < 5").select("raw_path"))
    assert {k: v.count() for k, v in out.items()} == {"demos": 45, "results": 45, "files": 45, "removed": 5, "backup": 50, "unknown": 0}
    for df in out.values():
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_tracking_states(spark):
    lines = [
        (1, 1, "Paired device: Type:  Right, TrackingStatus:  POSITION"),
        (1, 2, "Type: Left TrackingStatus: ORIENTATION_ONLY x"),
        (1, 3, "Type: Right TrackingStatus: NONE"),
        (1, 4, "Type: Right"),
        (1, 5, "TrackingStatus: POSITION"),
        (1, 6, "Type: Middle TrackingStatus: POSITION"),
        (2, 1, None),
        (None, 1, "Type: Left TrackingStatus: NONE"),
    ]
    df = spark.createDataFrame(lines, "d int, i int, line string")
    assert {tuple(r) for r in records.tracking_states(df, "d", "i", "line").collect()} == {(1, "r", "NONE"), (1, "l", "ORIENTATION_ONLY"), (None, "l", "NONE")}
