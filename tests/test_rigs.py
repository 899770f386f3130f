"""Small changes of a rig's tables, and errors that they raise."""

import pytest
from pyspark.sql import functions as F

from telemetra.operators import rigs


def test_cameras(spark):
    c = spark.createDataFrame([("a", "1", "zed", "scene"), ("b", "2", "zed", None)], "name string, serial string, type string, role string")
    with pytest.raises(Exception, match="invalid role: front"):
        rigs.with_camera(c, c.limit(1).withColumn("role", F.lit("front"))).collect()
    assert [r.name for r in rigs.without_camera(c, "a").collect()] == ["b"] and rigs.by_serial(c, F.lit(2)).first().name == "b"


def test_poses_are_numbered_on_and_taken_back(spark):
    p = spark.createDataFrame([(1, "x"), (4, "y")], "id long, name string")
    more = rigs.appended(p, spark.createDataFrame([("z",)], "name string"))
    assert sorted(map(tuple, more.collect())) == [(1, "x"), (4, "y"), (5, "z")]
    assert sorted(map(tuple, rigs.without_last(more).collect())) == [(1, "x"), (4, "y")]


def test_intrinsics_need_a_centre_crop():
    with pytest.raises(ValueError, match="not a centre crop"):
        rigs.recorded_intrinsics(None, (848, 480), (640, 360))
    assert rigs.measured_columns(["action", "observation.depth.a"]) == ["action"]


def test_base_transform(spark):
    rows = [("a", [1.0, 0.0, 0.0, 0.0], 1.0, 2.0, 3.0), ("a", [-1.0, 0.0, 0.0, 0.0], 3.0, 2.0, 3.0)]
    r = rigs.base_transform(spark.createDataFrame(rows, "g string, q array<double>, x double, y double, z double"), ["g"], "q", ["x", "y", "z"]).first()
    assert [abs(round(v, 9)) for v in r["mean"]] == [1, 0, 0, 0] and (r.n, r.x, r.y, r.z) == (2, 2.0, 2.0, 3.0)


def test_calibration_of_a_rig(spark):
    c = spark.createDataFrame([("scene", [1.0], None), ("wrist", None, [2.0]), ("none", None, None)], "camera string, base_pose array<double>, tool_pose array<double>")
    assert {r.camera: (r.hand_eye, r.extrinsics, r.success) for r in rigs.rig_calibration(c).collect()} == {"scene": (None, [1.0], True), "wrist": ([2.0], None, False), "none": (None, None, False)}
    cams = spark.createDataFrame([("a", "left_wrist"), ("b", "scene"), ("c", "right_wrist")], "name string, role string")
    assert {r.name: r.joints for r in rigs.wrist_joints(cams).collect()} == {"a": "follower_l_joint_pos", "c": "follower_r_joint_pos"}
