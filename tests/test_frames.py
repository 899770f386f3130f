"""Frames built from telemetry against plain interpolation, and the transforms of cameras."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import frames
from telemetra.sinks import datasets
from telemetra.sources import episodes

TURN = np.diag([-1.0, -1.0, 1.0, 1.0])


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows, asked, want = [], [], {}
    for e in range(3):
        ts = np.sort(rng.choice(1000, 30, replace=False))
        q = rng.normal(size=(30, 4))
        rows += [(e, int(t), [float(x) for x in v]) for t, v in zip(ts, q)]
        for k, t in enumerate([ts[0], ts[-1], *rng.integers(ts[0], ts[-1], 20)]):
            asked.append((e, k, int(t)))
            want[e, k] = [np.interp(t, ts, q[:, j]) for j in range(4)]
    f = spark.createDataFrame(asked, "e int, row int, t long")  # a column named like one of the operator's own
    samples = spark.createDataFrame(rows + rows[:5], "e int, t long, q array<double>")
    got = {(r.e, r["row"]): r.q for r in frames.vectors_at(f, samples, ["e"], "t", ["q"]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_frames_outside_and_empty(spark):
    samples = spark.createDataFrame([(1, 10, [1.0]), (1, 20, None), (1, 30, [3.0])], "e int, t long, q array<double>")
    ask = lambda *ts: frames.vectors_at(spark.createDataFrame([(e, t) for e, t in ts], "e int, t long"), samples, ["e"], "t", ["q"])
    assert [r.q for r in ask((1, 10), (1, 30)).orderBy("t").collect()] == [[1.0], [3.0]] and ask((1, 15)).first().q is None
    for bad in ((1, 9), (1, 31), (2, 10)):
        with pytest.raises(Exception, match="outside the telemetry"):
            ask(bad).collect()
    assert ask().count() == 0


def test_commands_keep_the_gripper_binary(spark):
    df = spark.createDataFrame([([0.5] * 6 + [g],) for g in (0.49, 0.5, 0.9)] + [(None,), ([],)], "q array<double>")
    got = [r.c for r in df.select(frames.commanded(F.col("q")).alias("c")).collect()]
    assert [c[6] for c in got[:3]] == [0.0, 1.0, 1.0] and got[0][:6] == [0.5] * 6 and got[3:] == [None, []]


def test_camera_transforms(spark):
    rng = np.random.default_rng(1)
    pose = np.vstack([rng.normal(size=(3, 4)), [0, 0, 0, 1]])
    flat = [float(x) for x in pose.flatten()]
    names = "camera string, wrist boolean, flip boolean, opened boolean, fx double, fy double, cx double, cy double, width int, height int, hand_eye array<double>, solved boolean, extrinsics array<double>, success boolean, reference_frame string"
    row = lambda name, wrist, flip, opened, solved, success, ref="left_arm_base": (name, wrist, flip, opened, 400.0, 410.0, 300.0, 200.0, 640, 480, flat, solved, flat, success, ref)
    rows = [row("turned", True, True, True, True, False), row("wrist", True, False, True, True, False), row("bare", True, None, True, None, False), row("scene", False, False, True, False, True), row("unknown", None, False, True, False, False), row("shut", False, True, False, False, True)]
    got = {r.camera: r for r in frames.camera_transforms(spark.createDataFrame(rows, names)).collect()}
    assert np.allclose(np.reshape(got["turned"].tool, (4, 4)), pose @ TURN) and got["turned"].intrinsics == [400, 0, 339, 0, 410, 279, 0, 0, 1]
    assert got["wrist"].tool == flat and got["wrist"].extrinsics is None and got["wrist"].note is None
    assert got["bare"].tool is None and got["bare"].note == "no hand-eye calibration"
    assert got["scene"].extrinsics == flat and got["scene"].tool is None
    assert np.allclose(np.reshape(got["unknown"].extrinsics, (4, 4)), np.eye(4)) and got["unknown"].note == "no extrinsics"
    assert got["shut"].intrinsics == [1, 0, 0, 0, 1, 0, 0, 0, 1] and got["shut"].note == "not opened"
    small = {r.camera: r for r in frames.camera_transforms(spark.createDataFrame(rows, names), resize=(320, 120)).collect()}
    assert np.allclose(small["wrist"].intrinsics, [200, 0, 150, 0, 102.5, 50, 0, 0, 1])
    with pytest.raises(Exception, match="extrinsics not in left_arm_base: far"):
        frames.camera_transforms(spark.createDataFrame([row("far", False, False, True, False, True, "world")], names)).collect()


def test_calibrations_round_trip(spark, tmp_path):
    pose = [float(k) for k in range(12)] + [0.0, 0.0, 0.0, 1.0]
    rows = [("t", "e1", "b", pose, None, False), ("t", "e1", "a", None, pose, True), ("t", "e2", "a", None, None, None)]
    cameras = spark.createDataFrame(rows, "task string, episode string, camera string, hand_eye array<double>, extrinsics array<double>, success boolean")
    datasets.documents(datasets.calibration_results(cameras), str(tmp_path / "store"))
    back = episodes.calibrations(spark, str(tmp_path / "store"), "*.txt").select("task", "episode", "camera", "hand_eye", "extrinsics", "success")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(*r[:5], bool(r[5])) for r in rows], key=str)


def test_recordings_without_commands(spark):
    f = spark.createDataFrame([("t", "e", 0, 5)], "task string, episode string, frame_idx int, t_ns long")
    tel = spark.createDataFrame([("t", "e", 5, [0.0] * 6, [0.5], None)], "task string, episode string, t_ns long, joint_pos array<float>, gripper_pos array<float>, joint_cmd array<float>")
    none = spark.createDataFrame([], "task string, episode string, camera string, intrinsics array<double>, extrinsics array<double>, task_name string, task_instruction string, table_pose array<double>")
    with pytest.raises(Exception, match="no commands in t/e"):
        frames.built(f, tel, none, none).collect()
    r = frames.built(f, tel.withColumn("joint_cmd", F.array_repeat(F.lit(0.7), 7)), none, none).first()
    assert r.joints == [0.0] * 6 + [0.5] and r.action_joints[6] == 1.0 and r.intrinsics is None and r.language_task is None


def test_openings(spark):
    from telemetra.operators.align import LEAST_OPENING, opening

    values = [-1.0, 0.0, 0.2, 0.5, 1.0, 2.0, None, float("nan"), float("inf")]
    got = [r.o for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(opening(F.col("v")).alias("o")).collect()]
    assert got == [LEAST_OPENING] * 3 + [0.5, 1.0, 1.0, None, None, 1.0]
