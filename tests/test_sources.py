"""Documents, listings and tables of a small episode store, read and written."""

import json
import math

import pytest
from pyspark.sql import functions as F

from telemetra.operators import records
from telemetra.sinks import datasets
from telemetra.sources import episodes

IDENTITY = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


@pytest.fixture()
def store(tmp_path):
    for task, name, complete in (("pour", "0000", True), ("pour", "0001", False), ("wipe", "0000", True)):
        ep = tmp_path / task / name
        ep.mkdir(parents=True)
        (ep / "metadata.json").write_text(json.dumps({"task_name": task, "duration_s": 12.5, "complete": complete, "cameras": ["a"], "camera_start_times_ns": {"a": 1 << 60}}, indent=1))
    (tmp_path / "wipe" / "0000" / "calibration_results.json").write_text(json.dumps({"version": "1", "cameras": {"a": {"hand_eye_calibration": {"rotation_matrix": IDENTITY, "translation_vector": [1, 2, 3]}}, "b": {"extrinsics": {"success": True, "rotation_matrix": IDENTITY, "translation_vector": [4, 5, 6]}}, "c": {}}}))
    bad = tmp_path / "wipe" / "0001"
    bad.mkdir()
    (bad / "metadata.json").write_text("{broken")
    return tmp_path


def test_documents_and_listings(spark, store):
    rows = {(r.task, r.episode): r for r in episodes.recordings(spark, str(store)).collect()}
    assert len(rows) == 4 and rows["pour", "0001"].complete is False and rows["pour", "0000"].camera_start_times_ns == {"a": 1 << 60}
    assert rows["wipe", "0001"].broken and rows["wipe", "0001"].duration_s is None
    assert sorted((r.task, r.episode) for r in episodes.listing(spark, str(store), "metadata.json").collect()) == sorted(rows)
    assert {r.task: r.episodes for r in episodes.tasks(spark, str(store), "metadata.json").collect()} == {"pour": 2, "wipe": 2}
    cal = {r.camera: r for r in episodes.calibrations(spark, str(store)).collect()}
    assert cal["a"].hand_eye == [1, 0, 0, 1, 0, 1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1] and cal["a"].extrinsics is None
    assert cal["b"].success and cal["b"].extrinsics[3] == 4 and cal["c"].hand_eye is None and not cal["c"].success


def test_log_of_sessions(spark, tmp_path):
    (tmp_path / "sessions.jsonl").write_text('{"started": "2026-01-02T10:00:00", "teacher": "b"}\nnot json\n{"teacher": "x"}\n{"started": "soon"}\n{"started": "2026-01-01T10:00:00", "teacher": "a"}\n')
    assert [r.teacher for r in episodes.logged(spark, str(tmp_path / "sessions.jsonl")).collect()] == ["a", "b"]


def test_telemetry_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("t", "0001", k, k * 10, "l", [float(k)] * 6, [0.5]) for k in range(5)] + [("t", "0002", 0, 3, "l", [0.0] * 6, [1.0])], "task string, episode string, sample_idx int, t_ns bigint, arm string, joint_pos array<float>, gripper_pos array<float>")
    datasets.telemetry(datasets.seven(rows), str(tmp_path / "written"))
    back = spark.read.parquet(str(tmp_path / "written"))
    assert back.count() == 6 and back.where("t_ns = 40").first().joint_pos_7d == [4.0] * 6 + [0.5]
    ep = tmp_path / "store" / "t" / "0001"
    rows.where("episode = '0001'").drop("task", "episode").coalesce(1).write.parquet(str(ep / "robot_data.parquet"))
    for f in (ep / "robot_data.parquet").glob("part-*.parquet"):
        f.rename(ep / "file.tmp")
    for f in (ep / "robot_data.parquet").glob("*"):
        f.unlink()
    for f in (ep / "robot_data.parquet").glob(".*"):
        f.unlink()
    (ep / "robot_data.parquet").rmdir()
    (ep / "file.tmp").rename(ep / "robot_data.parquet")
    got = episodes.telemetry(spark, str(tmp_path / "store"))
    assert [(r.task, r.episode, r.t_ns, r.joint_cmd) for r in got.orderBy("t_ns").collect()] == [("t", "0001", k * 10, None) for k in range(5)]
    with pytest.raises(Exception, match="joint_cmd is missing"):
        episodes.table(spark, str(tmp_path / "store"), "robot_data.parquet", episodes.TELEMETRY, ["joint_cmd"]).collect()


def test_merged_padded_and_shots(spark):
    a, b = (spark.createDataFrame(x, "t long, v string") for x in ([(3, "a3"), (1, "a1")], [(1, "b1"), (2, "b2")]))
    assert [r.v for r in episodes.merged([a, b], "t").collect()] == ["a1", "b1", "b2", "a3"]
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    filled = datasets.padded(rows, ["v"], [])
    assert {r.k: (len(r.v), r.length) for r in filled.collect()} == {1: (2, 1), 2: (2, 2)} and math.isnan(filled.where("k = 1").first().v[1])
    assert {r.k: r.v for r in episodes.unpadded(filled, ["v"], "length").collect()} == {1: [1.0], 2: [1.0, 2.0]}
    shots = spark.createDataFrame([("x", "base"), ("y", "world")], "name string, reference_frame string")
    assert episodes.shots(shots, ["x"], "base").count() == 1
    with pytest.raises(Exception, match="not in this frame: y"):
        episodes.shots(shots, None, "base").collect()
    one = lambda name: spark.range(1).select(F.lit(1).alias(name))
    assert episodes.geometry(one("a"), one("b"), one("c")).first().asDict() == {"a": 1, "b": 1, "c": 1}


def test_shards_and_documents(spark, tmp_path):
    rows = spark.range(250).select(F.col("id").alias("index"), F.lit("e").alias("episode"), F.array(F.col("id").cast("double")).alias("window"))
    made = datasets.samples(rows, {"action": F.col("window")}, {"anchor": F.col("index")})
    assert made.select("sample_id").distinct().count() == 250 and json.loads(made.where("index = 7").first().metadata) == {"anchor": 7}
    shards = datasets.shards(made, ["index"], 100, str(tmp_path / "shards"))
    assert [(r.shard, r.n) for r in shards.collect()] == [(0, 100), (1, 100), (2, 50)]
    datasets.manifest(shards, str(tmp_path / "manifest"))
    lines = [json.loads(x) for f in (tmp_path / "manifest").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(x["shard"] for x in lines) == ["shard_000000", "shard_000001", "shard_000002"] and sum(x["num_sequences"] for x in lines) == 250
    run = datasets.run_metadata({"samples": made, "shards": shards}, {"b": "2", "a": "1"}).first()
    assert json.loads(run.counts) == {"samples": 250, "shards": 3} and run.config == '{"a":"1","b":"2"}'
    stats = made.selectExpr("'action' as key", "action[0] as v").groupBy("key").agg(F.avg("v").alias("mean"))
    assert json.loads(datasets.statistics(stats, "key").first().json) == {"mean": 124.5}
    wide = datasets.wide(spark.createDataFrame([("e", 3, [1.0, 2.0])], "episode string, frame_idx int, joints array<double>"), {"joints": records.dimension_names(2, ["x", "y"])}, 30.0)
    assert wide.first().asDict() == {"episode": "e", "frame_idx": 3, "timestamp": 0.1, "joints.l_x": 1.0, "joints.l_y": 2.0}


def test_metadata_and_patches(spark):
    frames = spark.createDataFrame([("t", "0", k, c) for k in range(3) for c in "ab"], "task string, episode string, frame_idx int, camera string")
    recordings = spark.createDataFrame([("t", "0", "name", "")], "task string, episode string, task_name string, task_instruction string")
    r = datasets.episode_metadata(frames, recordings, 30.0).first()
    assert (r.num_frames, r.cameras, r.seconds, r.language) == (3, ["a", "b"], 0.1, "name")
    assert json.loads(datasets.metadata(recordings).first().json) == {"task_instruction": "", "task_name": "name"}
    rig = spark.createDataFrame([('{"b":"1","a":"2"}',)], "j string")
    assert rig.select(datasets.patched(F.col("j"), {"b": F.lit(5), "c": F.lit(6)}).alias("j")).first().j == '{"a":"2","b":"5","c":"6"}'
    cameras = spark.createDataFrame([("b", None, [1.0]), ("a", [2.0], None)], "camera string, hand_eye array<double>, extrinsics array<double>")
    assert json.loads(datasets.calibration(cameras, {"version": F.lit("1")}).first().json) == {"version": "1", "cameras": {"a": {"hand_eye": [2.0]}, "b": {"extrinsics": [1.0]}}}


def test_store_of_records(spark):
    store = spark.createDataFrame([(1, "a", "x", 0), (2, "b", "y", 0)], "id long, name string, status string, updated_at long")
    patch = spark.createDataFrame([(2, "c", None), (9, "z", "z")], "id long, name string, status string")
    assert sorted(map(tuple, records.updated(store, patch, F.lit(5).cast("long")).collect())) == [(1, "a", "x", 0), (2, "c", "y", 5)]
    assert [r.id for r in records.page(store, [F.desc("id")], 99, 1).collect()] == [1]


def test_documents_are_written_by_several_tasks(spark, tmp_path):
    """Small tables of many episodes are not joined into one task's files."""
    from telemetra.sinks import datasets

    datasets.documents(spark.range(60).selectExpr("concat('t', id % 3) task", "concat('e', id) episode", "'{}' json"), str(tmp_path / "s"))
    names = [f.name for f in (tmp_path / "s").rglob("part-*.txt")]
    assert len(names) == 60 and len({n[:10] for n in names}) > 1
