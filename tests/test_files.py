"""Files of arrays and shards: round trips, what is missing, and what failed tasks leave."""

import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.sinks import datasets
from telemetra.sources import files


@pytest.fixture(scope="module")
def session(spark):
    return files.registered(spark)


def test_telemetry_as_recorded(session, tmp_path, monkeypatch):
    rng, n = np.random.default_rng(1), 10_000
    left, right = rng.normal(size=(n, 7)).astype("f4"), rng.normal(size=(50, 7)).astype("f4")
    (tmp_path / "a/0001").mkdir(parents=True)
    (tmp_path / "a/0002").mkdir()
    np.savez_compressed(tmp_path / "a/0001/robot_data.npz", timestamps=np.arange(n) * 10, follower_l_joint_cmd=left, note=np.array(3))
    np.savez(tmp_path / "a/0002/robot_data.npz", timestamps=np.arange(50), follower_l_joint_cmd=right.astype("f8"), follower_r_joint_cmd=right)
    np.savez(tmp_path / "a/0002/other.npz", timestamps=np.arange(5))
    schema = "file string, row long, timestamps long, follower_l_joint_cmd array<float>, follower_r_joint_cmd array<float>"
    df = session.read.format("padded_arrays").schema(schema).option("pattern", r"robot_data\.npz").load(str(tmp_path / "a"))
    rows = df.withColumn("ep", F.element_at(F.split("file", "/"), -2)).collect()
    assert len(rows) == n + 50 and df.select("row").count() == n + 50
    for r in rows[:: 997]:
        want = left if r.ep == "0001" else right
        assert np.allclose(r.follower_l_joint_cmd, want[r.row]) and r.timestamps == r.row * (10 if r.ep == "0001" else 1)
        assert (r.follower_r_joint_cmd is None) == (r.ep == "0001")


def test_names_of_frames_with_fallback(session, tmp_path):
    for name in ("000000001", "000000002", "x"):
        np.savez(tmp_path / f"{name}.npz", joints=np.ones((1, 14)) * len(name))
    read = session.read.format("padded_arrays").schema("file string, joints array<double>").option("pattern", r"\d{10}\.npz").option("fallback", r"\d{9}\.npz")
    assert read.load(str(tmp_path)).count() == 2
    np.savez(tmp_path / "0000000001.npz", joints=np.zeros((1, 14)))
    assert [r.joints[0] for r in read.load(str(tmp_path)).collect()] == [0.0]


def test_padded_round_trip(session, tmp_path):
    rows = [(k, f"s{k}", [float(k)] * (k % 5), [k] * (k % 5)) for k in range(40)]
    df = session.createDataFrame(rows, "id long, name string, v array<double>, w array<int>")
    df.repartition(3).write.format("padded_arrays").mode("overwrite").save(str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 3
    back = session.read.format("padded_arrays").schema(df.schema).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    df.where("id < 2").coalesce(1).write.format("padded_arrays").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(r.id for r in session.read.format("padded_arrays").schema(df.schema).load(str(tmp_path / "out")).collect()) == [0, 1]
    with pytest.raises(Exception, match="has such files"):
        df.write.format("padded_arrays").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="a null in id"):
        session.createDataFrame([(None, "a", [1.0], [1])], df.schema).write.format("padded_arrays").mode("overwrite").save(str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad") or not [f for f in os.listdir(tmp_path / "bad") if f.endswith(".npz")]


def test_broken_and_odd_arrays_are_told(session, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.ones(3), y=np.ones(4))
    read = session.read.format("padded_arrays").schema("x double, y double")
    with pytest.raises(Exception, match="different numbers of rows"):
        read.load(str(tmp_path)).collect()
    np.savez(tmp_path / "a.npz", x=np.array([{}], object))
    with pytest.raises(Exception, match="objects"):
        read.load(str(tmp_path)).collect()
    np.savez(tmp_path / "a.npz", x=np.ones(0))
    assert read.load(str(tmp_path)).count() == 0


def test_tar_shards(session, tmp_path):
    path = str(tmp_path / "shards")
    df = session.range(250).select(F.xxhash64("id").alias("h"), "id").repartition(4)
    datasets.tar_shards(df, ["h"], 100, path, {"json": F.to_json(F.struct("id")), "bin": F.col("id").cast("string")})
    assert sorted(os.listdir(path)) == ["manifest.jsonl", "shard_000000.tar", "shard_000001.tar", "shard_000002.tar"]
    assert [json.loads(x) for x in open(f"{path}/manifest.jsonl")] == [{"shard": f"shard_{k:06d}", "num_sequences": n} for k, n in enumerate([100, 100, 50])]
    want = [r.id for r in df.orderBy("h").collect()]
    got = []
    for k in range(3):
        with tarfile.open(f"{path}/shard_{k:06d}.tar") as t:
            names = t.getnames()
            got += [int(t.extractfile(m).read()) for m in t.getmembers() if m.name.endswith(".bin")]
            assert names == sorted(names, key=lambda x: x[:10])
    assert got == want
    back = session.read.format("tar_shards").load(path)
    assert back.count() == 500 and back.where("name like '%.json'").select(F.get_json_object(F.col("data").cast("string"), "$.id").cast("long").alias("i")).agg(F.sum("i")).first()[0] == sum(range(250))
    datasets.tar_shards(df.limit(10), ["h"], 100, path, {"bin": F.col("id").cast("string")})
    assert sorted(os.listdir(path)) == ["manifest.jsonl", "shard_000000.tar"]


def test_a_failed_task_leaves_no_shard(session, tmp_path):
    path = str(tmp_path / "shards")
    bad = F.when(F.col("id") == 90, F.raise_error("broken sample").cast("binary")).otherwise(F.col("id").cast("string").cast("binary"))
    rows = session.range(0, 100, 1, 4).select(F.floor(F.col("id") / 25).alias("shard"), (F.col("id") % 25).alias("place"), F.array(F.struct(F.col("id").cast("string").alias("name"), bad.alias("data"))).alias("files"))
    with pytest.raises(Exception, match="broken sample"):
        rows.write.format("tar_shards").mode("overwrite").save(path)
    os.makedirs(path, exist_ok=True)
    assert not [f for f in os.listdir(path) if not f.startswith("_temporary-")] and session.read.format("tar_shards").load(path).count() == 0
    whole = session.range(100).select(F.lit(7).cast("long").alias("shard"), F.col("id").alias("place"), F.array(F.struct(F.col("id").cast("string").alias("name"), F.col("id").cast("string").cast("binary").alias("data"))).alias("files"))
    with pytest.raises(Exception, match="dealt by shard"):
        whole.repartition(3).write.format("tar_shards").mode("overwrite").save(path)
    assert session.read.format("tar_shards").load(path).count() == 0
    whole.coalesce(1).write.format("tar_shards").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == ["manifest.jsonl", "shard_000007.tar"]
