"""Training data and its documents, written by Spark: shards, manifests, statistics, indexes, wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..operators import summaries


def telemetry(rows: DataFrame, path: str) -> None:
    """Telemetry by task and episode, an episode's samples in order in one file."""
    _by_episode(rows, "t_ns").parquet(path)


def lowdim(frames: DataFrame, path: str) -> None:
    """Frames by task and episode, in order in one file; `operators.frames.built` makes them."""
    _by_episode(frames, "frame_idx").parquet(path)


def documents(rows: DataFrame, path: str) -> None:
    """JSON documents (task, episode, json), one to an episode, each in its folder."""
    _by_episode(rows.select("task", "episode", "json"), "json").text(path)


def _by_episode(rows: DataFrame, order: str) -> DataFrameWriter:
    """Files are what costs, not their bytes: a number of tasks keeps them from being joined into one, and each task puts its own files into place.

    A task that is repeated writes the same names again.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = rows.repartition(tasks, "task", "episode").sortWithinPartitions("task", "episode", order).write
    return out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("task", "episode").mode("overwrite")


def seven(rows: DataFrame) -> DataFrame:
    """Telemetry with joint_pos_7d, six joints and the gripper."""
    return rows.withColumn("joint_pos_7d", F.concat(F.slice("joint_pos", 1, 6), F.slice("gripper_pos", 1, 1)))


def metadata(rows: DataFrame) -> DataFrame:
    """(task, episode, json): an episode's document, its fields in order and unknown ones left out."""
    names = sorted(c for c in rows.columns if c not in ("task", "episode"))
    return rows.select("task", "episode", F.to_json(F.struct(*names)).alias("json"))


def episode_metadata(frames: DataFrame, recordings: DataFrame, fps: float) -> DataFrame:
    """(task, episode, num_frames, cameras, seconds, language): what each converted episode holds."""
    per = frames.groupBy("task", "episode").agg(F.count_distinct("frame_idx").alias("num_frames"), F.sort_array(F.collect_set("camera")).alias("cameras"))
    out = per.join(recordings.select("task", "episode", "task_name", "task_instruction"), ["task", "episode"], "left")
    language = F.coalesce(F.nullif("task_instruction", F.lit("")), F.nullif("task_name", F.lit("")), F.col("task"))
    return out.select("task", "episode", "num_frames", "cameras", (F.col("num_frames") / fps).alias("seconds"), language.alias("language"))


def samples(windows: DataFrame, keys: dict[str, Column], meta: dict[str, Column]) -> DataFrame:
    """One row a sample: an id that depends on its episode and anchor alone, its arrays by key, and its metadata as JSON."""
    uid = F.md5(F.concat_ws("/", "episode", "index"))
    return windows.select(uid.alias("sample_id"), "episode", "index", *[v.alias(k) for k, v in keys.items()], F.to_json(F.struct(*[v.alias(k) for k, v in meta.items()])).alias("metadata"))


def shards(rows: DataFrame, order: list[str], size: int, path: str) -> DataFrame:
    """Writes `size` rows to a shard in order, one folder and file a shard; returns the manifest (shard, n)."""
    placed = summaries.sharded(rows, order, size)
    placed.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard")


def tar_shards(rows: DataFrame, order: list[str], size: int, path: str, files: dict[str, Column]) -> None:
    """Writes `size` samples to a tar file in order, each with the given files (name within the sample: data), and the manifest.

    A file's name begins with the sample's place in the whole order, so names differ. Shards that are there go.
    """
    from ..sources.files import registered

    placed = summaries.sharded(rows, order, size)
    key = F.format_string("%010d", F.col("shard") * size + F.col("place"))
    parts = F.array(*[F.struct(F.concat(key, F.lit(f".{n}")).alias("name"), v.cast("binary").alias("data")) for n, v in files.items()])
    registered(rows.sparkSession)
    out = placed.select("shard", "place", parts.alias("files")).repartition("shard").sortWithinPartitions("shard", "place")
    out.write.format("tar_shards").mode("overwrite").save(path)


def manifest(shards: DataFrame, path: str) -> None:
    """The manifest as JSON lines: a shard's name and how many samples it holds."""
    shards.select(F.format_string("shard_%06d", F.col("shard")).alias("shard"), F.col("n").alias("num_sequences")).coalesce(1).write.mode("overwrite").json(path)


def statistics(moments: DataFrame, by: str) -> DataFrame:
    """(by, json): the moments of each key, as the document that training reads."""
    return moments.select(by, F.to_json(F.struct(*[c for c in moments.columns if c != by])).alias("json"))


def run_metadata(rows: dict[str, DataFrame], config: dict[str, str]) -> DataFrame:
    """One row: how many rows each table has, and the configuration with its keys in order."""
    counts = summaries.record_counts(rows).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))
    said = F.create_map(*[F.lit(x) for k in sorted(config) for x in (k, config[k])])
    return counts.select(F.to_json("counts").alias("counts"), F.to_json(said).alias("config"))


def wide(frames: DataFrame, vectors: dict[str, list[str]], fps: float) -> DataFrame:
    """Frames as the columns of a training table: each place of a vector under its name, and the time from the frame's number."""
    cells = [F.col(v)[k].alias(f"{v}.{name}") for v, names in vectors.items() for k, name in enumerate(names)]
    return frames.select("episode", "frame_idx", (F.col("frame_idx") / fps).alias("timestamp"), *cells)


def padded(rows: DataFrame, vectors: list[str], by: list[str]) -> DataFrame:
    """Arrays filled with NaN to the longest of their group, and length with their own length."""
    most = rows.groupBy(*by).agg(F.max(F.size(vectors[0])).alias("_most"))
    fill = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(float("nan")), F.col("_most") - F.size(c)))
    out = (rows.join(most, by) if by else rows.crossJoin(most)).withColumn("length", F.size(vectors[0]))
    return out.withColumns({c: fill(c) for c in vectors}).drop("_most")


def calibration(cameras: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """(json): a rig's calibration, cameras (camera, hand_eye, extrinsics) by name in order."""
    entry = F.struct("camera", F.struct("hand_eye", "extrinsics").alias("c"))
    both = cameras.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cameras"))
    return both.select(F.to_json(F.struct(*[v.alias(k) for k, v in extra.items()], "cameras")).alias("json"))


def calibration_results(cameras: DataFrame, version: str = "1.0") -> DataFrame:
    """(task, episode, json) as `sources.episodes.calibrations` reads it, from (task, episode, camera, hand_eye, extrinsics, success) with 4x4 poses.

    A camera without a pose of one kind has none in the document; an episode's cameras stand in order of their names.
    """

    def said(pose: str) -> list[Column]:
        rows = F.when(F.col(pose).isNotNull(), F.array(*[F.slice(pose, 4 * k + 1, 3) for k in range(3)]))
        return [rows.alias("rotation_matrix"), F.when(F.col(pose).isNotNull(), F.array(*[F.col(pose)[k] for k in (3, 7, 11)])).alias("translation_vector")]

    fixed = F.struct(F.col("success"), *said("extrinsics"))
    entry = F.struct("camera", F.struct(F.struct(*said("hand_eye")).alias("hand_eye_calibration"), fixed.alias("extrinsics")).alias("c"))
    rigs = cameras.groupBy("task", "episode").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("cameras"))  # a rig has a few cameras
    return rigs.select("task", "episode", F.to_json(F.struct(F.lit(version).alias("version"), "cameras")).alias("json"))


def patched(document: Column, changes: dict[str, Column]) -> Column:
    """A JSON object of plain values with some of them set anew."""
    said = F.from_json(document, "map<string,string>")
    new = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(said, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)))))
