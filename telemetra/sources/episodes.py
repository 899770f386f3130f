"""Tables of an episode store on any file system that Spark reads: <root>/<task>/<episode>/... with JSON documents and Parquet tables.

Folders may also bear the names that partitioned writes give them (task=<task>/episode=<episode>), as `sinks.datasets` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of the documents.
RECORDING = "task_name string, task_instruction string, timestamp string, duration_s double, robot_frames int, robot_hz double, cameras array<string>, camera_fps int, control string, complete boolean, converted boolean, camera_start_times_ns map<string,bigint>, realsense_clock_offsets map<string,bigint>, color_controls map<string,struct<white_balance:double,exposure:double,gain:double>>"
CAMERA = "struct<intrinsics:struct<camera_matrix:array<array<double>>,distortion:array<double>>,hand_eye_calibration:struct<rotation_matrix:array<array<double>>,translation_vector:array<double>>,extrinsics:struct<success:boolean,reference_frame:string,rotation_matrix:array<array<double>>,translation_vector:array<double>>>"
CALIBRATION = f"version string, timestamp string, coordinate_frame string, cameras map<string,{CAMERA}>"
TELEMETRY = "t_ns bigint, sample_idx int, arm string, joint_pos array<float>, joint_vel array<float>, joint_eff array<float>, gripper_pos array<float>, gripper_eff array<float>, joint_pos_7d array<float>, joint_cmd array<float>"
LOWDIM = "frame_idx int, t_ns bigint, joints array<float>, action array<float>, actual_poses array<float>, action_joints array<float>, extrinsics map<string,array<float>>, intrinsics map<string,array<float>>, language_task string, language_prompt string, table_pose array<float>"


def _folder(path: Column, up: int, name: str) -> Column:
    """The name of the folder `up` levels above a file, without `name=`."""
    parts = F.split(path, "/")
    return F.regexp_replace(parts[F.size(parts) - up - 1], f"^{name}=", "")


def _placed(df: DataFrame, depth: int) -> DataFrame:
    """`df` with task and episode from the path, whose file lies `depth` levels below the episode."""
    path = F.col("_metadata.file_path")
    return df.select("*", _folder(path, depth + 1, "task").alias("task"), _folder(path, depth, "episode").alias("episode"))


def listing(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(task, episode, modified): the episodes that hold a file of this name; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", "true").load(root)
    return files.select(_folder(F.col("path"), 2, "task").alias("task"), _folder(F.col("path"), 1, "episode").alias("episode"), F.col("modificationTime").alias("modified"))


def tasks(spark: SparkSession, root: str, file: str) -> DataFrame:
    """(task, episodes, modified) of the tasks with such episodes, the last changed first."""
    return by_task(listing(spark, root, file)).orderBy(F.desc("modified"), "task")


def by_task(found: DataFrame) -> DataFrame:
    """(task, episodes, modified) of a listing."""
    return found.groupBy("task").agg(F.count("*").alias("episodes"), F.max("modified").alias("modified"))


def documents(spark: SparkSession, root: str, file: str, schema: str) -> DataFrame:
    """JSON documents of this name with their task and episode; a broken one is a row of nulls with its text in `broken`."""
    read = spark.read.schema(f"{schema}, broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return _placed(read.option("pathGlobFilter", file).option("recursiveFileLookup", "true").json(root), 1)


def recordings(spark: SparkSession, root: str, file: str = "metadata.json") -> DataFrame:
    return documents(spark, root, file, RECORDING)


def calibrations(spark: SparkSession, root: str, file: str = "calibration_results.json") -> DataFrame:
    """(task, episode, camera, hand_eye, extrinsics, success) with 4x4 poses; one row for each camera."""
    rows = documents(spark, root, file, CALIBRATION).select("task", "episode", F.explode("cameras").alias("camera", "c"))
    return rows.select("task", "episode", "camera", matrix(F.col("c.hand_eye_calibration")).alias("hand_eye"), matrix(F.col("c.extrinsics")).alias("extrinsics"), F.coalesce("c.extrinsics.success", F.lit(False)).alias("success"))


def matrix(said: Column) -> Column:
    """A 4x4 pose from a rotation and a translation; null where one is missing."""
    r, t = said["rotation_matrix"], said["translation_vector"]
    full = F.flatten(F.array(*[F.concat(r[k], F.array(t[k])) for k in range(3)], F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))))
    return F.when(r.isNotNull() & t.isNotNull(), full)


def logged(spark: SparkSession, path: str) -> DataFrame:
    """(started, teacher) of a log of JSON lines, in order; lines that can't be read, or without a time, are left out."""
    rows = spark.read.schema("started string, teacher string").option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.try_to_timestamp("started").alias("started"), "teacher").where("started is not null").orderBy("started")


def table(spark: SparkSession, root: str, file: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Parquet tables of this name with their task and episode; optional columns that a file lacks are null.

    A row with a null in a required column ends the query with an error that names it.
    """
    rows = _placed(spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", file).parquet(root), 1)
    for name in required or []:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"{name} is missing in "), "task", F.lit("/"), "episode")).cast(dict(rows.dtypes)[name])).otherwise(F.col(name)))
    return rows


def telemetry(spark: SparkSession, root: str, file: str = "robot_data.parquet") -> DataFrame:
    return table(spark, root, file, TELEMETRY, ["t_ns"])


def lowdim(spark: SparkSession, root: str, required: list[str] | None = None, file: str = "lowdim.parquet") -> DataFrame:
    return table(spark, root, file, LOWDIM, required)


def merged(logs: list[DataFrame], t: str) -> DataFrame:
    """Logs of several cameras in one, in order of time and then of the log."""
    out = None
    for k, log in enumerate(logs):
        one = log.withColumn("source", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.orderBy(t, "source")


def unpadded(rows: DataFrame, vectors: list[str], length: str) -> DataFrame:
    """Arrays that were padded to one length, cut to their own."""
    return rows.withColumns({c: F.slice(c, 1, F.col(length)) for c in vectors}).drop(length)


def shots(captures: DataFrame, names: list[str] | None, frame: str) -> DataFrame:
    """Captures of the given names, all of which must be in the given frame of reference."""
    kept = captures.where(F.col("name").isin(names)) if names else captures
    wrong = F.raise_error(F.concat(F.lit("not in this frame: "), F.col("name"))).cast("string")
    return kept.withColumn("reference_frame", F.when(F.col("reference_frame") == frame, F.col("reference_frame")).otherwise(wrong))


def geometry(rig: DataFrame, layout: DataFrame, camera: DataFrame) -> DataFrame:
    """One row of all that placement rules need, from three documents of one row each."""
    return rig.crossJoin(layout).crossJoin(camera)
