"""The low-dimensional side of converted episodes: what the arms and cameras were at each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: The turn of a camera that hangs upside down, by half about its axis.
FLIP = (-1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def vectors_at(frames: DataFrame, telemetry: DataFrame, key: list[str], t: str, vectors: list[str]) -> DataFrame:
    """`frames` with each of `vectors` interpolated linearly at their times, place by place.

    One shuffle by key and two sorts serve all vectors. A frame outside its episode's telemetry ends the query with an
    error: nothing is extrapolated. Samples of one time count once, as the greatest by their vectors. A vector that
    either neighbour lacks is null; of unequal lengths, the places that only one has are null.
    """
    names = {c.lower() for c in [*frames.columns, *vectors]}
    free = lambda stem: next(n for n in (f"{stem}{k}" for k in range(len(names) + 1)) if n not in names)
    is_frame, sample, row, before, after = map(free, ("is_frame", "sample", "row", "before", "after"))
    once = telemetry.groupBy(*key, t).agg(F.max(F.struct(*vectors)).alias(sample))
    once = once.select(*key, t, F.lit(0).alias(is_frame), F.struct(F.col(t).alias("t"), F.col(sample).alias("v")).alias(sample))
    both = once.unionByName(frames.select(*key, t, F.lit(1).alias(is_frame), F.struct(*frames.columns).alias(row)), allowMissingColumns=True)
    w, back = Window.partitionBy(*key).orderBy(t, is_frame), Window.partitionBy(*key).orderBy(F.desc(t), is_frame)
    placed = both.withColumns({before: F.last(sample, True).over(w), after: F.last(sample, True).over(back)}).where(F.col(is_frame) == 1)
    a, b = F.col(before), F.col(after)
    at = F.col(f"{row}.{t}")
    outside = F.raise_error(F.lit("a frame lies outside the telemetry of its episode")).cast("array<double>")
    share = F.when(a["t"] == b["t"], 0.0).otherwise((at - a["t"]) / (b["t"] - a["t"]))
    placed = placed.withColumn(is_frame, share)
    step = lambda x, y: x + F.col(is_frame) * (y - x)
    return placed.select(*[F.col(row)[c].alias(c) for c in frames.columns], *[F.when(F.col(is_frame).isNull(), outside).otherwise(F.zip_with(a["v"][v], b["v"][v], step)).alias(v) for v in vectors])


def commanded(vector: Column, gripper: int = 6) -> Column:
    """A command whose gripper is open or closed, never between: interpolation makes openings that nobody asked for."""
    return F.transform(vector, lambda x, k: F.when(k == gripper, (x >= 0.5).cast("double")).otherwise(x))


def intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, flip: Column) -> Column:
    """3x3 intrinsics, of the picture turned by half where `flip` holds."""
    x, y = F.when(flip, width - 1 - cx).otherwise(cx), F.when(flip, height - 1 - cy).otherwise(cy)
    zero = F.lit(0.0)
    return F.array(fx, zero, x, zero, fy, y, zero, zero, F.lit(1.0))


def served(k: Column, width: Column, height: Column, to: tuple[int, int] | None) -> Column:
    """Intrinsics of pictures that are served at another size (width, height)."""
    return g.resized(k, to[0] / width, to[1] / height) if to else k


def camera_transforms(cameras: DataFrame, frame: str = "left_arm_base", resize: tuple[int, int] | None = None) -> DataFrame:
    """(camera, intrinsics, tool, extrinsics, note) of a server's cameras.

    `cameras` has camera, wrist, flip, opened, fx, fy, cx, cy, width, height, hand_eye (4x4) and solved (whether it was
    found), extrinsics (4x4), success and reference_frame. A camera that didn't open has the identity for intrinsics.
    A wrist camera gets its pose on the tool, turned by half with its picture, and no extrinsics: those follow from the
    arm. Any other camera gets its extrinsics, the identity without any; those of another frame of reference end the
    query with an error. `note` tells what is missing, else null.
    """
    turn = F.array(*map(F.lit, FLIP))
    eye = F.array(*map(F.lit, g.IDENTITY))
    wrist, flip = F.coalesce("wrist", F.lit(False)), F.coalesce("flip", F.lit(False))
    k = served(intrinsics(*map(F.col, ("fx", "fy", "cx", "cy", "width", "height")), flip), F.col("width"), F.col("height"), resize)
    k = F.when(F.coalesce("opened", F.lit(False)), k).otherwise(F.array(*[F.lit(float(j % 4 == 0)) for j in range(9)]))
    has_tool = F.coalesce("solved", F.lit(False)) & F.col("hand_eye").isNotNull()
    has_base = F.coalesce("success", F.lit(False)) & F.col("extrinsics").isNotNull()
    tool = F.when(wrist & has_tool, F.when(flip, g.matmul(F.col("hand_eye"), turn)).otherwise(F.col("hand_eye")))
    wrong = F.raise_error(F.concat(F.lit("extrinsics not in "), F.lit(f"{frame}: "), F.col("camera"))).cast("array<double>")
    base = F.when(has_base, F.when(F.coalesce("reference_frame", F.lit(frame)) == frame, F.col("extrinsics")).otherwise(wrong)).otherwise(eye)
    note = F.when(wrist & ~has_tool, "no hand-eye calibration").when(~wrist & ~has_base, "no extrinsics").when(~F.coalesce("opened", F.lit(False)), "not opened")
    return cameras.select("camera", k.alias("intrinsics"), tool.alias("tool"), F.when(~wrist, base).alias("extrinsics"), note.alias("note"))


def built(frames: DataFrame, telemetry: DataFrame, cameras: DataFrame, recordings: DataFrame, t: str = "t_ns") -> DataFrame:
    """The low-dimensional frames of converted episodes, one row a frame, as `sinks.datasets.lowdim` writes them.

    frames: (task, episode, frame_idx, t); telemetry: (task, episode, t, joint_pos, gripper_pos, joint_cmd), a recording
    without commands can't be converted; cameras: (task, episode, camera, intrinsics, extrinsics), few to an episode;
    recordings: (task, episode, task_name, task_instruction, table_pose), the identity for no table pose.
    """
    key = ["task", "episode"]
    lacking = F.raise_error(F.concat(F.lit("no commands in "), F.col("task"), F.lit("/"), F.col("episode"))).cast("array<double>")
    rows = telemetry.select(*key, t, F.concat(F.slice("joint_pos", 1, 6), F.slice("gripper_pos", 1, 1)).cast("array<double>").alias("joints"), F.coalesce(F.col("joint_cmd").cast("array<double>"), lacking).alias("action_joints"))
    at = vectors_at(frames.select(*key, "frame_idx", t), rows, key, t, ["joints", "action_joints"])
    one = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("camera", F.col(c).cast("array<float>").alias("v")))))).alias(c)
    rigs = cameras.groupBy(*key).agg(one("intrinsics"), one("extrinsics"))
    said = recordings.select(*key, F.coalesce("task_name", F.lit("")).alias("language_task"), F.coalesce("task_instruction", F.lit("")).alias("language_prompt"), F.coalesce(F.col("table_pose").cast("array<float>"), F.array(*map(F.lit, g.IDENTITY)).cast("array<float>")).alias("table_pose"))
    out = at.join(rigs, key, "left").join(said, key, "left")
    return out.withColumns({"joints": F.col("joints").cast("array<float>"), "action_joints": commanded(F.col("action_joints")).cast("array<float>")})
