"""Cameras, calibrations and touches of a rig: their tables, checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .summaries import numbered

from ..functions import geometry as g
from .poses import mean_rotation

#: The roles that a camera can have, and the turn between a simulator's camera axes and those of images.
ROLES = ("scene", "left_wrist", "right_wrist")
TO_IMAGE = (1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def with_camera(cameras: DataFrame, new: DataFrame) -> DataFrame:
    """Cameras (name, serial, type, role) with new ones in the place of those of the same name; an unknown role is an error."""
    wrong = F.raise_error(F.concat(F.lit("invalid role: "), F.col("role"))).cast("string")
    checked = new.withColumn("role", F.when(F.col("role").isNull() | F.col("role").isin(*ROLES), F.col("role")).otherwise(wrong))
    return cameras.join(new.select("name"), "name", "left_anti").select(cameras.columns).unionByName(checked.select(cameras.columns))


def without_camera(cameras: DataFrame, name: str) -> DataFrame:
    return cameras.where(~F.col("name").eqNullSafe(F.lit(name)))


def without_cameras(cameras: DataFrame, names: DataFrame) -> DataFrame:
    """Cameras without those whose name is in `names` (name)."""
    return cameras.join(names.select("name"), "name", "left_anti").select(cameras.columns)


def of_role(cameras: DataFrame, role: str) -> DataFrame:
    return cameras.where(F.col("role") == role)


def by_serial(cameras: DataFrame, serial: Column) -> DataFrame:
    """Cameras with that serial number, numbers and texts alike."""
    return cameras.where(F.col("serial").cast("string") == serial.cast("string"))


def by_index(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """(key, i, a, b): rows of two streams paired by their place alone, as far as the shorter one goes."""
    placed = lambda df, name: df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("i"), F.col(order).alias(name))
    return placed(a, "a").join(placed(b, "b"), [key, "i"])


def reprojection(seen: DataFrame, model: DataFrame, by: list[str], pixel: Column) -> DataFrame:
    """(by, n, rms): how far corners (id, u, v) are seen from where the model's corners of the same id project to."""
    off = F.hypot(F.col("u") - pixel[0], F.col("v") - pixel[1])
    return seen.join(model, "id").groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rms"))


def extents(points: DataFrame, by: list[str], axes: list[str], low: float, high: float) -> DataFrame:
    """(by, <axis>_lo, <axis>_hi): percentiles of the points along each axis, which outliers don't stretch."""
    out = points.groupBy(*by).agg(*[F.percentile(a, F.array(F.lit(low / 100), F.lit(high / 100))).alias(a) for a in axes])
    return out.select(*by, *[F.col(a)[k].alias(f"{a}_{end}") for a in axes for k, end in enumerate(("lo", "hi"))])


def main_axis(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, cx, cy, angle, spread): the middle of plane points, and the direction and deviation of their widest spread."""
    s = points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.covar_samp(x, x).alias("_xx"), F.covar_samp(y, y).alias("_yy"), F.covar_samp(x, y).alias("_xy"))
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.hypot((F.col("_xx") - F.col("_yy")) / 2, F.col("_xy"))
    return s.select(*by, "n", "cx", "cy", (F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy")) / 2).alias("angle"), F.sqrt(half + root).alias("spread"))


def touches(samples: DataFrame, by: list[str], joints: list[str], z: str, reference: float) -> DataFrame:
    """(by, joints..., spread, mean, deviation, off): medians of the joints during a touch, and its heights against a reference."""
    return samples.groupBy(*by).agg(*[F.percentile(j, 0.5).alias(j) for j in joints], (F.max(z) - F.min(z)).alias("spread"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("deviation"), (F.avg(z) - reference).alias("off"))


def detection_rate(poses: DataFrame, found: DataFrame) -> DataFrame:
    """One row: poses collected, the most that any camera saw the board in, their share, and whether any camera did."""
    per = found.groupBy("camera").agg(F.count_distinct("pose_id").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("detected"), F.count("*").alias("cameras"))
    total = poses.agg(F.count("*").alias("collected"))
    return total.crossJoin(per).select("collected", "detected", F.coalesce(F.col("detected") / F.nullif("collected", F.lit(0)), F.lit(0.0)).alias("rate"), (F.col("cameras") > 0).alias("success"))


def base_transform(pairs: DataFrame, by: list[str], quaternion: str, place: list[str]) -> DataFrame:
    """(by, n, mean, x, y, z): the mean of poses told by unit quaternion and place, as of one arm's base seen from the other's."""
    middle = pairs.groupBy(*by).agg(*[F.avg(c).alias(c) for c in place])
    return mean_rotation(pairs, by, quaternion).join(middle, by)


def table_pose(x0: Column, x1: Column, y0: Column, y1: Column, z: Column) -> Column:
    """The pose of a table's middle, its axes those of the base."""
    return g.pose([F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [(x0 + x1) / 2, (y0 + y1) / 2, z])


def image_pose(t: Column) -> Column:
    """A simulator's camera pose in the axes of images: y and z are turned round."""
    return g.matmul(t, F.array(*map(F.lit, TO_IMAGE)))


def recorded_intrinsics(k: Column, capture: tuple[int, int], stream: tuple[int, int], crop: tuple[int, int, int, int] | None = None) -> Column:
    """Intrinsics of a capture in a stream that is its centre cut, and then cropped. Raises ValueError for other streams."""
    (cw, ch), (sw, sh) = capture, stream
    if sh != ch or (cw - sw) % 2:
        raise ValueError(f"{sw}x{sh} is not a centre crop of {cw}x{ch}")
    x, y, _, _ = crop or (0, 0, sw, sh)
    return g.cropped(k, float(x + (cw - sw) // 2), float(y))


def rig_calibration(cameras: DataFrame) -> DataFrame:
    """(camera, hand_eye, extrinsics, success) of a rig's cameras (camera, base_pose, tool_pose): one fixed to the base has extrinsics, one on a tool hand-eye."""
    return cameras.select("camera", F.when(F.col("base_pose").isNull(), F.col("tool_pose")).alias("hand_eye"), F.col("base_pose").alias("extrinsics"), F.col("base_pose").isNotNull().alias("success"))


def wrist_joints(cameras: DataFrame) -> DataFrame:
    """(name, joints): the joints that move each wrist camera, by its role."""
    side = F.when(F.col("role") == "left_wrist", "follower_l_joint_pos").when(F.col("role") == "right_wrist", "follower_r_joint_pos")
    return cameras.select("name", side.alias("joints")).where("joints is not null")


def clock_offsets(frames: DataFrame, stream: str, wall: str, own: str) -> DataFrame:
    """(stream, offset): what takes a stream's own clock to the wall's, by its first frame."""
    return frames.groupBy(stream).agg(F.min_by(F.col(wall) - F.col(own), own).alias("offset"))


def tally(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    """(by, line): how many recordings there are of each verdict, in words; those without one only if there are any."""
    n = {k: F.count_if(F.col(status) == k) for k in ("success", "failure", "pending")}
    some = F.when(n["pending"] > 0, F.format_string(", %d unlabelled", n["pending"])).otherwise("")
    return rows.groupBy(*by).agg(F.concat(F.format_string("%d recorded: %d success, %d failure", F.count("*"), n["success"], n["failure"]), some).alias("line"))


def verdict(said: Column, waited: Column, most: float = 30.0) -> Column:
    """What was said of an episode in time, or pending."""
    return F.coalesce(F.when(waited <= most, said), F.lit("pending"))


def sorted_joints(name: Column, free: Column) -> Column:
    """arm, object or other: whether a joint is the robot's by its name, else a free body's."""
    return F.when(name.startswith("robot0") | name.startswith("gripper0"), "arm").when(free, "object").otherwise("other")


def appended(poses: DataFrame, new: DataFrame) -> DataFrame:
    """Poses (id, ...) with new ones numbered on."""
    top = poses.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = numbered(new, new.columns)
    return poses.unionByName(new.crossJoin(top).withColumn("id", (F.col("_top") + F.col("_k") + 1).cast(dict(poses.dtypes)["id"])).select(poses.columns))


def without_last(poses: DataFrame) -> DataFrame:
    """Poses without the one of the highest id."""
    return poses.join(poses.agg(F.max("id").alias("id")), "id", "left_anti").select(poses.columns)


def measured_columns(names: list[str], prefix: str = "observation.depth") -> list[str]:
    """The columns of which statistics are taken: all but those with the prefix."""
    return [n for n in names if not n.startswith(prefix)]


def vector_travel(path: Column, places: list[tuple[int, int]]) -> Column:
    """The greatest distance of later steps from the first of a path of vectors, over the given stretches (from, length) of places."""
    later = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))

    def ways(start: int, n: int) -> Column:
        cut = lambda v: F.slice(v, start + 1, n)
        square = lambda v: F.aggregate(F.zip_with(cut(path[0]), cut(v), lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x)
        return F.transform(later, lambda v: F.sqrt(square(v)))

    return F.array_max(F.concat(*[ways(start, n) for start, n in places]))


def unsaturated(depth: Column, at: int = 65535) -> Column:
    """A depth of 0 for a saturated one."""
    return F.when(depth == at, 0).otherwise(depth)
