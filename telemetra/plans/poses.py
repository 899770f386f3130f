"""Queries on poses, cameras and points. Vectors of `embeddings` stand for poses, `part` for places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import poses, records
from .registry import register, table

#: The first numbers of each vector as doubles, and two unit vectors made from them.
_SIX = """v as (select vec_id, label, [x::double for x in embedding] v from embeddings), a as (select *, sqrt(v[1]**2 + v[2]**2 + v[3]**2) na from v),
x as (select *, v[1] / na x1, v[2] / na x2, v[3] / na x3 from a), d as (select *, x1 * v[4] + x2 * v[5] + x3 * v[6] dt from x), b as (select *, v[4] - dt * x1 b1, v[5] - dt * x2 b2, v[6] - dt * x3 b3 from d),
r0 as (select *, b1 / sqrt(b1**2 + b2**2 + b3**2) y1, b2 / sqrt(b1**2 + b2**2 + b3**2) y2, b3 / sqrt(b1**2 + b2**2 + b3**2) y3 from b),
r as (select *, x2 * y3 - x3 * y2 z1, x3 * y1 - x1 * y3 z2, x1 * y2 - x2 * y1 z3, v[7] px, v[8] py, v[9] pz from r0)"""


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v, pose): a rotation from six numbers of each vector, a place from three more."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.withColumn("pose", g.pose(g.from_rot6d(F.col("v")), [F.col("v")[k] for k in (6, 7, 8)]))


@register(f"with {_SIX} select vec_id, round(x1, 6) as a, round(y2, 6) as b, round(z3, 6) as c, round(z1, 6) as d, true as sound, false as placeholder from r")
def rot6d_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations made from six numbers, and back."""
    p = _posed(spark, sf_dir).withColumn("again", g.pose(g.from_rot6d(g.rot6d(g.rotation(F.col("pose")))), [F.lit(0.0)] * 3))
    sound = (g.rotation_skew(F.col("pose")) < 1e-3) & (g.angle_between(F.col("pose"), F.col("again")) < 1e-3)
    return p.select("vec_id", F.round(F.col("pose")[0], 6).alias("a"), F.round(F.col("pose")[5], 6).alias("b"), F.round(F.col("pose")[10], 6).alias("c"), F.round(F.col("pose")[8], 6).alias("d"), sound.alias("sound"), g.is_identity(F.col("pose")).alias("placeholder"))


@register(f"""with {_SIX}, p as (select *, row_number() over (partition by label order by vec_id) k from r)
select t.vec_id, round(a.x1 * (t.px - a.px) + a.y1 * (t.py - a.py) + a.z1 * (t.pz - a.pz), 5) as x, round(a.x2 * (t.px - a.px) + a.y2 * (t.py - a.py) + a.z2 * (t.pz - a.pz), 5) as y, round(a.x1 * t.x1 + a.y1 * t.y1 + a.z1 * t.z1, 5) as r00,
round(degrees(acos(greatest(-1, least(1, (a.x1*t.x1 + a.x2*t.x2 + a.x3*t.x3 + a.y1*t.y1 + a.y2*t.y2 + a.y3*t.y3 + a.z1*t.z1 + a.z2*t.z2 + a.z3*t.z3 - 1) / 2)))), 3) as angle, round(sqrt((t.px - a.px)**2 + (t.py - a.py)**2 + (t.pz - a.pz)**2), 5) as distance from p t join p a on a.label = t.label and a.k = 1 where t.k > 1""")
def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses seen from the first of their group, and how far they differ from it."""
    p = _posed(spark, sf_dir)
    first = p.groupBy("label").agg(F.min_by(F.struct("vec_id", "pose"), "vec_id").alias("f")).select("label", F.col("f.vec_id").alias("anchor_id"), F.col("f.pose").alias("anchor"))
    both = p.join(first, "label").where("vec_id <> anchor_id").withColumn("rel", g.relative(F.col("anchor"), F.col("pose")))
    return both.select("vec_id", F.round(F.col("rel")[3], 5).alias("x"), F.round(F.col("rel")[7], 5).alias("y"), F.round(F.col("rel")[0], 5).alias("r00"), F.round(g.angle_between(F.col("anchor"), F.col("pose")), 3).alias("angle"), F.round(g.distance_between(F.col("anchor"), F.col("pose")), 5).alias("distance"))


@register(f"with {_SIX}, p as (select *, row_number() over (partition by label order by vec_id) k from r), e as (select t.vec_id, degrees(acos(greatest(-1, least(1, (a.x1*t.x1 + a.x2*t.x2 + a.x3*t.x3 + a.y1*t.y1 + a.y2*t.y2 + a.y3*t.y3 + a.z1*t.z1 + a.z2*t.z2 + a.z3*t.z3 - 1) / 2)))) d, sqrt((t.px - a.px)**2 + (t.py - a.py)**2 + (t.pz - a.pz)**2) m from p t join p a on a.label = t.label and a.k = t.k - 1) select vec_id, case when d > 90 and m > 0.2 then 'pose' when d > 90 then 'rotation' when m > 0.2 then 'translation' else 'ok' end as gate from e")
def pose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each pose drifts from the one before by more than an angle or a distance."""
    p = _posed(spark, sf_dir).withColumn("before", F.lag("pose").over(Window.partitionBy("label").orderBy("vec_id"))).where("before is not null")
    turned, moved = g.angle_between(F.col("before"), F.col("pose")) > 90, g.distance_between(F.col("before"), F.col("pose")) > 0.2
    return p.select("vec_id", F.when(turned & moved, "pose").when(turned, "rotation").when(moved, "translation").otherwise("ok").alias("gate"))


@register("with p as (select p_partkey, (p_size - 25) / 10.0::double x, (p_partkey % 9 - 4) / 5.0::double y, (p_partkey % 13 - 2) / 4.0::double z from part), q as (select p_partkey, case when z > 0 then 600 * x / z + 320 end u, case when z > 0 then 600 * y / z + 240 end v from p) select p_partkey, round(u, 4) as u, round(v, 4) as v, coalesce(u >= 0 and u < 640 and v >= 0 and v < 480, false) as seen from q")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as pixels, and whether the camera sees them."""
    k = F.array(*map(F.lit, (600.0, 0.0, 320.0, 0.0, 600.0, 240.0, 0.0, 0.0, 1.0)))
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("uv", g.projected(k, F.array((F.col("p_size") - 25) / 10.0, (key % 9 - 4) / 5.0, (key % 13 - 2) / 4.0)))
    return p.select("p_partkey", F.round(F.col("uv")[0], 4).alias("u"), F.round(F.col("uv")[1], 4).alias("v"), g.in_view(F.col("uv"), 640, 480).alias("seen"))


@register("with p as (select p_size % 5 g, (p_size - 25) / 10.0::double x, (p_partkey % 9 - 4) / 5.0::double y, (p_partkey % 13 - 2) / 4.0::double z from part), q as (select g, z, 600 * x / z + 320 u, 600 * y / z + 240 v from p where z > 0) select g, min(z) as lowest from q where u >= 0 and u < 640 and v >= 0 and v < 480 group by all")
def lowest_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least depth at which a group is seen."""
    k = F.array(*map(F.lit, (600.0, 0.0, 320.0, 0.0, 600.0, 240.0, 0.0, 0.0, 1.0)))
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("g"), ((F.col("p_size") - 25) / 10.0).alias("x"), ((key % 9 - 4) / 5.0).alias("y"), ((key % 13 - 2) / 4.0).alias("z"))
    seen = g.in_view(g.projected(k, F.array("x", "y", "z")), 640, 480)
    return p.where(seen).groupBy("g").agg(F.min("z").alias("lowest"))


@register("select p_partkey, 639 - (300 + p_size) as cx, 479 - 240.0::double as cy, (300 + p_size - 80.0::double) * 0.5 as cropped, 600 * 0.5::double as fx from part")
def adjusted_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intrinsics of turned, cropped and resized images."""
    k = F.array(F.lit(600.0), F.lit(0.0), F.lit(300) + F.col("p_size"), F.lit(0.0), F.lit(600.0), F.lit(240.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    p = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")).withColumn("k", k)
    small = g.resized(g.cropped(F.col("k"), 80.0, 0.0), 0.5, 0.5)
    turned = g.flipped(F.col("k"), 640, 480)
    return p.select("p_partkey", turned[2].cast("int").alias("cx"), turned[5].alias("cy"), small[2].alias("cropped"), small[0].alias("fx"))


@register("with e as (select vec_id, generate_subscripts(embedding, 1) - 1 k, unnest(embedding)::double d from embeddings) select vec_id, count(*) as n, round(sum((k % 4 - 1.5) * d / 2), 5) as x, round(sum((k // 4 - 1.5) * d / 2 + 1), 5) as y, round(max(d), 6) as z from e where k < 16 and d > 0 group by all")
def depth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of depth images of four times four pixels, moved by the camera's pose."""
    move = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "d")).where("k < 16 and d > 0").withColumn("d", F.col("d").cast("double"))
    p = g.unprojected(F.col("k") % 4, F.floor(F.col("k") / 4), F.col("d"), 2.0, 2.0, 1.5, 1.5)
    w = g.transformed(move, p[0], p[1], p[2])
    return e.select("vec_id", w.alias("w")).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w")[0]), 5).alias("x"), F.round(F.sum(F.col("w")[1]), 5).alias("y"), F.round(F.max(F.col("w")[2]), 6).alias("z"))


@register("with e as (select vec_id, generate_subscripts(embedding, 1) - 1 k, unnest(embedding)::double d from embeddings), i as (select *, case when d > 0 then 1 / greatest(d, 1e-8) end i from e), p as (select vec_id, quantile_cont(i, 0.95) p from i group by all) select vec_id, count(i) as n, round(sum(greatest(0, least(1, i / (p + 1e-6)))), 5) as total from i join p using (vec_id) group by all")
def inverse_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse depths as shares of each image's 95th percentile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("d")).withColumn("d", F.col("d").cast("double"))
    i = e.withColumn("i", F.when(F.col("d") > 0, 1 / F.greatest(F.col("d"), F.lit(1e-8))))
    p = i.groupBy("vec_id").agg(F.percentile("i", 0.95).alias("p"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("i") / (F.col("p") + 1e-6)))
    return i.join(p, "vec_id").groupBy("vec_id").agg(F.count("i").alias("n"), F.round(F.sum(share), 5).alias("total"))


@register("select vec_id, list_sum([case when x >= 0.168 and x <= 0.3 then floor(x * 1000)::int else 0 end for x in [e::double for e in embedding[1:8]]])::bigint as mm, round(list_sum([case when abs(x) > 0.25 then 0.0 else x end for x in [e::double for e in embedding[1:8]]]), 6) as clean from embeddings")
def depth_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths in range as millimetres, and what isn't finite as zero."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("v"))
    odd = F.transform("v", lambda x: F.when(x > 0.25, F.lit(float("inf"))).when(x < -0.25, F.lit(float("nan"))).otherwise(x))
    total = lambda a, zero: F.aggregate(a, zero, lambda s, x: s + x)
    return e.select("vec_id", total(F.transform("v", lambda x: g.depth_mm(x, 0.168, 0.3)), F.lit(0)).cast("long").alias("mm"), F.round(total(F.transform(odd, g.finite), F.lit(0.0)), 6).alias("clean"))


@register("with p as (select p_partkey, (p_size % 100 - 25)::double u, (p_partkey % 7)::double v from part), r as (select p_partkey, (u - 5) / 20 a, (v - 3) / 20 b from p) select p_partkey, round(1 + 2.5 * a, 6) as x, round(-2.5 * b, 6) as y, 0.5::double as z from r")
def rays_on_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pixels of a camera that looks down meet a table."""
    down = F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 3.0, 0.0, 0.0, 0.0, 1.0)))
    k = F.array(*map(F.lit, (20.0, 0.0, 5.0, 0.0, 20.0, 3.0, 0.0, 0.0, 1.0)))
    hit = g.on_plane(down, k, (F.col("p_size") % 100 - 25).cast("double"), (F.col("p_partkey") % 7).cast("double"), 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(hit[0], 6).alias("x"), F.round(hit[1], 6).alias("y"), hit[2].alias("z"))


@register("select p_partkey, 20 as n, round(5 * (p_size + p_size + 4), 6)::double as x, round(5 * (0 + 3), 6) + 5 * 3 - 5 * 3::double as y from part")
def box_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as closed lines of five points a side; sums over each line."""
    x0 = F.col("p_size").cast("double")
    line = g.outline(x0, x0 + 4, F.lit(0.0), F.lit(3.0), 5)
    total = lambda k: F.aggregate(F.transform(line, lambda p: p[k]), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(line).alias("n"), (total(0) / 2).alias("x"), (total(1) / 2).alias("y"))


@register("with p as (select p_partkey, p_size / 10.0::double x, (p_partkey % 17) / 4.0 - 2::double y, 0.5 + (p_partkey % 5) / 10.0::double z from part), o as (select *, degrees(atan2(y, x) - atan2(1.0, -1.0)) yaw, sqrt(x*x + y*y + z*z) n from p) select p_partkey, round(case when yaw + 180 < 0 then yaw + 360 when yaw + 180 >= 360 then yaw - 360 else yaw end, 6) as yaw, round(degrees(asin(z / n) - asin(0.5 / sqrt(2.25))), 6) as pitch, round(n / 1.5, 6) as dolly from o")
def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a camera about a pivot, against a place of reference."""
    key = F.col("p_partkey")
    p = [F.col("p_size") / 10.0, (key % 17) / 4.0 - 2, 0.5 + (key % 5) / 10.0]
    yaw, pitch, dolly = g.orbit(p, [F.lit(-1.0), F.lit(1.0), F.lit(0.5)], (0.0, 0.0, 0.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(yaw, 6).alias("yaw"), F.round(pitch, 6).alias("pitch"), F.round(dolly, 6).alias("dolly"))


@register("with p as (select p_partkey, p_size::double s, radians(-p_size::double) a from part) select p_partkey, round(1 + cos(a) * (s - 1), 6) as x, round(sin(a) * (s - 1), 6) as y, round(cos(a), 6) as r00, round(sin(a), 6) as r10, 2.0::double as z from p")
def nominal_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses turned back about a pivot by their yaw."""
    s = F.col("p_size").cast("double")
    p = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), g.pose([F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [s, F.lit(0.0), F.lit(2.0)]).alias("t"))
    p = p.select("p_partkey", g.about_pivot(F.col("t"), -F.radians("s"), (1.0, 0.0, 0.0)).alias("t"))
    t = F.col("t")
    return p.select("p_partkey", F.round(t[3], 6).alias("x"), F.round(t[7], 6).alias("y"), F.round(t[0], 6).alias("r00"), F.round(t[4], 6).alias("r10"), t[11].alias("z"))


@register("with p as (select p_partkey, (p_size - 25) / 25.0::double s, radians(6 * ((p_size - 25) / 25.0::double)) a from part) select p_partkey, round(1 + 0.2 * s, 6) as x, round(2 - 0.1 * s, 6) as y, round(3 + 0.3 * s, 6) as z, round(cos(a), 6) as r00, round(-sin(-a), 6) as r01 from p")
def nudged_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses moved by a six-axis device."""
    unit = g.pose([F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    p = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 25.0).alias("s"), unit.alias("t"))
    s, t = F.col("s"), F.col("t")
    p = p.select("p_partkey", g.nudged(t, [s, 2 * s, 3 * s], [F.lit(0.0), F.lit(0.0), F.radians(s * 2)], 0.1, 3.0).alias("t"))
    return p.select("p_partkey", F.round(t[3], 6).alias("x"), F.round(t[7], 6).alias("y"), F.round(t[11], 6).alias("z"), F.round(t[0], 6).alias("r00"), F.round(t[1], 6).alias("r01"))


@register("with p as (select p_partkey, p_size::double s, (p_partkey % 10 - 3)::double z from part) select p_partkey, round(s * least(1, 30 / sqrt(2 * s * s)), 6) as limited, round(s + greatest(0, least(1, z / 4)) * (10 - s), 6) as between, case when z > 1 then 'whole' when 3 > 1 then 'cut' end as clip, case when z <= 1 then round(3 + (3 - 1) / (3 - z) * (s - 3), 6) else s end as clipped from p")
def clamps_and_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors held to a length, values between two commands, and segments cut at the near plane."""
    s, z = F.col("p_size").cast("double"), (F.col("p_partkey") % 10 - 3).cast("double")
    cut = g.in_front(F.array(s, F.lit(0.0), z), F.array(F.lit(3.0), F.lit(0.0), F.lit(3.0)), 1.0)
    end = F.when(z > 1, cut[0][0]).otherwise(cut[1][0])
    limited, between = g.limited(F.array(s, s), 30.0), g.lerp(F.array(s), F.array(F.lit(10.0)), z / 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(limited[0], 6).alias("limited"), F.round(between[0], 6).alias("between"), F.when(z > 1, "whole").when(cut.isNotNull(), "cut").alias("clip"), F.when(z <= 1, F.round(end, 6)).otherwise(end).alias("clipped"))


@register(f"with {_SIX} select vec_id, round(px, 6) as left_x, round(v[7 + 13], 6) as right_x, round(v[7 + 12], 6) as left_hand, 'l_x,l_y,r_x,r_y|l_x,l_y|dim_0,dim_1,dim_2' as names, round(v[20], 6) as kind from (select vec_id, v[7] px, v from v)")
def action_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of both arms as named columns, and grouped by kind."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 7, 26).alias("a"))
    out = e.select("vec_id", "a", *records.arm_columns(F.col("a"), "l", 0), *records.arm_columns(F.col("a"), "r", 13))
    names = "|".join(",".join(records.dimension_names(n, ["x", "y"])) for n in (4, 2, 3))
    return out.select("vec_id", F.round(F.col("l_xyz")[0], 6).alias("left_x"), F.round(F.col("r_xyz")[0], 6).alias("right_x"), F.round("l_hand", 6).alias("left_hand"), F.lit(names).alias("names"), F.round(records.by_kind(F.col("a"))[3], 6).alias("kind"))


@register(None)
def mean_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each group's rotations, as unit quaternions."""
    e = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 4).alias("q"))
    return poses.mean_rotation(e, ["label"], "q")
