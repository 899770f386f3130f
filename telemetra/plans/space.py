"""Queries on points, chains of joints and poses along episodes: parts and customers stand for points, orders for frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import kinematics, scans, spatial
from .registry import events, register, table

_PARTS = "(select p_partkey id, p_size * 20.0::double x, p_retailprice y, (p_partkey % 97)::double z from part)"
_PEOPLE = "(select c_custkey id, c_nationkey * 40.0::double x, 900 + c_acctbal / 10 y, (c_custkey % 89)::double z from customer)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 20.0).alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 40.0).alias("x"), (900 + F.col("c_acctbal") / 10).alias("y"), (F.col("c_custkey") % 89).cast("double").alias("z"))


def _all_pairs(rows: str, points: str, way: str) -> str:
    square = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return f"select '{way}' as way, a.id, arg_min(b.id, ({square}, b.id)) as near, round(sqrt(min({square})), 6) as distance from {rows} a, {points} b group by all"


@register(f"{_all_pairs(_PEOPLE, _PARTS, 'to parts')} union all {_all_pairs(_PARTS, _PEOPLE, 'to people')}")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of one set of points to each of another, in both directions."""
    parts, people = _parts(spark, sf_dir), _people(spark, sf_dir)
    there = spatial.nearest(people, spatial.Cells(parts)).select(F.lit("to parts").alias("way"), "id", "near", F.round("distance", 6).alias("distance"))
    back = spatial.nearest(parts, spatial.Cells(people)).select(F.lit("to people").alias("way"), "id", "near", F.round("distance", 6).alias("distance"))
    return there.unionByName(back)


def _literal(t: tuple[float, ...]) -> Column:
    return F.array(*map(F.lit, t))


@register(None)
def rigid_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion of each brand's parts, which a turn by the brand's number and a shift have moved."""
    p = _parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    angle = F.regexp_extract("p_brand", r"(\d+)", 1).cast("double") / 20
    p = p.withColumn("t", geometry.yaw_pose(angle, F.lit(5.0), F.lit(-3.0), angle))
    p = p.withColumn("n", geometry.transformed(F.col("t"), F.col("x"), F.col("y"), F.col("z"))).withColumns({f"n{c}": F.col("n")[k] for k, c in enumerate("xyz")})
    out = spatial.rigid_fit(p, ["p_brand"])
    return out.select("p_brand", "n", *[F.round(F.col("pose")[k], 6).alias(f"m{k}") for k in range(12)])


@register(None)
def registered_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion that takes the parts onto a moved copy of most of them, found by nearest neighbours from no guess at all."""
    p = _parts(spark, sf_dir).select("id", *[(F.col(c) / 1000).alias(c) for c in "xyz"])
    planted = _literal((0.9998, -0.02, 0.0, 0.004, 0.02, 0.9998, 0.0, -0.006, 0.0, 0.0, 1.0, 0.002, 0.0, 0.0, 0.0, 1.0))
    moved = geometry.transformed(planted, F.col("x"), F.col("y"), F.col("z"))
    scene = p.where("id % 9 <> 0").select("id", moved.alias("m")).select("id", *[F.col("m")[k].alias(c) for k, c in enumerate("xyz")])
    pose, rms, kept = spatial.registered(p, scene, [[float(i == j) for j in range(4)] for i in range(4)])
    return p.agg(F.count("*").alias("n")).select("n", F.lit(kept).alias("kept"), F.lit(round(rms, 9)).alias("rms"), *[F.lit(round(float(pose[i][j]), 6)).alias(f"m{4 * i + j}") for i in range(3) for j in range(4)])


@register(None)
def robust_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane in most lines of each return flag, among a third of lines off it."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_extendedprice") / 1e5).alias("w"), "l_linenumber")
    z = F.when(F.col("l_linenumber") % 3 == 0, F.col("w")).otherwise(0.4 * F.col("x") - 0.2 * F.col("y") + 0.5 + (F.col("w") - 0.5) / 100)
    out = spatial.robust_plane(rows.withColumn("z", z), ["l_returnflag"], 0.01, tries=200, seed=7)
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in "abcd"], "n", "tried")


@register(None)
def surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the surface of each type's mesh, whose faces are its parts."""
    k, names = F.col("p_partkey"), [f"{p}{c}" for p in "abc" for c in "xyz"]
    faces = table(spark, sf_dir, "part").select("p_type", k.alias("face"), *[(F.pmod(k * (7 + 2 * j) + F.col("p_size"), F.lit(11 + j)) / 10).alias(n) for j, n in enumerate(names)])
    return spatial.surface_sample(faces, "p_type", 500, 3).select("p_type", "draw", "face", *[F.round(c, 9).alias(c) for c in "xyz"])


_JOINT = "select l_orderkey k, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) i, l_tax * 2 a, l_discount * 6 al, l_quantity / 50 d, l_extendedprice / 9000 th from lineitem"
_LINK = "[cos(th), -sin(th) * cos(al), sin(th) * sin(al), a * cos(th), sin(th), cos(th) * cos(al), -cos(th) * sin(al), a * sin(th), 0, sin(al), cos(al), d, 0, 0, 0, 1]"


_PRODUCT = ", ".join(" + ".join(f"c.m[{4 * r + x + 1}] * j.m[{4 * x + q + 1}]" for x in range(4)) for r in range(4) for q in range(4))


@register(f"""with recursive j as (select k, i, {_LINK} as m from (select k, row_number() over (partition by k order by i) as i, a, al, d, th from ({_JOINT}))),
c as (select k, i, m from j where i = 1 union all select c.k, j.i, [{_PRODUCT}] from c join j on j.k = c.k and j.i = c.i + 1)
select k as l_orderkey, max(i) as n, round(arg_max(m[4], i), 4) as x, round(arg_max(m[8], i), 4) as y, round(arg_max(m[12], i), 4) as z, round(arg_max(m[1], i), 4) as turn from c group by all""")
def forward_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tip of a chain whose joints are an order's lines."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", place.alias("joint"), kinematics.link(F.col("l_tax") * 2, F.col("l_discount") * 6, F.col("l_quantity") / 50, F.col("l_extendedprice") / 9000).alias("t"))
    out = kinematics.chained(rows, ["l_orderkey"], "joint", "t")
    return out.select("l_orderkey", "n", *[F.round(F.col("pose")[k], 4).alias(name) for k, name in ((3, "x"), (7, "y"), (11, "z"), (0, "turn"))])


@register(None)
def wrist_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of cameras on two arms, from an arm's joints and an episode's angles; those of one arm hang upside down."""
    sevens = F.sequence(F.lit(0), F.lit(5))
    joints = table(spark, sf_dir, "nation").where("n_nationkey < 12").select((F.col("n_nationkey") % 2).alias("arm"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("joint"), (F.col("n_nationkey") / 100).alias("a"), (F.col("n_regionkey") - 2.0).alias("alpha"), (F.col("n_nationkey") / 50).alias("d"), F.lit(0.1).alias("theta"))
    e = events(spark, sf_dir).select("event_id", (F.col("user_id") % 2).cast("int").alias("arm"), F.transform(sevens, lambda k: F.sin(F.col("value") + k)).alias("q"))
    tips = kinematics.forward(e, joints, "arm", ["event_id"])
    mount = _literal((0.0, -1.0, 0.0, 0.05, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.07, 0.0, 0.0, 0.0, 1.0))
    other = F.when(F.col("arm") == 1, _literal((-1.0, 0.0, 0.0, 0.6, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    seen = tips.select("event_id", "arm", kinematics.camera_pose(F.col("pose"), mount, other, F.col("arm") == 0).alias("c"))
    return seen.select("event_id", "arm", *[F.round(F.col("c")[k], 5).alias(f"m{k}") for k in range(12)])


@register(None)
def smoothed_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and turn along each episode, low-passed."""
    e = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    e = e.withColumn("pose", geometry.yaw_pose(F.col("value") / 20, F.col("value"), F.lit(1.0), F.col("i") / 10))
    out = scans.smoothed_poses(e, ["user_id"], ["i"], "pose", 0.3)
    return out.select("user_id", "i", *[F.round(F.col("pose")[k], 6).alias(n) for k, n in ((0, "cos"), (4, "sin"), (3, "x"), (11, "z"))])


def _view(k: Column, turns: tuple[float, float, float], shift: tuple[float, float, float]) -> Column:
    """A pose that three angles and a place of `k` give."""
    r, p, y = (F.sin(k * a) for a in turns)
    return geometry.pose([e for e in geometry.euler_xyz(r, p, y)], [F.sin(k * b) for b in shift])


@register(None)
def hand_eye_rigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera on the hand of each rig (a customer with orders), whose views of a board are the orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    camera = geometry.yaw_pose(F.col("o_custkey") / 7, F.lit(0.05), F.lit(-0.02), F.lit(0.08))
    o = o.withColumns({"hand": _view(F.col("o_orderkey").cast("double"), (0.7, 1.3, 2.1), (0.3, 0.9, 1.7)), "mount": camera})
    board = _literal((0.0, -1.0, 0.0, 0.4, 1.0, 0.0, 0.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    bound = lambda t, f: F.transform(F.array(t), f)[0]
    o = o.withColumn("board", geometry.times(bound(geometry.times(F.col("hand"), F.col("mount")), geometry.inverse_pose), board))
    out = kinematics.hand_eye(o, ["o_custkey"], "o_orderkey", least=5)
    return out.select("o_custkey", "n", "success", *[F.round(F.col("pose")[k], 5).alias(f"m{k}") for k in (0, 3, 4, 7, 11)])


@register("""with g as (select user_id, event_id, epoch_us(ts) // 1000 ms, lead(epoch_us(ts) // 1000) over (partition by user_id order by epoch_us(ts) // 1000) nxt from events), m as (select max(epoch_us(ts) // 1000) - 1800000 mark from events),
s as (select *, coalesce(nxt, mark + 1) - ms gap from g, m) select user_id, ms + 43200000 as ms, 'hold' as state from s where gap > 43200000 union all select user_id, ms + 172800000, 'warn' from s where gap > 172800000
union all select user_id, nxt, 'back' from s where nxt is not null and gap > 43200000 and gap <= 864000000""")
def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When no row of an episode has come for half a day and for two days, and when it is back; forgotten after ten days."""
    from ..streaming import timers
    from .streams import _finished, _stream

    rows = timers.marked(_stream(spark, sf_dir).select("user_id", "ts"), "ts", "30 minutes")
    out = _finished(timers.silence(rows, "user_id", "ts", 43_200_000, 172_800_000, 864_000_000))
    return out.select("user_id", F.expr("cast(date_diff(millisecond, timestamp_ntz'1970-01-01', at) as bigint)").alias("ms"), "state")


@register("""with a as (select user_id, ms, v, lead(ms) over (partition by user_id order by ms) nxt from (select user_id, epoch_us(ts) // 1000 ms, value v from events where event_type = 'purchase')), m as (select max(epoch_us(ts) // 1000) - 1800000 mark from events)
select user_id, ms, v as command, 'new' as state from a union all select user_id, ms + 86400000, v, 'held' from a, m where coalesce(nxt, mark + 1) - ms > 86400000""")
def stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase as an action that replaces the one before, and is held when none has replaced it for a day."""
    from ..streaming import timers
    from .streams import _finished, _stream

    rows = _stream(spark, sf_dir).select("user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("action"))
    out = _finished(timers.commanded(timers.marked(rows, "ts", "30 minutes"), "user_id", "ts", "action", 86_400_000, 864_000_000))
    return out.select("user_id", F.expr("cast(date_diff(millisecond, timestamp_ntz'1970-01-01', at) as bigint)").alias("ms"), "command", "state")
