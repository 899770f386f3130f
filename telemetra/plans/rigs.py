"""Queries on rigs: cameras, calibrations, touches and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import layouts, records, rigs, summaries
from .recordings import DEMOS, demos
from .registry import EVENTS, events, register, table

#: Customers as cameras: every fourth is a scene camera, every fourth a wrist one, the others have no role.
CAMERAS = "(select c_name as name, c_custkey::varchar serial, case when c_custkey % 2 = 0 then 'zed' else 'realsense' end as type, case c_custkey % 4 when 0 then 'scene' when 1 then 'left_wrist' end as role from customer)"


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "scene").when(k % 4 == 1, "left_wrist")
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), k.cast("string").alias("serial"), F.when(k % 2 == 0, "zed").otherwise("realsense").alias("type"), role.alias("role"))


@register(f"select name, case when serial = '8' then 'new' else serial end as serial, case when serial = '8' then 'realsense' else type end as type, case when serial = '8' then 'scene' else role end as role from {CAMERAS} where serial <> '12' and role = 'scene' union all select 'extra', 'new', 'realsense', 'scene'")
def camera_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera set anew, one added and one removed; those of the scene."""
    c = _cameras(spark, sf_dir)
    names = [rigs.by_serial(c, F.lit(k)) for k in (8, 12)]
    new = names[0].select("name").unionByName(spark.createDataFrame([("extra",)], "name string"))
    new = new.select("name", F.lit("new").alias("serial"), F.lit("realsense").alias("type"), F.lit("scene").alias("role"))
    return rigs.of_role(rigs.without_cameras(rigs.with_camera(c, new), names[1]), "scene")


_PLACED = "select user_id, t, row_number() over (partition by user_id order by t) - 1 i from " + EVENTS + " where event_type = '{}'"


@register(f"select a.user_id, a.i, a.t as a, b.t as b from ({_PLACED.format('click')}) a join ({_PLACED.format('view')}) b using (user_id, i)")
def frames_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cameras' frames paired by number, as a preview does."""
    e = events(spark, sf_dir).select("user_id", "t", "event_type")
    return rigs.by_index(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "t")


@register("with s as (select l_linenumber id, l_orderkey % 20 shot, l_quantity * 10 u, l_discount * 1000 v from lineitem), m as (select x::int id, x * 0.5 x, 0.25 * x y from range(1, 6) r(x)) select shot, count(*) as n, round(sqrt(avg((u - (100 * x / 2 + 320))**2 + (v - (100 * y / 2 + 24))**2)), 4) as rms from s join m using (id) group by all")
def reprojection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a board against their model, matched by id."""
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), (F.col("l_orderkey") % 20).alias("shot"), (F.col("l_quantity") * 10).alias("u"), (F.col("l_discount") * 1000).alias("v"))
    model = spark.range(1, 6).select(F.col("id").cast("int").alias("id"), (F.col("id") * 0.5).alias("x"), (F.col("id") * 0.25).alias("y"))
    k = F.array(*map(F.lit, (100.0, 0.0, 320.0, 0.0, 100.0, 24.0, 0.0, 0.0, 1.0)))
    out = rigs.reprojection(seen, model, ["shot"], g.projected(k, F.array("x", "y", F.lit(2.0))))
    return out.select("shot", "n", F.round("rms", 4).alias("rms"))


@register("with p as (select p_size % 4 g, p_retailprice x, (p_partkey * 7919 % 1000)::double y from part), c as (select g, count(*) n, quantile_cont(x, 0.02) x_lo, quantile_cont(x, 0.98) x_hi, quantile_cont(y, 0.02) y_lo, quantile_cont(y, 0.98) y_hi, covar_samp(x, x) xx, covar_samp(y, y) yy, covar_samp(x, y) xy from p group by all) select g, n, round(x_lo, 4) as x_lo, round(x_hi, 4) as x_hi, round(y_lo, 4) as y_lo, round(y_hi, 4) as y_hi, round(atan2(2 * xy, xx - yy) / 2, 5) as angle, round(sqrt((xx + yy) / 2 + sqrt(((xx - yy) / 2)**2 + xy**2)), 4) as spread from c")
def point_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where point sets lie but for outliers, and their main axis."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("g"), F.col("p_retailprice").alias("x"), (F.col("p_partkey") * 7919 % 1000).cast("double").alias("y"))
    both = rigs.extents(p, ["g"], ["x", "y"], 2, 98).join(rigs.main_axis(p, ["g"], "x", "y"), "g")
    return both.select("g", "n", *[F.round(c, 4).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")], F.round("angle", 5).alias("angle"), F.round("spread", 4).alias("spread"))


@register("select o_orderpriority as target, round(median(o_totalprice), 4) as j, round(max(o_totalprice) - min(o_totalprice), 4) as spread, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as deviation, round(avg(o_totalprice) - 100000, 4) as off from orders group by all")
def touch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("target"), F.col("o_totalprice").alias("j"), F.col("o_totalprice").alias("z"))
    t = rigs.touches(o, ["target"], ["j"], "z", 100_000.0)
    return t.select("target", *[F.round(c, 4).alias(c) for c in ("j", "spread", "mean", "deviation", "off")])


@register("select (select count(*) from orders) as collected, max(n) as detected, round(max(n) / (select count(*) from orders), 9) as rate, true as success from (select l_linenumber, count(distinct l_orderkey) n from lineitem where l_quantity > 10 group by all)")
def calibration_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_linenumber").alias("camera"), F.col("l_orderkey").alias("pose_id"))
    return rigs.detection_rate(table(spark, sf_dir, "orders"), found).withColumn("rate", F.round("rate", 9))


@register(f"select path % 10 as session, count(*) || ' recorded: ' || count_if(status = 'success') || ' success, ' || count_if(status = 'failure') || ' failure' || case when count_if(status = 'pending') > 0 then ', ' || count_if(status = 'pending') || ' unlabelled' else '' end as line from {DEMOS} group by all")
def session_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rigs.tally(demos(spark, sf_dir).withColumn("session", F.col("path") % 10), ["session"], "status")


@register(f"select id, case when id % 40 <= 30 and status <> 'pending' then status else 'pending' end as verdict, coalesce(case when id % 3 = 0 then price end, 7.5) as pose from {DEMOS} where case when id % 40 <= 30 and status <> 'pending' then status else 'pending' end <> 'failure'")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts given within thirty seconds, without failures, and a table's pose where the calibration lacks it."""
    d = demos(spark, sf_dir)
    said = F.when(F.col("status") != "pending", F.col("status"))
    out = d.select("id", rigs.verdict(said, (F.col("id") % 40).cast("double")).alias("verdict"), F.coalesce(F.when(F.col("id") % 3 == 0, F.col("price")), F.lit(7.5)).alias("pose"))
    return out.where("verdict <> 'failure'")


@register("select p_partkey, (p_size + 10.0::double) / 2 as x, (-4 + 6) / 2.0::double as y, -1.0::double as turned, p_size - 104 - 20.0::double as cx, 240 - 8.0::double as cy, case when p_partkey % 3 = 0 then 'arm' when p_partkey % 3 = 1 then 'object' else 'other' end as joint from part")
def rig_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of tables and of simulated cameras, intrinsics of a recorded stream, and joints by their names."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("double")
    t = rigs.table_pose(size, F.lit(10.0), F.lit(-4.0), F.lit(6.0), F.lit(0.5))
    k = F.array(F.lit(600.0), F.lit(0.0), size, F.lit(0.0), F.lit(600.0), F.lit(240.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    k = rigs.recorded_intrinsics(k, (848, 480), (640, 480), (20, 8, 600, 400))
    name = F.when(key % 3 == 0, "gripper0_right").when(key % 3 == 1, "cup_joint0").otherwise("door")
    return table(spark, sf_dir, "part").select("p_partkey", t[3].alias("x"), t[7].alias("y"), rigs.image_pose(t)[5].alias("turned"), k[2].alias("cx"), k[5].alias("cy"), rigs.sorted_joints(name, key % 3 == 1).alias("joint"))


@register(f"select event_type, arg_min(t - event_id * 1000, event_id * 1000) as offset from {EVENTS} group by all")
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("own", F.col("event_id") * 1000)
    return rigs.clock_offsets(e, "event_type", "t", "own")


@register("with e as (select label, vec_id, [x::double for x in embedding] v, row_number() over (partition by label order by vec_id) k from embeddings), p as (select a.label, a.vec_id, greatest(sqrt((b.v[1]-a.v[1])**2 + (b.v[2]-a.v[2])**2 + (b.v[3]-a.v[3])**2), sqrt((b.v[14]-a.v[14])**2 + (b.v[15]-a.v[15])**2 + (b.v[16]-a.v[16])**2)) d from e a join e b on a.label = b.label and b.k > a.k and b.k <= a.k + 3) select vec_id, round(max(d), 5) as travel, max(d) < 0.35 as still from p group by all")
def still_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far both arms move over the next three frames, and whether that is too little."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    path = F.collect_list("v").over(w.rowsBetween(0, 3))
    out = e.withColumn("travel", rigs.vector_travel(path, [(0, 3), (13, 3)])).where("travel is not null")
    return out.select("vec_id", F.round("travel", 5).alias("travel"), (F.col("travel") < 0.35).alias("still"))


@register("select l_orderkey, sum(case when l_partkey % 9 = 0 then 0 else l_partkey % 9 end)::bigint as depth, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as kept from (select *, max(l_linenumber) over (partition by l_orderkey) m from lineitem where l_orderkey % 40 = 3) where l_linenumber < m group by all")
def poses_without_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths without saturated ones; the last pose of each list taken back."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 3").withColumn("m", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).where("l_linenumber < m")
    depth = rigs.unsaturated(F.when(F.col("l_partkey") % 9 == 0, 65535).otherwise(F.col("l_partkey") % 9))
    return rows.groupBy("l_orderkey").agg(F.sum(depth).alias("depth"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("kept"))


@register(None)
def base_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean pose of one arm's base seen from the other's, by group."""
    v = table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 4).alias("q"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in ((4, "x"), (5, "y"), (6, "z"))])
    return rigs.base_transform(v, ["label"], "q", ["x", "y", "z"])


_HAND = "case when event_id % 5 = 0 then null when event_id % 2 = 0 then 'r' else 'l' end"


@register(f"select user_id, hand, arg_max(case event_id % 3 when 0 then 'POSITION' when 1 then 'ORIENTATION' else 'NONE' end, event_id) as state from (select *, {_HAND} as hand from events) where hand is not null group by all")
def tracking_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tracking state of each hand; one line in five doesn't tell it."""
    k = F.col("event_id")
    state = F.when(k % 3 == 0, "POSITION").when(k % 3 == 1, "ORIENTATION").otherwise("NONE")
    said = F.concat(F.lit("Paired device: Type:  "), F.when(k % 2 == 0, "Right").otherwise("Left"), F.lit(" Battery: 80, TrackingStatus: "), F.when(k % 5 != 0, state).otherwise("unknown"))
    return records.tracking_states(table(spark, sf_dir, "events").select("user_id", "event_id", said.alias("line")), "user_id", "event_id", "line")


@register("""with d as (select o_orderkey id, 'raw/' || o_custkey || '/' || o_orderkey raw, case when o_orderkey % 3 = 0 then 'conv/' || o_orderkey end conv from orders), g as (select id, raw, conv from d where id % 10 = 7)
select 'demos' as what, count(*) as n from d where id % 10 <> 7 union all select 'results', count(*) from d where id % 10 <> 7 and id % 2 = 0
union all select 'files', (select count(*) from d) + (select count(*) from d where conv is not null) - (select count(*) from g) - (select count(*) from g where conv is not null)
union all select 'removed', (select count(*) from g) + (select count(*) from g where conv is not null) union all select 'backup', count(*) from d union all select 'unknown', 1""")
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and files deleting one episode in ten leaves and takes, with one that nobody knows."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("raw/"), F.col("o_custkey").cast("string"), F.lit("/"), k.cast("string")).alias("raw_path"), F.when(k % 3 == 0, F.concat(F.lit("conv/"), k.cast("string"))).alias("converted_path"))
    results = d.where("id % 2 = 0").select("raw_path", F.lit("pass").alias("verdict"))
    files = d.select(F.concat("raw_path", F.lit("/metadata.json")).alias("path")).unionByName(d.where("converted_path is not null").select(F.concat("converted_path", F.lit("/a/b.parquet")).alias("path")))
    gone = d.where("id % 10 = 7").select("raw_path").unionByName(d.agg(F.lit("raw/nobody/0").alias("raw_path")))
    return summaries.record_counts(records.cascaded(d, results, files, gone)).withColumnRenamed("name", "what")


_PLANE = "select c_nationkey layout, c_custkey k, c_custkey % 11 kind, c_acctbal / 1e4 a from customer qualify row_number() over (partition by c_nationkey, c_custkey % 11 order by c_custkey) = 1 or (c_nationkey % 4 = 3 and c_custkey % 11 = 1)"


@register(f"""with p as ({_PLANE}), t as (select n_nationkey layout, 1.0 + n_nationkey / 100 as x1, -0.6 as y0, 0.7 as y1, 0.01 * n_regionkey as z from nation),
e as (select layout, count(*) filter (kind = 1) ends, count(*) filter (kind = 2) sides, arg_min(a, k) filter (kind = 1) a from p group by all), g as (select e.layout, x1, y0, y1, z, ends, sides, least(-0.2 - e.a / 10, 0.9) nx from e join t using (layout))
select layout, 'end' as wall, round((nx + x1 + 0.02) / 2, 6) as x, y0 as y, round(z + 0.6, 6) as z, null as problem from g where ends = 1 and sides = 1 union all select layout, 'far end', round((nx + x1 + 0.02) / 2, 6), y1, round(z + 0.6, 6), null from g where ends = 1 and sides = 1
union all select layout, 'side', round(x1, 6), round((y0 + y1) / 2, 6), round(z + 0.6, 6), null from g where ends = 1 and sides = 1
union all select p.layout, 'seen', case p.kind when 2 then 0.9 else 0.1 end, case p.kind when 1 then -0.55 else 0 end, round(a, 6), case when not (ends = 1 and sides = 1) then 'expected one end and one side, found ' || ends || ' and ' || sides end from p join g using (layout) where not (ends = 1 and sides = 1) or p.kind not in (1, 2)""")
def taped_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walls of layouts (nations) from planes (customers), some of which have no end, or several."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("layout"), F.col("c_custkey").alias("k"), (F.col("c_custkey") % 11).alias("kind"), (F.col("c_acctbal") / 1e4).alias("a"))
    place = F.row_number().over(Window.partitionBy("layout", "kind").orderBy("k"))
    c = c.withColumn("place", place).where("place = 1 or (layout % 4 = 3 and kind = 1)")
    triple = lambda x, y, z: F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)])
    end, side = F.col("kind") == 1, F.col("kind") == 2
    planes = c.select("layout", F.when(end, triple(0, 1, 0)).when(side, triple(-1, 0, 0)).otherwise(triple(0, 0, 1)).alias("normal"), F.when(end, triple(0.1, -0.55, F.col("a"))).when(side, triple(0.9, 0, F.col("a"))).otherwise(triple(0.1, 0, F.col("a"))).alias("center"), F.when(end, triple(1, 0, 0)).otherwise(triple(0, 1, 0)).alias("u"), F.lit(0.5).alias("offset"), F.array(0.9 + F.col("a") * 0, -0.2 - F.col("a") / 10).alias("extent"), F.array(F.lit(0.0), F.lit(1.0)).alias("z_extent"), triple(1, 1, 1).alias("rgb"), F.col("k").alias("n_points"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layout"), F.lit(0.0).alias("x0"), (1.0 + F.col("n_nationkey") / 100).alias("x1"), F.lit(-0.6).alias("y0"), F.lit(0.7).alias("y1"), (0.01 * F.col("n_regionkey")).alias("table_z"))
    out = layouts.taped_walls(planes, n, 1.0, 0.2)
    return out.select("layout", "wall", *[F.round(F.col("center")[i], 6).alias(x) for i, x in enumerate("xyz")], "problem")
