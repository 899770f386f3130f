"""Queries that write an episode store from the tables, in its own folders and documents, and read it as its users do.

Suppliers stand for recordings and cameras, nations for tasks and rigs, events for telemetry and frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import frames, records, rigs, summaries, windows
from ..sinks import datasets
from ..sources import episodes
from .registry import EVENTS, events, register, table
from .stores import _place

_SUPPLIER = "select s_suppkey, 'n' || s_nationkey as task, 's' || s_suppkey as episode, s_acctbal, s_nationkey from supplier"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey")).alias("task"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("episode"), "s_acctbal", "s_nationkey")


@register(f"with e as (select event_type as task, 'u' || user_id % 40 as episode, t * 1000 as t_ns, event_id % 1000 as q from {EVENTS}) select task, episode, count(*) as n, min(t_ns) as first, max(t_ns) as last, sum(q + 5)::double as last_joint, sum(q % 8 / 8.0)::double as gripper, count(*) as sevens from e group by all")
def telemetry_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry written by task and episode and scanned again; the seventh place of joint_pos_7d is the gripper's."""
    e = events(spark, sf_dir)
    q = F.col("event_id") % 1000
    rows = e.select(F.col("event_type").alias("task"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("episode"), (F.col("t") * 1000).alias("t_ns"), F.lit("l").alias("arm"), F.array(*[(q + k).cast("float") for k in range(6)]).alias("joint_pos"), F.array((q % 8 / 8).cast("float")).alias("gripper_pos"))
    at = _place(spark)
    datasets.telemetry(datasets.seven(rows), at)
    back = episodes.telemetry(spark, at, "*.parquet")
    total = lambda c: F.sum(c.cast("double"))
    return back.groupBy("task", "episode").agg(F.count("*").alias("n"), F.min("t_ns").alias("first"), F.max("t_ns").alias("last"), total(F.col("joint_pos")[5]).alias("last_joint"), total(F.col("joint_pos_7d")[6]).alias("gripper"), F.count_if(F.size("joint_pos_7d") == 7).alias("sevens"))


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """A store of recordings' documents; every tenth is cut short in its text. Returns its place."""
    r = _recorded(spark, sf_dir)
    k = F.col("s_suppkey")
    starts = F.create_map(F.lit("scene"), k * 1_000_000_000_000, F.lit("wrist"), k * 1_000_000_000_000 + 7)
    rows = r.select("task", "episode", F.concat(F.lit("task "), "s_nationkey").alias("task_name"), F.col("s_acctbal").alias("duration_s"), (k % 4 != 1).alias("complete"), F.when(k % 3 != 0, F.array(F.lit("scene"), F.lit("wrist"))).otherwise(F.array(F.lit("scene"))).alias("cameras"), starts.alias("camera_start_times_ns"))
    said = datasets.metadata(rows)
    number = F.substring("episode", 2, 20).cast("long")
    at = _place(spark)
    datasets.documents(said.withColumn("json", F.when(number % 10 == 0, F.substring("json", 1, 25)).otherwise(F.col("json"))), at)
    return at


@register(f"with r as ({_SUPPLIER}) select task, episode, case when s_suppkey % 10 <> 0 then s_acctbal end as duration_s, case when s_suppkey % 10 <> 0 then s_suppkey % 4 <> 1 end as complete, case when s_suppkey % 10 <> 0 then case when s_suppkey % 3 <> 0 then 2 else 1 end end::bigint as n_cameras, case when s_suppkey % 10 <> 0 then s_suppkey * 1000000000000 + 7 end as wrist_start, s_suppkey % 10 = 0 as broken from r")
def recording_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of recordings by their folders; a broken one keeps its row."""
    rows = episodes.recordings(spark, _documents(spark, sf_dir), "*.txt")
    n = F.when(F.col("cameras").isNotNull(), F.size("cameras")).cast("long")
    return rows.select("task", "episode", "duration_s", "complete", n.alias("n_cameras"), F.col("camera_start_times_ns")["wrist"].alias("wrist_start"), F.col("broken").isNotNull().alias("broken"))


@register(f"with r as ({_SUPPLIER}) select task, count(*) as episodes, count_if(s_suppkey % 3 <> 0) as converted, min(case when s_suppkey % 3 = 0 then episode end) as next from r group by all")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with their episodes, from listings alone: how many are converted, and the first that isn't."""
    raw = _documents(spark, sf_dir)
    done = _place(spark)
    datasets.documents(_recorded(spark, sf_dir).where("s_suppkey % 3 <> 0").select("task", "episode", F.lit("{}").alias("json")), done)
    found, made = episodes.listing(spark, raw, "*.txt"), episodes.listing(spark, done, "*.txt")
    left = records.to_do(found.select("task", "episode"), made.select("task", "episode"), ["task", "episode"]).groupBy("task").agg(F.min("episode").alias("next"))
    counted = episodes.by_task(made).select("task", F.col("episodes").alias("converted"))
    out = episodes.by_task(found).join(counted, "task", "left").join(left, "task", "left")
    return out.select("task", "episodes", F.coalesce("converted", F.lit(0)).cast("long").alias("converted"), "next")


@register("select strftime(o_orderdate, '%Y-%m-%d') as day, 't' || o_custkey as teacher, count(*) as n from orders where o_orderkey % 7 > 2 group by all")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, some of which aren't JSON, lack a time or have none that can be read."""
    k = F.col("o_orderkey")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00"))
    told = F.to_json(F.struct(F.when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, "soon").otherwise(at).alias("started"), F.concat(F.lit("t"), "o_custkey").alias("teacher")))
    place = _place(spark)
    table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.concat(F.lit("["), told)).otherwise(told)).write.text(place)
    log = episodes.logged(spark, place)
    return log.groupBy(F.date_format("started", "yyyy-MM-dd").alias("day"), "teacher").agg(F.count("*").alias("n"))


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, episode, camera, hand_eye, extrinsics, success): a rig's cameras, each third of them on a tool, and some not calibrated."""
    r, k = _recorded(spark, sf_dir), F.col("s_suppkey")
    pose = g.yaw_pose(F.lit(0.0), k.cast("double"), F.lit(2.0), F.lit(3.0))
    return r.select(F.lit("rigs").alias("task"), F.col("task").alias("episode"), F.col("episode").alias("camera"), F.when(k % 3 == 0, pose).alias("hand_eye"), F.when(k % 3 == 1, pose).alias("extrinsics"), (k % 3 == 1).alias("success"))


@register(f"with r as ({_SUPPLIER}) select task as rig, episode as camera, case when s_suppkey % 3 = 0 then s_suppkey end::double as hand_x, case when s_suppkey % 3 = 1 then s_suppkey end::double as base_x, case when s_suppkey % 3 < 2 then 16 end::bigint as size, s_suppkey % 3 = 1 as success from r")
def calibration_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations of rigs as documents, and the poses that are read of them."""
    at = _place(spark)
    datasets.documents(datasets.calibration_results(_cameras(spark, sf_dir)), at)
    c = episodes.calibrations(spark, at, "*.txt")
    some = F.coalesce("hand_eye", "extrinsics")
    return c.select(F.col("episode").alias("rig"), "camera", F.col("hand_eye")[3].alias("hand_x"), F.col("extrinsics")[3].alias("base_x"), F.when(some.isNotNull(), F.size(some)).cast("long").alias("size"), "success")


@register(f"with r as ({_SUPPLIER}) select episode as camera, case when s_suppkey % 3 = 0 then 'follower_' || case when s_suppkey % 2 = 0 then 'l' else 'r' end || '_joint_pos' end as joints, case when s_suppkey % 3 = 0 then s_suppkey end::double as hand_x, case when s_suppkey % 3 <> 0 then s_suppkey end::double as base_x, s_suppkey % 3 <> 0 as success from r")
def rig_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rig's cameras as its calibration, and the joints that move those on wrists."""
    r, k = _recorded(spark, sf_dir), F.col("s_suppkey")
    pose = g.yaw_pose(F.lit(0.0), k.cast("double"), F.lit(2.0), F.lit(3.0))
    cal = rigs.rig_calibration(r.select(F.col("episode").alias("camera"), F.when(k % 3 != 0, pose).alias("base_pose"), pose.alias("tool_pose")))
    role = F.when(k % 3 != 0, "scene").when(k % 2 == 0, "left_wrist").otherwise("right_wrist")
    moved = rigs.wrist_joints(r.select(F.col("episode").alias("name"), role.alias("role"))).withColumnRenamed("name", "camera")
    return cal.join(moved, "camera", "left").select("camera", "joints", F.col("hand_eye")[3].alias("hand_x"), F.col("extrinsics")[3].alias("base_x"), "success")


@register(f"with r as ({_SUPPLIER}), k as (select *, case when s_suppkey % 5 = 4 then null else 639 - s_suppkey end flipped from r) select episode as camera, case when s_suppkey % 5 = 4 then 1 else 400 * 320 / 640.0 end::double as fx, case when s_suppkey % 5 = 4 then 0 when s_suppkey % 2 = 0 then flipped * 320 / 640.0 else s_suppkey * 320 / 640.0 end::double as cx, case when s_suppkey % 3 = 0 and s_suppkey % 7 <> 0 then case when s_suppkey % 2 = 0 then -1 else 1 end end::double as tool_r00, case when s_suppkey % 3 <> 0 then case when s_suppkey % 7 <> 0 then s_suppkey else 0 end end::double as base_x, case when s_suppkey % 3 = 0 and s_suppkey % 7 = 0 then 'no hand-eye calibration' when s_suppkey % 3 <> 0 and s_suppkey % 7 = 0 then 'no extrinsics' when s_suppkey % 5 = 4 then 'not opened' end as note from k")
def served_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transforms that a server holds for its cameras: on wrists, upside down, not opened, not calibrated."""
    r, k = _recorded(spark, sf_dir), F.col("s_suppkey")
    pose = g.yaw_pose(F.lit(0.0), k.cast("double"), F.lit(2.0), F.lit(3.0))
    c = r.select(F.col("episode").alias("camera"), (k % 3 == 0).alias("wrist"), (k % 2 == 0).alias("flip"), (k % 5 != 4).alias("opened"), *[F.lit(v).alias(n) for n, v in (("fx", 400.0), ("fy", 400.0), ("cy", 200.0))], k.cast("double").alias("cx"), F.lit(640).alias("width"), F.lit(480).alias("height"),
                 pose.alias("hand_eye"), (k % 7 != 0).alias("solved"), pose.alias("extrinsics"), (k % 7 != 0).alias("success"), F.lit("left_arm_base").alias("reference_frame"))
    out = frames.camera_transforms(c, resize=(320, 240))
    return out.select("camera", F.col("intrinsics")[0].alias("fx"), F.col("intrinsics")[2].alias("cx"), F.col("tool")[0].alias("tool_r00"), F.col("extrinsics")[3].alias("base_x"), "note")


_LOWDIM = f"""s as (select user_id % 100 e, t * 1000 t, max(value) v from {EVENTS} where event_type = 'view' group by all), f as (select event_id, user_id % 100 e, t * 1000 t from {EVENTS} where event_type = 'click'),
n as (select f.*, b.t bt, b.v bv, a.v av, case when a.t = b.t then 0 else (f.t - b.t) / (a.t - b.t) end share from f asof join s b on f.e = b.e and f.t >= b.t asof join s a on f.e = a.e and f.t <= a.t)"""


@register(f"with {_LOWDIM} select 'e' || e as episode, event_id::int as frame_idx, round((bv + share * (av - bv))::float::double, 3) as joint, round((bv / 100 + share * (av / 100 - bv / 100))::float::double, 4) as opening, case when bv / 100 + share * (av / 100 - bv / 100) >= 0.5 then 1 else 0 end::double as command, (639 - e)::double as wrist_cx, 1::bigint as n_extrinsics, case when e % 3 = 0 then '' else 'task' || e end as language, case when e % 4 = 0 then 0 else e end::double as table_x from n")
def lowdim_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames built from telemetry, cameras and recordings, written by episode and scanned with what they must have."""
    e = events(spark, sf_dir).select("event_id", F.lit("t").alias("task"), (F.col("user_id") % 100).alias("k"), F.concat(F.lit("e"), F.col("user_id") % 100).alias("episode"), (F.col("t") * 1000).alias("t_ns"), "event_type", "value")
    v = F.col("value")
    samples = e.where("event_type = 'view'").select("task", "episode", "t_ns", F.array(*[v + float(j) for j in range(6)]).alias("joint_pos"), F.array(v / 100).alias("gripper_pos"), F.array(*[v - float(j) for j in range(6)], v / 100).alias("joint_cmd"))
    span = samples.groupBy("task", "episode").agg(F.min("t_ns").alias("lo"), F.max("t_ns").alias("hi"))
    seen = e.where("event_type = 'click'").join(span, ["task", "episode"]).where("t_ns between lo and hi").select("task", "episode", F.col("event_id").cast("int").alias("frame_idx"), "t_ns")
    eps = e.select("task", "episode", F.col("k").cast("double").alias("k")).distinct()
    k = F.col("k")
    cameras = eps.select("task", "episode", "k", F.explode(F.array(F.lit("front"), F.lit("wrist"))).alias("camera")).select("task", "episode", "camera", frames.intrinsics(F.lit(400.0), F.lit(400.0), k, F.lit(200.0), F.lit(640), F.lit(480), F.col("camera") == "wrist").alias("intrinsics"), F.when(F.col("camera") == "front", g.yaw_pose(F.lit(0.0), k, k, k)).alias("extrinsics"))
    said = eps.select("task", "episode", F.when(k % 3 != 0, F.concat(F.lit("task"), k.cast("int"))).alias("task_name"), F.lit("do").alias("task_instruction"), F.when(k % 4 != 0, g.yaw_pose(F.lit(0.0), k, F.lit(0.0), F.lit(0.0))).alias("table_pose"))
    at = _place(spark)
    datasets.lowdim(frames.built(seen, samples, cameras, said), at)
    back = episodes.lowdim(spark, at, ["joints", "action_joints"], "*.parquet")
    d = lambda c: c.cast("double")
    return back.select("episode", "frame_idx", F.round(d(F.col("joints")[0]), 3).alias("joint"), F.round(d(F.col("joints")[6]), 4).alias("opening"), d(F.col("action_joints")[6]).alias("command"), d(F.col("intrinsics")["wrist"][2]).alias("wrist_cx"), F.size("extrinsics").cast("long").alias("n_extrinsics"), F.col("language_task").alias("language"), d(F.col("table_pose")[3]).alias("table_x"))


@register(f"with b as (select event_id, user_id, value, row_number() over w - 1 i, lag(value) over w before, lead(value) over w after from {EVENTS} window w as (partition by user_id order by t, event_id)) select md5(user_id || '/' || i) as sample_id, round(coalesce(before, value), 6) as state, round(value + coalesce(after, value), 6) as action, '{{\"anchor\":' || i || ',\"user\":' || user_id || '}}' as metadata from b")
def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples with ids of their own, arrays by key, and metadata."""
    w = windows.clamped(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", 1, 1).withColumn("episode", F.col("user_id").cast("string"))
    made = datasets.samples(w, {"state": F.slice("window", 1, 1), "action": F.slice("window", 2, 2)}, {"anchor": F.col("index"), "user": F.col("user_id")})
    return made.select("sample_id", F.round(F.col("state")[0], 6).alias("state"), F.round(F.col("action")[0] + F.col("action")[1], 6).alias("action"), "metadata")


@register("select event_type, count(value) as n, round(avg(value), 6) as mean, min(value) as min, round(quantile_cont(value, 0.99), 6) as p99 from events group by all")
def statistics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each key as the document that training reads, read again."""
    told = datasets.statistics(summaries.moments(events(spark, sf_dir), ["event_type"], "value", summaries.PERCENTS), "event_type")
    j = F.from_json("json", "n long, mean double, min double, p99 double")
    return told.select("event_type", j.alias("j")).select("event_type", "j.n", F.round("j.mean", 6).alias("mean"), "j.min", F.round("j.p99", 6).alias("p99"))


@register("select '{\"events\":' || (select count(*) from events) || ',\"frames\":' || (select count(*) from events where event_type = 'click') || ',\"recordings\":' || (select count(*) from supplier) || '}' as counts, '{\"past\":\"1\",\"stride\":\"2\"}' as config")
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run read and made, and its configuration, in one row."""
    e = events(spark, sf_dir)
    return datasets.run_metadata({"recordings": table(spark, sf_dir, "supplier"), "events": e, "frames": e.where("event_type = 'click'")}, {"stride": "2", "past": "1"})


@register("select label as episode, vec_id as frame_idx, round(vec_id / 30.0, 6) as timestamp, embedding[1] as l_x, embedding[2] as l_y, embedding[3] as r_x, embedding[4] as r_y from embeddings")
def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as the columns of a training table, a place of a vector to each."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("joints"))
    w = datasets.wide(e, {"joints": records.dimension_names(4, ["x", "y"])}, 30.0)
    return w.select("episode", "frame_idx", F.round("timestamp", 6).alias("timestamp"), *[F.col(f"`joints.{n}`").alias(n) for n in ("l_x", "l_y", "r_x", "r_y")])


@register("with c as (select o_custkey % 500 as episode, list(o_totalprice order by o_orderkey) v from orders group by all), m as (select max(len(v)) most from c) select episode, len(v)::bigint as n, (select most from m)::bigint as padded, round(list_sum(v), 2) as total from c")
def padded_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each episode, filled to one length, written, read and cut to their own."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"])
    c = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("episode")).agg(path.alias("v"))
    at = _place(spark)
    datasets.padded(c, ["v"], []).write.parquet(at)
    back = spark.read.parquet(at).withColumn("padded", F.size("v").cast("long"))
    out = episodes.unpadded(back, ["v"], "length")
    return out.select("episode", F.size("v").cast("long").alias("n"), "padded", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@register(f"with f as (select user_id, count(distinct event_id) n, string_agg(distinct event_type, ',' order by event_type) c from {EVENTS} group by all) select user_id::varchar as episode, n as num_frames, c as cameras, round(n / 30.0, 6) as seconds, case when user_id % 3 = 0 then 'say ' || user_id when user_id % 3 = 1 then 'name' else 'all' end as language from f")
def episode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each converted episode holds; its language is the instruction, else the task's name, else its folder's."""
    u = F.col("user_id")
    f = events(spark, sf_dir).select(F.lit("all").alias("task"), u.cast("string").alias("episode"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("camera"), "user_id")
    said = f.select("task", "episode", "user_id").distinct().select("task", "episode", F.when(u % 3 == 2, "").otherwise("name").alias("task_name"), F.when(u % 3 == 0, F.concat(F.lit("say "), u)).otherwise("").alias("task_instruction"))
    m = datasets.episode_metadata(f, said, 30.0)
    return m.select("episode", "num_frames", F.array_join("cameras", ",").alias("cameras"), F.round("seconds", 6).alias("seconds"), "language")


@register("select s_suppkey, '{\"fit\":\"' || s_nationkey || '\",\"name\":\"' || s_name || '\",\"new\":\"' || s_suppkey % 7 || '\"}' as now, '{\"fit\":\"old\",\"name\":\"' || s_name || '\"}' as before from supplier")
def rig_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of rigs with some values set anew; what they were stays beside them."""
    s = table(spark, sf_dir, "supplier").withColumn("before", F.to_json(F.struct(F.lit("old").alias("fit"), F.col("s_name").alias("name"))))
    return s.select("s_suppkey", datasets.patched(F.col("before"), {"fit": F.col("s_nationkey"), "new": F.col("s_suppkey") % 7}).alias("now"), "before")


@register("select p_partkey, p_type as name, 'base' as frame from part where p_type in ('SMALL', 'ECONOMY')")
def board_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of a board by their names, all of one frame of reference; those of other names may have any."""
    wanted = ["SMALL", "ECONOMY"]
    p = table(spark, sf_dir, "part")
    shots = p.select("p_partkey", F.col("p_type").alias("name"), F.when(F.col("p_type").isin(wanted), "base").otherwise("world").alias("reference_frame"))
    return episodes.shots(shots, wanted, "base").select("p_partkey", "name", F.col("reference_frame").alias("frame"))
