"""Whole verdicts on episodes: users stand for episodes, hours for seconds, values for joints and purchases for a closed gripper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from .registry import EVENTS, events, register

HOUR = 3_600_000_000
SETTINGS = verdicts.Settings(
    controls={"scene": {"gain": 16.0}, "wrist": {"gain": 16.0}}, inner=(0.0, 10.0, -6.0, 6.0), outer=(-1.0, 12.0, -9.0, 9.0), fixture=(2.0, 4.0, -5.0, 5.0), radius=1.5, footprint=(-1.0, 2.0, -3.0, 3.0),
    x_slack=1.0, tips=(20, 10), most_tip=12, moved=1.5, closes=2, still=1.44, gripper_still=5.0, guard=1.0, pause=12.0, lag=2, seconds=(9.5, 60.5), unit=float(HOUR), names=("object", "fixture"))

_AT = "'(' || printf('%.3f', u % 14 - 1.0) || ', ' || printf('%+.3f', u % 17 - 8.0) || ')'"
_FIX = "'(' || printf('%.3f', u % 6 + 0.0) || ', ' || printf('%+.3f', u % 15 - 7.0) || ')'"


@register(f"""with e as (select *, row_number() over (partition by user_id, t order by event_id) one from {EVENTS}), d as (select * from e where one = 1),
s as (select user_id, t, abs(value - lag(value, 2) over w) / greatest(t - lag(t, 2) over w, 1) < 1.44 / 3600000000.0 and (event_type = 'purchase') = (lag(event_type) over w = 'purchase') still, event_type = 'purchase' and lag(event_type) over w <> 'purchase' shut,
 min(t) over (partition by user_id) lo, max(t) over (partition by user_id) hi, coalesce(lead(t) over w, t) nxt from d window w as (partition by user_id order by t)),
m as (select *, coalesce(still, false) and t > lo + 3600000000 and t < hi - 3600000000 x from s), g as (select *, sum(case when x then 0 else 1 end) over (partition by user_id order by t) g from m),
r as (select user_id, g, min(t) - min(lo) a, max(nxt) - min(t) n from g where x group by all having max(nxt) - min(t) > 43200000000),
p as (select user_id, list('pause ' || printf('%.1f', n / 3600000000.0) || ' s at ' || printf('%.1f', a / 3600000000.0) || ' s' order by a) p from r group by all),
c as (select user_id, count_if(shut) c from s where user_id % 19 <> 3 group by all),
q as (select distinct user_id u, user_id % 4 task, case when user_id % 23 <> 0 then (user_id * 37 % 100)::double end dur from events),
o as (select a.u, median(b.dur) others from q a join q b on a.task = b.task and a.u <> b.u where b.dur <> 0 group by all having count(*) >= 5),
f as (select q.*, coalesce(c, 0) c, case when u % 19 <> 3 then p end p, case when dur <> 0 and not dur between 0.5 * others and 1.8 * others then others end med from q left join c on c.user_id = u left join p on p.user_id = u left join o using (u))
select u as user_id, c as closes, array_to_string(list_concat(list_filter([
 case when u % 3 > 0 then 'scene color_controls {{"gain":' || (16 + u % 3)::double || '}} (camera.json {{"gain":16.0}})' end,
 case when u % 5 = 0 then 'wrist color_controls None (camera.json {{"gain":16.0}})' end,
 case when u % 11 = 0 then 'wrist frame unreadable' end,
 case when u % 11 > 0 and u % 8 > 0 and abs(u % 40 - 20) > 12 then 'wrist: left tip row ' || u % 40 || ' vs 20 (camera slipped?)' end,
 case when u % 11 > 0 and u % 6 > 0 and abs(u % 30 - 10) > 12 then 'wrist: right tip row ' || u % 30 || ' vs 10 (camera slipped?)' end,
 case when u % 11 > 0 and u % 24 = 0 then 'wrist: no fingertip found (camera slipped?)' end,
 case when u % 11 > 0 and 90 + u % 20 < 100 then 'wrist brightness ' || 90 + u % 20 || ' < 100 (camera slipped?)' end,
 case when u % 13 = 0 then 'scene frame unreadable' end,
 case when u % 13 > 0 and 80 + u % 70 not between 90 and 140 then 'scene brightness ' || 80 + u % 70 || ' outside (90.0, 140.0)' end,
 case when u % 13 > 0 and u % 9 = 0 then 'object not found in the first scene frame' end,
 case when u % 13 > 0 and u % 9 > 0 and not (u % 14 - 1 between 0 and 10 and u % 17 - 8 between -6 and 6) then 'object centre ' || {_AT} || ' outside the inner box' end,
 case when u % 13 > 0 and u % 9 > 0 and not (u % 14 - 2.5 >= -1 and u % 14 + 0.5 <= 12 and u % 17 - 9.5 >= -9 and u % 17 - 6.5 <= 9) then 'object ' || {_AT} || ' may cross the outer box' end,
 case when u % 13 > 0 and u % 10 = 0 then 'fixture not found in the first scene frame' end,
 case when u % 13 > 0 and u % 10 > 0 and not u % 6 between 1 and 5 then 'fixture x ' || printf('%.3f', u % 6 + 0.0) || ', sim 3.000 (> 1000 mm off)' end,
 case when u % 13 > 0 and u % 10 > 0 and not u % 15 - 7 between -5 and 5 then 'fixture y ' || printf('%+.3f', u % 15 - 7.0) || ' outside the sim''s ±5.000' end,
 case when u % 13 > 0 and u % 10 > 0 and not (u % 6 - 1 >= -1 and u % 6 + 2 <= 12 and u % 15 - 10 >= -9 and u % 15 - 4 <= 9) then 'fixture ' || {_FIX} || ' crosses the outer box' end,
 case when u % 13 > 0 and u % 10 > 0 and u % 4 > 1 then 'fixture moved ' || (u % 4) * 1000 || ' mm (x +' || (u % 4) * 1000 || ', y +0 mm)' || case when u % 7 > 3 then ' by 50 s, hidden for the last ' || u % 7 || ' s' else '' end end,
 case when c <> 2 then c || ' gripper closes (expected 2: ' || case when c < 2 then 'object not grasped?' else 'grasped again?' end || ')' end], lambda x: x is not null), coalesce(p, []), list_filter([
 case when not coalesce(dur, 0) between 9.5 and 60.5 then 'duration ' || printf('%.1f', coalesce(dur, 0)) || ' outside [9.5, 60.5]' end,
 case when med is not null then 'duration outlier (' || printf('%.1f', dur) || ' s vs median ' || printf('%.1f', med) || ' s)' end], lambda x: x is not null)), '; ') as reasons from f""")
def whole_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on every episode: cameras, placements, the arm's pauses and closes, durations; some have no telemetry."""
    e, u = events(spark, sf_dir), F.col("user_id")
    some = lambda no, value: F.when(no, None).otherwise(value)
    eps = e.select("user_id").distinct().select(
        "user_id", (u % 4).alias("task"), some(u % 23 == 0, (u * 37 % 100).cast("double")).alias("duration_s"),
        F.map_filter(F.create_map(F.lit("scene"), F.create_map(F.lit("gain"), (16 + u % 3).cast("double")), F.lit("wrist"), F.create_map(F.lit("gain"), F.lit(16.0))), lambda k, _: (k == "scene") | (u % 5 != 0)).alias("controls"),
        some(u % 11 == 0, (90 + u % 20).cast("double")).alias("wrist_mean"), F.array(some(u % 8 == 0, u % 40), some(u % 6 == 0, u % 30)).alias("tips"), some(u % 13 == 0, (80 + u % 70).cast("double")).alias("scene_mean"),
        some(u % 9 == 0, F.array(u % 14 - 1.0, u % 17 - 8.0)).alias("at"), some(u % 10 == 0, F.array(u % 6 + 0.0, u % 15 - 7.0)).alias("fixture"),
        some(u % 10 == 0, F.struct((u % 4).cast("double").alias("dx"), F.lit(0.0).alias("dy"), F.lit(50.0).alias("seen_s"), (50 + u % 7).cast("double").alias("length_s"))).alias("moved"))
    first = e.groupBy("user_id", "t").agg(F.min_by(F.struct("event_type", "value"), "event_id").alias("x"))
    v = F.col("x.value")
    rows = first.where("user_id % 19 <> 3").select("user_id", "t", F.array(v, v / 2).alias("joint_pos"), F.when(F.col("x.event_type") == "purchase", 0.0).otherwise(1.0).alias("gripper_cmd"), v.alias("gripper_pos"))
    return verdicts.checked(eps, rows, "user_id", "t", SETTINGS).select("user_id", "closes", F.array_join("reasons", "; ").alias("reasons"))


@register(f"""with e as (select user_id u, case when event_type in ('click', 'view') then 'left' else 'right' end arm, t, event_id % 2 = 0 down, value from {EVENTS} where user_id % 10 <> 9),
k as (select u, max(d) w from (select u, t - lag(t) over (partition by u, arm order by t) d from e) group by all),
a as (select u, arm, max(value) - min(value) reach, count_if(down) shut, quantile_cont(value / 100 + 0.5 - 0.5, 0.99) filter (down) p from e group by all),
c as (select *, least(abs(p - 0.6), abs(p - 0.9)) d, case when abs(p - 0.6) < abs(p - 0.9) then 0.6 else 0.9 end v from a),
w as (select u, arm, list_filter([case when reach < 60 then arm || ': the arm barely moved (max joint range < 60.0 rad)' end, case when arm = 'left' and shut < 10 then arm || ': gripper never commanded closed, so nothing was grasped' end,
 case when arm = 'left' and shut >= 10 and d > 0.25 * v then arm || ': gripper lag p99 ' || printf('%+.4f', p) || ' matches no known clamp ceiling' end], lambda x: x is not null) x from c),
l as (select u, flatten(list(x order by arm)) x from w group by all), q as (select distinct user_id u from events)
select u as user_id, array_to_string(list_concat(list_filter([case when u % 5 = 0 then 'complete=False: this recording was cut short' end, case when u % 40 < 15 then 'only ' || printf('%.1f', (u % 40)::double) || ' s long' end,
 case when u % 3 = 0 then 'no verdict recorded (pending)' end, case when u % 4 = 3 then 'duplicate rows of this path' end, case when u % 6 = 1 then 'camera ''wrist'' has no file' end], lambda x: x is not null),
 case when x is null then ['no telemetry at all'] else list_concat(list_filter([case when w > 240 * 3600000000 then printf('%.0f', w / 3600000.0) || ' ms gap in robot telemetry' end], lambda x: x is not null), x) end), '; ') as warnings from q left join k using (u) left join l using (u)""")
def whole_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All warnings of every recording; the right arm has no gripper, and some episodes no telemetry."""
    e, u = events(spark, sf_dir), F.col("user_id")
    status = F.when(u % 3 == 0, "pending").otherwise("success")
    eps = e.select("user_id").distinct().select("user_id", (u % 5 != 0).alias("complete"), (u % 40).cast("double").alias("duration_s"), F.when(u % 4 == 3, F.array(status, F.lit("failure"))).otherwise(F.array(status)).alias("statuses"),
                                                F.array(F.lit("wrist"), F.lit("scene")).alias("cameras"), F.when(u % 6 == 1, F.array(F.lit("scene"))).otherwise(F.array(F.lit("scene"), F.lit("wrist"))).alias("files"))
    arm = F.when(F.col("event_type").isin("click", "view"), "left").otherwise("right")
    v = F.col("value")
    zero = [F.lit(0.0)] * 5
    rows = e.where("user_id % 10 <> 9").select("user_id", "t", arm.alias("arm"), F.array(v, *zero).alias("joint_pos"), F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(1.0).alias("cmd"), "value")
    seven = lambda x: F.when(F.col("arm") == "left", F.array(*zero, F.lit(0.0), x))
    rows = rows.withColumns({"joint_cmd": seven(F.col("cmd")), "joint_pos_7d": seven(v / 100 + F.col("cmd"))})
    out = verdicts.linted(eps, rows, "user_id", "t", {"low": 0.6, "high": 0.9}, gap=240.0, span=60.0, unit=float(HOUR))
    return out.select("user_id", F.array_join("warnings", "; ").alias("warnings"))
