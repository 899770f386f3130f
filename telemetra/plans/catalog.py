"""Registered queries over the driver's tables, and the same questions in DuckDB SQL.

A user of `events` stands for an episode, its values for telemetry, and times count in microseconds; `orders` are
demonstrations with a status, customers and nations their dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import align, summaries, windows
from .registry import EVENTS, ORACLES, QUERIES, events, grid_and_samples, register, table

__all__ = ["ORACLES", "QUERIES"]

_NEAR = f"""g as (select event_id, user_id, t from {EVENTS} where event_type = 'click'),
s as (select user_id, t, max(value) v from {EVENTS} where event_type = 'view' group by all),
n as (select g.*, b.t bt, b.v bv, a.t at_, a.v av from g asof left join s b on g.user_id = b.user_id and g.t >= b.t asof left join s a on g.user_id = a.user_id and g.t <= a.t)"""


@register(f"with {_NEAR} select event_id, user_id, t, round(case when at_ = bt then bv else bv + (t - bt)::double / (at_ - bt) * (av - bv) end, 6) as value from n")
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.interpolated(*grid_and_samples(spark, sf_dir), "user_id", "t", "value").withColumn("value", F.round("value", 6))


@register(f"with {_NEAR} select event_id, user_id, t, round(case when at_ = bt then bv else bv + (t - bt)::double / (at_ - bt) * (av - bv) end, 6) as value from n")
def asof_interpolate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for episodes too long for one task, dealt by days."""
    return align.interpolated(*grid_and_samples(spark, sf_dir), "user_id", "t", "value", bucket=86_400_000_000).withColumn("value", F.round("value", 6))


@register(f"with {_NEAR} select event_id, user_id, t, case when (case when at_ = bt then bv else bv + (t - bt)::double / (at_ - bt) * (av - bv) end) >= 50 then 1.0::double when (case when at_ = bt then bv else bv + (t - bt)::double / (at_ - bt) * (av - bv) end) < 50 then 0.0::double end as value from n")
def asof_binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.interpolated(*grid_and_samples(spark, sf_dir), "user_id", "t", "value").withColumn("value", align.binarised(F.col("value"), 50.0))


@register(f"with {_NEAR}, p as (select *, bt is null or at_ - t < t - bt as late from n) select event_id, user_id, t, case when late then av else bv end as value, case when late then at_ - t else bt - t end as dt from p")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.nearest(*grid_and_samples(spark, sf_dir), "user_id", "t", "value")


@register(f"""with g as (select event_id, user_id, t from {EVENTS} where event_type = 'click'), s as (select user_id, t - 1800000000 t, max(value) v from {EVENTS} where event_type = 'view' group by all),
first as (select user_id, min(t) t, arg_min(v, t) v from s group by all)
select g.event_id, g.user_id, g.t, coalesce(s.v, f.v) as value, abs(coalesce(s.t, f.t) + 1800000000 - g.t) as residual from g asof left join s on g.user_id = s.user_id and g.t >= s.t left join first f on f.user_id = g.user_id""")
def asof_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.held(*grid_and_samples(spark, sf_dir), "user_id", "t", "value", 3_600_000_000)


@register(f"with e as (select user_id, event_type, min(t) lo, max(t) hi from {EVENTS} group by all) select user_id, max(lo) as t_start, min(hi) as t_end from e group by all having max(lo) <= min(hi)")
def stream_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.overlap(events(spark, sf_dir), "user_id", "event_type", "t")


@register(f"select event_id, user_id, coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by t, event_id), -1.0) as command from {EVENTS}")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("command", F.when(F.col("event_type") == "purchase", F.col("value")))
    return align.filled(e, "user_id", ["t", "event_id"], "command", F.lit(-1.0)).select("event_id", "user_id", "command")


#: Values under 10 are unknown, in the middle of an episode and at its ends; steps are two rows apart.
_WINDOW = f"""b as (select event_id, user_id, case when value >= 10 then value end v, row_number() over w - 1 i, count(*) over (partition by user_id) n from {EVENTS} window w as (partition by user_id order by t, event_id)),
x as (select b.event_id, b.i, b.n, list(c.v order by k) as w from b, range(-2, 4) r(k), b c where c.user_id = b.user_id and c.i = greatest(0, least(b.n - 1, b.i + 2 * k)) group by all)"""


@register(f"with {_WINDOW} select event_id, i as index, round(w[1] + 2*w[2] + 3*w[3] + 4*w[4] + 5*w[5] + 6*w[6], 6) as checksum, greatest(ceil((4 - i) / 2), 0)::int as pad_left, greatest(ceil((6 - (n - 1 - i)) / 2), 0)::int as pad_right from x where greatest(ceil((4 - i) / 2), 0) <= 1 and greatest(ceil((6 - (n - 1 - i)) / 2), 0) <= 2 and len(list_filter(w, lambda v: v is null)) = 0 and list_max(w) - list_min(w) >= 20")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 10, F.col("value")))
    w = windows.clamped(rows, "user_id", ["t", "event_id"], "value", 2, 3, 2)
    total = sum(((k + 1) * F.col("window")[k] for k in range(1, 6)), F.col("window")[0])
    return windows.usable(w, 1, 2, 20.0).select("event_id", "index", F.round(total, 6).alias("checksum"), "pad_left", "pad_right")


@register(f"select event_id, t - lag(t) over w as dt, round(value - lag(value) over w, 6) as dv from {EVENTS} window w as (partition by user_id order by t, event_id)")
def finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.changes(events(spark, sf_dir), "user_id", ["t", "event_id"], "t", "value").select("event_id", "dt", F.round("dv", 6).alias("dv"))


@register(f"with d as (select user_id, lag(value) over (partition by user_id order by t, event_id) >= 50 and value < 50 down from {EVENTS}) select user_id, count(*) filter (down) as closes from d group by all")
def gripper_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.falls(events(spark, sf_dir), "user_id", ["t", "event_id"], "value", 50.0)


@register(f"with m as (select user_id, t, value < 60 as still, sum(case when value < 60 then 0 else 1 end) over (partition by user_id order by t, event_id) g from {EVENTS}), r as (select user_id, g, min(t) t_start, max(t) t_end, count(*) n from m where still group by all) select user_id, t_start, t_end, n from r where t_end - t_start >= 3600000000")
def still_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(events(spark, sf_dir), "user_id", ["t", "event_id"], "t", F.col("value") < 60, 3_600_000_000)


@register(f"with s as (select user_id, t, value, case when lag(t) over w is not null and (t - lag(t) over w > 43200000000 or event_type = 'signup') then 1 else 0 end new, event_id from {EVENTS} window w as (partition by user_id order by t, event_id)), n as (select *, sum(new) over (partition by user_id order by t, event_id) session from s) select user_id, session, count(*) as n, min(t) as t_start, max(t) as t_end from n group by all")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(events(spark, sf_dir), "user_id", ["t", "event_id"], "t", 43_200_000_000, F.col("event_type") == "signup")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))


_PCT = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) as p{p:02d}" for p in summaries.PERCENTS)


@register(f"select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max, {_PCT} from events group by all")
def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = summaries.moments(events(spark, sf_dir), ["event_type"], "value", summaries.PERCENTS)
    return m.withColumns({c: F.round(c, 6) for c in ["mean", "std", *[f"p{p:02d}" for p in summaries.PERCENTS]]})


@register("select event_type, count(value) as n, round(avg(value), 3) + 1e9 as mean, round(stddev_samp(value), 4) as std from events group by all union all select 'one', 1, 1e9 + 7, 0.0")
def combined_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user, then in all: means around a thousand million, and a group of one row."""
    e = events(spark, sf_dir).select("user_id", "event_type", (F.col("value") + 1e9).alias("value"))
    e = e.unionByName(spark.sql("select -1L user_id, 'one' event_type, 1e9 + 7 value"))
    parts = e.groupBy("user_id", "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return summaries.combined(parts, ["event_type"]).select("event_type", "n", F.round("mean", 3).alias("mean"), F.round("std", 4).alias("std"))


@register("select c_custkey, c_name, count(o_orderkey) as total, count_if(o_orderstatus = 'O') as \"O\", count_if(o_orderstatus = 'F') as \"F\", count_if(o_orderstatus = 'P') as \"P\" from customer left join orders on c_custkey = o_custkey group by all")
def status_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return summaries.counted(dim, facts, "c_custkey", "o_orderstatus", ["O", "F", "P"])


@register("with c as (select floor((l_quantity - 5) / (45 - 5) * 8)::int cx, floor((0.08 - l_discount) / (0.08 - 0.01) * 3)::int cy from lineitem), c2 as (select case when cx between 0 and 7 and cy between 0 and 2 then cx end cx, case when cx between 0 and 7 and cy between 0 and 2 then cy end cy, 1 k from c), e as (select x::int cx, y::int cy from range(8) a(x), range(3) b(y) union all select null, null) select e.cx, e.cy, count(c2.k) as n from e left join c2 on e.cx is not distinct from c2.cx and e.cy is not distinct from c2.cy group by all")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows lie on every edge of the box: the near one of x and the high one of y are inside, the others outside."""
    return summaries.coverage(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (5, 45, 0.01, 0.08), (8, 3))


@register("select coalesce(kind, 'other') as kind, count(*) as n from (select case when contains(o_orderpriority, 'URGENT') then 'red' when contains(o_orderpriority, 'H') then 'amber' when contains(o_orderpriority, 'LOW') then 'green' end kind from orders) group by all")
def flag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = summaries.first_match(F.col("o_orderpriority"), [("URGENT", "red"), ("H", "amber"), ("LOW", "green")], "other")
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def later_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return summaries.later_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register("with r as (select l_orderkey, l_linenumber, row_number() over (order by l_orderkey, l_linenumber, l_partkey) - 1 k from lineitem) select k // 100 as shard, count(*) as n, sum(l_orderkey * 10 + l_linenumber) as checksum from r group by all")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    s = summaries.sharded(rows, ["l_orderkey", "l_linenumber", "l_partkey"], 100)
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(38,0)").alias("checksum"))


@register("select event_id, round(cos(value) * 1 - sin(value) * 2 + value, 6) as x, round(sin(value) * 1 + cos(value) * 2 + 1, 6) as y, abs(cos(value) * cos(value) + sin(value) * sin(value) - 1) < 1e-6 as sound from events")
def rigid_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("pose", geometry.yaw_pose(F.col("value"), F.col("value"), F.lit(1.0), F.lit(0.0)))
    back = geometry.matmul(F.col("pose"), geometry.inverse_pose(F.col("pose")))
    off = F.greatest(*[F.abs(back[k] - (1.0 if k % 5 == 0 else 0.0)) for k in range(16)])
    p = geometry.transformed(F.col("pose"), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return e.select("event_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"), ((off < 1e-6) & (geometry.rotation_skew(F.col("pose")) < 1e-6)).alias("sound"))


from . import archives, poses, recordings, rigs, signals, space, stores, streams, verdicts  # noqa: E402, F401
