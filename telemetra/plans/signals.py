"""Queries on time series: clocks, gaps, resampling, windows and their statistics, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, quality, records, scans, summaries, windows
from .registry import EVENTS, events, grid_and_samples, register, table

HOUR = 3_600_000_000
ORDER = ["t", "event_id"]


@register(f"with d as (select user_id, event_type, t - lag(t) over (partition by user_id, event_type order by t) d from {EVENTS}), m as (select user_id, event_type, coalesce(greatest(round_even(d / 86400000000, 0) - 1, 0), 0)::bigint m from d) select user_id, event_type, count(*) as n, sum(m)::bigint as dropped, max(m) as longest from m group by all")
def drop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames missing from each stream of an episode, with a day as the period."""
    return align.drops(events(spark, sf_dir), "user_id", "event_type", "t", 24 * HOUR)


_HELD = f"""g as (select event_id, user_id, t from {EVENTS} where event_type = 'click'), s as (select user_id, t - 1800000000 t from {EVENTS} where event_type = 'view' group by all), f as (select user_id, min(t) t from s group by all),
h as (select g.user_id, abs(coalesce(s.t, f.t) + 1800000000 - g.t) r from g asof left join s on g.user_id = s.user_id and g.t >= s.t left join f on f.user_id = g.user_id)"""


@register(f"with {_HELD} select user_id, median(r) as median, max(r) as worst, max(r) <= 5 * 3600000000 as ok from h group by all")
def sync_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far held frames are from their grid, and whether a frame is more than five periods off."""
    return align.residuals(align.held(*grid_and_samples(spark, sf_dir), "user_id", "t", "value", HOUR), "user_id", HOUR, 4)


@register(f"with e as (select user_id, event_type, min(t) lo, max(t) hi from {EVENTS} group by all), b as (select user_id, max(lo) a, min(hi) z from e group by all) select x.event_id, x.user_id, x.t from {EVENTS} x join b using (user_id) where t between a and z")
def inside_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.within(events(spark, sf_dir), "user_id", "event_type", "t").select("event_id", "user_id", "t")


@register(f"select g.event_id, (select count(*) from {EVENTS} m where m.event_type = 'view' and m.user_id = g.user_id and m.t <= g.t) as ticks from {EVENTS} g where event_type = 'click'")
def tick_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many views an episode has up to each click."""
    return align.ticks(*grid_and_samples(spark, sf_dir), "user_id", "t").select("event_id", "ticks")


@register(f"with f as (select event_id, user_id, row_number() over (partition by user_id order by t, event_id) - 1 i, count(*) over (partition by user_id) m from {EVENTS} where event_type = 'click'), s as (select user_id, value, row_number() over (partition by user_id order by t, event_id) - 1 i, count(*) over (partition by user_id) n from {EVENTS} where event_type = 'view') select f.event_id, s.value from f join s on f.user_id = s.user_id and s.i = least(floor(f.i * s.n / f.m), s.n - 1)")
def proportional_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry by share of the episode, not by time."""
    from pyspark.sql import Window

    numbered = lambda df: df.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    e = events(spark, sf_dir)
    clicks, views = (numbered(e.where(F.col("event_type") == kind)).select("event_id", "user_id", "i", "value") for kind in ("click", "view"))
    return align.proportional(clicks.drop("value"), views.drop("event_id"), "user_id", "i", "value").where("value is not null").select("event_id", "value")


@register(f"with m as (select user_id, min(t) lo from {EVENTS} group by all), s as (select user_id, event_type, min(t) lo from {EVENTS} group by all) select e.event_id, case when e.user_id % 4 = 0 then e.t when e.user_id % 4 = 1 then e.t - s.lo + 5 when e.user_id % 4 = 2 then e.t - s.lo end as t, case e.user_id % 4 when 0 then 'wall' when 1 then 'started' when 2 then 'own' else 'mixed' end as clock from {EVENTS} e join s using (user_id, event_type) where e.user_id in (select user_id from {EVENTS} group by 1 having count(distinct event_type) > 1)")
def common_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams on wall clocks, on hardware clocks with known starts, on their own clocks, and mixed without starts."""
    e = events(spark, sf_dir)
    several = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("k"), F.min_by("event_type", F.col("event_type")).alias("one")).where("k > 1")
    e = e.join(several, "user_id")
    own = (F.col("user_id") % 4 == 1) | (F.col("user_id") % 4 == 2) | ((F.col("user_id") % 4 == 3) & (F.col("event_type") == F.col("one")))
    e = e.withColumn("t", F.when(own, F.col("t") - 1_700_000_000_000_000).otherwise(F.col("t")))
    starts = e.where("user_id % 4 = 1").select("user_id", "event_type", F.lit(5).cast("long").alias("start")).distinct()
    return align.clocked(e, "user_id", "event_type", "t", 1_577_836_800_000_000, starts).select("event_id", "t", "clock")


@register(f"with d as (select user_id, t, t - lag(t) over (partition by user_id order by t, event_id) d from {EVENTS}) select user_id, count(*) as n, median(d) as median, max(d) as longest, round(case when max(t) > min(t) then (count(*) - 1) / ((max(t) - min(t)) / 86400e6) end, 6) as per_day from d group by all")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, gaps and rate of each episode."""
    c = windows.changes(events(spark, sf_dir), "user_id", ORDER, "t", "value")
    rate = (F.count("*") - 1) / F.nullif((F.max("t") - F.min("t")) / 86_400e6, F.lit(0.0))
    return c.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("dt", 0.5).alias("median"), F.max("dt").alias("longest"), F.round(rate, 6).alias("per_day"))


@register(f"with d as (select user_id, t < lag(t) over (partition by user_id order by event_id) down from {EVENTS}) select user_id, count(*) filter (down) as falls, count(*) filter (down) = 0 as monotonic from d group by all")
def monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.falling(events(spark, sf_dir), "user_id", ["event_id"], "t")


@register(f"with r as (select user_id, value, row_number() over (partition by user_id order by t, event_id) u, row_number() over (partition by user_id order by t desc, event_id desc) d from {EVENTS}) select user_id, round(case when count(*) filter (u <= 5) >= 3 then median(value) filter (u <= 5) end, 6) as start, round(case when count(*) filter (d <= 5) >= 3 then median(value) filter (d <= 5) end, 6) as end from r group by all")
def first_last_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.ends(events(spark, sf_dir), "user_id", ORDER, "value")
    return out.select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@register("select user_id, coalesce(min(event_id) filter (value > 90), -1) as first from events group by all")
def first_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_where(events(spark, sf_dir), "user_id", "event_id", F.col("value") > 90)


@register(f"""with s as (select user_id, t, max(value) v from {EVENTS} group by all), b as (select user_id, min(t) lo, max(t) - min(t) span, round_even((max(t) - min(t)) / 86400000000, 0)::bigint n from s group by all),
g as (select user_id, lo, span, n, unnest(range(n + 1)) step from b), p as (select user_id, step, lo + case when n > 0 then span::double * step / n else 0 end as t, lo + case when n > 0 then span * step // n else 0 end as tb, n from g),
x as (select p.user_id, p.step, p.t, l.t a, l.v av, (select min(t) from s where s.user_id = p.user_id and s.t > l.t) z from p asof join s l on p.user_id = l.user_id and p.tb >= l.t)
select x.user_id, x.step, round(av + case when z is null then 0 else (x.t - a) / (z - a) * (s.v - av) end, 4) as value from x left join s on s.user_id = x.user_id and s.t = x.z""")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes at even steps of about a day."""
    return windows.resampled(events(spark, sf_dir), "user_id", "t", "value", 24 * HOUR).select("user_id", "step", F.round("value", 4).alias("value"))


@register(f"""with r as (select event_id, user_id, case when user_id % 3 = 0 then t when user_id % 3 = 1 then -t else t // 864000000000 end t, row_number() over (partition by user_id order by t, event_id) - 1 i, count(*) over (partition by user_id) n from {EVENTS}),
d as (select *, t - lag(t) over (partition by user_id order by i) d from r), b as (select *, coalesce(min(d) over p, 0) < 0 or count(*) filter (d = 0) over p > 0.1 * (n - 1) as bad, min(t) over p lo, max(t) over p hi from d window p as (partition by user_id))
select event_id, case when bad then lo + floor((hi - lo) * i / greatest(n - 1, 1))::bigint else t end as t from b""")
def sane_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that fall or repeat too often become even ones."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    kind = F.col("user_id") % 3
    e = e.withColumn("t", F.when(kind == 0, F.col("t")).when(kind == 1, -F.col("t")).otherwise(F.expr("t div 864000000000")))
    return windows.spread(e, "user_id", ["i"], "t").select("event_id", "t")


@register(f"""with e as (select user_id, value v, coalesce(json_extract(props, '$.k')::double, 0) m, row_number() over (partition by user_id order by t, event_id) i from {EVENTS}),
l as (select a.user_id, k, a.v - b.m e from e a, range(6) r(k), e b where b.user_id = a.user_id and b.i = a.i + k), g as (select user_id, k, sqrt(var_pop(e)) s, sqrt(avg(e * e)) r, max(abs(e)) m from l group by all)
select user_id, round(max(r) filter (k = 0), 6) as rms, round(max(m) filter (k = 0), 6) as max, arg_min(k, (round(s, 9), k))::int as lag, round(min(round(s, 9)), 6) as rms_at_lag from g group by all""")
def lag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking error of one signal behind another, now and at the best lag."""
    e = events(spark, sf_dir).withColumn("m", F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)))
    out = windows.lags(e, "user_id", ORDER, "value", "m", 5)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("rms", "max")], "lag", F.round("rms_at_lag", 6).alias("rms_at_lag"))


@register(f"""with e as (select user_id, value v, row_number() over (partition by user_id order by t, event_id) i from {EVENTS}) select a.user_id, a.i, round(sum(case when b.i = 1 then 0.7 ** (a.i - 1) else 0.3 * 0.7 ** (a.i - b.i) end * b.v) + 1.23e-7, 4) as value from e a join e b on a.user_id = b.user_id and b.i <= a.i group by all""")
def smoothed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential low-pass along each episode; told a little off the halves that its first values have."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return scans.smoothed(e, ["user_id"], ["i"], "value", 0.3).select("user_id", "i", F.round(F.col("value") + 1.23e-7, 4).alias("value"))


@register(f"""with e as (select user_id, t, event_id, abs(value - lag(value, 2) over w) / greatest(t - lag(t, 2) over w, 1) < 4e-10 and event_type <> 'purchase' and (lag(event_type) over w <> 'purchase') still, min(t) over (partition by user_id) lo, max(t) over (partition by user_id) hi, coalesce(lead(t) over w, t) nxt from {EVENTS} window w as (partition by user_id order by t, event_id)),
m as (select *, coalesce(still, false) and t > lo + 3600000000 and t < hi - 3600000000 s from e), g as (select *, sum(case when s then 0 else 1 end) over (partition by user_id order by t, event_id) g from m), r as (select user_id, g, min(t) t_start, max(nxt) - min(t) length from g where s group by all) select user_id, t_start, length from r where length > 43200000000""")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Still stretches of over half a day, by the speed over two rows and an unchanged command."""
    e = events(spark, sf_dir).withColumn("command", F.when(F.col("event_type") != "purchase", 0))  # a purchase is no command to compare
    return windows.pauses(e, "user_id", ORDER, "t", {"value": 4e-10}, "command", 2, HOUR, 12 * HOUR)


@register(f"""with e as (select user_id, row_number() over w x, sum(value) over w y, count(*) over (partition by user_id) n from {EVENTS} window w as (partition by user_id order by t, event_id)),
k as (select distinct user_id, x k from e where x >= 4 and x <= n - 4), f as (select k.user_id, k, regr_slope(y, x) filter (x <= k) b1, regr_intercept(y, x) filter (x <= k) c1, regr_slope(y, x) filter (x > k) b2,
regr_syy(y, x) filter (x <= k) - regr_slope(y, x) filter (x <= k) * regr_sxy(y, x) filter (x <= k) + regr_syy(y, x) filter (x > k) - regr_slope(y, x) filter (x > k) * regr_sxy(y, x) filter (x > k) s from k join e using (user_id) group by all)
select user_id, arg_min(k, (round(s, 4), k)) as k, round(arg_min(b1 * k + c1, (round(s, 4), k)), 2) as z, round(arg_min(b1, (round(s, 4), k)), 2) as approach, round(arg_min(b2, (round(s, 4), k)), 2) as contact from f group by all""")
def breakpoint_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The break of each episode's running total into two lines."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir).select("user_id", F.row_number().over(w).cast("long").alias("x"), F.sum("value").over(w).alias("y"))
    out = windows.breakpoints(e, "user_id", ["x"], "x", "y")
    return out.select("user_id", F.col("k").cast("long").alias("k"), *[F.round(c, 2).alias(c) for c in ("z", "approach", "contact")])


@register("""with s as (select p_size % 7 g, p_retailprice z, p_size::double x, (p_partkey % 100)::double y from part), c as (select g, count(*) n, avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x, x) xx, covar_pop(y, y) yy, covar_pop(z, z) zz, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, z) yz from s group by all),
f as (select *, (xz * yy - yz * xy) / (xx * yy - xy * xy) a, (yz * xx - xz * xy) / (xx * yy - xy * xy) b from c) select g, round(a, 6) as a, round(b, 6) as b, round(mz - a * mx - b * my, 4) as c, n, round(sqrt(greatest(zz - a * xz - b * yz, 0)), 4) as rms, round(degrees(atan(sqrt(a * a + b * b))), 6) as tilt from f""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares planes by group, and their tilt."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("g"), F.col("p_retailprice").alias("z"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y"))
    f = summaries.plane(p, ["g"], "x", "y", "z")
    return f.select("g", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"), "n", F.round("rms", 4).alias("rms"), F.round(F.degrees(F.atan(F.hypot("a", "b"))), 6).alias("tilt"))


@register("""with s as (select p_size % 7 g, p_retailprice z, p_size::double x, (p_partkey % 100)::double y from part), c as (select g, avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x, x) xx, covar_pop(y, y) yy, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, z) yz from s group by all),
f as (select mz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * mx - (yz * xx - xz * xy) / (xx * yy - xy * xy) * my h from c) select count(*) as n, round(max(h) - min(h), 4) as spread, round(stddev_pop(h), 4) as deviation from f""")
def plane_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the heights of the groups' planes lie apart."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("g"), F.col("p_retailprice").alias("z"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 100).cast("double").alias("y"))
    return summaries.plane(p, ["g"], "x", "y", "z").agg(F.count("*").alias("n"), F.round(F.max("c") - F.min("c"), 4).alias("spread"), F.round(F.stddev_pop("c"), 4).alias("deviation"))


_STEPS = f"""b as (select event_type, user_id, event_id, value v, row_number() over w - 1 i, count(*) over (partition by user_id) n from {EVENTS} window w as (partition by user_id order by t, event_id)),
x as (select b.event_id, b.event_type, k step, c.v from b, range(-1, 3) r(k), b c where c.user_id = b.user_id and c.i = greatest(0, least(b.n - 1, b.i + 3 * k)))"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.clamped(events(spark, sf_dir), "user_id", ORDER, "value", 1, 2, 3)
    return w.select("event_id", "event_type", F.posexplode("window").alias("step", "v")).withColumn("step", F.col("step") - 1)


@register(f"with {_STEPS} select event_type, step, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as lowest, max(v) as highest from x group by all")
def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each step of the training windows."""
    m = summaries.moments(_steps(spark, sf_dir), ["event_type", "step"], "v")
    return m.select("event_type", "step", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.col("min").alias("lowest"), F.col("max").alias("highest"))


@register(f"with {_STEPS} select event_type, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from x group by all")
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all steps, combined from those of each step."""
    m = summaries.moments(_steps(spark, sf_dir), ["event_type", "step"], "v").select("event_type", "n", "mean", "std")
    return summaries.combined(m, ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register(f"with {_STEPS}, q as (select event_type, step, quantile_cont(v, [0.01, 0.02, 0.05, 0.95, 0.98, 0.99]) q from x group by all) select event_type, step, unnest([1, 2, 5, 95, 98, 99])::double as percent, round(unnest(q), 6) as v from q")
def window_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each step, of groups of any size."""
    return summaries.percentiles(_steps(spark, sf_dir), ["event_type", "step"], "v").withColumn("v", F.round("v", 6))


@register("select event_type, event_id, value from events qualify row_number() over (partition by event_type order by md5(event_id::varchar), event_id) <= 50")
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows of each kind, by a hash of their ids."""
    e = events(spark, sf_dir).select("event_type", "event_id", "value")
    return summaries.sampled(e, ["event_type"], [F.md5(F.col("event_id").cast("string")), F.col("event_id")], 50)


_NAN = "case when event_id % 11 = 0 then null when event_id % 13 = 0 then 'nan'::double else value end"


@register(f"""with b as (select event_id, user_id, {_NAN} v, row_number() over w - 1 i, count(*) over (partition by user_id) n from {EVENTS} window w as (partition by user_id order by t, event_id)),
x as (select b.event_id, b.i, b.n, list(c.v order by k) w from b, range(-1, 3) r(k), b c where c.user_id = b.user_id and c.i = greatest(0, least(b.n - 1, b.i + k)) group by all),
f as (select event_id, case when greatest(1 - i, 0) > 0 or greatest(2 - (n - 1 - i), 0) > 1 then 'padding' when not isnan(w[2]) and w[2] is not null and len(list_filter(w[3:], lambda v: v is null or isnan(v))) = 0 and list_max([abs(v - w[2]) for v in w[3:]]) < 25 then 'still' when len(list_filter(w, lambda v: v is null or isnan(v))) > 0 then 'nan' else 'kept' end reason from x) select reason, count(*) as n from f group by all""")
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why windows are left out, of values some of which are unknown or not numbers."""
    v = F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    w = windows.clamped(events(spark, sf_dir).withColumn("value", v), "user_id", ORDER, "value", 1, 2)
    known = F.when(~windows.has_gap(F.slice("window", 2, 3)), F.col("window"))
    why = F.when((F.col("pad_left") > 0) | (F.col("pad_right") > 1), "padding").when(windows.travel(known, 1) < 25, "still")
    return w.groupBy(F.coalesce(why, windows.reason(0, 1, 0.0, 1), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@register(f"""with b as (select event_id, user_id, value v, row_number() over w - 1 i, count(*) over (partition by user_id) n from {EVENTS} window w as (partition by user_id order by t, event_id)),
x as (select b.event_id, k, c.v from b, range(-1, 3) r(k), b c where c.user_id = b.user_id and c.i = greatest(0, least(b.n - 1, b.i + k)))
select event_id, round(sum(v) filter (k < 0), 6) as past, round(sum(v) filter (k > 0), 6) as future, count(*) filter (k < 0) as n_past, count(*) filter (k > 0) as n_future from x group by all""")
def window_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each training window lies before its anchor, and what after it."""
    w = windows.clamped(events(spark, sf_dir), "user_id", ORDER, "value", 1, 2)
    masked = lambda mask: F.aggregate(F.zip_with("window", mask, lambda v, on: F.when(on, v).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    count = lambda mask: F.size(F.filter(mask, lambda on: on))
    before, after = windows.masks(1, 2)
    return w.select("event_id", F.round(masked(before), 6).alias("past"), F.round(masked(after), 6).alias("future"), count(before).cast("long").alias("n_past"), count(after).cast("long").alias("n_future"))


@register(f"select event_id from {EVENTS} qualify (row_number() over (partition by user_id order by t, event_id) - 1) % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.every(events(spark, sf_dir), "user_id", ORDER, 10).select("event_id")


@register(f"with l as (select 0 src, event_id, user_id, t from {EVENTS} where event_type = 'click' union all select 1, event_id, user_id, t from {EVENTS} where event_type = 'view') select event_id, row_number() over (order by t, src, event_id) - 1 as k from l")
def merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs in one order of time, ties by log and row."""
    e = events(spark, sf_dir)
    both = e.where("event_type = 'click'").select(F.lit(0).alias("src"), "event_id", "t").unionByName(e.where("event_type = 'view'").select(F.lit(1).alias("src"), "event_id", "t"))
    return summaries.numbered(both, ["t", "src", "event_id"]).select("event_id", F.col("_k").alias("k"))


@register(f"select user_id, count(*) as n, md5(string_agg(event_id::varchar, ',' order by t, event_id)) as path from {EVENTS} group by all")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's rows as one ordered path."""
    path = F.array_sort(F.collect_list(F.struct("t", "event_id")))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(path, lambda x: x["event_id"].cast("string")), ",")).alias("path"))


@register(f"select event_id, coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by t, event_id), case when value >= 50 then 1.0 else 0.0 end) as command from {EVENTS}")
def command_or_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last command, or before the first one the row's own value with a binary gripper."""
    e = events(spark, sf_dir).withColumn("command", F.when(F.col("event_type") == "purchase", F.col("value")))
    return align.filled(e, "user_id", ORDER, "command", align.binarised(F.col("value"), 50.0)).select("event_id", "command")


@register("select event_id, 10 - least(floor(value / 7.5), 10)::int as left_over from events")
def late_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ten actions after a latency."""
    chunk = F.sequence(F.lit(1), F.lit(10))
    return events(spark, sf_dir).select("event_id", F.size(records.after_latency(chunk, F.col("value"), 7.5)).alias("left_over"))


@register(f"with d as (select event_type, t - lag(t) over (partition by event_type, user_id order by t, event_id) d, t from {EVENTS}) select event_type, count(d) as n, round(quantile_cont(d, 0.5), 2) as p50, round(quantile_cont(d, 0.99), 2) as p99, max(d) as longest, round(count(d) / (sum(d) / 1e6), 9) as hz from d group by all")
def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p99 and longest step of each kind of event, and the rate reached."""
    from pyspark.sql import Window

    step = F.col("t") - F.lag("t").over(Window.partitionBy("event_type", "user_id").orderBy("t", "event_id"))
    d = events(spark, sf_dir).withColumn("d", step)
    p = summaries.percentiles(d, ["event_type"], "d", (50, 99)).groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("percent") == p, F.col("d"))), 2).alias(f"p{p}") for p in (50, 99)])
    return d.groupBy("event_type").agg(F.count("d").alias("n"), F.max("d").alias("longest"), F.round(F.count("d") / (F.sum("d") / 1e6), 9).alias("hz")).join(p, "event_type")


@register("with e as (select label, generate_subscripts(embedding, 1) - 1 dim, unnest(embedding)::double v from embeddings) select label, dim::int as dim, count(v) as n, round(min(v), 6) as lowest, round(max(v), 6) as highest, round(max(abs(v)), 6) as top, round(max(v) - min(v), 6) as range from e group by all")
def joint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of each place of a vector, as of an arm's joints."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return summaries.by_dimension(v, ["label"], "v").select("label", "dim", "n", *[F.round(c, 6).alias(c) for c in ("lowest", "highest", "top", "range")])


@register("with e as (select label, vec_id, unnest([case when x <= -0.1 then 0 when x > 0.3 then 65535 else floor((x::double + 0.1) * 10000)::int end for x in embedding[1:16]]) d from embeddings), c as (select label, count(*) filter (d > 0) / count(*) valid, median(d) filter (d > 0) m from e group by all), s as (select label, count(*) filter (b > 8) n from (select label, vec_id, count(*) filter (d = 65535) b from e group by all) group by all) select label, round(valid, 6) as valid, m as median_mm, n as n_saturated, array_to_string(list_filter([case when valid = 0 then 'no return' end, case when not m between 50 and 10000 then 'suspect median' end, case when valid > 0 and valid < 0.5 then 'sparse' end, case when n > 0 then 'saturated frames' end], lambda x: x is not null), ',') as reasons from c join s using (label)")
def depth_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth frames of sixteen pixels: valid share, median and what is wrong with them."""
    to_mm = lambda x: F.when(x <= -0.1, 0).when(x > 0.3, 65535).otherwise(F.floor((x.cast("double") + 0.1) * 10000)).cast("int")
    frames = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 16), to_mm).alias("d"))
    out = quality.depth_report(frames, "label", "d", 16)
    return out.select("label", F.round("valid", 6).alias("valid"), "median_mm", "n_saturated", F.array_join("reasons", ",").alias("reasons"))


@register("with e as (select label, generate_subscripts(embedding, 1) - 1 k, unnest(embedding)::double v from embeddings) select label, k::int as k, round(median(v) filter (v > 0), 6) as v from e group by all")
def pixel_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over time of each pixel, without those that have no return."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    return e.groupBy("label", "k").agg(F.round(F.percentile(F.when(F.col("v") > 0, F.col("v").cast("double")), 0.5), 6).alias("v"))


@register("with m as (select vec_id, list_avg([x::double for x in embedding]) m, list_avg([x::double for x in embedding[1:8]]) b, list_avg([x::double for x in embedding[9:16]]) r from embeddings) select vec_id, round(m, 6) as brightness, round(case when r <> 0 then b / r end, 4) as ratio from m where abs(r) > 1e-3")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of an image's values, and the ratio of two channels' means."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", mean(F.col("v")).alias("m"), mean(F.slice("v", 1, 8)).alias("b"), mean(F.slice("v", 9, 8)).alias("r")).where(F.abs("r") > 1e-3)
    return e.select("vec_id", F.round("m", 6).alias("brightness"), F.round(F.col("b") / F.col("r"), 4).alias("ratio"))


@register(None)
def lockstep_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of an episode paired by elapsed time, within six hours."""
    e = events(spark, sf_dir).where("event_type in ('click', 'view')")
    return scans.lockstep(e, "user_id", "event_type", "t", 6 * HOUR)


@register("select event_id, case when value / 100 >= 0.5 then 1.0 else 0.0 end::double as recorded, round(greatest(20 / 95.0, least(value / 100, 1.0)), 9) as told from events where value is not null")
def gripper_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gripper's signal as it is recorded, open or closed, and as its motor is told it, within limits."""
    from ..operators.align import binarised, opening

    x = F.col("value") / 100
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", binarised(x).alias("recorded"), F.round(opening(x), 9).alias("told"))
