"""Putting streams of different clocks on one grid. Each works within an episode and streams through its sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Grid rows and samples in one table; at equal times samples stand first."""
    left = grid.select(key, t, F.lit(1).alias("_grid"), F.lit(None).cast("struct<t:bigint,v:double>").alias("_s"), F.struct(*grid.columns).alias("_row"))
    right = samples.groupBy(key, t).agg(F.max(value).alias("_v")).select(key, t, F.lit(0).alias("_grid"), F.struct(F.col(t).cast("long").alias("t"), F.col("_v").cast("double").alias("v")).alias("_s"))
    return left.unionByName(right, allowMissingColumns=True)


def neighbours(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, bucket: int | None = None) -> DataFrame:
    """`grid` with before and after: the last sample at or before each row, the first at or after it, as (t, v).

    One shuffle serves both directions, each with its sort. Several samples of one time count as their greatest value.
    With `bucket`, an episode is dealt by stretches of that length, so that a very long one isn't sorted by one task;
    each stretch then gets the last sample before it and the first after it from a table of one row a stretch.
    """
    both = _merged(grid, samples, key, t, value).withColumn("_b", F.floor(F.col(t) / bucket) if bucket else F.lit(0).cast("long"))
    w = Window.partitionBy(key, "_b").orderBy(t, "_grid")
    back = Window.partitionBy(key, "_b").orderBy(F.col(t).desc(), "_grid")
    placed = both.withColumns({"before": F.last("_s", True).over(w), "after": F.last("_s", True).over(back)}).where("_grid = 1")
    if bucket is None:
        return placed.select("_row.*", "before", "after")
    ends = both.groupBy(key, "_b").agg(F.max_by("_s", F.col("_s.t")).alias("_last"), F.min_by("_s", F.col("_s.t")).alias("_first"))
    past = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_b", F.last("_last", True).over(past).alias("_past"), F.last("_first", True).over(future).alias("_future"))
    return placed.join(ends, [key, "_b"]).select("_row.*", F.coalesce("before", "_past").alias("before"), F.coalesce("after", "_future").alias("after"))


def interpolated(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, bucket: int | None = None) -> DataFrame:
    """Linear interpolation of `value` at the grid's times; null outside the samples' range, never extrapolated."""
    near = neighbours(grid, samples, key, t, value, bucket)
    share = (F.col(t) - F.col("before.t")) / F.nullif(F.col("after.t") - F.col("before.t"), F.lit(0))
    v = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.col("before.v") + F.coalesce(share, F.lit(0.0)) * (F.col("after.v") - F.col("before.v")))
    return near.withColumn(value, v).drop("before", "after")


def binarised(x: Column, at: float = 0.5) -> Column:
    return F.when(x >= at, 1.0).when(x < at, 0.0)


#: Fixed value: the least share of a gripper's stroke that a motor is told, 20 of 95 mm.
LEAST_OPENING = 20.0 / 95.0


def opening(x: Column, least: float = LEAST_OPENING) -> Column:
    """What the motor of a gripper is told: never closed below `least`, never past open; null for null or NaN.

    Only the motor is told this. Recorded actions are `binarised`, so that nothing learns the limit.
    """
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(least), F.least(x, F.lit(1.0))))


def held(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, period: int, bucket: int | None = None) -> DataFrame:
    """The last sample with time at most half a period after each grid row, or else the first one."""
    shifted = samples.select(key, (F.col(t) - period // 2).alias(t), value)
    near = neighbours(grid, shifted, key, t, value, bucket)
    pick = F.coalesce(F.col("before"), F.col("after"))  # where none is before, the next one is the first
    return near.withColumns({value: pick["v"], "residual": F.abs(pick["t"] + period // 2 - F.col(t))}).drop("before", "after")


def nearest(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, bucket: int | None = None) -> DataFrame:
    """The sample nearest in time; of two as near, the earlier."""
    near = neighbours(grid, samples, key, t, value, bucket)
    late = F.col("after.t") - F.col(t)
    early = F.col(t) - F.col("before.t")
    pick = F.when(F.col("before").isNull() | (late < early), F.col("after")).otherwise(F.col("before"))
    return near.withColumn("_p", pick).withColumns({value: F.col("_p.v"), "dt": F.col("_p.t") - F.col(t)}).drop("before", "after", "_p")


def overlap(samples: DataFrame, group: str, stream: str, t: str) -> DataFrame:
    """(group, t_start, t_end): the time that all streams of a group cover; groups without any are left out."""
    ends = samples.groupBy(group, stream).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    return ends.groupBy(group).agg(F.max("lo").alias("t_start"), F.min("hi").alias("t_end")).where("t_start <= t_end")


def within(samples: DataFrame, group: str, stream: str, t: str) -> DataFrame:
    """The samples in the time that all streams of their group cover, both ends included."""
    return samples.join(overlap(samples, group, stream, t), group).where(F.col(t).between(F.col("t_start"), F.col("t_end"))).drop("t_start", "t_end")


def drops(samples: DataFrame, group: str, stream: str, t: str, period: int) -> DataFrame:
    """(group, stream, n, dropped, longest): frames missing between neighbours, in all and in a row."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(group, stream).orderBy(t))
    missing = F.coalesce(F.greatest(F.rint(step / period) - 1, F.lit(0.0)).cast("long"), F.lit(0))
    return samples.withColumn("_m", missing).groupBy(group, stream).agg(F.count("*").alias("n"), F.sum("_m").alias("dropped"), F.max("_m").alias("longest"))


def residuals(aligned: DataFrame, key: str, period: int, run: int) -> DataFrame:
    """(key, median, worst, ok) of `residual`; ok where the worst is at most run + 1 periods."""
    out = aligned.groupBy(key).agg(F.percentile("residual", 0.5).alias("median"), F.max("residual").alias("worst"))
    return out.withColumn("ok", F.col("worst") <= (run + 1) * period)


def ticks(frames: DataFrame, marks: DataFrame, key: str, t: str) -> DataFrame:
    """`frames` with ticks: how many marks of the episode have a time not after theirs, by running counts."""
    both = frames.select("*", F.lit(1).alias("_frame")).unionByName(marks.select(key, t, F.lit(0).alias("_frame")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("ticks", F.sum(1 - F.col("_frame")).over(w)).where("_frame = 1").drop("_frame")


def proportional(frames: DataFrame, samples: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Each frame with the sample at the same share of its episode, by position alone: no times are compared."""
    n = samples.groupBy(key).agg(F.count("*").alias("_n"))
    last = frames.groupBy(key).agg(F.count("*").alias("_m"))
    at = F.least(F.floor(F.col(index) * F.col("_n") / F.col("_m")), F.col("_n") - 1)
    placed = frames.join(n, key).join(last, key).withColumn("_at", at)
    return placed.join(samples.select(key, F.col(index).alias("_at"), value), [key, "_at"], "left").drop("_n", "_m", "_at")


def clocked(frames: DataFrame, group: str, stream: str, t: str, epoch: int, starts: DataFrame | None = None) -> DataFrame:
    """`t` of all streams of a group on one clock, with `clock`: wall, started, own or mixed (t null).

    A stream is on the wall clock if its first time is over `epoch`. Others are moved to their start in `starts` (group,
    stream, start) where all streams of the group have one; a group without wall clocks and starts counts from each first frame.
    """
    first = frames.groupBy(group, stream).agg(F.min(t).alias("_first"))
    first = first.join(starts, [group, stream], "left") if starts is not None else first.withColumn("start", F.lit(None).cast("long"))
    both = first.groupBy(group).agg(F.bool_and(F.col("_first") > epoch).alias("_wall"), F.bool_or(F.col("_first") > epoch).alias("_some"), F.bool_and(F.col("start").isNotNull()).alias("_known"))
    out = frames.join(first, [group, stream]).join(both, group)
    clock = F.when(F.col("_wall"), "wall").when(F.col("_known"), "started").when(~F.col("_some"), "own").otherwise("mixed")
    moved = F.when(F.col("clock") == "own", F.col(t) - F.col("_first")).when((F.col("clock") == "started") & (F.col("_first") <= epoch), F.col(t) - F.col("_first") + F.col("start")).when(F.col("clock") != "mixed", F.col(t))
    return out.withColumn("clock", clock).withColumn(t, moved).drop("_first", "start", "_wall", "_some", "_known")


def filled(rows: DataFrame, key: str, order: list[str], value: str, fallback: Column) -> DataFrame:
    """`value` carried forward over nulls; before its first, the fallback of that row."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(value, F.coalesce(F.last(value, True).over(w), fallback))
