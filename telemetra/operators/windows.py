"""Training windows, differences, edges, islands, sessions, resampling and fits over ordered rows of an episode.

Every function partitions by the episode and streams through its sorted rows; `scans` has what carries a state along them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(rows: DataFrame, key: str, order: list[str], value: str, past: int, future: int, stride: int = 1) -> DataFrame:
    """Rows with index, n, window (past + 1 + future values, `stride` rows apart, ends repeated) and pad_left, pad_right.

    Offsets come from a frame over the sorted episode, so it is neither self-joined nor gathered whole. Values travel
    in structs, so that a null within the episode stays a null and isn't taken for its end. Padding counts steps, not rows.
    """
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    boxed = F.struct(F.col(value).alias("v"))
    cells = [F.coalesce(F.lag(boxed, -k * stride).over(w) if k else boxed, F.col("_first") if k < 0 else F.col("_last"))["v"] for k in range(-past, future + 1)]
    out = rows.withColumns({"index": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(key)), "_first": F.first(boxed).over(w), "_last": F.last(boxed).over(whole)})
    out = out.withColumn("window", F.array(*cells)).drop("_first", "_last")
    steps = lambda missing: F.greatest(F.ceil(missing / stride), F.lit(0)).cast("int")
    return out.withColumns({"pad_left": steps(past * stride - F.col("index")), "pad_right": steps(future * stride - (F.col("n") - 1 - F.col("index")))})


def masks(past: int, future: int) -> tuple[Column, Column]:
    """Which steps of a window lie before and after its anchor."""
    step = F.sequence(F.lit(-past), F.lit(future))
    return F.transform(step, lambda k: k < 0), F.transform(step, lambda k: k > 0)


def has_gap(window: Column) -> Column:
    """Whether a window holds a null or NaN."""
    return F.exists(window, lambda x: x.isNull() | F.isnan(x))


def travel(window: Column, past: int) -> Column:
    """The greatest distance from the anchor over the steps after it, of numbers; null without such steps."""
    return F.array_max(F.transform(F.slice(window, past + 2, F.size(window) - past - 1), lambda x: F.abs(x - window[past])))


def reason(pad_left: int, pad_right: int, still: float, past: int) -> Column:
    """Why a window of `clamped` is left out: padding, still or nan, in this order; null for usable ones."""
    return (
        F.when((F.col("pad_left") > pad_left) | (F.col("pad_right") > pad_right), "padding")
        .when(travel(F.col("window"), past) < still, "still")
        .when(has_gap(F.col("window")), "nan")
    )


def usable(windows: DataFrame, pad_left: int, pad_right: int, still: float, finite: bool = True) -> DataFrame:
    """Windows with at most that much padding, that move by `still` or more, and hold no NaN or null."""
    kept = windows.where((F.col("pad_left") <= pad_left) & (F.col("pad_right") <= pad_right))
    kept = kept.where(~has_gap(F.col("window"))) if finite else kept
    return kept.where(F.array_max("window") - F.array_min("window") >= still)


def every(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Every n-th row of an episode, the first included."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("_at", at).where(F.col("_at") % n == 0).drop("_at")


def changes(rows: DataFrame, key: str, order: list[str], t: str, value: str) -> DataFrame:
    """Rows with dt, dv and rate against the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumns({"dt": F.col(t) - F.lag(t).over(w), "dv": F.col(value) - F.lag(value).over(w)})
    return out.withColumn("rate", F.col("dv") / F.nullif("dt", F.lit(0)))


def falls(rows: DataFrame, key: str, order: list[str], value: str, at: float) -> DataFrame:
    """(key, closes): how often `value` goes from `at` or more to less."""
    w = Window.partitionBy(key).orderBy(*order)
    down = (F.lag(value).over(w) >= at) & (F.col(value) < at)
    return rows.withColumn("_down", down).groupBy(key).agg(F.count_if("_down").alias("closes"))


def islands(rows: DataFrame, key: str, order: list[str], t: str, inside: Column, least: int) -> DataFrame:
    """(key, t_start, t_end, n): stretches of rows with `inside`, lasting `least` or longer."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w))
    runs = marked.where("_in").groupBy(key, "_g").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count("*").alias("n"))
    return runs.where(F.col("t_end") - F.col("t_start") >= least).drop("_g")


def pauses(rows: DataFrame, key: str, order: list[str], t: str, slow: dict[str, float], command: str, lag: int, guard: int, longest: int) -> DataFrame:
    """(key, t_start, length): still stretches longer than `longest`, outside `guard` at both ends.

    A row is still if over `lag` rows each column of `slow` moved slower than its limit a unit of time, and the command
    is that of the row before. A stretch lasts to the row that ends it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    took = F.greatest(F.col(t) - F.lag(t, lag).over(w), F.lit(1))
    inside = F.col(command) == F.lag(command).over(w)
    for value, limit in slow.items():
        inside = inside & (F.abs(F.col(value) - F.lag(value, lag).over(w)) / took < limit)
    out = rows.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_lo": F.min(t).over(whole), "_hi": F.max(t).over(whole), "_next": F.coalesce(F.lead(t).over(w), F.col(t))})
    out = out.withColumn("_in", F.col("_in") & (F.col(t) > F.col("_lo") + guard) & (F.col(t) < F.col("_hi") - guard))
    out = out.withColumn("_g", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w))
    runs = out.where("_in").groupBy(key, "_g").agg(F.min(t).alias("t_start"), (F.max("_next") - F.min(t)).alias("length"))
    return runs.where(F.col("length") > longest).drop("_g")


def sessions(rows: DataFrame, key: str, order: list[str], t: str, gap: int, starts: Column | None = None) -> DataFrame:
    """Rows with session (from 0): a new one begins after a gap longer than `gap`, or where `starts` holds."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False))
    if starts is not None:
        new = new | (starts & F.lag(t).over(w).isNotNull())
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def sessions_with_starts(episodes: DataFrame, key: str, start: str, end: str, tie: str, logged: DataFrame, logged_at: str, gap: int) -> DataFrame:
    """Episodes with session (from 0), by their end: a new one after more than `gap` from the end before to the start.

    A logged start also begins one if it lies after the end before and not after this start. Logged starts are merged
    into the episodes' order once, so no episode is compared with all of them.
    """
    w = Window.partitionBy(key).orderBy(end, tie)
    ranked = episodes.withColumn("_prev", F.lag(end).over(w))
    marks = logged.select(key, F.col(logged_at).alias("_at"), F.col(logged_at).alias("_log"))
    both = ranked.withColumn("_at", F.col(start)).unionByName(marks, allowMissingColumns=True)
    last = F.max("_log").over(Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumn("_last", last).where(F.col(end).isNotNull())
    new = F.col("_prev").isNotNull() & ((F.col(start) - F.col("_prev") > gap) | F.coalesce(F.col("_last") > F.col("_prev"), F.lit(False)))
    return seen.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_prev", "_at", "_log", "_last", "_new")


def spread(rows: DataFrame, key: str, order: list[str], t: str, most_equal: float = 0.1) -> DataFrame:
    """`t` as it is if it never falls and few steps are zero, else evenly spaced between its ends."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    out = rows.withColumns({"_d": F.col(t) - F.lag(t).over(w), "_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    bad = (F.coalesce(F.min("_d").over(whole), F.lit(0)) < 0) | (F.count_if(F.col("_d") == 0).over(whole) > most_equal * (F.col("_n") - 1))
    even = F.min(t).over(whole) + F.floor((F.max(t).over(whole) - F.min(t).over(whole)) * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))).cast("long")
    return out.withColumn(t, F.when(bad, even).otherwise(F.col(t))).drop("_d", "_i", "_n")


def resampled(rows: DataFrame, key: str, t: str, value: str, period: int) -> DataFrame:
    """(key, step, t, value): linear interpolation at rint(span / period) + 1 even places from first to last time.

    Each row gives the places between its time and the next one, so an episode's grid is never joined with its rows.
    """
    one = rows.groupBy(key, t).agg(F.max(value).alias(value))
    w = Window.partitionBy(key).orderBy(t)
    whole = Window.partitionBy(key)
    lo, hi = F.min(t).over(whole), F.max(t).over(whole)
    out = one.withColumns({"_lo": lo, "_span": hi - lo, "_n": F.rint((hi - lo) / period).cast("long"), "_t2": F.lead(t).over(w), "_v2": F.lead(value).over(w)})
    place = lambda at: (at - F.col("_lo")) * F.col("_n") / F.nullif("_span", F.lit(0))
    first, after = F.ceil(F.coalesce(place(F.col(t)), F.lit(0.0))), F.ceil(place(F.col("_t2")))
    steps = F.when(F.col("_t2").isNull(), F.array(F.col("_n"))).when(first < after, F.sequence(first, after - 1))
    out = out.withColumn("step", F.explode(steps))
    at = F.col("_lo") + F.col("_span") * F.col("step") / F.greatest(F.col("_n"), F.lit(1))
    v = F.col(value) + F.coalesce((at - F.col(t)) / (F.col("_t2") - F.col(t)) * (F.col("_v2") - F.col(value)), F.lit(0.0))
    return out.select(key, "step", at.alias(t), v.alias(value))


def ends(rows: DataFrame, key: str, order: list[str], value: str, n: int = 5, least: int = 3) -> DataFrame:
    """(key, start, end): medians of the first and last n values; null where fewer than `least` rows are."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    marked = rows.withColumns({"_up": up, "_down": down})
    half = lambda c: F.when(F.count(F.when(F.col(c) <= n, F.lit(1))) >= least, F.percentile(F.when(F.col(c) <= n, F.col(value)), 0.5))
    return marked.where((F.col("_up") <= n) | (F.col("_down") <= n)).groupBy(key).agg(half("_up").alias("start"), half("_down").alias("end"))


def first_where(rows: DataFrame, key: str, index: str, condition: Column) -> DataFrame:
    """(key, first): the least index at which the condition holds, or -1."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(condition, F.col(index))), F.lit(-1)).alias("first"))


def falling(rows: DataFrame, key: str, order: list[str], t: str) -> DataFrame:
    """(key, falls, monotonic): how often the time is less than that of the row before."""
    down = F.lag(t).over(Window.partitionBy(key).orderBy(*order)) > F.col(t)
    return rows.withColumn("_down", down).groupBy(key).agg(F.count_if("_down").alias("falls")).withColumn("monotonic", F.col("falls") == 0)


def lags(rows: DataFrame, key: str, order: list[str], command: str, measured: str, most: int) -> DataFrame:
    """(key, rms, max, lag, rms_at_lag): tracking error now, and the lag of 0 to `most` rows with the least one about its mean.

    A frame over the sorted episode gives all lags of a row at once; the errors are then summed by lag.
    """
    w = Window.partitionBy(key).orderBy(*order)
    found = rows.withColumn("_e", F.array(*[F.col(command) - F.lead(measured, k).over(w) if k else F.col(command) - F.col(measured) for k in range(most + 1)]))
    by_lag = found.select(key, F.posexplode("_e").alias("k", "e")).where("e is not null").groupBy(key, "k")
    by_lag = by_lag.agg(F.sqrt(F.var_pop("e")).alias("about"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.max(F.abs("e")).alias("top"))
    best = F.min(F.struct(F.round("about", 9).alias("about"), "k"))
    return by_lag.groupBy(key).agg(F.max(F.when(F.col("k") == 0, F.col("rms"))).alias("rms"), F.max(F.when(F.col("k") == 0, F.col("top"))).alias("max"), best.alias("b")).select(key, "rms", "max", F.col("b.k").alias("lag"), F.col("b.about").alias("rms_at_lag"))


def breakpoints(rows: DataFrame, key: str, order: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    """(key, k, z, approach, contact, sse): the best split of an episode into two lines, at `least` rows or more on both sides.

    Sums before and after each row come from running sums of centred values, so every split is judged in one pass.
    """
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    out = rows.withColumns({"_x": F.col(x) - F.avg(x).over(whole), "_y": F.col(y) - F.avg(y).over(whole), "_mx": F.avg(x).over(whole), "_my": F.avg(y).over(whole), "k": F.row_number().over(w), "_n": F.count("*").over(whole)})
    terms = {"x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") * F.col("_y")}
    out = out.withColumns({f"_{s}{name}": v for name, e in terms.items() for s, v in (("a", F.sum(e).over(w)), ("t", F.sum(e).over(whole)))})

    def line(side: str, n: Column) -> tuple[Column, Column, Column]:
        s = {name: F.col(f"_a{name}") if side == "a" else F.col(f"_t{name}") - F.col(f"_a{name}") for name in terms}
        sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / n, s["xy"] - s["x"] * s["y"] / n, s["yy"] - s["y"] * s["y"] / n
        slope = F.coalesce(sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
        return slope, (s["y"] - slope * s["x"]) / n, F.greatest(syy - slope * sxy, F.lit(0.0))

    out = out.where((F.col("k") >= least) & (F.col("k") <= F.col("_n") - least))
    (b1, c1, e1), (b2, _, e2) = line("a", F.col("k")), line("b", F.col("_n") - F.col("k"))
    judged = out.select(key, "k", (e1 + e2).alias("sse"), b1.alias("approach"), b2.alias("contact"), (b1 * F.col("_x") + c1 + F.col("_my")).alias("z"))
    best = judged.groupBy(key).agg(F.min(F.struct(F.round("sse", 6).alias("sse"), "k", "z", "approach", "contact")).alias("b"))
    return best.select(key, "b.k", "b.z", "b.approach", "b.contact", "b.sse")
