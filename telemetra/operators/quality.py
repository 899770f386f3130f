"""Quality rules of episodes as columns: each gives reasons, and an episode without any passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

Box = tuple[float, float, float, float]


def reasons(rules: list[tuple[Column, Column]]) -> Column:
    """The texts of the rules (holds, text) that hold, in order; a rule that is null doesn't."""
    return F.array_compact(F.array(*[F.when(holds, text) for holds, text in rules]))


def inside(x: Column, y: Column, box: Box, margin: Box = (0.0, 0.0, 0.0, 0.0)) -> Column:
    """Whether a place, widened by a margin (low x, high x, low y, high y), lies in a box (x0, x1, y0, y1), edges included."""
    return (x + margin[0] >= box[0]) & (x + margin[1] <= box[1]) & (y + margin[2] >= box[2]) & (y + margin[3] <= box[3])


def placement(x: Column, y: Column, inner: Box, outer: Box, radius: float) -> tuple[Column, Column]:
    """(centre in the inner box, whole disc in the outer one)."""
    return inside(x, y, inner), inside(x, y, outer, (-radius, radius, -radius, radius))


def placement_reasons(x: Column, y: Column, inner: Box, outer: Box, radius: float) -> list[tuple[Column, Column]]:
    centre, whole = placement(x, y, inner, outer, radius)
    at = F.format_string("(%.3f, %+.3f)", rounded(x, 3), rounded(y, 3))
    return [
        (x.isNull() | y.isNull(), F.lit("not found")),
        (~centre, F.concat(F.lit("centre "), at, F.lit(" outside the inner box"))),
        (~whole, F.concat(at, F.lit(" may cross the outer box"))),
    ]


def tip_reasons(tips: list[Column], rows: list[int], most: int) -> list[tuple[Column, Column]]:
    """Tips that are found off their reference rows by more than `most`, and no tip at all; one may be hidden."""
    off = [(F.abs(tip - row) > most, F.concat(F.lit(f"tip {k} row "), tip.cast("string"), F.lit(f" vs {row}"))) for k, (tip, row) in enumerate(zip(tips, rows))]
    none = tips[0].isNull()
    for tip in tips[1:]:
        none = none & tip.isNull()
    return [*off, (none, F.lit("no tip found"))]


def unlocked(got: Column, want: Column, within: float = 0.5) -> Column:
    """Whether controls differ from the wanted ones by more than `within` on any key, or are not known; maps of numbers."""
    far = F.exists(F.map_entries(want), lambda e: F.abs(F.coalesce(F.try_element_at(got, e["key"]), F.lit(-1.0)) - e["value"]) > within)
    return F.coalesce(far | got.isNull() | want.isNull(), F.lit(True))


def range_reason(name: str, x: Column, low: float, high: float) -> tuple[Column, Column]:
    return ~F.coalesce(x, F.lit(0.0)).between(low, high), F.format_string(f"{name} %.1f outside [{low}, {high}]", rounded(F.coalesce(x, F.lit(0.0)), 1))


def closes_reason(closes: Column, expected: int, few: str, many: str) -> tuple[Column, Column]:
    why = F.when(closes < expected, few).otherwise(many)
    return closes != expected, F.concat(closes.cast("string"), F.lit(f" closes (expected {expected}: "), why, F.lit(")"))


def moved_reason(x0: Column, y0: Column, x1: Column, y1: Column, most: float) -> tuple[Column, Column]:
    way = F.hypot(x1 - x0, y1 - y0)
    return way > most, F.format_string("moved %.0f mm", rounded(way * 1000, 0))


def linted(episodes: DataFrame, rows: DataFrame, key: str, t: str, value: str, gap: int, span: float) -> DataFrame:
    """`episodes` (key, complete, duration_s, status, n_rows) with warnings, from their samples (key, t, value).

    Cut short, too short, without verdict, with several rows in the store, without samples, with a gap over `gap`, or
    with values that range over less than `span`.
    """
    step = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    stats = rows.withColumn("_d", step).groupBy(key).agg(F.count("*").alias("_samples"), F.max("_d").alias("_gap"), (F.max(value) - F.min(value)).alias("_span"))
    out = episodes.join(stats, key, "left")
    rules = [
        (~F.coalesce("complete", F.lit(True)), F.lit("cut short")),
        (F.col("duration_s") < 15, F.format_string("only %.1f s long", rounded(F.col("duration_s"), 1))),
        (F.col("status") == "pending", F.lit("no verdict")),
        (F.col("n_rows") > 1, F.lit("duplicate rows")),
        (F.col("_samples").isNull(), F.lit("no telemetry")),
        (F.col("_gap") > gap, F.lit("gap in telemetry")),
        (F.col("_span") < span, F.lit("barely moved")),
    ]
    return out.withColumn("warnings", reasons(rules)).drop("_samples", "_gap", "_span")


def matched_clamp(p99: Column, ceilings: dict[str, float]) -> tuple[Column, Column]:
    """(name of the ceiling nearest to p99, whether it lies within a quarter of that)."""
    near = F.array_min(F.array(*[F.struct(F.abs(p99 - v).alias("d"), F.lit(name).alias("name"), F.lit(v).alias("v")) for name, v in ceilings.items()]))
    return near["name"], near["d"] <= 0.25 * near["v"]


def depth_report(frames: DataFrame, key: str, pixels: str, expected: int, saturated: int = 65535) -> DataFrame:
    """(key, valid, median_mm, n_saturated, reasons) of depth frames, arrays of millimetres, 0 for no return."""
    bad = F.size(F.filter(pixels, lambda d: d == saturated)) > 0.5 * F.size(pixels)
    per = frames.groupBy(key).agg(F.count_if(bad).alias("n_saturated"), F.count_if(F.size(pixels) != expected).alias("_shape"), F.count(pixels).alias("_n"))
    cells = frames.select(key, F.explode(pixels).alias("d")).groupBy(key, "d").agg(F.count("*").alias("c"))
    found = cells.groupBy(key).agg((F.sum(F.when(F.col("d") > 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("valid"), F.percentile(F.when(F.col("d") > 0, F.col("d")), 0.5, F.col("c")).alias("median_mm"))
    out = per.join(found, key, "left")
    rules = [
        (F.col("_shape") > 0, F.lit("unaligned")),
        (F.coalesce("valid", F.lit(0.0)) == 0, F.lit("no return")),
        (~F.col("median_mm").between(50, 10_000), F.lit("suspect median")),
        ((F.col("valid") > 0) & (F.col("valid") < 0.5), F.lit("sparse")),
        (F.col("n_saturated") > 0, F.lit("saturated frames")),
    ]
    return out.select(key, "valid", "median_mm", "n_saturated", reasons(rules).alias("reasons"))


def unusable_length(streams: DataFrame, key: str, stream: str, share: float = 0.9) -> DataFrame:
    """(key, least, most, ok) of the streams' frame counts; ok where the shortest has `share` of the longest, to which all are then cut."""
    n = streams.groupBy(key, stream).agg(F.count("*").alias("n")).groupBy(key).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return n.withColumn("ok", F.col("least") >= share * F.col("most"))


def cut(frames: DataFrame, lengths: DataFrame, key: str, index: str) -> DataFrame:
    """Frames of usable episodes, cut to the shortest stream; `lengths` as `unusable_length` gives it."""
    return frames.join(lengths.where("ok").select(key, "least"), key).where(F.col(index) < F.col("least")).drop("least")


def jump(now: Column, command: Column, joints: int = 6) -> Column:
    """The greatest step of the first `joints` places of a command; the gripper after them has other units."""
    return F.array_max(F.zip_with(F.slice(now, 1, joints), F.slice(command, 1, joints), lambda a, b: F.abs(b - a)))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
