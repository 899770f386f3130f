"""Whole verdicts on episodes: every quality rule of a finished recording, and every warning of a linter.

A key names an episode by itself, such as its path. Texts of reasons are fixed values that reports sort by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from . import quality, summaries, windows

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Settings:
    """What an episode must keep to; times are seconds, of `unit` ticks of the telemetry's clock."""

    controls: dict[str, dict[str, float]]  #: camera: its locked controls
    inner: Box  #: where the object's centre may start (x0, x1, y0, y1)
    outer: Box  #: what no part of object or fixture may cross
    fixture: Box  #: where the fixture stands
    radius: float  #: of the object
    footprint: Box  #: the fixture's reach about its origin (low x, high x, low y, high y)
    x_slack: float = 0.015
    tips: tuple[int, ...] = (312, 304)
    tip_names: tuple[str, ...] = ("left", "right")
    most_tip: float = 25
    least_wrist: float = 100.0
    scene: tuple[float, float] = (90.0, 140.0)
    moved: float = 0.015
    closes: int = 1
    still: float = 0.02
    gripper_still: float = 0.05
    guard: float = 0.5
    pause: float = 1.0
    lag: int = 10
    seconds: tuple[float, float] = (5.0, 90.0)
    unit: float = 1e9
    names: tuple[str, str] = field(default=("object", "fixture"))


def _controls(got: Column, s: Settings) -> list[tuple[Column, Column]]:
    rules = []
    for camera, wanted in s.controls.items():
        want = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))])
        have = F.try_element_at(got, F.lit(camera))
        text = F.concat(F.lit(f"{camera} color_controls "), F.coalesce(F.to_json(have), F.lit("None")), F.lit(" (camera.json "), F.to_json(want), F.lit(")"))
        rules.append((quality.unlocked(have, want), text))
    return rules


def _wrist(mean: Column, tips: Column, s: Settings) -> list[tuple[Column, Column]]:
    seen = mean.isNotNull()
    tip = lambda k: F.try_element_at(tips, F.lit(k + 1))
    off = [(seen & (F.abs(tip(k) - row) > s.most_tip), F.concat(F.lit(f"wrist: {name} tip row "), tip(k).cast("string"), F.lit(f" vs {row} (camera slipped?)"))) for k, (name, row) in enumerate(zip(s.tip_names, s.tips))]
    none = F.coalesce(~F.exists(tips, lambda x: x.isNotNull()), F.lit(True))
    dark = F.concat(F.format_string("wrist brightness %.0f", rounded(mean)), F.lit(f" < {s.least_wrist:.0f} (camera slipped?)"))
    return [(~seen, F.lit("wrist frame unreadable")), *off, (seen & none, F.lit("wrist: no fingertip found (camera slipped?)")), (mean < s.least_wrist, dark)]


def _scene(mean: Column, at: Column, fixture: Column, moved: Column, s: Settings) -> list[tuple[Column, Column]]:
    """Rules of the scene's first frame; where it can't be read, that is all there is to say, but for what moved."""
    seen = mean.isNotNull()
    thing, big = s.names
    place = lambda p: F.format_string("(%.3f, %+.3f)", rounded(p[0], 3), rounded(p[1], 3))
    centre, whole = quality.placement(at[0], at[1], s.inner, s.outer, s.radius)
    x0, x1, y0, y1 = s.fixture
    inside = quality.inside(fixture[0], fixture[1], s.outer, s.footprint)
    way = F.hypot(moved["dx"], moved["dy"])
    hidden = F.when(moved["length_s"] - moved["seen_s"] > 3, F.format_string(" by %.0f s, hidden for the last %.0f s", rounded(moved["seen_s"]), rounded(moved["length_s"] - moved["seen_s"]))).otherwise("")
    went = F.format_string(f"{big} moved %.0f mm (x %+.0f, y %+.0f mm)", rounded(way * 1000), rounded(moved["dx"] * 1000), rounded(moved["dy"] * 1000))
    return [
        (~seen, F.lit("scene frame unreadable")),
        (~mean.between(*s.scene), F.concat(F.format_string("scene brightness %.0f", rounded(mean)), F.lit(f" outside {s.scene}"))),
        (seen & at.isNull(), F.lit(f"{thing} not found in the first scene frame")),
        (seen & ~centre, F.concat(F.lit(f"{thing} centre "), place(at), F.lit(" outside the inner box"))),
        (seen & ~whole, F.concat(F.lit(f"{thing} "), place(at), F.lit(" may cross the outer box"))),
        (seen & fixture.isNull(), F.lit(f"{big} not found in the first scene frame")),
        (seen & ~fixture[0].between(x0 - s.x_slack, x1 + s.x_slack), F.format_string(f"{big} x %.3f, sim {(x0 + x1) / 2:.3f} (> {s.x_slack * 1000:.0f} mm off)", rounded(fixture[0], 3))),
        (seen & ~fixture[1].between(y0, y1), F.format_string(f"{big} y %+.3f outside the sim's ±{y1:.3f}", rounded(fixture[1], 3))),
        (seen & ~inside, F.concat(F.lit(f"{big} "), place(fixture), F.lit(" crosses the outer box"))),
        (seen & (way > s.moved), F.concat(went, hidden)),
    ]


def checked(episodes: DataFrame, telemetry: DataFrame, key: str, t: str, s: Settings) -> DataFrame:
    """`episodes` with closes, pauses and reasons; those without any reason pass.

    episodes: (key, task, duration_s, controls: map of maps, wrist_mean, tips, scene_mean, at, fixture: places (x, y),
    moved: struct (dx, dy, seen_s, length_s)); null means of frames stand for frames that can't be read. telemetry:
    (key, t, joint_pos, gripper_cmd, gripper_pos). An episode without telemetry has no closes, which is a reason unless
    none are expected. Durations far from the median of the other episodes of their task are outliers, from five others on.
    """
    joints = 6
    rows = telemetry.select(key, t, *[F.try_element_at("joint_pos", F.lit(k + 1)).cast("double").alias(f"joint_{k}") for k in range(joints)], "gripper_cmd", F.col("gripper_pos").cast("double").alias("gripper"))
    # Arms of fewer joints have nulls, which don't move.
    rows = rows.withColumns({f"joint_{k}": F.coalesce(f"joint_{k}", F.lit(0.0)) for k in range(joints)})
    slow = {f"joint_{k}": s.still / s.unit for k in range(joints)} | {"gripper": s.gripper_still / s.unit}
    still = windows.pauses(rows, key, [t], t, slow, "gripper_cmd", s.lag, int(s.guard * s.unit), int(s.pause * s.unit))
    starts = rows.groupBy(key).agg(F.min(t).alias("origin"))
    told = F.struct(((F.col("t_start") - F.col("origin")) / s.unit).alias("start_s"), (F.col("length") / s.unit).alias("length_s"))
    pauses = still.join(starts, key).groupBy(key).agg(F.array_sort(F.collect_list(told)).alias("pauses"))  # each is longer than `pause`
    closes = windows.falls(rows, key, [t], "gripper_cmd", 0.5).select(key, "closes")
    lengths = summaries.outliers(episodes.where("duration_s <> 0").select(key, "task", "duration_s"), ["task"], [key], "duration_s").where("outlier").select(key, "others")
    out = episodes.join(closes, key, "left").join(pauses, key, "left").join(lengths, key, "left")
    out = out.withColumns({"closes": F.coalesce("closes", F.lit(0)), "pauses": F.coalesce("pauses", F.array().cast("array<struct<start_s:double,length_s:double>>"))})
    few, many = f"{s.names[0]} not grasped?", "grasped again?"
    first = quality.reasons([*_controls(F.col("controls"), s), *_wrist(F.col("wrist_mean"), F.col("tips"), s), *_scene(F.col("scene_mean"), F.col("at"), F.col("fixture"), F.col("moved"), s), _closes(F.col("closes"), s.closes, few, many)])
    waited = F.transform("pauses", lambda p: F.format_string("pause %.1f s at %.1f s", rounded(p["length_s"], 1), rounded(p["start_s"], 1)))
    far = F.format_string("duration outlier (%.1f s vs median %.1f s)", rounded(F.col("duration_s"), 1), rounded(F.col("others"), 1))
    last = quality.reasons([quality.range_reason("duration", F.col("duration_s"), *s.seconds), (F.col("others").isNotNull(), far)])
    return out.withColumn("reasons", F.concat(first, waited, last)).drop("others")


def _closes(n: Column, expected: int, few: str, many: str) -> tuple[Column, Column]:
    return n != expected, F.concat(n.cast("string"), F.lit(f" gripper closes (expected {expected}: "), F.when(n < expected, few).otherwise(many), F.lit(")"))


def linted(episodes: DataFrame, telemetry: DataFrame, key: str, t: str, ceilings: dict[str, float], short: float = 15.0, gap: float = 0.1, span: float = 0.05, closed: float = 0.6, least: int = 10, unit: float = 1e9) -> DataFrame:
    """(key, warnings): all that a linter says of raw recordings; [] for a sound one.

    episodes: (key, complete, duration_s, statuses: of its rows in the store, cameras, files: the cameras that have one).
    telemetry: (key, arm, t, joint_pos, joint_cmd, joint_pos_7d), of which the last two may be null where an arm has no
    gripper. An arm's gripper is told by the 99th percentile of how far the measured jaws stay open of the command while
    that is closed, exact at any length, which must lie within a quarter of one of `ceilings`.
    """
    e = F.col
    missing = F.transform(F.array_sort(F.array_except(F.coalesce("cameras", F.array().cast("array<string>")), F.coalesce("files", F.array().cast("array<string>")))), lambda c: F.concat(F.lit("camera '"), c, F.lit("' has no file")))
    count = F.size(F.coalesce("statuses", F.array().cast("array<string>")))
    head = quality.reasons([
        (~F.coalesce("complete", F.lit(True)), F.lit("complete=False: this recording was cut short")),
        (e("duration_s") < short, F.format_string("only %.1f s long", rounded(F.col("duration_s"), 1))),
        ((count == 1) & F.lower(e("statuses")[0]).startswith("pending") | (count > 1) & F.exists("statuses", lambda x: F.lower(x).contains("pending")), F.lit("no verdict recorded (pending)")),
        (count > 1, F.lit("duplicate rows of this path")),
    ])
    steps = windows.changes(telemetry.select(key, "arm", t).withColumn("lane", F.struct(key, "arm")).withColumn("zero", F.lit(0.0)), "lane", [t], t, "zero")
    gaps = steps.groupBy(key).agg((F.max("dt") / unit).alias("widest"))
    ranges = F.greatest(*[F.max(e("joint_pos")[k]) - F.min(e("joint_pos")[k]) for k in range(6)])
    grip = telemetry.select(key, "arm", e("joint_cmd")[6].cast("double").alias("cmd"), (e("joint_pos_7d")[6].cast("double") - e("joint_cmd")[6].cast("double")).alias("behind"))
    shut = grip.where(e("cmd") < closed)
    per = telemetry.groupBy(key, "arm").agg(ranges.alias("reach"), F.count_if(e("joint_cmd")[6] < closed).alias("shut"), F.count_if(e("joint_cmd").isNotNull() & e("joint_pos_7d").isNotNull()).alias("gripped"))
    p99 = summaries.percentiles(shut, [key, "arm"], "behind", (99.0,)).select(key, "arm", e("behind").alias("p99"))
    name, near = quality.matched_clamp(e("p99"), ceilings)
    enough = (e("gripped") > 0) & (e("shut") >= least)
    arms = per.join(p99, [key, "arm"], "left").select(key, "arm", quality.reasons([
        (e("reach") < span, F.concat("arm", F.lit(f": the arm barely moved (max joint range < {span} rad)"))),
        ((e("gripped") > 0) & (e("shut") < least), F.concat("arm", F.lit(": gripper never commanded closed, so nothing was grasped"))),
        (enough & ~near, F.concat("arm", F.format_string(": gripper lag p99 %+.4f matches no known clamp ceiling", rounded(F.col("p99"), 4)))),
    ]).alias("said"))
    said = arms.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arm", "said"))), lambda x: x["said"])).alias("of_arms"))  # a few arms
    out = episodes.join(gaps, key, "left").join(said, key, "left")
    late = quality.reasons([(e("widest") > gap, F.format_string("%.0f ms gap in robot telemetry", rounded(e("widest") * 1000)))])
    tail = F.when(e("of_arms").isNull(), F.array(F.lit("no telemetry at all"))).otherwise(F.concat(late, e("of_arms")))
    return out.select(key, F.concat(head, missing, tail).alias("warnings"))
