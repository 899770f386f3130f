"""Queries that run as streams over all that is there, and stop. Results go to Parquet in the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove, shared_dir
from ..streaming import observations, stateful
from .registry import EVENTS, register

HOUR = 3_600_000_000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of files, with times in microseconds."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("t", F.expr("cast(date_diff(microsecond, timestamp_ntz'1970-01-01', ts) as bigint)"))


def _finished(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    atexit.register(remove, spark, at)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@register(f"""with g as (select event_id, user_id, t from {EVENTS} where event_type = 'click'), s as (select user_id, t, value v from {EVENTS} where event_type = 'view'), f as (select user_id, arg_min(v, t) v from s group by all),
n as (select g.*, b.t bt, b.v bv, a.t at_, a.v av, f.v fv from g asof left join s b on g.user_id = b.user_id and g.t >= b.t asof join s a on g.user_id = a.user_id and g.t <= a.t left join f on f.user_id = g.user_id)
select user_id, t, round(case when bt is null then fv when at_ = bt then bv else bv + (t - bt)::double / (at_ - bt) * (av - bv) end, 6) as value from n""")
def stream_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames answered from a ring buffer of samples as soon as one follows them."""
    rows = _stream(spark, sf_dir).where("event_type in ('click', 'view')").select("user_id", "t", "value", (F.col("event_type") == "click").alias("frame"))
    return _finished(stateful.interpolated(rows, "user_id", "t", "value", "frame")).withColumn("value", F.round("value", 6))


@register(f"with f as (select user_id, event_type, min(t) t from {EVENTS} group by all) select f.user_id, f.event_type, r.t - f.t as offset from f join f r on r.user_id = f.user_id and r.event_type = 'view'")
def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each stream's first row is before that of the reference."""
    return _finished(stateful.offsets(_stream(spark, sf_dir).select("user_id", "t", "event_type"), "user_id", "t", "event_type", "view"))


@register(f"with g as (select user_id, t, t - lag(t) over (partition by user_id order by t) gap from {EVENTS}) select user_id, t, gap, case when gap > 172800000000 then 'warn' else 'hold' end as state from g where gap > 43200000000")
def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(stateful.stale(_stream(spark, sf_dir).select("user_id", "t"), "user_id", "t", 12 * HOUR, 48 * HOUR))


@register(f"with g as (select user_id, t, event_type, value >= 50 d, lag(value >= 50) over (partition by user_id, event_type order by t) p from {EVENTS}) select user_id, t, 'done: ' || event_type as event from g where d and not p")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has become done."""
    rows = _stream(spark, sf_dir).select("user_id", "t", "event_type", (F.col("value") >= 50).alias("done"))
    return _finished(stateful.turned(rows, "user_id", "t", "event_type", "done"))


@register(f"select user_id, count(distinct floor(t / 86400000000 + 0.5)) as slots from {EVENTS} group by all")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a grid of a day that have a row."""
    rows = _stream(spark, sf_dir).select("user_id", "ts")
    return _finished(observations.slotted(rows, "user_id", "ts", 24 * HOUR)).groupBy("user_id").agg(F.count("*").alias("slots"))


@register(None)
def stream_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row of each episode in two days."""
    return _finished(stateful.limited(_stream(spark, sf_dir).select("user_id", "t"), "user_id", "t", 48 * HOUR))


@register(None)
def stream_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command at each tick: purchases are actions, other rows ticks."""
    rows = _stream(spark, sf_dir).select("user_id", "t", F.when(F.col("event_type") == "purchase", F.col("value")).alias("action"))
    return _finished(stateful.held(rows, "user_id", "t", "action", 24 * HOUR))


@register(None)
def stream_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of every source at each click."""
    return _finished(stateful.assembled(_stream(spark, sf_dir).select("user_id", "t", "event_type", "value"), "user_id", "t", "event_type", "value", "click"))


@register(None)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return _finished(observations.sessions(_stream(spark, sf_dir).select("ts", "user_id"), "ts", "user_id", "12 hours"))
