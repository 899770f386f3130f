"""Where queries register themselves with their DuckDB SQL, and the tables that stand for telemetry and demonstrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENTS = "(select event_id, user_id, epoch_us(ts) t, event_type, value, props from events)"


def register(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query by its name, with the SQL of its result where SQL can tell it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: a user's events are an episode, times are microseconds."""
    t = F.expr("cast(date_diff(microsecond, timestamp_ntz'1970-01-01', ts) as bigint)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", t.alias("t"), "event_type", "value", "props")


def grid_and_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as a camera's frames and views as samples."""
    e = events(spark, sf_dir)
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select("user_id", "t", "value")
