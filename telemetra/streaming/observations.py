"""Streams of observations: late data is bounded by a watermark, repeated stamps are dropped, windows are counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, t: str, late: str = "30 minutes") -> DataFrame:
    """`stream` with `t` as a timestamp, and its watermark."""
    return stream.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def windowed(stream: DataFrame, t: str, by: str, value: str, width: str = "10 minutes", late: str | None = "30 minutes") -> DataFrame:
    """(window, by, n, mean) of a stream with timestamp `t`; also runs on a batch table. late: None if `stream` has its watermark."""
    on_time = stream if late is None else timed(stream, t, late)
    return on_time.groupBy(F.window(t, width).alias("window"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def once(stream: DataFrame, t: str, key: list[str], late: str = "30 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return timed(stream, t, late).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, t: str, key: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """(key, start, last, n): a session ends with a gap longer than `gap`; also runs on a batch table."""
    found = timed(stream, t, late).groupBy(key, F.session_window(t, gap).alias("_w"))
    return found.agg(F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n")).drop("_w")


def newest(stream: DataFrame, key: str, t: str) -> DataFrame:
    """The newest row of each key; in update mode each trigger gives one row for keys that have new ones, so older ones are skipped."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), t).alias("_r")).select(key, "_r.*")


def slotted(stream: DataFrame, key: str, t: str, period: int, late: str = "30 minutes") -> DataFrame:
    """One row for each slot of a grid of `period` microseconds, whose edges lie half a period around its points."""
    on_time = timed(stream, t, late)
    slot = F.floor(F.unix_micros(t) / period + F.lit(0.5)).alias("slot")
    return on_time.select("*", slot).dropDuplicatesWithinWatermark([key, "slot"])


def watched(stream: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, key: str, order: str, checkpoint: str):
    """A query that checks what arrives and merges it into the Parquet tables `path`/<batch>, of which the highest is valid.

    Each batch writes a whole new version, so a repeated batch overwrites its own; of rows with the same key the last in order stays.
    """
    from ..operators.summaries import later_wins

    def merge(batch: DataFrame, number: int) -> None:
        found = check(batch)
        if number:
            found = found.unionByName(batch.sparkSession.read.parquet(f"{path}/{number - 1}"))
        later_wins(found, [key], [order]).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
