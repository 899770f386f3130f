"""Operators that act when nothing comes: timers by event time, and memory that ends with them.

A timer of a key is due at a time that its memory tells. It goes off before the key's first row after that time, or, if none
comes, once the watermark has passed it; so what is given doesn't depend on how rows fall into triggers. A timer can end
the memory of its key, so keys that have gone silent for good leave no state. A row that is older than the newest
one of its key, or not after the watermark, changes nothing. Times are whole milliseconds after 1970.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

Memory = object
#: Of a memory and a row's time and values: the new memory and what is given.
OnRow = Callable[[Memory, int, tuple], tuple[Memory, list[tuple]]]
#: Of a memory: when its timer is due, None without one.
Due = Callable[[Memory], int | None]
#: Of a memory whose timer is due: the new memory, None to forget the key, and what is given.
OnTime = Callable[[Memory], tuple[Memory | None, list[tuple]]]


def timed(stream: DataFrame, key: str, ts: str, values: list[str], out: str, on_row: OnRow, due: Due, on_time: OnTime, known: bool = False) -> DataFrame:
    """(key, *out): what `on_row` and `on_time` give; `stream` has its watermark on the timestamp `ts`. A new key's memory is None.

    With `known`, rows with a null among `values` move the watermark and do nothing else.
    """
    names = [part.split()[0] for part in out.split(", ")]
    kind = dict(stream.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory, newest = json.loads(state.get[0]) if state.exists else (None, None)
        made = []

        def pass_to(t: int) -> None:
            nonlocal memory, newest
            while memory is not None and (at := due(memory)) is not None and at < t:
                memory, given = on_time(memory)
                made.extend(given)
            newest = None if memory is None else newest

        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.dropna(subset=values) if known else rows  # not before: a filter would be pushed below the watermark
            rows = rows.assign(**{"": rows[ts].astype("datetime64[ms]").astype("int64")}).sort_values(["", *values], kind="stable")
            for t, *row in rows[["", *values]].itertuples(index=False, name=None):
                # Spark's own filter of late rows is a trigger behind
                if t <= mark or (newest is not None and t < newest):
                    continue
                pass_to(t)
                memory, given = on_row(memory, t, tuple(row))
                made.extend(given)
                newest = t
        pass_to(mark + 1)
        if memory is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps((memory, newest)),))
            if (at := due(memory)) is not None:
                state.setTimeoutTimestamp(max(at, mark + 1))
        if made:
            yield pd.DataFrame([(k[0], *row) for row in made], columns=[key, *names])

    rows = stream.select(key, ts, *values)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def silence(stream: DataFrame, key: str, ts: str, hold: int, warn: int, forget: int) -> DataFrame:
    """(key, at, state): `hold` and `warn` when no row of a key has come for that many milliseconds, `back` with the next row.

    After `forget` (more than `warn`, which is more than `hold`) a key is forgotten; a row after that begins anew, without `back`.
    """
    steps = [("hold", hold), ("warn", warn), (None, forget)]

    def on_row(memory, t: int, _: tuple):
        return [t, 0], [(_at(t), "back")] if memory is not None and memory[1] else []

    def on_time(memory):
        last, told = memory
        state, after = steps[told]
        return (None, []) if state is None else ([last, told + 1], [(_at(last + after), state)])

    return timed(stream, key, ts, [], "at timestamp_ntz, state string", on_row, lambda m: m[0] + steps[m[1]][1], on_time)


def commanded(stream: DataFrame, key: str, ts: str, action: str, period: int, forget: int) -> DataFrame:
    """(key, at, command, state): each action as `new` at its time, and `held` when none has replaced it for a period.

    An action replaces the one before, it doesn't queue behind it; a null action is none, and doesn't tell that a period
    is over before the watermark does. After `forget` milliseconds without an action a key is forgotten.
    """

    def on_row(memory, t: int, row: tuple):
        return [t, float(row[0]), 0], [(_at(t), float(row[0]), "new")]

    def on_time(memory):
        t, a, told = memory
        return (None, []) if told else ([t, a, 1], [(_at(t + period), a, "held")])

    return timed(stream, key, ts, [action], "at timestamp_ntz, command double, state string", on_row, lambda m: m[0] + (forget if m[2] else period), on_time, known=True)


def limited(stream: DataFrame, key: str, ts: str, every: int) -> DataFrame:
    """(key, at) of the rows that come more than `every` milliseconds after the last one given; that is all that is remembered, and as long."""

    def on_row(memory, t: int, _: tuple):
        return (memory, []) if memory is not None else ([t], [(_at(t),)])

    return timed(stream, key, ts, [], "at timestamp_ntz", on_row, lambda m: m[0] + every, lambda m: (None, []))


def marked(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """`stream` with `ts` as a timestamp, and its watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
