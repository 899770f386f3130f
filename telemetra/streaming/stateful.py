"""Operators that remember something of each key: ring buffers, latest values, changes and rate limits.

Each is a small step over a key's new rows, in order of time, and what it remembers. Within a trigger a key's rows
are taken together, so a trigger's size bounds them; between triggers only the step's own memory stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[object, pd.DataFrame], tuple[object, list[tuple]]]


def remembered(stream: DataFrame, key: str, t: str, out: str, start, step: Step) -> DataFrame:
    """(key, *out): what `step` gives of each key's rows and memory; `start` is the memory of a new key."""
    names = [part.split()[0] for part in out.split(", ")]
    kind = dict(stream.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else json.loads(json.dumps(start))
        memory, made = step(memory, pd.concat(list(frames)).sort_values(t, kind="stable"))
        state.update((json.dumps(memory),))
        yield pd.DataFrame([(k[0], *row) for row in made], columns=[key, *names])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", "memory string", "append", "NoTimeout")


def interpolated(stream: DataFrame, key: str, t: str, value: str, frame: str, keep: int = 64) -> DataFrame:
    """(key, t, value) for rows where `frame` holds: the value of the other rows at that time, linear between neighbours.

    The last `keep` samples are remembered. A frame waits for a sample at or after it; one before all samples kept gets the first.
    """

    def step(memory, rows):
        samples, waiting, made = memory[0], memory[1], []
        for is_frame, at, v in zip(rows[frame], rows[t], rows[value]):
            if is_frame:
                waiting.append(int(at))
                continue
            samples = [*samples[-keep + 1 :], [int(at), float(v)]]
            for f in [f for f in waiting if f <= at]:
                before = [s for s in samples if s[0] <= f]
                after = [s for s in samples if s[0] >= f]
                if not before:
                    made.append((f, samples[0][1]))
                else:
                    (t0, v0), (t1, v1) = before[-1], after[0]
                    made.append((f, v0 if t1 == t0 else v0 + (f - t0) / (t1 - t0) * (v1 - v0)))
            waiting = [f for f in waiting if f > at]
        return [samples, waiting], made

    return remembered(stream, key, t, f"{t} long, {value} double", [[], []], step)


def offsets(stream: DataFrame, key: str, t: str, camera: str, reference: str) -> DataFrame:
    """(key, camera, offset): once for each camera, how far its first frame is before the reference camera's first."""

    def step(memory, rows):
        first, told, made = memory["first"], memory["told"], []
        for c, at in zip(rows[camera], rows[t]):
            first.setdefault(c, int(at))
        if reference in first:
            for c in first:
                if c not in told:
                    made.append((c, first[reference] - first[c]))
                    told.append(c)
        return {"first": first, "told": told}, made

    return remembered(stream, key, t, f"{camera} string, offset long", {"first": {}, "told": []}, step)


def assembled(stream: DataFrame, key: str, t: str, source: str, value: str, reference: str) -> DataFrame:
    """(key, t, latest): at each row of the reference source the latest value of every source, as JSON."""

    def step(memory, rows):
        made = []
        for s, at, v in zip(rows[source], rows[t], rows[value]):
            memory[s] = None if pd.isna(v) else float(v)
            if s == reference:
                made.append((int(at), json.dumps(memory, sort_keys=True)))
        return memory, made

    return remembered(stream, key, t, f"{t} long, latest string", {}, step)


def held(stream: DataFrame, key: str, t: str, action: str, period: int) -> DataFrame:
    """(key, t, command, state) for rows without action: the latest action, new at its first use, then on for one period, then held."""

    def step(memory, rows):
        made = []
        for at, a in zip(rows[t], rows[action]):
            if not pd.isna(a):
                memory = {"at": int(at), "a": float(a), "used": False}
            elif memory:
                state = "new" if not memory["used"] else "on" if at - memory["at"] <= period else "held"
                memory["used"] = True
                made.append((int(at), memory["a"], state))
        return memory, made

    return remembered(stream, key, t, f"{t} long, command double, state string", None, step)


def stale(stream: DataFrame, key: str, t: str, hold: int, warn: int) -> DataFrame:
    """(key, t, gap, state): each gap between rows that is longer than `hold`, and whether it is longer than `warn`."""

    def step(memory, rows):
        made = []
        for at in rows[t]:
            if memory is not None and at - memory > hold:
                made.append((int(at), int(at - memory), "warn" if at - memory > warn else "hold"))
            memory = int(at)
        return memory, made

    return remembered(stream, key, t, f"{t} long, gap long, state string", None, step)


def turned(stream: DataFrame, key: str, t: str, name: str, done: str) -> DataFrame:
    """(key, t, event): when something becomes done that was seen undone before, `done: <name>`."""

    def step(memory, rows):
        made = []
        for n, at, d in zip(rows[name], rows[t], rows[done]):
            if bool(d) and memory.get(n) is False:
                made.append((int(at), f"done: {n}"))
            memory[n] = bool(d)
        return memory, made

    return remembered(stream, key, t, f"{t} long, event string", {}, step)


def limited(stream: DataFrame, key: str, t: str, every: int) -> DataFrame:
    """(key, t) of the rows that come more than `every` after the last one given."""

    def step(memory, rows):
        made = []
        for at in rows[t]:
            if memory is None or at - memory > every:
                made.append((int(at),))
                memory = int(at)
        return memory, made

    return remembered(stream, key, t, f"{t} long", None, step)
