"""Verdicts of episodes with nulls, without telemetry, and against loops."""

import numpy as np
from pyspark.sql import functions as F

from telemetra.operators import verdicts

BOX = (0.0, 1.0, -1.0, 1.0)
S = verdicts.Settings(controls={"scene": {"gain": 16.0}}, inner=BOX, outer=(-1.0, 2.0, -2.0, 2.0), fixture=BOX, radius=0.1, footprint=(-0.1, 0.1, -0.1, 0.1))
EPISODE = "k string, task string, duration_s double, controls map<string,map<string,double>>, wrist_mean double, tips array<int>, scene_mean double, at array<double>, fixture array<double>, moved struct<dx:double,dy:double,seen_s:double,length_s:double>"
SAMPLE = "k string, t long, joint_pos array<double>, gripper_cmd double, gripper_pos double"
SOUND = ("t", 20.0, {"scene": {"gain": 16.2}}, 120.0, [312, None], 100.0, [0.5, 0.0], [0.5, 0.0], (0.0, 0.0, 9.0, 9.0))


def samples(k, n=3000, still=(), closes=1):
    """A hundred samples a second of an arm that moves but in the given stretches."""
    q, out = 0.0, []
    edges = np.linspace(0, n, 2 * closes + 1)[1:-1] if closes else []
    for i in range(n):
        q += 0.0 if any(a <= i < b for a, b in still) else 0.01
        shut = int(sum(i >= e for e in edges)) % 2
        out.append((k, int(5e9) + i * 10_000_000, [q, None, 0.0, 0.0, 0.0, 0.0], float(1 - shut), 0.5))
    return out


def loop_pauses(rows):
    t = np.array([r[1] for r in rows]) / 1e9 - 5
    q = np.array([r[2][0] for r in rows])
    cmd = np.array([r[3] for r in rows])
    found, start = [], None
    for i in range(10, len(t)):
        still = abs(q[i] - q[i - 10]) / (t[i] - t[i - 10]) < 0.02 and cmd[i] == cmd[i - 1] and 0.5 < t[i] < t[-1] - 0.5
        if still and start is None:
            start = t[i]
        if start is not None and (not still or i == len(t) - 1):
            if t[i] - start > 1.0:
                found.append(f"pause {t[i] - start:.1f} s at {start:.1f} s")
            start = None
    return found


def test_verdicts(spark):
    stretches = [(503, 700), (1000, 1050), (2000, 2408), (2990, 3000)]
    tel = samples("sound") + samples("still", still=stretches) + samples("twice", closes=2)
    rows = [("sound", *SOUND), ("still", *SOUND), ("twice", *SOUND), ("nothing", "t", *[None] * 8), ("silent", *SOUND)]
    df = spark.createDataFrame(rows, EPISODE).withColumn("lane", F.lit(1))
    got = {r.k: r for r in verdicts.checked(df, spark.createDataFrame(tel, SAMPLE), "k", "t", S).collect()}
    assert len(got) == 5 and got["sound"].reasons == [] and got["sound"].closes == 1 and got["sound"].lane == 1
    want = loop_pauses([r for r in tel if r[0] == "still"])
    assert got["still"].reasons == want and len(want) == 2
    assert got["twice"].reasons == ["2 gripper closes (expected 1: grasped again?)"]
    none = "0 gripper closes (expected 1: object not grasped?)"
    assert got["nothing"].reasons == ['scene color_controls None (camera.json {"gain":16.0})', "wrist frame unreadable", "scene frame unreadable", none, "duration 0.0 outside [5.0, 90.0]"]
    assert got["silent"].reasons == [none] and got["silent"].pauses == []


def test_verdicts_of_empty_tables(spark):
    tel = spark.createDataFrame([], SAMPLE)
    assert verdicts.checked(spark.createDataFrame([], EPISODE), tel, "k", "t", S).count() == 0
    many = [(f"e{k}", "t", 10.0 if k else 30.0, *SOUND[2:]) for k in range(6)]
    got = {r.k: r.reasons for r in verdicts.checked(spark.createDataFrame(many, EPISODE), tel, "k", "t", S).collect()}
    assert got["e0"][1:] == ["duration outlier (30.0 s vs median 10.0 s)"] and all(len(got[f"e{k}"]) == 1 for k in range(1, 6))


def test_lint(spark):
    names = "k string, complete boolean, duration_s double, statuses array<string>, cameras array<string>, files array<string>"
    eps = [("bare", None, None, None, None, None), ("sound", True, 20.0, ["success"], ["a"], ["a", "b"]), ("two", False, 3.0, ["success", "Pending"], ["b", "a"], []), ("lag", True, 20.0, ["success"], [], []), ("open", True, 20.0, ["pending (x)"], [], [])]
    tel, shape = [], "k string, arm string, t long, joint_pos array<double>, joint_cmd array<double>, joint_pos_7d array<double>"
    for k, behind, shut in (("sound", 0.02, 50), ("two", 0.02, 50), ("lag", 0.5, 50), ("open", 0.02, 9)):
        for i in range(100):
            cmd = 0.1 if i < shut else 1.0
            t = i * 10_000_000 + (200_000_000 if k == "lag" and i > 50 else 0)
            tel.append((k, "l", t, [i / 100.0] + [0.0] * 5, [0.0] * 6 + [cmd], [0.0] * 6 + [cmd + behind]))
            tel.append((k, "r", t, [0.0] * 6, None, None))
    got = {r.k: r.warnings for r in verdicts.linted(spark.createDataFrame(eps, names), spark.createDataFrame(tel, shape), "k", "t", {"new": 0.0189, "old": 0.076}).collect()}
    idle = "r: the arm barely moved (max joint range < 0.05 rad)"
    assert got["bare"] == ["no telemetry at all"] and got["sound"] == [idle]
    assert got["two"] == ["complete=False: this recording was cut short", "only 3.0 s long", "no verdict recorded (pending)", "duplicate rows of this path", "camera 'a' has no file", "camera 'b' has no file", idle]
    assert got["lag"] == ["210 ms gap in robot telemetry", "l: gripper lag p99 +0.5000 matches no known clamp ceiling", idle]
    assert got["open"] == ["no verdict recorded (pending)", "l: gripper never commanded closed, so nothing was grasped", idle]
    assert verdicts.linted(spark.createDataFrame([], names), spark.createDataFrame([], shape), "k", "t", {"new": 0.0189}).count() == 0
