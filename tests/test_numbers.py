"""Rounding and percentiles to the last place, against Python's own and DuckDB's."""

import random

import duckdb
from pyspark.sql import functions as F

from telemetra.functions import numbers
from telemetra.operators import quality, summaries


def test_rounded_is_printf(spark):
    rng = random.Random(4)
    xs = [1.0005, 2.675, 0.125, 0.375, -0.00001, 0.0, 1e18, 0.15, 0.25, 1.28925, 1.13655, -2.5, 1e-30, *[rng.randrange(10**6) / 1e5 for _ in range(3000)], *[-rng.random() * 1e3 for _ in range(500)]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    for r in df.select("x", *[F.format_string(f"%+.{p}f", numbers.rounded(x, p)).alias(f"p{p}") for p in (0, 1, 2, 3, 4)]).collect():
        assert [r[f"p{p}"] for p in (0, 1, 2, 3, 4)] == [f"{r.x:+.{p}f}" for p in (0, 1, 2, 3, 4)]
    odd = df.limit(1).select(*[numbers.rounded(F.lit(v).cast("double"), 2).alias(n) for n, v in (("nan", "nan"), ("inf", "-inf"), ("none", None))]).first()
    assert odd.nan != odd.nan and odd.inf == float("-inf") and odd.none is None
    told = df.where("x = 2.675").select(quality.range_reason("duration", x + 9.975, 20.0, 30.0)[1].alias("t")).first().t
    assert told == f"duration {2.675 + 9.975:.1f} outside [20.0, 30.0]"


def test_percentiles_are_those_of_duckdb_to_the_last_place(spark):
    rng = random.Random(5)
    rows = [(g, round(rng.random() * 100, 2) / 100 + 0.5 - 0.5) for g in range(300) for _ in range(2 + g % 40)]
    got = {(r.g, r.percent): r.v for r in summaries.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", (99.0, 5.0, 50.0)).collect()}
    con = duckdb.connect()
    con.execute("create table r (g int, v double)")
    con.executemany("insert into r values (?, ?)", rows)
    want = {(g, p): v for p in (99.0, 5.0, 50.0) for g, v in con.execute(f"select g, quantile_cont(v, {p / 100}) from r group by g").fetchall()}
    assert got == want
    ends = summaries.percentiles(spark.createDataFrame([(float("inf"),), (float("inf"),), (1e305,), (1.1e305,)], "v double").withColumn("g", F.lit(0)), ["g"], "v", (90.0, 20.0)).collect()
    assert sorted(r.v for r in ends)[1] == float("inf") and abs(sorted(r.v for r in ends)[0] / 1.06e305 - 1) < 1e-12
