"""Spans of matches against Python's own, for texts of none, few and very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from telemetra.llm import secrets


def test_spans_against_re(spark):
    rng = random.Random(3)
    pattern = "[0-9a-f]{4,}"
    texts = ["", "zz", "abcd", "zzabcdzz", "é abcd 漢字 0123 zz", "abcd" * 50]
    for n in (1, 63, 64, 65, 127, 128, 129, 1000, 5000):
        texts.append("".join(rng.choice(["xyz ", "é", "\n"]) + "".join(rng.choices("0123456789abcdef", k=rng.randint(4, 9))) + " " for _ in range(n)))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", secrets.spans(F.col("text"), pattern).alias("s"))
    got = {r.k: [tuple(x) for x in r.s] for r in df.collect()}
    assert got == {k: [(*m.span(), m.group()) for m in re.finditer(pattern, t)] for k, t in enumerate(texts)}


def test_many_runs_in_one_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", k=20)) for _ in range(20_000))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    began = time.time()
    (r,) = df.select(secrets.spans(df.text, secrets.KEY_LIKE).alias("s")).collect()
    assert [x.start for x in r.s] == list(range(0, 21 * 20_000, 21)) and time.time() - began < 60
