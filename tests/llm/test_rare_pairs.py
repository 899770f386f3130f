"""Pairs by rarest shingles: other components only, none lost, and nothing from null, empty or no texts."""

from telemetra.llm.minhash import rare_pairs

SCHEMA = "id long, component long, text string"


def test_rare_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [
        (1, 1, " ".join(words)),
        (2, 2, " ".join(words[:-1] + ["x"])),
        (3, 3, None),
        (4, 4, ""),
        (5, 5, " ".join(f"q{i}" for i in range(60))),
        (6, 1, " ".join(words)),
    ]
    found = rare_pairs(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (6, 2)]


def test_rare_pairs_of_no_texts(spark):
    assert rare_pairs(spark.createDataFrame([], SCHEMA), 3, 85).count() == 0
