"""Queries against their SQL, and each stage of the pipeline against a brute-force version of it on what that stage was given."""

import os

import duckdb
import pytest
from test_brute import brute_components, brute_lines, brute_shares

import corpus_pipeline
from telemetra.llm import decontaminate, lines, packing, quality
from telemetra.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_stages(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    names = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == names, name
        kept.append((name, before, docs))
    rows = {name: ({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, a, b in kept}

    was, now = rows["quality"]
    model = quality.fit(kept[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(now) == {r.doc_id for r in quality.score(kept[0][1], model).collect() if r.score >= 0.5} and now  # too few labels here to reject any
    was, now = rows["line_dedup"]
    left = {d: t for (d, _), t in brute_lines(list(was.items()), lines.MIN_WORDS).items()}
    assert {d: r.text for d, r in now.items()} == {d: t for d, t in left.items() if t or was[d] == ""}
    assert all(r.n_chars == len(r.text) for r in now.values())
    was, now = rows["near_dedup"]
    assert set(now) == {d for d, c in brute_components(list(was.items()), 5, 80).items() if d == c}
    was, now = rows["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for (d, _), v in brute_shares(list(was.items()), items).items() if v >= decontaminate.SHARE}
    assert set(now) == set(was) - dirty and dirty
    was, _ = rows["packing"]
    pieces = kept[4][2].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(map(tuple, packing.tokenise(kept[4][1]).selectExpr("doc_id", "piece", "start", "length", "crc32(ids)").collect()))
    assert len({r.sequence_id for r in pieces}) == -(-sum(r.length for r in pieces) // packing.CAPACITY)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
