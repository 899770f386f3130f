"""A training corpus from `documents`, in stages that each write Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import decontaminate, lines, minhash, packing, quality
from telemetra.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on what this stage is given, doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents of which nothing is left go."""
    out = lines.deduplicated(docs).where("n_removed = 0 or n_removed < n_lines")
    return out.drop("n_lines", "n_removed").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in training sequences."""
    return packing.digest(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeats),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Compression and the tokenizer can't be told in SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's table is removed when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
