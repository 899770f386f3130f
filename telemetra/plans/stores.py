"""Queries that write a store of files and read it again: padded arrays and tar shards, in the folder that all share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove, shared_dir
from ..sinks import datasets
from ..sources import files
from .registry import register, table


def _place(spark: SparkSession) -> str:
    at = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    return at


@register("select vec_id, label, (vec_id % 65)::bigint as n, round(coalesce(list_sum([x::double for x in embedding[1:vec_id % 65]]), 0), 5) as total from embeddings")
def padded_array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of different lengths written padded, and read at their own length again."""
    at = _place(files.registered(spark))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, (F.col("vec_id") % 65).cast("int")).alias("v"))
    e.write.format("padded_arrays").mode("overwrite").save(at)
    back = spark.read.format("padded_arrays").schema("vec_id long, label int, v array<float>").load(at)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", "label", F.size("v").cast("long").alias("n"), F.round(total, 5).alias("total"))


@register("with p as (select p_partkey, p_name, (row_number() over (order by p_partkey) - 1) // 100 as shard, row_number() over (order by p_partkey) - 1 as k from part) select shard, count(*) as n, md5(string_agg(p_name || '/' || lpad(k::varchar, 10, '0'), ',' order by k)) as said from p group by all")
def tar_shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred samples to a tar file in order, and what is in each."""
    at = _place(files.registered(spark))
    datasets.tar_shards(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"], 100, at, {"name": F.col("p_name"), "key": F.col("p_partkey").cast("string")})
    rows = spark.read.format("tar_shards").load(at).where("name like '%.name'").select("shard", F.substring("name", 1, 10).alias("k"), F.col("data").cast("string").alias("said"))
    told = F.array_sort(F.collect_list(F.struct("k", "said")))  # a hundred to a shard
    out = rows.groupBy("shard").agg(F.count("*").alias("n"), told.alias("t"))
    return out.select("shard", "n", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["said"], F.lit("/"), x["k"])), ",")).alias("said"))
