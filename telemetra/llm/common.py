"""What several operators need: tables, shared scratch tables, hold-out split, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and Python, of which each task holds several outside the heap; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
#: Bytes of an Arrow batch that a Python worker turns into Python objects at a time; only a longer single row exceeds it.
PART_BYTES = 2_000_000
#: Characters of each passage that a text over the level gives to a sample.
PASSAGE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, read by Spark so that any supported store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master without it gets a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="telemetra-")
        sc.setCheckpointDir(found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH_BYTES for this session, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts lineage and outlives lost executors.

    The table is removed when the driver ends, because lazy results may still read it until then.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PART_BYTES, so that a worker's memory doesn't grow with Arrow's batches."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        step, at = max(1, n * PART_BYTES // max(batch.nbytes, 1)), 0
        while at < n:
            part = batch.slice(at, step)
            while len(part) > 1 and part.nbytes > 2 * PART_BYTES:
                part = part.slice(0, len(part) // 2)
            at += len(part)
            yield part


def level(lengths: list[int], total: int) -> int:
    """The highest level at which lengths, each cut to it, keep to `total`: the longest one where all of them do."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, total_chars: int) -> list[tuple[int, int, str]]:
    """(doc_id, label, text) of training rows: at most `per_class` of each class, in order of a hash of the id, whatever their length.

    Rows of hold-out fold 1 and rows without that label are never taken; null texts count as empty. Ids are chosen
    first, from ids and lengths alone, and the few chosen ones are broadcast, so no text crosses a shuffle. Texts come
    whole as long as all together have at most `total_chars` characters; otherwise those over a common level give
    passages from all over.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "n": F.length("text")})
    rows = labels.where(F.col(column).isin(0, 1) & (fold(F.col("doc_id")) != 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    rows = rows.join(texts.drop("text"), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    taken = [tuple(r) for label in (0, 1) for r in rows.where(F.col("label") == label).select("doc_id", "h", "label", "n").orderBy(*order).limit(per_class).collect()]
    if not taken:
        return []
    top = max(level([r[3] for r in taken], total_chars), PASSAGE)
    many = top // PASSAGE
    spread = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.substring("text", (k * (F.col("n") - PASSAGE) / max(many - 1, 1)).cast("int") + 1, F.lit(PASSAGE))))
    keys = docs.sparkSession.createDataFrame([*{r[:2] for r in taken}], texts.select("doc_id", "h").schema)  # 2 * per_class rows at most
    found = texts.join(F.broadcast(keys), ["doc_id", "h"]).select("doc_id", "h", F.when(F.col("n") <= top, F.col("text")).otherwise(spread).alias("text"))
    said = {(r.doc_id, r.h): r.text for r in found.dropDuplicates(["doc_id", "h"]).collect()}
    return [(d, label, said[d, h]) for d, h, label, _ in taken]


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b), for ids that have an edge.

    Alternates the large-star and small-star steps, which need a number of rounds logarithmic in the number of
    nodes; each round is a few joins on ids, is written to the shared folder, and only its count and hash come
    to the driver. Null ends and self-loops are ignored, repeated edges count once.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
