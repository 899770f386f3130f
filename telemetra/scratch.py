"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master without it gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="telemetra-")
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark knows, unless Spark has ended."""
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table, read again: cuts lineage and outlives lost executors. It is removed when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Removes a written table before the driver ends."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)
