"""Helpers that every operator may use: tables, the shared scratch folder, size-checked values."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session sets none and runs on one machine a temporary folder is made and set; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-strandline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path inside the shared folder; ``clear`` deletes it."""
    path = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: scratch paths of each Spark application of this process
_made: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Delete all that this session has put into the shared folder, and say how many paths there were. Results that are still read from them must be written before."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the Hadoop file system it lives on."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit`` of them, else None: the check before a broadcast."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, before work that takes far longer than moving the rows (adaptive execution joins small partitions, by bytes)."""
    spark = df.sparkSession
    return df.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a Spark application; where it is installed there, nothing changes."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-strandline-"), "strandline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)
