"""Tables in the shared folder, and dense numbering that no single task has to do."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class scope:  # noqa: N801
    """with scope(spark): tables written inside, by this thread or task, are deleted at its end, when no result that reads them is needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.paths: list[str] = []
        self.token = _SCOPE.set(self.paths)

    def __exit__(self, *_):
        _SCOPE.reset(self.token)
        for path in self.paths:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, True)


#: Where the innermost scope lists its tables; each thread has its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one of our own only where none is set and all runs on this machine (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/shardloom/{name}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation.

    Shuffle files of the job go with it: nothing reads them again.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, by: list, name: str, start: int = 0) -> DataFrame:
    """df with `name` (bigint): its rows numbered in the order of `by`, from start, without gaps.

    Rows are sorted by range, numbered in their task and shifted by the sizes of the tasks before, of
    which there are as many as tasks; no window runs over the whole table. Ties are broken arbitrarily.
    """
    local = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    local = local.withColumn("_p", F.shiftright("_m", 33))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row per task: a bounded side.
    out = local.join(F.broadcast(sizes), "_p")
    return out.select(*df.columns, (F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + start).cast("bigint").alias(name))
