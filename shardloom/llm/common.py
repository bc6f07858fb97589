"""Helpers that the operators share: input, scratch tables, Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, written

__all__ = ["ascii_lower", "numbered_columns", "scratch_path", "small_batches", "table", "without", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Arrow batches of at most that many rows, and bytes, but for a single row that has more: a batch must fit in a Python worker.

    The session keeps the settings, as its plans read them when they run; lower ones stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key, str((1 << 31) - 1)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ascii_lower(col):
    """Lower-cases A-Z only; where every character is ASCII, lower() does the same and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


#: Rows up to which a side of narrow keys is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def without(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not among the dropped ones, which must be a written table of narrow keys."""
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    on = [rows[k].eqNullSafe(dropped[k]) for k in keys]
    return rows.join(F.broadcast(dropped) if few else dropped.hint("shuffle_hash"), on, "left_anti")


def numbered_columns(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ..., so that names of ours clash with none; and the new names of those given."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{i}" for i in at]
