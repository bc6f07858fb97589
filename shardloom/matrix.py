"""The data model: a matrix is a DataFrame of entries (row, col, value), with row and feature tables beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features belong to at most so many groups: a group is a bit of an int mask.
MAX_GROUPS = 32
#: Value type codes of a codec table.
VALUE_CODES = {"u32": 1, "i32": 2, "f16": 3, "f32": 4, "f64": 5, "bf16": 6, "fp8_e4m3": 7, "fp8_e5m2": 8}
#: Rows and entries of one partition fit an unsigned 32-bit number.
LOCAL_LIMIT = (1 << 32) - 1


@dataclass(frozen=True)
class SparseMatrix:
    """entries (row, col bigint, value); rows x cols; obs by row, var by col; partitions and shards as offset lists."""

    entries: DataFrame
    rows: int
    cols: int
    obs: DataFrame | None = None
    var: DataFrame | None = None
    partitions: tuple[int, ...] = ()
    shards: tuple[int, ...] = ()

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    def nnz(self) -> int:
        return nonzero(self.entries).count()


def nonzero(entries: DataFrame) -> DataFrame:
    """A stored zero is no entry: every read and every reduction drops it."""
    return entries.filter(F.col("value") != 0)


def triplets(df: DataFrame, row: str | Column, col: str | Column, value: str | Column, duplicates: str = "sum", ordinal: str | Column | None = None, short_rows: bool = False) -> DataFrame:
    """Entries of any table. Repeated (row, col): "sum" them, "keep" them, or take the "last" by ordinal.

    Null values count as absent. By default entries are dealt out by (row, col), after partial sums, so
    that a row with a large share of them is no task's alone. Where rows are known to be short,
    short_rows deals them out by row; later sums by row then need no further shuffle.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    out = df.select(c(row).cast("bigint").alias("row"), c(col).cast("bigint").alias("col"), c(value).cast("double").alias("value"), *([c(ordinal).alias("_ord")] if ordinal is not None else [])).filter("value is not null")
    if duplicates == "keep":
        return nonzero(out.select("row", "col", "value"))
    keyed = (out.repartition("row") if short_rows else out).groupBy("row", "col")
    if duplicates == "last":
        return nonzero(keyed.agg(F.max_by("value", "_ord").alias("value")))
    if duplicates != "sum":
        raise ValueError(f"duplicates must be sum, keep or last, not {duplicates!r}")
    return nonzero(keyed.agg(F.sum("value").alias("value")))


def dense_entries(df: DataFrame, row: str, values: str) -> DataFrame:
    """Entries of a table with one array of values per row."""
    return nonzero(df.select(F.col(row).cast("bigint").alias("row"), F.posexplode(values).alias("col", "value")).select("row", F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")))
