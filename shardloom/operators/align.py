"""Alignment of assays that observe the same rows: exact and partial row maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assay_row(row_map: DataFrame, assay: str, wanted: DataFrame) -> DataFrame:
    """(global_row, assay_row) of the wanted global rows; null where the assay lacks one."""
    return wanted.select("global_row").join(row_map.filter(F.col("assay_id") == assay).select("global_row", "assay_row"), "global_row", "left")


def paired_rows(row_map: DataFrame, left: str, right: str) -> DataFrame:
    """(global_row, left_row, right_row) of the global rows that either assay has."""
    side = lambda a, n: row_map.filter(F.col("assay_id") == a).select("global_row", F.col("assay_row").alias(n))
    return side(left, "left_row").join(side(right, "right_row"), "global_row", "full_outer")


def resolve_rows(row_map: DataFrame, spine: DataFrame, assays: list[str]) -> DataFrame:
    """(global_row, one column per assay in the given order) for every row of the spine; one pass for any number of assays."""
    by = row_map.groupBy("global_row").pivot("assay_id", assays).agg(F.first("assay_row"))
    return spine.select("global_row").join(by, "global_row", "left")


def assay_range(entries: DataFrame, assay: str, start: int, count: int, extent: int | None = None) -> DataFrame:
    """Rows [start, start + count) of one assay's entries (assay_id, row, col, value), renumbered from 0.

    With the assay's extent, a range that leaves it is an error.
    """
    if start < 0 or count < 0 or extent is not None and start + count > extent:
        raise IndexError(f"rows {start} to {start + count} are out of range for {extent} rows")
    t = entries.filter((F.col("assay_id") == assay) & (F.col("row") >= start) & (F.col("row") < start + count) & (F.col("value") != 0))
    return t.select((F.col("row") - start).alias("row"), "col", "value")


def map_is_inverse(row_map: DataFrame, assay: str, rows: int, global_rows: int) -> bool:
    """Whether the assay's rows 0..rows-1 map one to one into the global rows."""
    m = row_map.filter(F.col("assay_id") == assay)
    r = m.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("assay_row").alias("a"), F.countDistinct("global_row").alias("g"), F.min("assay_row").alias("lo"), F.max("assay_row").alias("hi"), F.min("global_row").alias("glo"), F.max("global_row").alias("ghi")).first()
    return r.n == rows == r.a == r.g and (rows == 0 or (r.lo == 0 and r.hi == rows - 1 and r.glo >= 0 and r.ghi < global_rows))


def pairing_report(row_map: DataFrame, global_rows: int) -> DataFrame:
    """(assay_id, rows, exact): exact if the assay has every global row."""
    return row_map.groupBy("assay_id").agg(F.countDistinct("global_row").alias("rows")).withColumn("exact", F.col("rows") == global_rows)


def pairing_is_valid(row_map: DataFrame, global_rows: int, kind: str) -> bool:
    """exact: each assay covers all global rows; partial: any do."""
    if kind not in ("exact", "partial"):
        raise ValueError(f"pairing {kind!r} is neither exact nor partial")
    return kind == "partial" or not pairing_report(row_map, global_rows).filter("not exact").limit(1).count()


def local_window(row_map: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, assay_id, local_begin, local_end, contiguous) for windows (window_id, row_begin, row_end) of global rows.

    A window must map to a run of local rows in order; without rows it is 0 to 0.
    """
    from .access import span_of

    m = span_of(row_map, "global_row", windows, "window_id").filter("window_id is not null")
    by = m.groupBy("window_id", "assay_id").agg(F.min("assay_row").alias("lo"), F.max("assay_row").alias("hi"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("global_row", "assay_row"))).alias("r"))
    rising = F.col("r.assay_row") == F.sort_array("r.assay_row")
    by = by.select("window_id", "assay_id", F.col("lo").alias("local_begin"), (F.col("hi") + 1).alias("local_end"), ((F.col("hi") - F.col("lo") + 1 == F.col("n")) & rising).alias("contiguous"))
    every = windows.select("window_id").withColumn("k", F.lit(1)).join(row_map.select("assay_id").distinct().withColumn("k", F.lit(1)), "k").drop("k")
    return every.join(by, ["window_id", "assay_id"], "left").select("window_id", "assay_id", F.coalesce("local_begin", F.lit(0).cast("bigint")).alias("local_begin"), F.coalesce("local_end", F.lit(0).cast("bigint")).alias("local_end"), F.coalesce("contiguous", F.lit(True)).alias("contiguous"))
