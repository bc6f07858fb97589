"""Reads and filters: points, rows, ranges, features, derived subsets, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import nonzero
from ..scratch import dense_index

#: A metadata table of spans is broadcast up to so many rows.
BROADCAST_SPANS = 100_000
#: A request for so many rows at most is a list in the filter.
FEW_ROWS = 1000


def point(entries: DataFrame, row: int, col: int) -> DataFrame:
    """The entries at (row, col); none if nothing is stored there. The filter reaches the scan."""
    return nonzero(entries.filter((F.col("row") == row) & (F.col("col") == col)))


def csr(entries: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """(row, cols array<bigint>, vals array<double>), columns ascending; with a spine, rows without entries too."""
    by = nonzero(entries).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("e"))
    if spine is not None:
        by = spine.select("row").join(by, "row", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<col:bigint,value:double>>")))
    return by.select("row", F.col("e.col").alias("cols"), F.col("e.value").alias("vals"))


def indptr(rows: DataFrame, lengths: str = "cols") -> DataFrame:
    """csr() rows with row_begin and row_end, offsets into the concatenated arrays in row order."""
    from pyspark.sql import Window as W

    from ..scratch import written

    local = written(rows.select("row", F.size(lengths).cast("bigint").alias("n")).repartitionByRange("row").sortWithinPartitions("row").withColumn("_p", F.spark_partition_id()), "row-lengths")
    before = local.groupBy("_p").agg(F.sum("n").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ends = local.withColumn("row_end", F.sum("n").over(W.partitionBy("_p").orderBy("row"))).join(F.broadcast(before), "_p")
    return ends.select("row", (F.col("_before") + F.col("row_end") - F.col("n")).alias("row_begin"), (F.col("_before") + F.col("row_end")).alias("row_end"))


def request(spark: SparkSession, rows: list[int], extent: int) -> DataFrame:
    """(ord, row) of a list of rows, order and repeats kept; a row outside the extent fails the whole request."""
    if bad := [r for r in rows if not 0 <= r < extent]:
        raise IndexError(f"row {bad[0]} is out of range for {extent} rows")
    return spark.createDataFrame([*enumerate(rows)], "ord bigint, row bigint")


def gather(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ord, row, col, value) for a request; a row without entries has one line with nulls.

    A request for few rows is a filter that reaches the scan, below any sums that make the entries.
    """
    few = [r.row for r in wanted.select("row").distinct().limit(FEW_ROWS + 1).collect()]
    found = nonzero(entries.filter(F.col("row").isin(few)) if len(few) <= FEW_ROWS else entries)
    return wanted.select("ord", "row").join(found, "row", "left").select("ord", "row", "col", "value")


def read_range(entries: DataFrame, start: int, count: int, extent: int) -> DataFrame:
    """The rows [start, start + count), renumbered from 0."""
    if start < 0 or count < 0 or start + count > extent:
        raise IndexError(f"rows {start} to {start + count} are out of range for {extent} rows")
    return nonzero(entries.filter((F.col("row") >= start) & (F.col("row") < start + count))).withColumn("row", F.col("row") - start)


def head(table: DataFrame, key: str, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n must not be negative")
    return table.orderBy(key).limit(n)


def check_selection(values: list[int], extent: int, what: str) -> None:
    """A selection must not be empty, repeat itself or leave the extent."""
    if not values:
        raise ValueError(f"no {what} selected")
    if len({*values}) != len(values):
        raise ValueError(f"a {what} is selected twice")
    if bad := [v for v in values if not 0 <= v < extent]:
        raise IndexError(f"{what} {bad[0]} is out of range for {extent}")


def select_features(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """Entries of the selected columns, renumbered: selection has col and new_col."""
    return nonzero(entries).join(selection, "col").select("row", F.col("new_col").alias("col"), "value")


def select_rows(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """Entries of the selected rows, renumbered: selection has row and new_row."""
    return nonzero(entries).join(selection, "row").select(F.col("new_row").alias("row"), "col", "value")


def derived(entries: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """A derived matrix: rows (row, new_row) and features (col, new_col) in a new order."""
    return select_rows(select_features(entries, features), rows)


def annotate(table: DataFrame, key: str, selection: DataFrame, spans: list[tuple[int, int, str]], label: str) -> DataFrame:
    """The selected rows of an annotation table in their new order, with the group label of the spans over new numbers."""
    new = f"new_{key}"
    out = table.join(selection, key).withColumn(label, group_label(F.col(new), spans))
    return out.drop(key).withColumnRenamed(new, key)


def group_label(index, spans: list[tuple[int, int, str]]):
    """The name of the span [begin, end) that holds index, or "". Spans ascend and do not overlap."""
    last = None
    for begin, end, _ in spans:
        if begin >= end or (last is not None and begin < last):
            raise ValueError(f"span {begin} to {end} is empty or overlaps the one before")
        last = end
    out = F.lit("")
    for begin, end, name in reversed(spans):
        out = F.when((index >= begin) & (index < end), F.lit(name)).otherwise(out)
    return out


def keep_masked(entries: DataFrame, rows: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """Entries whose row and feature are kept; no table keeps all. Tables: row or col, and keep (boolean)."""
    t = nonzero(entries)
    for table, key in ((rows, "row"), (features, "col")):
        if table is not None:
            t = t.join(table.filter("keep").select(key), key, "left_semi")
    return t


def remap(entries: DataFrame, rows: DataFrame | None = None, features: DataFrame | None = None, out_rows: int | None = None, out_cols: int | None = None) -> DataFrame:
    """Entries under new numbers; no table leaves them as they are. What falls beyond the output's bounds, or has no new number, is dropped."""
    t = nonzero(entries)
    for table, key, bound in ((rows, "row", out_rows), (features, "col", out_cols)):
        if table is not None:
            t = t.join(table.select(key, F.col(f"new_{key}").alias("_new")), key).withColumn(key, F.col("_new")).drop("_new")
        if bound is not None:
            t = t.filter((F.col(key) >= 0) & (F.col(key) < bound))
    return t.select("row", "col", "value")


def rebuild_stats(before: DataFrame, after: DataFrame, kept_rows: int, kept_features: int, value_bytes: int = 2) -> DataFrame:
    """One row: kept_rows, kept_features, live_nnz, bytes_before, bytes_after (row offsets and entries of a CSR), live_fill."""
    n = nonzero(before).agg(F.count(F.lit(1)).alias("before_nnz"), F.coalesce(F.max("row") + 1, F.lit(0)).alias("before_rows"))
    m = nonzero(after).agg(F.count(F.lit(1)).alias("live_nnz"))
    size = lambda rows, nnz: ((rows + 1) * 4 + nnz * (4 + value_bytes)).cast("bigint")
    # Two rows of one: the product is one row.
    both = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k")
    return both.select(F.lit(kept_rows).cast("bigint").alias("kept_rows"), F.lit(kept_features).cast("bigint").alias("kept_features"), "live_nnz", size(F.col("before_rows"), F.col("before_nnz")).alias("bytes_before"), size(F.lit(kept_rows), F.col("live_nnz")).alias("bytes_after"), F.when(F.col("before_nnz") > 0, F.col("live_nnz") / F.col("before_nnz")).otherwise(0.0).alias("live_fill"))


def compact(table: DataFrame, key: str, keep: str = "keep") -> DataFrame:
    """(key, new_key): the kept rows numbered densely in their old order."""
    return dense_index(table.filter(F.col(keep)).select(key), [key], f"new_{key}")


def finalize(entries: DataFrame, obs: DataFrame, var: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, obs, var) after the keep masks of obs and var: dense new numbers in the old order, kept flags all true."""
    rows, features = compact(obs, "row"), compact(var, "col")
    renumber = lambda t, m, k: t.join(m, k).drop(k).withColumnRenamed(f"new_{k}", k).withColumn("keep", F.lit(True))
    return derived(entries, rows, features), renumber(obs, rows, "row"), renumber(var, features, "col")


def source_totals(entries: DataFrame, obs: DataFrame, source: str) -> DataFrame:
    """By source: its rows and non-zero entries."""
    by = nonzero(entries).groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))
    return obs.select("row", source).join(by, "row", "left").groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("nnz"), F.lit(0).cast("bigint")).alias("nnz"))


def span_of(df: DataFrame, value: str, spans: DataFrame, id: str) -> DataFrame:
    """df with the id of the span [row_begin, row_end) that its value lies in, or null.

    Spans are metadata, one row per partition or shard. They meet their values in buckets of the spans'
    mean width, so that no pair outside a bucket is formed; few of them are broadcast.
    """
    few, width = spans.agg(F.count(F.lit(1)), F.avg(F.col("row_end") - F.col("row_begin"))).first()
    s = spans.select(F.col(id), F.col("row_begin").alias("_b"), F.col("row_end").alias("_e")).filter("_b < _e")
    width = max(1, int(width or 1))
    bucket = s.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_b") / width), F.floor((F.col("_e") - 1) / width))))
    bucket = F.broadcast(bucket) if few <= BROADCAST_SPANS else bucket
    keyed = df.withColumn("_k", F.floor(F.col(value) / width))
    return keyed.join(bucket, (keyed["_k"] == bucket["_k"]) & (F.col(value) >= F.col("_b")) & (F.col(value) < F.col("_e")), "left").select(*[keyed[c] for c in df.columns], id)
