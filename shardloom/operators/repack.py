"""Filters, bucketing and layouts composed: filtered views, repacked shards, and the choice between orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..matrix import nonzero
from . import access, layout, ordering


def filter_stats(entries: DataFrame, rows: int, cols: int, block: int, keep_rows: DataFrame | None = None, keep_cols: DataFrame | None = None, value_bytes: int = 2) -> DataFrame:
    """One row: what masks leave of a blocked ELL's slots.

    slots (values that its blocks hold, padding included), kept_row_slots (those in kept rows), live (kept
    non-zero entries), dead_slots, live_fill_ratio and dead_value_bytes. Masks as in keep_masked().
    """
    t = nonzero(entries)
    per = t.select(F.floor(F.col("row") / block).alias("rb"), F.floor(F.col("col") / block).alias("cb")).distinct().groupBy("rb").agg(F.count(F.lit(1)).alias("n"))
    width = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("width")).withColumn("k", F.lit(1))
    live = access.keep_masked(t, keep_rows, keep_cols).agg(F.count(F.lit(1)).alias("live")).withColumn("k", F.lit(1))
    kept = (keep_rows.agg(F.count_if("keep").alias("kept")) if keep_rows is not None else entries.sparkSession.range(1).select(F.lit(rows).cast("bigint").alias("kept"))).withColumn("k", F.lit(1))
    # Three tables of one row each, joined by a constant.
    one = width.join(live, "k").join(kept, "k")
    of = lambda n: n * F.col("width") * block
    out = one.select(of(F.lit(rows)).alias("slots"), of(F.col("kept")).alias("kept_row_slots"), "live")
    return out.withColumn("dead_slots", F.col("slots") - F.col("live")).withColumn("live_fill_ratio", F.when(F.col("slots") > 0, F.col("live") / F.col("slots")).otherwise(0.0)).withColumn("dead_value_bytes", F.col("dead_slots") * value_bytes)


def fill_ratio(nnz: int, rows: int, ell_cols: int) -> float:
    return nnz / (rows * ell_cols) if rows and ell_cols else 0.0


def bucketed_view(entries: DataFrame, spine: DataFrame, rows: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(CSR rows with exec_row and bucket, order (row, exec_row)): rows sorted by nnz, in buckets of equal counts."""
    order = ordering.nnz_buckets(entries, spine, buckets, rows)
    view = access.csr(entries, spine).join(order.select("row", F.col("rank").alias("exec_row"), "bucket"), "row")
    return view.select("bucket", "exec_row", "row", "cols", "vals"), order.select("row", F.col("rank").alias("exec_row"))


def repack(entries: DataFrame, obs: DataFrame, var: DataFrame, buckets: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(blocked ELL, order): kept rows and features renumbered, rows put in bucket order, blocks rebuilt.

    obs and var have row or col, and keep. The rebuilt rows follow the bucket order: order (row, exec_row)
    leads back to the old numbers.
    """
    t, o, _ = access.finalize(entries, obs, var)
    n = o.count()
    _, order = bucketed_view(t, o, n, buckets)
    moved = ordering.apply_order(t, order.select(F.col("row").alias("old"), F.col("exec_row").alias("new")))
    back = access.compact(obs, "row").join(order.withColumnRenamed("row", "new_row"), "new_row").select("row", "exec_row")
    return layout.blocked_ell(moved, block), back


def shard_buckets_view(entries: DataFrame, shards: DataFrame, buckets: int) -> DataFrame:
    """Rows of each shard in the order of their nnz: shard_id, bucket, exec_row (within the shard), row, cols, vals."""
    order = ordering.shard_nnz_buckets(entries, shards, buckets)
    return access.csr(entries, shards).join(order, "row").select("shard_id", "bucket", F.col("rank").alias("exec_row"), "row", "cols", "vals")


def width_segments(blocks: DataFrame, row_blocks: int, segments: int) -> DataFrame:
    """(row_block, width, pos, segment): row blocks by width in segments [i n / k, (i + 1) n / k); one segment if all are of one width.

    The last row block, which may be short, stays last. Row blocks without blocks have width 0.
    """
    from ..scratch import dense_index

    spark = blocks.sparkSession
    by = blocks.groupBy("row_block").agg(F.count(F.lit(1)).alias("width"))
    every = spark.range(row_blocks).withColumnRenamed("id", "row_block").join(by, "row_block", "left").fillna(0, ["width"]).withColumn("_last", F.col("row_block") == row_blocks - 1)
    k = 1 if every.select("width").distinct().limit(2).count() < 2 else max(1, min(segments, row_blocks))
    ranked = dense_index(every, ["_last", "width", "row_block"], "pos")
    return ranked.select("row_block", "width", "pos", F.floor(((F.col("pos") + 1) * k - 1) / F.lit(max(1, row_blocks))).alias("segment"))


def bucketed_bytes(segments: DataFrame, block: int, value_bytes: int = 2) -> int:
    """Bytes of a blocked ELL whose segments each have their own width."""
    got = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).collect()  # a few segments
    return sum(r.n * r.w * 4 + r.n * block * r.w * block * value_bytes for r in got)


def choose_order(entries: DataFrame, rows: DataFrame, cols: DataFrame, n_rows: int, block: int, segments: int = 4) -> tuple[str, dict[str, tuple[int, int]]]:
    """("barycenter" or "signature", their bytes (padded, bucketed)): the former if it is smaller, or equal and smaller in buckets."""
    row_pos, col_pos = ordering.barycenter_orders(entries, rows, cols)
    as_order = lambda t, k: t.select(F.col(k).alias("old"), F.col("pos").alias("new"))
    moved = {
        "barycenter": ordering.apply_order(entries, as_order(row_pos, "row"), as_order(col_pos, "col")),
        "signature": ordering.apply_order(entries, cols=as_order(ordering.signature_order(entries, cols, block), "col")),
    }
    size = {}
    for name, t in moved.items():
        padded = layout.tune_blocked_ell(t, n_rows, (block,)).first().padded_bytes
        size[name] = padded, bucketed_bytes(width_segments(layout.blocked_ell(t, block), -(-n_rows // block), segments), block)
    return ("barycenter" if size["barycenter"] < size["signature"] else "signature"), size


def sampled_rows(entries: DataFrame, obs: DataFrame, group: str, per_group: int) -> DataFrame:
    """Entries of the first `per_group` rows of each group by a hash of their number: a sample that is the same each time."""
    w = W.partitionBy(group).orderBy(F.xxhash64("row"), "row")
    picked = obs.select("row", group).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_group)
    return nonzero(entries).join(picked.select("row", group), "row").select(group, "row", "col", "value")
