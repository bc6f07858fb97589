"""Aggregations: masked and grouped reductions by row, statistics by feature, roll-ups of metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import MAX_GROUPS, nonzero


@dataclass(frozen=True)
class GroupFilter:
    """Quality control of a row: least total, least detected features, largest share of one feature group."""

    min_total: float = 0.0
    min_detected: int = 0
    max_fraction: float = 1.0
    group: int = 0

    def keep(self, groups: int):
        fraction = F.when(F.col("total") > 0, F.col(f"g{self.group}") / F.col("total")).otherwise(0.0) if self.group < groups else F.lit(0.0)
        return (F.col("total") >= self.min_total) & (F.col("detected") >= self.min_detected) & (fraction <= self.max_fraction)


def group_reduce(entries: DataFrame, spine: DataFrame, features: DataFrame | None = None, groups: int = 0, rows: GroupFilter = GroupFilter()) -> DataFrame:
    """By row: row, total, detected, max_value, g0.., pct0.., keep (int); a row of zeros for rows without entries.

    spine: row, and optionally row_keep (boolean); a masked row has zeros and keep 0. features: col, and
    optionally feature_keep (boolean) and group_mask (int, bit g for group g; groups may overlap); features
    that it lacks count as kept, in no group. max_value is at least 0; pct is 100 times a group's share of
    the total, 0 where the total is not positive.
    """
    if not 0 <= groups <= MAX_GROUPS:
        raise ValueError(f"{groups} feature groups; there are at most {MAX_GROUPS}")
    t = nonzero(entries)
    masked = "row_keep" in spine.columns
    if features is not None:
        t = t.join(features, "col", "left")
        if "feature_keep" in features.columns:
            t = t.filter(F.coalesce("feature_keep", F.lit(True)))
    if features is None or "group_mask" not in features.columns:
        t = t.withColumn("group_mask", F.lit(0))
    v, mask = F.col("value"), F.coalesce(F.col("group_mask"), F.lit(0))
    sums = [F.sum(F.when(F.getbit(mask, F.lit(g)) == 1, v).otherwise(0.0)).alias(f"g{g}") for g in range(groups)]
    by = t.groupBy("row").agg(F.sum(v).alias("total"), F.count(F.lit(1)).alias("detected"), F.max(v).alias("max_value"), *sums)
    live = F.col("row_keep") if masked else F.lit(True)
    zero = lambda c, z: F.when(live, F.coalesce(c, z)).otherwise(z).alias(c)
    out = spine.select("row", *(["row_keep"] if masked else [])).join(by, "row", "left")
    out = out.select("row", live.alias("_live"), zero("total", F.lit(0.0)), zero("detected", F.lit(0).cast("bigint")), F.greatest(zero("max_value", F.lit(0.0)), F.lit(0.0)).alias("max_value"), *[zero(f"g{g}", F.lit(0.0)) for g in range(groups)])
    pct = [F.when(F.col("total") > 0, 100.0 * F.col(f"g{g}") / F.col("total")).otherwise(0.0).alias(f"pct{g}") for g in range(groups)]
    return out.select("row", "total", "detected", "max_value", *[f"g{g}" for g in range(groups)], *pct, (F.col("_live") & rows.keep(groups)).cast("int").alias("keep"))


def row_counts(entries: DataFrame, axis: str = "row") -> DataFrame:
    """(row or col, nnz) of those with entries."""
    return nonzero(entries).groupBy(axis).agg(F.count(F.lit(1)).alias("nnz"))


def feature_stats(entries: DataFrame, var: DataFrame, rows: int, min_sum: float = 0.0, min_detected: int = 0, min_variance: float = 0.0) -> DataFrame:
    """By feature of var: col, feature_sum, feature_sq_sum, detected, mean, variance, keep (int).

    mean and variance are over all rows, zeros included; with no rows they are 0.
    """
    by = nonzero(entries).groupBy("col").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(F.lit(1)).alias("n"))
    n = F.lit(float(rows))
    out = var.select("col").join(by, "col", "left").select("col", F.coalesce("s", F.lit(0.0)).alias("feature_sum"), F.coalesce("q", F.lit(0.0)).alias("feature_sq_sum"), F.coalesce("n", F.lit(0).cast("bigint")).alias("detected"))
    mean = F.col("feature_sum") / n if rows else F.lit(0.0)
    out = out.withColumn("mean", mean).withColumn("variance", F.col("feature_sq_sum") / n - F.col("mean") * F.col("mean") if rows else F.lit(0.0))
    return out.withColumn("keep", ((F.col("feature_sum") >= min_sum) & (F.col("detected") >= min_detected) & (F.col("variance") >= min_variance)).cast("int"))


def group_means(entries: DataFrame, membership: DataFrame, group: str, features: DataFrame | None = None) -> DataFrame:
    """(group, col, mean) over membership (row, group): a sum over its rows, divided by how many they are, zeros included."""
    sizes = membership.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    t = nonzero(entries)
    if features is not None:
        t = t.join(features.select("col"), "col", "left_semi")
    by = t.join(membership, "row").groupBy(group, "col").agg(F.sum("value").alias("_sum"))
    return by.join(sizes, group).select(group, "col", (F.col("_sum") / F.col("_rows")).alias("mean"))


def rollup_counts(counts: DataFrame, spans: DataFrame, id: str) -> DataFrame:
    """(id, rows, nnz) of partitions or shards: sums of row counts (row, nnz) over spans (id, row_begin, row_end)."""
    from .access import span_of

    by = span_of(counts, "row", spans, id).filter(F.col(id).isNotNull()).groupBy(id).agg(F.sum("nnz").alias("nnz"))
    return spans.select(id, (F.col("row_end") - F.col("row_begin")).alias("rows")).join(by, id, "left").select(id, "rows", F.coalesce("nnz", F.lit(0).cast("bigint")).alias("nnz"))
