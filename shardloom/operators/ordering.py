"""Ordering and bucketing of rows and columns."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..matrix import nonzero
from ..scratch import dense_index

#: Rows of a systematic sample at most.
SAMPLE_ROWS = 16_384
#: Segments of a layout at most.
MAX_BUCKETS = 8


def invert(permutation: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    return permutation.select(F.col(new).alias(old), F.col(old).alias(new))


def check_permutation(permutation: DataFrame, n: int, old: str = "old", new: str = "new") -> bool:
    """Whether it maps 0..n-1 onto 0..n-1."""
    r = permutation.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(old).alias("a"), F.countDistinct(new).alias("b"), F.min(F.least(old, new)).alias("lo"), F.max(F.greatest(old, new)).alias("hi")).first()
    return r.n == r.a == r.b == n and (n == 0 or (r.lo == 0 and r.hi == n - 1))


def nnz_buckets(entries: DataFrame, spine: DataFrame, buckets: int, rows: int) -> DataFrame:
    """(row, nnz, rank, bucket): rows by nnz and number; buckets of equal counts, the first rows % buckets of them one larger.

    Ranks come from a distributed sort, not from one window over all rows.
    """
    k = min(max(1, buckets), max(1, rows))
    nnz = spine.select("row").join(nonzero(entries).groupBy("row").agg(F.count(F.lit(1)).alias("nnz")), "row", "left").fillna(0, ["nnz"])
    ranked = dense_index(nnz, ["nnz", "row"], "rank")
    size, more = divmod(rows, k)
    r = F.col("rank")
    edge = more * (size + 1)
    bucket = F.when(r < edge, F.floor(r / (size + 1))).otherwise(more + F.floor((r - edge) / max(1, size)))
    return ranked.withColumn("bucket", bucket.cast("bigint"))


def shard_nnz_buckets(entries: DataFrame, shards: DataFrame, buckets: int) -> DataFrame:
    """nnz_buckets() within each shard: shards has row and shard_id. A shard is bounded, so that a window over it is too."""
    nnz = shards.join(nonzero(entries).groupBy("row").agg(F.count(F.lit(1)).alias("nnz")), "row", "left").fillna(0, ["nnz"])
    w = W.partitionBy("shard_id").orderBy("nnz", "row")
    return nnz.select("shard_id", "row", "nnz", (F.row_number().over(w) - 1).cast("bigint").alias("rank"), (F.ntile(buckets).over(w) - 1).cast("bigint").alias("bucket"))


def apply_order(entries: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
    """Entries under permuted numbers: rows and cols have old and new."""
    t = entries
    for p, key in ((rows, "row"), (cols, "col")):
        if p is not None:
            t = t.join(p.select(F.col("old").alias(key), F.col("new").alias("_new")), key).withColumn(key, F.col("_new")).drop("_new")
    return t.select("row", "col", "value")


def barycenter_order(entries: DataFrame, spine: DataFrame, axis: str, ranks: DataFrame | None = None) -> DataFrame:
    """(axis, pos): ordered by the mean rank of neighbours on the other axis, those without neighbours last, ties by number.

    ranks (other axis, rank); without it a neighbour's number is its rank.
    """
    other = "row" if axis == "col" else "col"
    t = nonzero(entries).select(axis, other)
    t = t.join(ranks, other) if ranks is not None else t.withColumn("rank", F.col(other))
    mean = t.groupBy(axis).agg((F.sum("rank") / F.count(F.lit(1))).alias("_mean"))
    keyed = spine.select(axis).join(mean, axis, "left").withColumn("_last", F.col("_mean").isNull())
    return dense_index(keyed, ["_last", "_mean", axis], "pos").select(axis, "pos")


def barycenter_orders(entries: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(row order, column order) after alternating rounds, columns first."""
    row_pos = None
    for _ in range(rounds):
        col_pos = barycenter_order(entries, cols, "col", row_pos)
        row_pos = barycenter_order(entries, rows, "row", col_pos.withColumnRenamed("pos", "rank"))
        final, row_pos = row_pos, row_pos.withColumnRenamed("pos", "rank")
    return final, col_pos


def signature_order(entries: DataFrame, spine: DataFrame, block: int) -> DataFrame:
    """(col, pos): columns with entries first, then by least row block, hash of the row blocks, support and number."""
    seen = nonzero(entries).select("col", F.floor(F.col("row") / block).alias("rb")).distinct()
    by = seen.groupBy("col").agg(F.min("rb").alias("_first"), F.count(F.lit(1)).alias("_support"), F.sum(F.xxhash64("rb").cast("decimal(38,0)")).alias("_sum"))
    keyed = spine.select("col").join(by, "col", "left").withColumn("_none", F.col("_support").isNull())
    return dense_index(keyed, ["_none", "_first", "_sum", F.col("_support").desc(), "col"], "pos").select("col", "pos")


def block_order(blocks: DataFrame) -> DataFrame:
    """(row_block, pos): row blocks by width and a hash of their column blocks, ties by number."""
    by = blocks.groupBy("row_block").agg(F.count(F.lit(1)).alias("_w"), F.sort_array(F.collect_list("col_block")).alias("_b")).withColumn("_h", F.xxhash64("_b"))
    return dense_index(by.select("row_block", "_w", "_h"), ["_w", "_h", "row_block"], "pos").select("row_block", "pos")


def systematic_sample(entries: DataFrame, rows: int, budget: int = SAMPLE_ROWS) -> DataFrame:
    """Every stride-th row, renumbered, stride = rows / budget rounded up; the stride is exact, so are the new numbers."""
    stride = max(1, -(-rows // budget))
    return nonzero(entries).filter(F.col("row") % stride == 0).withColumn("row", (F.col("row") / stride).cast("bigint"))


def width_segments(histogram: dict[int, int], k: int, fixed: int = 16, slot_bytes: int = 6) -> tuple[int, list[tuple[int, int]]]:
    """(cost, [(rows, width)]): at most k segments of rows sorted by width, with the least sum of fixed + slot_bytes * rows * widest.

    histogram: rows by width. Neighbours of one width are one segment. For each number of segments the best
    cut before a width is the lowest, there, of lines that fall ever steeper: the lower hull of those lines
    is walked once, so that the work is k times the number of widths.
    """
    widths = sorted(w for w, n in histogram.items() if n)
    if not widths:
        return 0, []
    upto = [0, *accumulate(histogram[w] for w in widths)]
    n, inf = len(widths), float("inf")
    cost = [0] + [inf] * n
    cut: list[list[int]] = []
    for _ in range(min(k, n)):
        new, back, hull, at = list(cost), [-1] * (n + 1), [], 0
        value = lambda i, x: cost[i] + fixed - slot_bytes * upto[i] * x  # noqa: B023, E731
        for j in range(1, n + 1):
            if cost[j - 1] < inf:
                while len(hull) > 1 and _above(hull[-2], hull[-1], j - 1, cost, upto, slot_bytes):
                    hull.pop()
                hull.append(j - 1)
                at = min(at, len(hull) - 1)
            x = widths[j - 1]
            while at + 1 < len(hull) and value(hull[at + 1], x) <= value(hull[at], x):
                at += 1
            if hull and (c := value(hull[at], x) + slot_bytes * upto[j] * x) < new[j]:
                new[j], back[j] = c, hull[at]
        cut.append(back)
        cost = new
    out, j, level = [], n, len(cut) - 1
    while j:
        while cut[level][j] < 0:
            level -= 1
        i = cut[level][j]
        out.append((upto[j] - upto[i], widths[j - 1]))
        j, level = i, level - 1
    return int(cost[n]), out[::-1]


def _above(a: int, b: int, c: int, cost: list, upto: list[int], slope: int) -> bool:
    """Whether the line of b is nowhere below both those of a and c."""
    return (cost[c] - cost[a]) * (upto[b] - upto[a]) <= (cost[b] - cost[a]) * (upto[c] - upto[a])


def choose_bucket_count(histogram: dict[int, int], most: int = MAX_BUCKETS) -> tuple[int, int]:
    """(buckets, bytes) with the least bytes, then the fewest buckets; rows are cut into equal counts by width."""
    widths = sorted(histogram)
    rows = sum(histogram.values())
    ends, at = [], 0
    for w in widths:
        at += histogram[w]
        ends.append(at)
    best = (0, 0)
    for k in range(1, min(most, rows) + 1):
        size = 0
        for i in range(k):
            lo, hi = i * rows // k, (i + 1) * rows // k
            if hi > lo:
                size += 16 + 6 * (hi - lo) * widths[bisect_left(ends, hi)]
        if not best[0] or size < best[1]:
            best = (k, size)
    return best


def width_histogram(entries: DataFrame, spine: DataFrame) -> DataFrame:
    """(width, rows): how many rows have so many entries."""
    nnz = spine.select("row").join(nonzero(entries).groupBy("row").agg(F.count(F.lit(1)).alias("width")), "row", "left").fillna(0, ["width"])
    return nnz.groupBy("width").agg(F.count(F.lit(1)).alias("rows"))


def bucket_costs(entries: DataFrame, spine: DataFrame, rows: int, most: int = MAX_BUCKETS) -> DataFrame:
    """(buckets, bytes) for each number of equal-count buckets of rows sorted by nnz.

    The histogram of widths holds all that is needed: a bucket is as wide as its last row, whose width is
    the first that has so many rows up to it.
    """
    cuts = [(k, b, (b + 1) * rows // k - b * rows // k, (b + 1) * rows // k) for k in range(1, min(most, max(1, rows)) + 1) for b in range(k)]
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("buckets"), F.lit(b).alias("b"), F.lit(n).cast("bigint").alias("n"), F.lit(end).cast("bigint").alias("end")) for k, b, n, end in cuts if n]))
    upto = width_histogram(entries, spine).withColumn("upto", F.sum("rows").over(W.orderBy("width")))
    per = upto.select("width", "upto", each.alias("c")).filter("upto >= c.end").groupBy("c.buckets", "c.b").agg(F.first("c.n").alias("n"), F.min("width").alias("w"))
    return per.groupBy("buckets").agg(F.sum(F.lit(16) + F.lit(6) * F.col("n") * F.col("w")).alias("bytes"))
