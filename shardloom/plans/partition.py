"""Partition and shard plans: greedy folds over metadata, one number per partition or row.

Folds that start anew on overflow have no window form; they run on the driver over partition-sized
metadata. For cuts at single rows of a large matrix, row counts are first summed over row ranges.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import LOCAL_LIMIT
from ..scratch import written


def cut(weights: Iterable[Sequence[int]], limits: Sequence[int], idle: bool = False) -> list[int]:
    """Offsets of groups: a new one starts where a weight would pass its limit (0: none) and the group isn't empty.

    idle: an item without weight never starts a group.
    """
    out, total, n, count = [0], [0] * len(limits), 0, 0
    for n, w in enumerate(weights, 1):
        if count and any(m and t + x > m for t, x, m in zip(total, w, limits, strict=True)) and not (idle and not any(w)):
            out.append(n - 1)
            total, count = [0] * len(limits), 0
        total = [t + x for t, x in zip(total, w, strict=True)]
        count += any(total) if idle else 1
    return [*out, n] if n else [0]


def partitions_by_nnz(row_nnz: Iterable[int], most: int) -> list[int]:
    """Row offsets: a cut before a row that would pass `most` entries, unless nothing is there yet; 0 makes one partition."""
    out, total, n = [0], 0, 0
    for n, w in enumerate(row_nnz, 1):
        if most and total and total + w > most:
            out.append(n - 1)
            total = 0
        total += w
    return [*out, n] if n else [0]


def partition_offsets(row_nnz: DataFrame, most: int) -> list[int]:
    """partitions_by_nnz() of rows (row, nnz), as the first row of each partition and what follows the last row.

    Counts are made in parallel and written; then one task reads them in order and jumps from cut to cut.
    Only offsets, as many as partitions, reach the driver.
    """
    counts = written(row_nnz.select("row", "nnz"), "row-counts")

    def fold(batches):
        total = 0
        for batch in batches:
            row, upto = batch.column(0).to_numpy(), np.cumsum(batch.column(1).to_numpy())
            cuts, begin, base = [], 0, -total
            while most and begin < len(upto):
                # The first row that passes the limit; if nothing is there before it, the one after.
                i = max(begin, int(np.searchsorted(upto, base + most, "right")))
                i += i < len(upto) and (upto[i - 1] if i else 0) == base
                if i < len(upto):
                    cuts.append(int(row[i]))
                    base = int(upto[i - 1]) if i else 0
                begin = i
            total = int(upto[-1]) - base
            yield pa.RecordBatch.from_arrays([pa.array([int(row[0])]), pa.array([int(row[-1]) + 1]), pa.array([cuts], pa.list_(pa.int64()))], ["first", "end", "cuts"])

    found = counts.coalesce(1).sortWithinPartitions("row").mapInArrow(fold, "first bigint, end bigint, cuts array<bigint>").collect()
    return [found[0].first, *(c for r in found for c in r.cuts), found[-1].end] if found else [0]


def partition_table(row_nnz: DataFrame, most: int) -> DataFrame:
    """(row, partition_id) of partition_offsets()."""
    from ..operators.access import span_of

    spans = spans_table(row_nnz.sparkSession, partition_offsets(row_nnz, most), "partition_id")
    return span_of(row_nnz.select("row"), "row", spans, "partition_id")


def range_partitions(row_nnz: DataFrame, rows: int, most: int, ranges: int = 100_000) -> list[int]:
    """Row offsets with at most `most` entries each, cut at range ends only: counts are summed over at most `ranges` row ranges."""
    step = max(1, -(-rows // ranges))
    got = {r.k: r.n for r in row_nnz.groupBy(F.floor(F.col("row") / step).alias("k")).agg(F.sum("nnz").alias("n")).collect()}
    n = -(-rows // step)
    return [min(rows, o * step) for o in partitions_by_nnz((got.get(k, 0) for k in range(n)), most)]


def by_limit(parts: Sequence[tuple[int, int]], nnz: int = 0, size: int = 0) -> list[int]:
    """Offsets of groups of parts (nnz, bytes) within both limits."""
    return cut(parts, (nnz, size))


def checked_shards(parts: Sequence[dict], size: int) -> list[int]:
    """Offsets of shards of parts (rows, nnz, slots, bytes): by bytes, with every count inside an unsigned 32-bit number."""
    return cut([(p["rows"], p["nnz"], p.get("slots", 0), p["bytes"]) for p in parts], (LOCAL_LIMIT, LOCAL_LIMIT, LOCAL_LIMIT, size))


def prefix(sizes: Iterable[int]) -> list[int]:
    out = [0]
    for s in sizes:
        out.append(out[-1] + s)
    return out


def equal_shards(part_rows: Sequence[int], count: int) -> list[int]:
    """Row offsets of `count` shards: one ends where it has its share of rows, while enough partitions are left; the last takes the rest."""
    rows, offsets = sum(part_rows), prefix(part_rows)
    count = min(max(1, count), max(1, len(part_rows)))
    share, out, start = -(-rows // count) if rows else 0, [0], 0
    for i in range(len(part_rows)):
        left = count - len(out)
        if left and offsets[i + 1] - start >= share or left and len(part_rows) - i - 1 == left:
            out.append(offsets[i + 1])
            start = offsets[i + 1]
    return [*out, rows] if out[-1] != rows or len(out) == 1 else out


def shards_by_rows(part_rows: Sequence[int], target: int) -> list[int]:
    """Row offsets of shards with at most `target` rows, whole partitions each; 0 makes each partition a shard."""
    offsets = prefix(part_rows)
    return offsets if not target else [offsets[i] for i in cut([(r,) for r in part_rows], (target,))]


def shards_by(weights: Sequence[int], offsets: Sequence[int], most: int) -> list[int]:
    """Row offsets of shards by nnz or bytes of their partitions; partitions of weight 0 never start one."""
    return [offsets[i] for i in cut([(w,) for w in weights], (most,), idle=True)]


def check_reshard(offsets: Sequence[int], partitions: Sequence[int]) -> str:
    """"" if shard offsets run from 0 to the last row, rise, and lie on partition bounds; else what is wrong."""
    if not offsets:
        return ""
    if offsets[0] != 0 or offsets[-1] != partitions[-1]:
        return "shards must cover all rows"
    if any(a > b for a, b in zip(offsets, offsets[1:], strict=False)):
        return "shard offsets must rise"
    return "" if {*offsets} <= {*partitions} else "a shard ends inside a partition"


def find_span(offsets: Sequence[int], x: int) -> int:
    """The span [offsets[i], offsets[i + 1]) that holds x, or the number of spans."""
    n = len(offsets) - 1
    return bisect_right(offsets, x) - 1 if n > 0 and offsets[0] <= x < offsets[-1] else max(0, n)


def round_robin(shards: int, devices: int) -> list[int]:
    return [s % devices for s in range(shards)]


def by_bytes(sizes: Sequence[int], devices: int) -> list[int]:
    """The device of each shard: largest first, to the least loaded; ties by number."""
    heap, out = [(0, d) for d in range(devices)], [0] * len(sizes)
    for s in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, d = heapq.heappop(heap)
        out[s] = d
        heapq.heappush(heap, (load + sizes[s], d))
    return out


def spans_table(spark, offsets: Sequence[int], id: str) -> DataFrame:
    """(id, row_begin, row_end) of offsets."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))], f"{id} bigint, row_begin bigint, row_end bigint")


class Spans:
    """Row offsets of partitions, and shards of whole partitions: who holds what."""

    def __init__(self, partitions: Sequence[int], shards: Sequence[int] | None = None):
        if why := check_reshard(shards or [], partitions):
            raise ValueError(why)
        self.partitions, self.shards = list(partitions), list(shards or partitions)

    def partition_of(self, row: int) -> int:
        return find_span(self.partitions, row)

    def shard_of(self, row: int) -> int:
        return find_span(self.shards, row)

    def partition_rows(self, i: int) -> tuple[int, int]:
        """The first row, and the one after the last."""
        return self.partitions[i], self.partitions[i + 1]

    def shard_rows(self, i: int) -> tuple[int, int]:
        return self.shards[i], self.shards[i + 1]

    def shard_partitions(self, i: int) -> tuple[int, int]:
        """The first partition, and the one after the last."""
        return bisect_left(self.partitions, self.shards[i]), bisect_left(self.partitions, self.shards[i + 1])

    def is_bound(self, row: int) -> bool:
        return row in {*self.partitions}

    def shard_sums(self, weights: Sequence[int]) -> list[int]:
        """Sums by shard of a number per partition: rows, entries, bytes."""
        return [sum(weights[slice(*self.shard_partitions(i))]) for i in range(len(self.shards) - 1)]
