"""Concatenation and the union of feature spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..scratch import dense_index


def concat_rows(top: SparseMatrix, bottom: SparseMatrix) -> SparseMatrix:
    """bottom under top. Unequal numbers of columns are an error, but one of 0 adopts the other's. Shards become partitions."""
    if top.cols and bottom.cols and top.cols != bottom.cols:
        raise ValueError(f"{top.cols} and {bottom.cols} columns can't be stacked")
    below = bottom.entries.withColumn("row", F.col("row") + top.rows)
    offsets = (*(top.partitions or (0, top.rows)), *(x + top.rows for x in (bottom.partitions or (0, bottom.rows))[1:]))
    return SparseMatrix(top.entries.unionByName(below), top.rows + bottom.rows, top.cols or bottom.cols, partitions=offsets, shards=offsets)


def feature_union(features: DataFrame) -> DataFrame:
    """(source, local_col, global_col) for features (source int, local_col, id, name, type): equal (id, name, type) are one feature.

    A feature's number is its rank by first appearance: the least (source, local_col). Missing strings count as "".
    """
    f = features.select("source", "local_col", *[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "name", "type")])
    key = ["id", "name", "type"]
    first = f.groupBy(*key).agg(F.min(F.struct("source", "local_col")).alias("first"))
    first = dense_index(first.select(*key, "first.source", "first.local_col").toDF(*key, "_source", "_local"), ["_source", "_local"], "global_col")
    return f.join(first.select(*key, "global_col"), key).select("source", "local_col", "global_col")


def source_spans(sources: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(source, row_begin, row_end) of sources (id, rows), stacked in their order."""
    out, at = [], 0
    for source, rows in sources:
        out.append((source, at, at + rows))
        at += rows
    return out


def union_sources(entries: DataFrame, feature_map: DataFrame, spans: DataFrame) -> DataFrame:
    """Entries (source, row, col, value) in one space: rows shifted to their source's span, columns mapped to the union's."""
    t = entries.join(feature_map.select("source", F.col("local_col").alias("col"), "global_col"), ["source", "col"])
    # One row per source.
    return t.join(F.broadcast(spans), "source").select((F.col("row") + F.col("row_begin")).alias("row"), F.col("global_col").alias("col"), "value")
