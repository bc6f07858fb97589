"""Integrity checks: each gives a message, "" if all is well, or a table of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import LOCAL_LIMIT

_KINDS = {"string", "float", "smallint", "tinyint"}


def layout(partitions: list[dict], shards: list[int], rows: int, nnz: int) -> str:
    """Partitions (row_begin, row_end, rows, nnz) start at 0, follow each other and add up; shard offsets lie on their bounds."""
    at = 0
    for i, p in enumerate(partitions):
        if p["row_begin"] != at or p["row_end"] < p["row_begin"]:
            return f"partition {i} doesn't start where the one before ends"
        if p["rows"] != p["row_end"] - p["row_begin"]:
            return f"partition {i} has {p['rows']} rows in a span of {p['row_end'] - p['row_begin']}"
        if p["rows"] > LOCAL_LIMIT or p["nnz"] > LOCAL_LIMIT:
            return f"partition {i} exceeds the local limit"
        at = p["row_end"]
    if at != rows:
        return f"the partitions have {at} rows, the matrix {rows}"
    if sum(p["nnz"] for p in partitions) != nnz:
        return "the partitions' entries don't add up to the matrix's"
    bounds = {0, *(p["row_end"] for p in partitions)}
    if shards and (shards[0] != 0 or shards[-1] != rows or sorted(shards) != list(shards) or not {*shards} <= bounds):
        return "shard offsets must run from 0 to the last row along partition bounds"
    return ""


def unknown_codecs(partitions: DataFrame, codecs: DataFrame) -> DataFrame:
    """Partitions whose codec_id the codec table lacks."""
    return partitions.join(codecs.select("codec_id"), "codec_id", "left_anti")


def bad_entries(entries: DataFrame, rows: int, cols: int) -> DataFrame:
    """Entries outside the matrix, without a number, or not finite."""
    v = F.col("value")
    return entries.filter(F.col("row").isNull() | F.col("col").isNull() | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (F.col("row") < 0) | (F.col("row") >= rows) | (F.col("col") < 0) | (F.col("col") >= cols))


def table(annotations: DataFrame, key: str, extent: int) -> str:
    """An annotation table has one line for each number below extent; its columns are text, float or small integers."""
    if odd := [f.name for f in annotations.schema if f.name != key and f.dataType.simpleString() not in _KINDS]:
        return f"column {odd[0]} is none of text, float32 and uint8"
    r = annotations.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return "" if r.n == r.d == extent and (not extent or (r.lo == 0 and r.hi == extent - 1)) else f"{r.n} lines for an extent of {extent}"


def csr_arrays(indptr: list[int], indices: list[int], values: list[float], cols: int) -> str:
    if not indptr or indptr[0] != 0:
        return "indptr must start at 0"
    if any(a > b for a, b in zip(indptr, indptr[1:], strict=False)):
        return "indptr must rise"
    if indptr[-1] != len(indices) or len(indices) != len(values):
        return "indptr must end at the number of entries"
    return "" if all(0 <= c < cols for c in indices) else "an index is out of range"


def semantics(row_axis: str, col_axis: str) -> bool:
    """An assay's axes differ."""
    return bool(row_axis and col_axis and row_axis != col_axis)
