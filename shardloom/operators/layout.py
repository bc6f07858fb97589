"""Layouts: COO, CSR, CSC, dense, diagonal, blocked ELL, sliced ELL and quantised forms, each a view of the entries."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..matrix import nonzero
from .access import csr

#: Candidates of the tuning.
BLOCK_SIZES, SLICE_ROWS = (4, 8, 16, 32), (8, 16, 32, 64)
#: A slot of a blocked ELL row block that holds no block.
NO_BLOCK = -1


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def csc(entries: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """(col, rows, vals), rows ascending."""
    spine = spine.select(F.col("col").alias("row")) if spine is not None else None
    return csr(transpose(entries), spine).select(F.col("row").alias("col"), F.col("cols").alias("rows"), "vals")


def from_csr(rows: DataFrame) -> DataFrame:
    """Entries of csr() rows."""
    return rows.select("row", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("value"))))


def from_csc(cols: DataFrame) -> DataFrame:
    return transpose(from_csr(cols.select(F.col("col").alias("row"), F.col("rows").alias("cols"), "vals")))


def dense(entries: DataFrame, spine: DataFrame, cols: int) -> DataFrame:
    """(row, vals) with an array of all cols values, for matrices with few columns."""
    by = csr(entries, spine)
    m = F.map_from_arrays("cols", "vals")
    return by.select("row", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint")), lambda c: F.coalesce(F.element_at(m, c), F.lit(0.0))).alias("vals"))


def diagonals(entries: DataFrame) -> DataFrame:
    """(diag_offset = col - row, rows, vals), rows ascending."""
    by = nonzero(entries).groupBy((F.col("col") - F.col("row")).alias("diag_offset")).agg(F.sort_array(F.collect_list(F.struct("row", "value"))).alias("e"))
    return by.select("diag_offset", F.col("e.row").alias("rows"), F.col("e.value").alias("vals"))


def from_diagonals(diags: DataFrame) -> DataFrame:
    return diags.select("diag_offset", F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("vals").alias("value")))).select("row", (F.col("row") + F.col("diag_offset")).alias("col"), "value")


def _candidates(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def tune_blocked_ell(entries: DataFrame, rows: int, sizes=BLOCK_SIZES) -> DataFrame:
    """By candidate, best first: block_size, width, row_blocks, blocks, padded_bytes, fill.

    width is the most distinct column blocks of a row block; the least padded size wins, then the
    largest fill, then the larger block. Blocks are found once and counted by candidate in one pass.
    """
    # Blocks of a size that divides all are found first; larger ones are found among those.
    unit = gcd(*sizes)
    small = nonzero(entries).select(F.floor(F.col("row") / unit).alias("r"), F.floor(F.col("col") / unit).alias("c")).distinct()
    sized = small.select("r", "c", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])).alias("block_size"))
    at = lambda x: F.floor(F.col(x) * unit / F.col("block_size"))
    block = sized.select("block_size", at("r").alias("rb"), at("c").alias("cb")).distinct()
    per = block.groupBy("block_size", "rb").agg(F.count(F.lit(1)).alias("n")).groupBy("block_size").agg(F.max("n").alias("width"), F.sum("n").alias("blocks"))
    per = _candidates(entries.sparkSession, sizes, "block_size").join(per, "block_size", "left").fillna(0, ["width", "blocks"])
    row_blocks = F.ceil(F.lit(rows) / F.col("block_size")).cast("bigint")
    out = per.withColumn("row_blocks", row_blocks).withColumn("padded_bytes", F.lit(rows) * F.col("width") * F.col("block_size") * 2)
    out = out.withColumn("fill", F.when(F.col("width") > 0, F.col("blocks") / (F.col("row_blocks") * F.col("width"))).otherwise(0.0))
    return out.select("block_size", "width", "row_blocks", "blocks", "padded_bytes", "fill").orderBy("padded_bytes", F.desc("fill"), F.desc("block_size"))


def blocked_ell(entries: DataFrame, block: int, ordinal: str | None = None) -> DataFrame:
    """(row_block, slot, col_block, cells array<struct<r,c,value>>): slots ascend by column block; cells by place.

    Of entries at one place the last by the ordinal stays; without one they are summed. What is 0 then is dropped.
    """
    place = entries.groupBy("row", "col").agg((F.max_by("value", ordinal) if ordinal else F.sum("value")).alias("value"))
    cell = nonzero(place).select(F.floor(F.col("row") / block).alias("row_block"), F.floor(F.col("col") / block).alias("col_block"), F.struct((F.col("row") % block).cast("int").alias("r"), (F.col("col") % block).cast("int").alias("c"), "value").alias("cell"))
    by = cell.groupBy("row_block", "col_block").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    return by.select("row_block", (F.row_number().over(W.partitionBy("row_block").orderBy("col_block")) - 1).alias("slot"), "col_block", "cells")


def from_blocked_ell(blocks: DataFrame, block: int) -> DataFrame:
    """Entries of blocked_ell() rows, zeros dropped."""
    cells = blocks.select("row_block", "col_block", F.inline("cells"))
    return nonzero(cells.select((F.col("row_block") * block + F.col("r")).alias("row"), (F.col("col_block") * block + F.col("c")).alias("col"), "value"))


def blocked_ell_slots(blocks: DataFrame, rows: int, block: int) -> DataFrame:
    """(row_block, slots): every row block of the matrix, its column blocks padded with NO_BLOCK to the matrix's width."""
    spark = blocks.sparkSession
    by = blocks.groupBy("row_block").agg(F.sort_array(F.collect_list("col_block")).alias("b"))
    width = by.agg(F.coalesce(F.max(F.size("b")), F.lit(0)).alias("w"))
    spine = spark.range(-(-rows // block)).withColumnRenamed("id", "row_block")
    # One row: a bounded side.
    out = spine.join(by, "row_block", "left").join(F.broadcast(width))
    held = F.coalesce("b", F.array().cast("array<bigint>"))
    return out.select("row_block", F.concat(held, F.array_repeat(F.lit(NO_BLOCK).cast("bigint"), F.col("w") - F.size(held))).alias("slots"))


def tune_sliced_ell(entries: DataFrame, rows: int, heights=SLICE_ROWS) -> DataFrame:
    """By candidate, best first: slice_rows, slices, slots, score, bytes; score = slots per entry + a quarter of slices per row."""
    nnz = nonzero(entries).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    sized = nnz.select("row", "n", F.explode(F.array(*[F.lit(h).cast("bigint") for h in heights])).alias("slice_rows"))
    wide = sized.groupBy("slice_rows", F.floor(F.col("row") / F.col("slice_rows")).alias("slice")).agg(F.max("n").alias("w"), F.sum("n").alias("n"))
    height = F.least(F.col("slice_rows"), F.lit(rows) - F.col("slice") * F.col("slice_rows"))
    per = wide.groupBy("slice_rows").agg(F.sum(F.col("w") * height).alias("slots"), F.sum("n").alias("nnz"))
    per = _candidates(entries.sparkSession, heights, "slice_rows").join(per, "slice_rows", "left").fillna(0, ["slots", "nnz"])
    slices = F.ceil(F.lit(rows) / F.col("slice_rows")).cast("bigint")
    out = per.withColumn("slices", slices).withColumn("bytes", F.col("slots") * 6 + F.col("slices") * 8)
    score = F.when(F.col("nnz") > 0, F.col("slots") / F.col("nnz")).otherwise(0.0) + 0.25 * F.col("slices") / F.lit(max(1, rows))
    return out.withColumn("score", score).select("slice_rows", "slices", "slots", "score", "bytes").orderBy(F.round("score", 12), "bytes", F.desc("slice_rows"))


def sliced_ell(entries: DataFrame, spine: DataFrame, height: int) -> DataFrame:
    """(slice, row, width, cols, vals): each row padded to its slice's width; -1 and 0 fill up. Repeated entries stay."""
    by = csr(entries, spine).withColumn("slice", F.floor(F.col("row") / height))
    width = F.max(F.size("cols")).over(W.partitionBy("slice"))
    by = by.withColumn("width", width)
    pad = lambda c, z: F.concat(c, F.array_repeat(z, F.col("width") - F.size(c)))
    return by.select("slice", "row", "width", pad(F.col("cols"), F.lit(-1).cast("bigint")).alias("cols"), pad(F.col("vals"), F.lit(0.0)).alias("vals"))


def from_sliced_ell(slices: DataFrame) -> DataFrame:
    return nonzero(slices.select("row", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("value"))))).filter("col >= 0")


def byte_sizes(rows: int, nnz: int, cols: int = 0, block: int = 1, width: int = 0, slots: int = 0, slices: int = 0) -> dict[str, int]:
    """Bytes of the layouts, with 16-bit values and 32-bit indices."""
    row_blocks = -(-rows // block)
    return {"csr": (rows + 1) * 4 + nnz * 6, "coo": nnz * 10, "dense": rows * cols * 2, "blocked_ell": row_blocks * width * 4 + rows * width * block * 2, "sliced_ell": (slices + 1) * 4 + slices * 4 + slots * 6}


def quantize(entries: DataFrame, scale: DataFrame, bits: int = 8, signed: bool = True) -> DataFrame:
    """(row, col, code): value = code * scale + offset by column, rounded half to even and clamped to the codes there are."""
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    code = F.bround((F.col("value") - F.col("offset")) / F.col("scale"))
    return nonzero(entries).join(scale, "col").select("row", "col", F.greatest(F.lit(low), F.least(F.lit(high), code)).cast("int").alias("code"))


def dequantize(codes: DataFrame, scale: DataFrame, row_offsets: DataFrame | None = None) -> DataFrame:
    """Entries of codes, by column scale and offset, or by column scale and row offset (row, offset)."""
    if row_offsets is None:
        return codes.join(scale, "col").select("row", "col", (F.col("code") * F.col("scale") + F.col("offset")).alias("value"))
    return codes.join(scale.select("col", "scale"), "col").join(row_offsets, "row").select("row", "col", (F.col("code") * F.col("scale") + F.col("offset")).alias("value"))
