"""Matrix Market coordinate files and the text tables that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix, nonzero

_FIELDS, _SYMMETRIES = ("pattern", "integer", "real"), ("general", "symmetric")


@dataclass(frozen=True)
class Header:
    field: str
    symmetry: str
    rows: int
    cols: int
    lines: int


def parse_header(lines: list[str]) -> Header:
    """The banner, comments and dimensions that a file starts with."""
    banner = lines[0].removeprefix("﻿").lower().split() if lines else []
    if banner[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(banner) < 5:
        raise ValueError("not a Matrix Market coordinate file")
    if banner[3] not in _FIELDS or banner[4] not in _SYMMETRIES:
        raise ValueError(f"{banner[3]} {banner[4]} matrices are not read")
    dims = next((x.split() for x in lines[1:] if x.strip() and not x.lstrip().startswith("%")), [])
    if len(dims) != 3 or not all(d.isdigit() for d in dims):
        raise ValueError("no line with the dimensions")
    return Header(banner[3], banner[4], *map(int, dims))


def read_header(spark: SparkSession, path: str, most: int = 10_000) -> Header:
    """The header of a file, from its first lines (comments of over `most` lines aren't read)."""
    return parse_header([r.value for r in spark.read.text(path).limit(most).collect()])


def read_entries(spark: SparkSession, path: str) -> SparseMatrix:
    """The matrix: 0-based, mirrored where symmetric, 1.0 where a pattern; repeated entries and zeros stay as they are.

    Lines are split by Spark and read in parallel. A bad line, or a place outside the matrix, is an error.
    """
    h = read_header(spark, path)
    line = F.trim(F.regexp_replace("value", "\t", " "))
    lines = spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.ltrim("line").startswith("%") & ~F.col("line").startswith("﻿%"))
    # The dimensions are the first line that is no comment; where an entry reads the same, one of them is taken off.
    parts = F.split("line", " +")
    number = lambda i: F.element_at(parts, i).try_cast("bigint")
    value = F.lit(1.0) if h.field == "pattern" else F.try_element_at(parts, F.lit(3)).try_cast("double")
    dims = (F.size(parts) == 3) & (number(1) == h.rows) & (number(2) == h.cols) & (F.try_element_at(parts, F.lit(3)).try_cast("bigint") == h.lines)
    rows = lines.select(dims.alias("dims"), (number(1) - 1).alias("row"), (number(2) - 1).alias("col"), value.alias("value"))
    same = h.field != "pattern" and 0 < h.rows and 0 < h.cols and lines.filter(dims).limit(2).count() > 1
    first = rows.filter("not dims")
    if same:  # entries at the last place whose value is the number of lines
        extra = lines.filter(dims).count() - 1
        first = first.unionByName(spark.range(extra).select(F.lit(False).alias("dims"), F.lit(h.rows - 1).cast("bigint").alias("row"), F.lit(h.cols - 1).cast("bigint").alias("col"), F.lit(float(h.lines)).alias("value")))
    ok = F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("value").isNotNull() & (F.col("row") >= 0) & (F.col("row") < h.rows) & (F.col("col") >= 0) & (F.col("col") < h.cols)
    good = first.select(F.when(ok, F.col("row")).otherwise(F.raise_error(F.lit(f"{path}: a line is no entry of a {h.rows} x {h.cols} matrix")).cast("bigint")).alias("row"), "col", "value")
    if h.symmetry == "symmetric":
        here, there = F.struct("row", "col", "value"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), "value")
        good = good.select(F.inline(F.when(F.col("row") == F.col("col"), F.array(here)).otherwise(F.array(here, there))))
    return SparseMatrix(good, h.rows, h.cols)


def row_nnz(matrix: SparseMatrix) -> DataFrame:
    """(row, nnz) of rows with lines; mirrored entries count, zeros don't."""
    return nonzero(matrix.entries).groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))


def partitioned(matrix: SparseMatrix, offsets: list[int], begin: int = 0, end: int | None = None) -> DataFrame:
    """(partition_id, row within it, col, value) of the partitions begin to end."""
    from ..operators.access import span_of
    from ..plans.partition import spans_table

    spans = spans_table(matrix.entries.sparkSession, offsets, "partition_id")
    end = len(offsets) - 1 if end is None else end
    t = matrix.entries.filter((F.col("row") >= offsets[begin]) & (F.col("row") < offsets[end]))
    t = span_of(t, "row", spans, "partition_id").join(F.broadcast(spans.drop("row_end")), "partition_id")
    return t.select("partition_id", (F.col("row") - F.col("row_begin")).alias("row"), "col", "value")


def read_lines(spark: SparkSession, path: str, name: str = "barcode", key: str = "row") -> DataFrame:
    """(key, name): the lines that are not empty, numbered in their order."""
    return _numbered(spark.read.text(path).filter(F.trim("value") != ""), key).select(key, F.col("value").alias(name))


def read_features(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(col, id, name, type) of up to three tab-separated fields; what is missing is ""."""
    parts = F.split("value", "\t")
    lines = _numbered(spark.read.text(path).filter(F.trim("value") != ""), "col")
    lines = lines.filter("col > 0").withColumn("col", F.col("col") - 1) if header else lines
    field = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return lines.select("col", field(1).alias("id"), field(2).alias("name"), field(3).alias("type"))


def read_metadata(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(row, text columns) of a tab-separated table; a line with another number of fields than the first is an error."""
    first = [r.value for r in spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()]
    if not first:
        return spark.createDataFrame([], "row bigint")
    names = first[0].split("\t") if header else [f"field_{i}" for i in range(len(first[0].split("\t")))]
    lines = _numbered(spark.read.text(path).filter(F.trim("value") != ""), "row")
    lines = lines.filter("row > 0").withColumn("row", F.col("row") - 1) if header else lines
    parts = F.split("value", "\t", -1)
    right = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.lit(f"{path}: a line hasn't {len(names)} fields")).cast("array<string>"))
    return lines.select("row", right.alias("_p")).select("row", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def _numbered(lines: DataFrame, key: str) -> DataFrame:
    """Lines of text files numbered in file order: by task, then within it."""
    from ..scratch import dense_index

    return dense_index(lines.withColumn("_at", F.monotonically_increasing_id()), ["_at"], key).drop("_at")
