"""AnnData-like sources: a directory of Parquet tables, or an HDF5 file where h5py is installed.

A directory has X (and raw/X, layers/<name>) with entries row, col, value, and obs, var (raw/var).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix
from ..scratch import hadoop_path

#: Columns that may name a feature, and that may say its type, in order.
NAME_COLUMNS = ("gene_short_name", "feature_name", "gene_name", "gene_symbol", "symbol", "name")
TYPE_COLUMNS = ("gene_type", "feature_type", "feature_types", "type")
#: Values that are looked at to tell counts from processed values.
PROBED = 1024


def matrix_paths(source: str) -> tuple[str, str]:
    """(matrix, feature table) below a dataset for x, raw_x or layer:<name>."""
    if source in ("", "x"):
        return "X", "var"
    if source == "raw_x":
        return "raw/X", "raw/var"
    if source.startswith("layer:") and source != "layer:":
        return f"layers/{source.removeprefix('layer:')}", "var"
    raise ValueError(f"matrix source {source!r} is none of x, raw_x and layer:<name>")


def count_like(entries: DataFrame) -> bool:
    """Whether the first values by (row, col) are finite, not negative and whole numbers, but for rounding."""
    v = F.col("value")
    first = entries.orderBy("row", "col").limit(PROBED)
    bad = first.filter(F.isnan(v) | (F.abs(v) == float("inf")) | (v < -1e-6) | (F.abs(v - F.round(v)) > 1e-4))
    return bad.limit(1).count() == 0


def infer_columns(table: DataFrame, key: str) -> DataFrame:
    """Annotation columns as text, float or uint8 (smallint): whole numbers that are all 0 or 1 become flags; names with _ and other types go."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema if f.name != key and not f.name.startswith("_")}
    whole = [n for n, k in kinds.items() if k in ("tinyint", "smallint", "int", "bigint")]
    flags = table.agg(*[F.coalesce(F.bool_and(F.col(n).isin(0, 1)), F.lit(False)).alias(n) for n in whole]).first() if whole else {}
    out = [F.col(key)]
    for n, k in kinds.items():
        if k == "string":
            out.append(F.coalesce(n, F.lit("")).alias(n))
        elif k == "boolean" or n in whole and flags[n]:
            out.append(F.col(n).cast("smallint").alias(n))
        elif n in whole or k in ("float", "double"):
            out.append(F.col(n).cast("float").alias(n))
    return table.select(*out)


def decode_categorical(codes: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Codes as their categories; a code without one is ""."""
    names = F.array(*[F.lit(c) for c in categories]) if categories else F.array().cast("array<string>")
    return codes.withColumn(column, F.when((F.col(column) >= 0) & (F.col(column) < len(categories)), F.try_element_at(names, (F.col(column) + 1).cast("int"))).otherwise(""))


def feature_table(var: DataFrame, key: str = "col") -> DataFrame:
    """(col, id, name, type): the index names a feature; its name and type come from the first column there is."""
    index = next((c for c in ("_index", "id", "index") if c in var.columns), None)
    id = F.col(index).cast("string") if index else F.concat(F.lit("feature_"), F.col(key).cast("string"))
    first = lambda columns, other: F.col(c).cast("string") if (c := next((c for c in columns if c in var.columns), None)) else other
    return var.select(key, id.alias("id"), F.coalesce(first(NAME_COLUMNS, id), id).alias("name"), F.coalesce(first(TYPE_COLUMNS, F.lit("gene")), F.lit("gene")).alias("type"))


def observation_text(obs: DataFrame, key: str = "row") -> DataFrame:
    """obs with all columns as text, missing ones ""."""
    return obs.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in obs.columns if c != key])


def read(spark: SparkSession, path: str, source: str = "") -> SparseMatrix:
    """A dataset directory; .h5ad files need h5py, which reads them on the driver."""
    if path.endswith((".h5ad", ".h5")):
        return _read_hdf5(spark, path, source)
    x, v = matrix_paths(source)
    entries = spark.read.parquet(f"{path}/{x}")
    obs, var = spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/{v}")
    name = next((c for c in ("_index", "barcode", "index") if c in obs.columns), None)
    obs = obs.withColumn("barcode", F.col(name).cast("string") if name else F.concat(F.lit("cell_"), F.col("row").cast("string")))
    return SparseMatrix(entries.select("row", "col", F.col("value").cast("double").alias("value")), obs.count(), var.count(), obs, feature_table(var))


def _read_hdf5(spark: SparkSession, path: str, source: str) -> SparseMatrix:
    try:
        import h5py
        import numpy as np
        import pandas as pd
    except ImportError as e:
        raise ImportError("reading .h5ad files needs h5py; convert them to a dataset directory otherwise") from e
    x, v = matrix_paths(source)
    with h5py.File(path) as f:
        g = f[x]
        kind = str(g.attrs.get("encoding-type", "")) if isinstance(g, h5py.Group) else "dense"
        if kind not in ("csr_matrix", "csc_matrix"):
            raise ValueError(f"{kind} matrices are not read")
        rows, cols = (int(n) for n in g.attrs["shape"])
        major = np.repeat(np.arange(len(g["indptr"]) - 1), np.diff(g["indptr"][:]))
        a, b = (major, g["indices"][:]) if kind == "csr_matrix" else (g["indices"][:], major)
        entries = spark.createDataFrame(pd.DataFrame({"row": a.astype("int64"), "col": b.astype("int64"), "value": g["data"][:].astype("float64")}))
        names = lambda t: [n.decode() if isinstance(n, bytes) else str(n) for n in f[t][f[t].attrs.get("_index", "_index")][:]]
        obs = spark.createDataFrame([*enumerate(names("obs"))], "row bigint, barcode string")
        var = spark.createDataFrame([*enumerate(names(v))], "col bigint, id string")
    return SparseMatrix(entries, rows, cols, obs, feature_table(var))


def row_window(entries: DataFrame, begin: int, end: int) -> DataFrame:
    """Entries of the rows begin to end; the filter reaches the files' row statistics."""
    return entries.filter((F.col("row") >= begin) & (F.col("row") < end))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)
