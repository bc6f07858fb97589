"""Manifests: tab-separated lists of sources, and the ingest of all of them into one matrix."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FALSE, TRUE
from ..matrix import SparseMatrix, nonzero
from ..operators.union import feature_union, source_spans, union_sources
from . import columnar, mtx

#: Names of formats; only the last three are read.
FORMATS = ("tenx_h5", "loom", "binary", "mtx", "tenx_mtx", "h5ad")
READABLE = FORMATS[3:]
_FIELDS = {"dataset": "dataset", "sample": "dataset", "path": "path", "matrix": "path", "format": "format", "features": "features", "barcodes": "barcodes", "metadata": "metadata", "matrix_source": "matrix_source", "allow_processed": "allow_processed", "rows": "rows", "cols": "cols", "nnz": "nnz"}
_POSITIONS = ("dataset", "path", "format", "features", "barcodes", "metadata", "matrix_source", "allow_processed", "rows", "cols", "nnz")


@dataclass(frozen=True)
class Source:
    dataset: str
    path: str
    format: str = "unknown"
    features: str = ""
    barcodes: str = ""
    metadata: str = ""
    matrix_source: str = ""
    allow_processed: bool = False
    rows: int = 0
    cols: int = 0
    nnz: int = 0


def _flag(text: str) -> bool:
    if text not in TRUE + FALSE:
        raise ValueError(f"{text!r} is no flag")
    return text in TRUE


def parse_manifest(lines: list[str], header: bool = True) -> list[Source]:
    """Sources of a manifest's lines; fields by name, or by position without a header."""
    lines = [x for x in lines if x.strip() and not x.startswith("#")]
    names = [_FIELDS.get(n.strip().lower(), "") for n in lines.pop(0).split("\t")] if header and lines else list(_POSITIONS)
    out = []
    for line in lines:
        given = {n: v.strip() for n, v in zip(names, line.split("\t"), strict=False) if n}
        counts = {k: int(given.pop(k) or 0) for k in ("rows", "cols", "nnz") if k in given}
        kind = given.pop("format", "")
        if not given.get("path"):
            raise ValueError(f"a source without a path: {line!r}")
        flag = _flag(given.pop("allow_processed", ""))
        out.append(Source(**{"dataset": "", **given}, format=kind if kind in FORMATS else "unknown", allow_processed=flag, **counts))
    return out


def read_manifest(spark: SparkSession, path: str, header: bool = True, most: int = 100_000) -> list[Source]:
    """The sources, of which a manifest may list `most`."""
    lines = [r.value for r in spark.read.text(path).limit(most + 2).collect()]
    if len(lines) > most + 1:
        raise ValueError(f"more than {most} sources")
    return parse_manifest(lines, header)


def read_source(spark: SparkSession, source: Source) -> SparseMatrix:
    """A source's matrix with obs (row, barcode, ...) and var (col, id, name, type); processed values only if allowed."""
    if source.format not in READABLE:
        raise ValueError(f"{source.format} sources are not read")
    if source.format == "h5ad":
        m = columnar.read(spark, source.path, source.matrix_source)
        if not source.allow_processed and not columnar.count_like(m.entries):
            raise ValueError(f"{source.dataset}: the matrix doesn't hold counts; set allow_processed to read it")
        return m
    m = mtx.read_entries(spark, source.path)
    obs = mtx.read_lines(spark, source.barcodes) if source.barcodes else None
    if obs is not None and source.metadata:
        obs = obs.join(mtx.read_metadata(spark, source.metadata), "row", "left")
    return replace(m, obs=obs, var=mtx.read_features(spark, source.features) if source.features else None)


def _check_axis(table: DataFrame | None, extent: int, what: str, source: Source) -> None:
    if table is not None and (n := table.count()) != extent:
        raise ValueError(f"{source.dataset}: {n} {what} for an extent of {extent}")


def ingest(spark: SparkSession, sources: list[Source]) -> SparseMatrix:
    """All readable sources as one matrix: rows stacked in order, features united by (id, name, type).

    obs has row, source, local_row and barcode; var has col, id, name and type. Others are skipped.
    """
    read = [(i, s, read_source(spark, s)) for i, s in enumerate(s for s in sources if s.format in READABLE)]
    if not read:
        raise ValueError("no source that can be read")
    for _, s, m in read:
        _check_axis(m.obs, m.rows, "barcodes", s)
        _check_axis(m.var, m.cols, "features", s)
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union(dfs[: len(dfs) // 2]).unionByName(union(dfs[len(dfs) // 2 :]))
    blank = lambda m, i: (m.var if m.var is not None else spark.range(m.cols).select(F.col("id").alias("col"), F.concat(F.lit("feature_"), "id").alias("id"), F.lit("").alias("name"), F.lit("gene").alias("type"))).select(F.lit(i).alias("source"), F.col("col").alias("local_col"), "id", "name", "type")
    features = union([blank(m, i) for i, _, m in read])
    mapping = feature_union(features)
    spans = source_spans([(i, m.rows) for i, _, m in read])
    span_table = spark.createDataFrame(spans, "source int, row_begin bigint, row_end bigint")
    entries = union_sources(union([nonzero(m.entries).select(F.lit(i).alias("source"), "row", "col", "value") for i, _, m in read]), mapping, span_table)
    name = lambda m: m.obs.select("row", "barcode") if m.obs is not None else spark.range(m.rows).select(F.col("id").alias("row"), F.concat(F.lit("cell_"), "id").alias("barcode"))
    obs = union([name(m).select((F.col("row") + spans[i][1]).alias("row"), F.lit(i).alias("source"), F.col("row").alias("local_row"), "barcode") for i, _, m in read])
    var = features.join(mapping, ["source", "local_col"]).groupBy(F.col("global_col").alias("col")).agg(*[F.first(c).alias(c) for c in ("id", "name", "type")])
    rows = spans[-1][2]
    offsets = (0, *(e for _, _, e in spans))
    return SparseMatrix(entries, rows, var.count(), obs, var, offsets, offsets)
