"""Datasets as folders of Parquet tables under numbered metadata.

<path>/meta/<number>.json says all about a version: the folders that hold entries, obs, var and tables, the
shards and the service generations. A version is written by creating its file, which must not exist: of two
writers that start from one version, the second fails. Data folders are never written again, so an older
version stays readable, and appending writes the new rows only. Entries are sorted by row within shard
folders, so that row ranges prune both folders and row groups.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import feature_order_hash
from ..matrix import SparseMatrix, nonzero
from ..operators import access, align, validate
from ..plans import service as sv
from ..plans.partition import find_span, spans_table
from ..scratch import hadoop_path

SCHEMA_VERSION = 1


_ENTRIES = "row bigint, col bigint, value double, shard_id bigint"


def _published(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, falling."""
    fs, p = hadoop_path(spark, f"{path}/meta")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _current(spark: SparkSession, path: str) -> dict:
    """The last version's metadata, read without a job; one that is still being written doesn't count."""
    for n in _published(spark, path):
        fs, p = hadoop_path(spark, f"{path}/meta/{n}.json")
        stream = fs.open(p)
        try:
            return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            continue
        finally:
            stream.close()
    raise FileNotFoundError(f"{path}: no dataset there")


def _publish(spark: SparkSession, path: str, meta: dict, before: int = 0) -> dict:
    """Writes metadata as the version after `before`; FileExistsError if another writer did so meanwhile."""
    last = _published(spark, path)
    if any(_current(spark, path)["version"] > before for _ in last[:1] if last[0] > before):
        raise FileExistsError(f"{path} has a version after {before}")
    meta = meta | {"version": max([before, *last]) + 1}
    fs, p = hadoop_path(spark, f"{path}/meta/{meta['version']}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "exist" in str(e.java_exception).lower():
            raise FileExistsError(f"{path} has a version after {before}") from None
        raise
    out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
    out.close()
    return meta


def _new_folder(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex[:12]}"


@dataclass(frozen=True)
class Dataset:
    """A dataset at one generation. Properties come from metadata; tables are read when an action asks."""

    spark: SparkSession
    path: str
    meta: dict
    role: str = "owner"

    @property
    def shape(self) -> tuple[int, int]:
        return self.meta["rows"], self.meta["cols"]

    @property
    def nnz(self) -> int:
        return self.meta["nnz"]

    def _table(self, name: str) -> DataFrame:
        sv.require(self.role, "read")
        folders = [f"{self.path}/{f}" for f in self.meta["folders"][name]]
        if name == "entries":
            return self.spark.read.schema(_ENTRIES).option("basePath", f"{self.path}/entries").parquet(*folders)
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)

    @property
    def obs(self) -> DataFrame:
        return self._table("obs")

    @property
    def var(self) -> DataFrame:
        return self._table("var")

    @property
    def attributes(self) -> dict[str, str]:
        return dict(self.meta["attributes"])

    def entries(self, rows: tuple[int, int] | None = None) -> DataFrame:
        """Entries, of the rows [begin, end) only if given: a filter on the shards that hold them, and on rows."""
        t = self._table("entries")
        if rows is not None:
            shards = self.meta["shards"]
            a, b = find_span(shards, rows[0]), find_span(shards, max(rows[0], rows[1] - 1))
            t = t.filter(F.col("shard_id").between(a, b) & (F.col("row") >= rows[0]) & (F.col("row") < rows[1]))
        return t.select("row", "col", "value")

    def matrix(self) -> SparseMatrix:
        return SparseMatrix(self.entries(), *self.shape, self.obs, self.var, tuple(self.meta["partitions"]), tuple(self.meta["shards"]))

    def csr(self) -> DataFrame:
        """All rows, without and with entries, as csr()."""
        return access.csr(self.entries(), self.spark.range(self.shape[0]).withColumnRenamed("id", "row"))

    def rows(self, wanted: list[int]) -> DataFrame:
        """gather() of a list of rows, in its order; only the shards that hold one are read."""
        ask = access.request(self.spark, wanted, self.shape[0])
        shards = sorted({find_span(self.meta["shards"], r) for r in wanted})
        t = self._table("entries").filter(F.col("shard_id").isin(shards)) if shards else self._table("entries").limit(0)
        return access.gather(t.select("row", "col", "value"), ask)

    def read_range(self, start: int, count: int) -> DataFrame:
        access.read_range(self.entries(), start, count, self.shape[0])
        return access.read_range(self.entries((start, start + count)), start, count, self.shape[0])

    def partition(self, i: int) -> DataFrame:
        p = self.meta["partitions"]
        return self.entries((p[i], p[i + 1]))

    def shard(self, i: int) -> DataFrame:
        s = self.meta["shards"]
        return self.entries((s[i], s[i + 1]))

    def head(self, n: int = 5) -> DataFrame:
        return access.head(self.obs, "row", n)

    @property
    def service(self) -> sv.Service:
        return sv.Service(**self.meta["service"])

    def snapshot(self) -> sv.Snapshot:
        summary = {k: v for k, v in self.meta.items() if k not in ("service", "shards", "folders", "tables", "version")} | {"shards": len(self.meta["shards"]) - 1, "shard_offsets": self.meta["shards"]}
        return sv.Snapshot(self.path, summary, self.service)

    def describe(self) -> dict:
        return {"path": self.path, "rows": self.shape[0], "cols": self.shape[1], "nnz": self.nnz, "partitions": len(self.meta["partitions"]) - 1, "shards": len(self.meta["shards"]) - 1, "generation": self.service.active}

    def refresh(self) -> Dataset:
        return open_dataset(self.spark, self.path, self.role)

    def validate(self) -> tuple[bool, str]:
        """Whether tables and metadata agree, and what is wrong if not."""
        rows, cols = self.shape
        t = self.entries()
        if bad := validate.bad_entries(t, rows, cols).limit(1).count():
            return False, f"{bad} entry outside the matrix or without a number"
        if (n := nonzero(t).count()) != self.nnz:
            return False, f"{n} entries, the metadata say {self.nnz}"
        for name, key, extent in (("obs", "row", rows), ("var", "col", cols)):
            if (n := self._table(name).select(key).distinct().count()) != extent:
                return False, f"{name} has {n} lines for an extent of {extent}"
        if not self.meta["feature_hash"] or self.meta["feature_hash"] != _feature_hash(self.var):
            return False, "the order of features isn't what its hash says"
        p = self.meta["partitions"]
        return (False, "shard offsets are not on partition bounds") if not {*self.meta["shards"]} <= {*p} or p[-1] != rows else (True, "")


def _feature_hash(var: DataFrame) -> int:
    """FNV-1a of the features' ids in order, read in turn so that the driver holds a part of them at a time."""
    name = next((c for c in ("id", "feature_id", "name", "_index") if c in var.columns), "col")
    return feature_order_hash(str(r[0]) for r in var.orderBy("col").select(name).toLocalIterator())


def _write_part(spark: SparkSession, m: SparseMatrix, path: str, offset: int, shards: tuple[int, ...], first_shard: int) -> tuple[dict, int]:
    """Writes m's entries and rows, numbered from offset on, to folders of their own: (their names, number of entries)."""
    names = {"entries": [f"entries/part={uuid.uuid4().hex[:12]}"], "obs": [_new_folder("obs")]}
    t = access.span_of(nonzero(m.entries).select("row", "col", F.col("value").cast("double").alias("value")), "row", spans_table(spark, shards, "shard_id"), "shard_id")
    t = t.select((F.col("row") + offset).alias("row"), "col", "value", (F.col("shard_id") + first_shard).alias("shard_id"))
    t.repartitionByRange("shard_id", "row").sortWithinPartitions("shard_id", "row", "col").write.partitionBy("shard_id").parquet(f"{path}/{names['entries'][0]}")
    obs = m.obs if m.obs is not None else spark.range(m.rows).withColumnRenamed("id", "row")
    obs.withColumn("row", F.col("row") + offset).write.parquet(f"{path}/{names['obs'][0]}")
    return names, Dataset(spark, path, {"folders": names}).entries().count()


def create(spark: SparkSession, m: SparseMatrix, path: str, attributes: dict[str, str] | None = None, role: str = "builder") -> Dataset:
    """Writes a matrix as generation 1 of a new dataset."""
    sv.require(role, "build")
    fs, p = hadoop_path(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    partitions = m.partitions or (0, m.rows)
    shards = m.shards or partitions
    if m.rows and not {*shards} <= {*partitions}:
        raise ValueError("a shard ends inside a partition")
    folders, nnz = _write_part(spark, m, path, 0, shards, 0)
    folders["var"] = [_new_folder("var")]
    (m.var if m.var is not None else spark.range(m.cols).withColumnRenamed("id", "col")).write.parquet(f"{path}/{folders['var'][0]}")
    meta = {"schema": SCHEMA_VERSION, "rows": m.rows, "cols": m.cols, "partitions": [*partitions], "shards": [*shards], "attributes": attributes or {}, "service": asdict(sv.Service()), "folders": folders, "tables": {}, "nnz": nnz}
    meta["feature_hash"] = _feature_hash(Dataset(spark, path, meta).var)
    return Dataset(spark, path, _publish(spark, path, meta))


def open_dataset(spark: SparkSession, path: str, role: str = "owner") -> Dataset:
    """Reads metadata only. An executor sees what is published, like anyone; it may not write."""
    meta = _current(spark, path)
    if meta["schema"] != SCHEMA_VERSION:
        raise ValueError(f"{path} has schema {meta['schema']}, this reads {SCHEMA_VERSION}")
    return Dataset(spark, path, meta, role)


def append(ds: Dataset, more: SparseMatrix, attributes: dict[str, str] | None = None) -> Dataset:
    """A new generation with more's rows below, and attributes added: only they are written, then published in one file.

    FileExistsError if another writer published meanwhile; what was written for it is read by nobody.
    """
    sv.require(ds.role, "write")
    current = ds.refresh()
    meta, (rows, cols) = current.meta, current.shape
    if more.cols != cols:
        raise ValueError(f"{more.cols} and {cols} columns can't be stacked")
    partitions = more.partitions or (0, more.rows)
    shards = more.shards or partitions
    folders, nnz = _write_part(ds.spark, more, ds.path, rows, shards, len(meta["shards"]) - 1)
    now = sv.publish(current.service, sv.stage(current.service))
    meta = meta | {
        "rows": rows + more.rows,
        "nnz": meta["nnz"] + nnz,
        "partitions": meta["partitions"] + [x + rows for x in partitions[1:]],
        "shards": meta["shards"] + [x + rows for x in shards[1:]],
        "folders": {k: v + folders.get(k, []) for k, v in meta["folders"].items()},
        "attributes": meta["attributes"] | (attributes or {}),
        "service": asdict(now),
    }
    return Dataset(ds.spark, ds.path, _publish(ds.spark, ds.path, meta, current.meta["version"]), ds.role)


def put_table(ds: Dataset, name: str, table: DataFrame, key: str | None = None) -> Dataset:
    """Adds or replaces a table: annotations by row or col, one line for each, or any table without a key. It stays through later appends."""
    sv.require(ds.role, "metadata")
    current = ds.refresh()
    if key is not None:
        extent = current.shape[0] if key == "row" else current.shape[1]
        if bad := validate.table(table, key, extent):
            raise ValueError(f"{name}: {bad}")
    folder = _new_folder("table")
    table.write.parquet(f"{ds.path}/{folder}")
    meta = current.meta | {"tables": current.meta["tables"] | {name: folder}}
    return Dataset(ds.spark, ds.path, _publish(ds.spark, ds.path, meta, current.meta["version"]), ds.role)


def get_table(ds: Dataset, name: str) -> DataFrame:
    sv.require(ds.role, "read")
    tables = ds.meta["tables"] if name in ds.meta["tables"] else ds.refresh().meta["tables"]
    if name not in tables:
        raise KeyError(f"{ds.path} has no table {name}")
    return ds.spark.read.parquet(f"{ds.path}/{tables[name]}")


def put_attributes(ds: Dataset, attributes: dict[str, str]) -> Dataset:
    """The dataset with these attributes added or replaced."""
    sv.require(ds.role, "metadata")
    meta = ds.refresh().meta
    return Dataset(ds.spark, ds.path, _publish(ds.spark, ds.path, meta | {"attributes": meta["attributes"] | attributes}, meta["version"]), ds.role)


def derive(ds: Dataset, path: str, rows: list[int], features: list[int], row_groups=(), feature_groups=()) -> Dataset:
    """A new dataset of the selected rows and features in their order, with group labels and where it came from."""
    access.check_selection(rows, ds.shape[0], "row")
    access.check_selection(features, ds.shape[1], "feature")
    pick = lambda xs, k: ds.spark.createDataFrame([(x, i) for i, x in enumerate(xs)], f"{k} bigint, new_{k} bigint")
    r, c = pick(rows, "row"), pick(features, "col")
    m = SparseMatrix(access.derived(ds.entries(), r, c), len(rows), len(features), access.annotate(ds.obs, "row", r, [*row_groups], "derived_row_group"), access.annotate(ds.var, "col", c, [*feature_groups], "derived_feature_group"))
    return create(ds.spark, m, path, ds.attributes | {"derived.parent_path": ds.path, "derived.parent_snapshot": str(ds.snapshot().id)})


def create_multi_assay(spark: SparkSession, assays: dict[str, SparseMatrix], row_map: DataFrame, global_rows: int, kind: str, path: str) -> None:
    """One dataset per assay below path, and the row map; exact or partial pairing."""
    for name, m in assays.items():
        if not align.map_is_inverse(row_map, name, m.rows, global_rows):
            raise ValueError(f"the row map of {name} isn't one to one")
        if m.var is not None and m.var.count() != m.cols:
            raise ValueError(f"{name} has {m.cols} columns and another number of features")
    if not align.pairing_is_valid(row_map, global_rows, kind):
        raise ValueError(f"the pairing isn't {kind}")
    for name, m in assays.items():
        create(spark, m, f"{path}/{name}")
    row_map.write.parquet(f"{path}/row_map")


def write_h5ad(ds: Dataset, path: str, most: int = 100_000_000) -> None:
    """An AnnData file, where anndata is installed, of a matrix that fits on the driver."""
    try:
        import anndata
        import scipy.sparse as sp
    except ImportError as e:
        raise ImportError("writing .h5ad files needs anndata and scipy") from e
    if ds.nnz > most:
        raise ValueError(f"{ds.nnz} entries are too many for the driver; derive a smaller dataset")
    t = ds.entries().toPandas()
    anndata.AnnData(sp.csr_matrix((t.value.astype("float32"), (t.row, t.col)), ds.shape), ds.obs.orderBy("row").toPandas(), ds.var.orderBy("col").toPandas(), uns=ds.attributes).write(path)
