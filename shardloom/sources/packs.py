"""Execution packs: shards in a layout ready for use, below the path of their generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..plans import service as sv
from ..scratch import hadoop_path
from .store import Dataset


def pack_path(ds: Dataset, root: str, shard: int) -> str:
    snap = ds.snapshot()
    return f"{root}/{snap.delivery(snap.ref(), shard)}"


def write_pack(ds: Dataset, root: str, shard: int, height: int = 32) -> str:
    """The pack of a shard as sliced ELL, written beside its place and renamed; one that is there stays."""
    sv.require(ds.role, "read")
    path = pack_path(ds, root, shard)
    fs, p = hadoop_path(ds.spark, path)
    if fs.exists(p):
        return path
    a, b = ds.meta["shards"][shard], ds.meta["shards"][shard + 1]
    spine = ds.spark.range(a, b).withColumnRenamed("id", "row")
    _, new = hadoop_path(ds.spark, path + ".new")
    layout.sliced_ell(ds.shard(shard), spine, height).write.mode("overwrite").parquet(path + ".new")
    if not fs.rename(new, p):
        raise OSError(f"{path} could not be put in place")
    return path


def warm(ds: Dataset, root: str, begin: int = 0, end: int | None = None) -> list[str]:
    """The packs of a range of shards."""
    return [write_pack(ds, root, s) for s in range(begin, len(ds.meta["shards"]) - 1 if end is None else end)]


def read_pack(ds: Dataset, root: str, shard: int) -> DataFrame:
    """A pack's entries; it is made if it isn't there."""
    return layout.from_sliced_ell(ds.spark.read.parquet(write_pack(ds, root, shard)))


def invalidate(ds: Dataset, root: str) -> None:
    """Removes all packs below root."""
    fs, p = hadoop_path(ds.spark, f"{root}/packs")
    fs.delete(p, True)


def pack_sizes(ds: Dataset, root: str, shards: int) -> DataFrame:
    """(shard_id, rows, slots) of packs that are there."""
    out = None
    for s in range(shards):
        path = pack_path(ds, root, s)
        fs, p = hadoop_path(ds.spark, path)
        if fs.exists(p):
            one = ds.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("width"), F.lit(0)).cast("bigint").alias("slots")).select(F.lit(s).alias("shard_id"), "rows", "slots")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else ds.spark.createDataFrame([], "shard_id int, rows bigint, slots bigint")
