"""python -m shardloom inspect|validate|read-rows|convert PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api
from .sources import manifest, store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "validate"):
        sub.add_parser(name).add_argument("path")
    r = sub.add_parser("read-rows")
    r.add_argument("path")
    r.add_argument("--start", type=int, default=0)
    r.add_argument("--count", type=int, default=1)
    c = sub.add_parser("convert")
    c.add_argument("manifest")
    c.add_argument("path")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        store.create(spark, manifest.ingest(spark, manifest.read_manifest(spark, a.manifest)), a.path)
        return 0
    view = api.open(a.path, spark)
    if a.command == "inspect":
        print(json.dumps(view.describe()))
    elif a.command == "validate":
        ok, why = view.dataset.validate()
        print("valid" if ok else why)
        return int(not ok)
    else:
        for row in view.dataset.read_range(a.start, a.count).orderBy("row", "col").toLocalIterator():
            print(row.row + a.start, row.col, row.value, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
