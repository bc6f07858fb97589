"""Plans, alignment, sources, store, versions and streams."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom import api
from shardloom.functions import scalars
from shardloom.matrix import SparseMatrix
from shardloom.operators import access, align, validate
from shardloom.plans import partition as plan
from shardloom.plans import service as sv
from shardloom.sources import columnar, manifest, mtx, store
from shardloom.streaming import append as stream

from test_access_layout import TINY, frame, ids, matrix


def test_partition_folds(spark):
    assert plan.partitions_by_nnz([3, 3, 3, 9, 0, 1], 6) == [0, 2, 3, 4, 6] and plan.partitions_by_nnz([3, 9], 0) == [0, 2] and plan.partitions_by_nnz([], 5) == [0]
    nnz = spark.createDataFrame([*enumerate([3, 3, 3, 9, 0, 1])], "row bigint, nnz bigint")
    assert [r.partition_id for r in plan.partition_table(nnz, 6).orderBy("row").collect()] == [0, 0, 1, 2, 3, 3]
    assert plan.range_partitions(nnz, 6, 6) == [0, 2, 3, 4, 6]
    assert plan.by_limit([(5, 1), (5, 9), (1, 1)], nnz=10, size=8) == [0, 1, 2, 3]
    assert plan.shards_by_rows([4, 4, 4], 8) == [0, 8, 12] and plan.shards_by_rows([4, 4], 0) == [0, 4, 8]
    assert plan.shards_by([5, 0, 5, 1], [0, 2, 4, 6, 8], 5) == [0, 4, 6, 8]
    assert plan.equal_shards([3, 3, 3, 3], 2) == [0, 6, 12] and plan.equal_shards([10, 1, 1], 3) == [0, 10, 11, 12]
    assert plan.check_reshard([0, 4, 8], [0, 4, 6, 8]) == "" and plan.check_reshard([0, 5, 8], [0, 4, 8]) and plan.check_reshard([0, 4], [0, 4, 8])
    assert [plan.find_span([0, 3, 3, 7], x) for x in (0, 2, 3, 6, 7, -1)] == [0, 0, 2, 2, 3, 3]
    assert plan.round_robin(5, 2) == [0, 1, 0, 1, 0] and plan.by_bytes([5, 9, 5, 3], 2) == [1, 0, 1, 0]


def test_alignment(spark):
    exact = [("rna", i, i) for i in range(3)] + [("atac", i, i) for i in range(3)]
    partial = [("rna", i, i) for i in range(3)] + [("atac", 0, 0), ("atac", 2, 1)]
    table = lambda rows: spark.createDataFrame(rows, "assay_id string, global_row bigint, assay_row bigint")
    e, p = table(exact), table(partial)
    spine = spark.range(3).withColumnRenamed("id", "global_row")
    assert tuple(align.resolve_rows(e, spine, ["rna", "atac"]).filter("global_row = 2").first())[1:] == (2, 2)
    assert tuple(align.resolve_rows(p, spine, ["rna", "atac"]).filter("global_row = 1").first())[1:] == (1, None)
    assert align.pairing_is_valid(e, 3, "exact") and not align.pairing_is_valid(p, 3, "exact") and align.pairing_is_valid(p, 3, "partial")
    with pytest.raises(ValueError):
        align.pairing_is_valid(p, 3, "loose")
    assert align.map_is_inverse(p, "atac", 2, 3) and not align.map_is_inverse(table([("atac", 0, 0), ("atac", 0, 1), ("atac", 2, 2)]), "atac", 3, 3)
    w = plan.spans_table(spark, [0, 2, 3], "window_id")
    got = {(r.window_id, r.assay_id): (r.local_begin, r.local_end, r.contiguous) for r in align.local_window(p, w).collect()}
    assert got[0, "atac"] == (0, 1, True) and got[1, "atac"] == (1, 2, True) and got[0, "rna"] == (0, 2, True)
    atac = spark.createDataFrame([("atac", 0, 1, 6.0), ("atac", 1, 3, 9.0)], "assay_id string, row bigint, col bigint, value double")
    assert [(r.row, r.col) for r in align.assay_range(atac, "atac", 1, 1).collect()] == [(0, 3)]


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_matrix_market(spark, tmp_path):
    general = write(tmp_path / "a.mtx", "﻿%%MatrixMarket matrix coordinate real general\n% a comment\n\n2 4 5\n2 4 4\n1\t1 1\n1 3  2\n2 2 3\n1 2 0\n")
    m = mtx.read_entries(spark, general)
    assert m.shape == (2, 4) and (matrix(m.entries, (2, 4)) == TINY).all() and m.nnz() == 4
    s = mtx.read_entries(spark, write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 5\n2 1 7\n"))
    assert (matrix(s.entries, (2, 2)) == [[5, 7], [7, 0]]).all()
    p = mtx.read_entries(spark, write(tmp_path / "p.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n"))
    assert (matrix(p.entries, (2, 2)) == [[0, 0], [1, 0]]).all()
    same = mtx.read_entries(spark, write(tmp_path / "d.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n2 2 2\n1 1 1\n"))
    assert (matrix(same.entries, (2, 2)) == [[1, 0], [0, 2]]).all()
    for bad in ("%%MatrixMarket matrix coordinate complex general\n1 1 0\n", "%%MatrixMarket matrix array real general\n1 1\n", "%%MatrixMarket matrix coordinate real general\n"):
        with pytest.raises(ValueError):
            mtx.parse_header(bad.splitlines())
    for line in ("0 1 1", "3 1 1", "1 x 1"):
        with pytest.raises(Exception, match="no entry"):
            mtx.read_entries(spark, write(tmp_path / f"{line[0]}{line[2]}.mtx", f"%%MatrixMarket matrix coordinate real general\n2 2 1\n{line}\n")).entries.collect()
    parts = mtx.partitioned(m, [0, 1, 2])
    assert sorted(tuple(r) for r in parts.filter("value <> 0").collect()) == [(0, 0, 0, 1.0), (0, 0, 2, 2.0), (1, 0, 1, 3.0), (1, 0, 3, 4.0)]


def test_text_tables_and_ingest(spark, tmp_path):
    head = "%%MatrixMarket matrix coordinate real general\n"
    a = write(tmp_path / "a.mtx", head + "2 2 2\n1 1 1\n2 2 2\n")
    b = write(tmp_path / "b.mtx", head + "1 2 2\n1 1 5\n1 2 6\n")
    fa, fb = write(tmp_path / "fa.tsv", "x\tX\tgene\ny\tY\n"), write(tmp_path / "fb.tsv", "y\tY\t\nz\tZ\tgene\n")
    ba, bb = write(tmp_path / "ba.tsv", "c1\n\nc2\n"), write(tmp_path / "bb.tsv", "c3\n")
    m = write(tmp_path / "m.tsv", f"sample\tpath\tformat\tfeatures\tbarcodes\tallow_processed\na\t{a}\tmtx\t{fa}\t{ba}\tyes\nskip\tp\tloom\t\t\t\nb\t{b}\ttenx_mtx\t{fb}\t{bb}\tNO\n")
    sources = manifest.read_manifest(spark, m)
    assert [s.format for s in sources] == ["mtx", "loom", "tenx_mtx"] and sources[0].allow_processed
    got = manifest.ingest(spark, sources)
    assert got.shape == (3, 3) and (matrix(got.entries, (3, 3)) == [[1, 0, 0], [0, 2, 0], [0, 5, 6]]).all()
    assert [r.barcode for r in got.obs.orderBy("row").collect()] == ["c1", "c2", "c3"]
    assert [r.id for r in got.var.orderBy("col").collect()] == ["x", "y", "z"]
    assert manifest.parse_manifest(["d\tp\tmystery"], header=False)[0].format == "unknown"
    with pytest.raises(ValueError):
        manifest.parse_manifest(["dataset\tpath\tallow_processed", "a\tp\tmaybe"])
    meta = write(tmp_path / "meta.tsv", "stage\tbatch\nE8\tA\nP0\tB\n")
    assert [tuple(r) for r in mtx.read_metadata(spark, meta).orderBy("row").collect()] == [(0, "E8", "A"), (1, "P0", "B")]
    with pytest.raises(Exception, match="fields"):
        mtx.read_metadata(spark, write(tmp_path / "bad.tsv", "a\tb\n1\n")).collect()


def test_columnar_source(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    frame(spark, TINY * 0.5).write.parquet(f"{root}/X")
    frame(spark, TINY).write.parquet(f"{root}/layers/counts")
    spark.createDataFrame([(0, "a", 1), (1, "b", 0)], "row bigint, _index string, flag int").write.parquet(f"{root}/obs")
    spark.createDataFrame([(c, f"g{c}", f"G{c}") for c in range(4)], "col bigint, _index string, gene_symbol string").write.parquet(f"{root}/var")
    s = manifest.Source("d", root, "h5ad", matrix_source="layer:counts")
    m = manifest.read_source(spark, s)
    assert m.shape == (2, 4) and m.var.orderBy("col").first().name == "G0" and m.obs.orderBy("row").first().barcode == "a"
    with pytest.raises(ValueError, match="counts"):
        manifest.read_source(spark, manifest.Source("d", root, "h5ad"))
    assert manifest.read_source(spark, manifest.Source("d", root, "h5ad", allow_processed=True)).nnz() == 4
    assert columnar.matrix_paths("raw_x") == ("raw/X", "raw/var")
    with pytest.raises(ValueError):
        columnar.matrix_paths("layers")
    t = spark.createDataFrame([(0, 1, 5, 1.5, "x", 2), (1, 0, 6, 2.5, None, 9)], "row bigint, f int, n int, d double, s string, _h int")
    assert columnar.infer_columns(t, "row").dtypes == [("row", "bigint"), ("f", "smallint"), ("n", "float"), ("d", "float"), ("s", "string")]
    assert [r.c for r in columnar.decode_categorical(spark.createDataFrame([(0,), (1,), (-1,), (5,)], "c int"), "c", ["a", "b"]).collect()] == ["a", "b", "", ""]


def test_store_versions_and_views(spark, tmp_path):
    path = f"file://{tmp_path}/ds"
    obs = spark.createDataFrame([(0, "cell_a"), (1, "cell_b")], "row bigint, barcode string")
    var = spark.createDataFrame([(c, f"gene{c}") for c in range(4)], "col bigint, id string")
    ds = store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4, obs, var, (0, 1, 2)), path, {"study": "demo"})
    assert ds.shape == (2, 4) and ds.nnz == 4 and ds.validate() == (True, "") and ds.attributes == {"study": "demo"}
    assert (matrix(ds.partition(1), (2, 4)) == [[0] * 4, [0, 3, 0, 4]]).all() and ds.read_range(1, 1).count() == 2
    assert "PartitionFilters: [isnotnull(shard_id" in ds.entries((1, 2))._jdf.queryExecution().toString()
    with pytest.raises(FileExistsError):
        store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4), path)
    view = api.open(path, spark)
    assert view[0].count() == 2 and view[::-1].orderBy("ord").first().row == 1 and view[[1, 1]].count() == 4 and view.head(9).count() == 4
    assert view.matrix("csr").count() == 2 and view.matrix("csc").count() == 4 and api.at(view, 1, 3) == 4 and api.at(view, 0, 1) is None
    for bad in ("01", [-1], [7]):
        with pytest.raises((TypeError, IndexError, ValueError)):
            view.rows(bad)
    old = ds.snapshot()
    grown = store.append(ds, SparseMatrix(frame(spark, TINY), 2, 4))
    assert grown.shape == (4, 4) and grown.nnz == 8 and grown.service.active == 2 and grown.service.epoch == 2 and grown.validate()[0]
    assert ds.entries().count() == 4, "an older generation stays readable"
    with pytest.raises(sv.Stale, match="canonical_generation"):
        grown.snapshot().check(old.ref())
    assert view.shape == (4, 4), "a stale view refreshes itself"
    with pytest.raises(PermissionError):
        store.append(store.open_dataset(spark, path, "executor"), SparseMatrix(frame(spark, TINY), 2, 4))
    child = store.derive(grown, f"file://{tmp_path}/child", [1, 0], [3, 2, 0], [(0, 1, "late"), (1, 2, "early")])
    assert (matrix(child.entries(), (2, 3)) == [[4, 0, 0], [0, 2, 1]]).all() and child.attributes["derived.parent_path"] == path
    assert [r.derived_row_group for r in child.obs.orderBy("row").collect()] == ["late", "early"]
    with pytest.raises(ValueError):
        store.derive(grown, f"file://{tmp_path}/x", [0, 0], [1])


def test_append_writes_new_rows_only_and_tables_stay(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ds"
    ds = store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4), path)
    ds = store.put_table(ds, "notes", spark.createDataFrame([(0, "a"), (1, "b")], "row bigint, note string"), "row")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    one = ds
    for i in range(3):
        ds = store.append(ds, SparseMatrix(frame(spark, TINY + i), 2, 4, spark.createDataFrame([(0, i), (1, i)], "row bigint, batch int")))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {p: after[p] for p in before} == before
    assert spark.read.parquet(f"{path}/{ds.meta['folders']['entries'][-1]}").select("row").distinct().count() == 2
    assert ds.shape == (8, 4) and ds.validate() == (True, "") and ds.nnz == ds.entries().count() and ds.obs.columns == ["row", "batch"]
    assert (matrix(ds.entries((4, 6)), (6, 4))[4:] == TINY + 1).all()
    assert store.get_table(ds, "notes").count() == 2 == store.get_table(one, "notes").count()
    with pytest.raises(KeyError):
        store.get_table(ds, "other")
    # Of two writers that start from one version, the second fails.
    stale = store.open_dataset(spark, path)
    store.put_attributes(stale, {"x": "1"})
    monkeypatch.setattr(store.Dataset, "refresh", lambda self: self)
    with pytest.raises(FileExistsError):
        store.append(stale, SparseMatrix(frame(spark, TINY), 2, 4))
    monkeypatch.undo()
    assert ds.refresh().shape == (8, 4) and ds.refresh().attributes == {"x": "1"}


def test_properties_run_no_job(spark, tmp_path):
    path = f"file://{tmp_path}/ds"
    store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4), path)
    spark.sparkContext.setJobGroup("properties", "")
    view = api.open(path, spark)
    assert view.shape == (2, 4) and view.dataset.describe()["rows"] == 2 if hasattr(view, "dataset") else view.shape == (2, 4)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("properties")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_offsets_match_the_fold(spark):
    rng = random.Random(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    for most in (0, 1, 5, 20):
        w = [rng.choice([0, 0, 1, 2, 3, 30]) for _ in range(120)]
        t = spark.createDataFrame([*enumerate(w)], "row bigint, nnz bigint").repartition(5)
        assert plan.partition_offsets(t, most) == plan.partitions_by_nnz(w, most)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan.partition_offsets(t.limit(0), 5) == [0]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().toString()


def test_plans(spark, tmp_path):
    rng = np.random.default_rng(0)
    frame(spark, (rng.random((40, 30)) < 0.3).astype(float)).write.parquet(f"{tmp_path}/e")
    t = spark.read.parquet(f"{tmp_path}/e")
    spans = plan.spans_table(spark, [0, 3, 9, 40], "shard_id")
    assert "NestedLoop" not in plan_of(access.span_of(t, "row", spans, "shard_id"))
    gathered = access.gather(t.groupBy("row", "col").agg(F.sum("value").alias("value")), access.request(spark, [3, 3, 1], 40))
    text = gathered._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (" in text[text.index("Aggregate") :] or "INSET" in text[text.index("Aggregate") :], "requested rows are a filter below the sums"
    assert plan.partition_table(t.groupBy("row").agg(F.count("col").alias("nnz")), 20).count() == 40


def test_service():
    s = sv.Service(canonical=11, plan=12, pack=13, epoch=14, active=15, staged=16)
    staged = sv.stage(s)
    assert (staged.canonical, staged.plan, staged.pack, staged.staged, staged.active, staged.epoch) == (17, 17, 17, 17, 15, 14)
    now = sv.publish(s, staged)
    assert (now.active, now.staged, now.epoch) == (17, 17, 15)
    snap = sv.Snapshot("p", {"shards": 1, "rows": 2}, s)
    assert snap.delivery(snap.ref(), 0) == "packs/plan.12-pack.13-epoch.14/shard.0"
    with pytest.raises(sv.Stale, match="pack_generation"):
        snap.check(snap.ref() | {"pack_generation": 14})
    with pytest.raises(IndexError):
        snap.delivery(snap.ref(), 1)
    assert sv.loads(snap.dumps()) == snap and sv.Snapshot("other", snap.summary, s).id == snap.id
    with pytest.raises(ValueError):
        sv.loads(snap.dumps().replace('"rows": 2', '"rows": 3'))
    with pytest.raises(ValueError):
        sv.publish(s, sv.Service(active=5, staged=0))
    with pytest.raises(ValueError):
        sv.stage(sv.Service(append_only=False))
    c = sv.PackCache(10)
    assert c.load("a", 6) == [] and c.load("b", 6) == ["a"]
    c.pin("b")
    assert c.load("c", 6) == [] and not c.evict("b") and c.evict("c")
    assert sv.memory_budget(0) == sv.LEAST_CACHE and sv.memory_budget(1 << 40) == sv.MOST_CACHE and sv.cache_budget(100, 50) == 25


def test_multi_assay(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 1, 0)], "assay_id string, global_row bigint, assay_row bigint")
    m = {"a": SparseMatrix(frame(spark, TINY), 2, 4), "b": SparseMatrix(frame(spark, TINY[:1]), 1, 4)}
    with pytest.raises(ValueError, match="exact"):
        store.create_multi_assay(spark, m, rows, 2, "exact", f"file://{tmp_path}/x")
    store.create_multi_assay(spark, m, rows, 2, "partial", f"file://{tmp_path}/m")
    assert store.open_dataset(spark, f"file://{tmp_path}/m/b").shape == (1, 4)


def test_validation(spark):
    part = lambda a, b, n: {"row_begin": a, "row_end": b, "rows": b - a, "nnz": n}
    good = [part(0, 2, 3), part(2, 5, 4)]
    assert validate.layout(good, [0, 2, 5], 5, 7) == ""
    for bad in ((good[1:], [], 5, 7), (good, [0, 3, 5], 5, 7), (good, [], 6, 7), (good, [], 5, 8), ([good[0] | {"rows": 9}, good[1]], [], 5, 7)):
        assert validate.layout(*bad)
    t = spark.createDataFrame([(0, 0, 1.0), (5, 0, 1.0), (0, 9, 1.0), (0, 1, float("nan")), (0, 2, None), (0, 3, float("inf"))], "row bigint, col bigint, value double")
    assert validate.bad_entries(t, 5, 5).count() == 5
    assert validate.table(spark.createDataFrame([(0, "x"), (1, "y")], "row bigint, a string"), "row", 2) == ""
    assert validate.table(spark.createDataFrame([(0, "x")], "row bigint, a string"), "row", 2) and validate.table(spark.createDataFrame([(0, [1])], "row bigint, a array<int>"), "row", 1)
    assert validate.csr_arrays([0, 2, 4], [0, 2, 1, 3], [1, 2, 3, 4], 4) == "" and validate.csr_arrays([0, 2], [0], [1], 4) and validate.csr_arrays([0, 1], [7], [1], 4)


def test_scalars(spark):
    df = spark.createDataFrame([(" a b/c ", "12", "yes"), ("__", "", ""), (None, "x", "maybe")], "s string, n string, f string")
    got = df.select(scalars.sanitize_label(F.col("s"), "none").alias("s"), scalars.parse_count(F.col("n")).alias("n"), scalars.parse_flag(F.col("f")).alias("f"), scalars.default_name(F.col("s"), "c", F.lit(3)).alias("d")).collect()
    assert [tuple(r) for r in got] == [("a_b_c", 12, True, " a b/c "), ("none", 0, False, "__"), ("none", None, None, "c3")]
    assert scalars.feature_order_hash(["a", "b"]) != scalars.feature_order_hash(["ab"]) and scalars.fnv1a(b"") == 1469598103934665603
    halves = spark.createDataFrame([(1.0,), (2049.0,), (70000.0,)], "v double").select(scalars.half("v").alias("h")).collect()
    assert [r.h for r in halves] == [1.0, 2048.0, float("inf")]
    rng = random.Random(1)
    xs = [tuple(rng.randrange(1 << 32) for _ in range(3)) for _ in range(20)]
    out = spark.createDataFrame(xs, "a bigint, b bigint, c bigint").select(scalars.mad_u32(F.col("a"), F.col("b"), F.col("c")).alias("x"), scalars.sub_u32(F.col("a"), F.col("b")).alias("y")).collect()
    assert [(r.x, r.y) for r in out] == [((a * b + c) % 2**32, (a - b) % 2**32) for a, b, c in xs]
    assert scalars.unpack_blocked_aux(scalars.pack_blocked_aux(5, 16)) == (5, 16) and scalars.unpack_sliced_aux(scalars.pack_sliced_aux(9, 2)) == (9, 2)


def test_stream_publishes_batches(spark, tmp_path):
    path = f"file://{tmp_path}/ds"
    ds = store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4), path)
    events = spark.createDataFrame([(u, i % 4, 1.0) for u, i in itertools.product((7, 8), range(6))], "u bigint, c int, v double")
    events.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        q = stream.publish_batches(ds, spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp", "u", "c", "v")
        q.awaitTermination()
    got = ds.refresh()
    assert got.shape == (4, 4) and got.service.active == 2 and got.nnz == 12
    assert (matrix(got.entries(), (4, 4))[2:] == [[2, 2, 1, 1]] * 2).all()


def test_ids_helper(spark):
    assert np.array([r.row for r in ids(spark, 3).collect()]).tolist() == [0, 1, 2]
