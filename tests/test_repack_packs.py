"""Composed operators, packs, tables of a dataset, spans and the command line."""

import numpy as np
import pytest

from shardloom import __main__ as cli
from shardloom.matrix import SparseMatrix
from shardloom.operators import layout, repack
from shardloom.plans.partition import Spans
from shardloom.sources import packs, store

from test_access_layout import TINY, frame, ids, matrix


def test_repack_is_the_filtered_matrix_in_bucket_order(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(1, 9, (13, 9)) * (rng.random((13, 9)) < 0.4)
    keep_r, keep_c = rng.random(13) < 0.7, rng.random(9) < 0.8
    obs = spark.createDataFrame([(i, bool(k)) for i, k in enumerate(keep_r)], "row bigint, keep boolean")
    var = spark.createDataFrame([(i, bool(k)) for i, k in enumerate(keep_c)], "col bigint, keep boolean")
    blocks, order = repack.repack(frame(spark, m), obs, var, 3, 4)
    own = m[keep_r][:, keep_c]
    rows = {r.exec_row: r.row for r in order.collect()}
    assert sorted(rows) == [*range(len(own))]
    assert (matrix(layout.from_blocked_ell(blocks, 4), own.shape) == m[[rows[i] for i in range(len(own))]][:, keep_c]).all()
    nnz = [(m[rows[i]][keep_c] != 0).sum() for i in range(len(own))]
    assert nnz == sorted(nnz)
    s = repack.filter_stats(frame(spark, m), 13, 9, 4, obs, var).first()
    assert s.live == (own != 0).sum() and s.slots - s.live == s.dead_slots


def test_views_orders_samples(spark):
    t, rows, cols = frame(spark, TINY), ids(spark, 2), ids(spark, 4, "col")
    view, order = repack.bucketed_view(t, rows, 2, 2)
    assert sorted((r.bucket, r.exec_row, r.row) for r in view.collect()) == [(0, 0, 0), (1, 1, 1)] and order.count() == 2
    name, size = repack.choose_order(t, rows, cols, 2, 2)
    assert name in size and all(len(x) == 2 for x in size.values())
    shards = spark.createDataFrame([(0, 0), (1, 0)], "row bigint, shard_id bigint")
    assert repack.shard_buckets_view(t, shards, 2).count() == 2
    obs = spark.createDataFrame([(0, "a"), (1, "a")], "row bigint, g string")
    assert repack.sampled_rows(t, obs, "g", 1).select("row").distinct().count() == 1
    assert repack.fill_ratio(4, 2, 4) == 0.5 and repack.fill_ratio(0, 0, 0) == 0
    assert repack.width_segments(layout.blocked_ell(t, 2), 1, 4).first().segment == 0


def test_packs_and_tables(spark, tmp_path, capsys):
    path, root = f"file://{tmp_path}/ds", f"file://{tmp_path}/cache"
    ds = store.create(spark, SparseMatrix(frame(spark, TINY), 2, 4, partitions=(0, 1, 2)), path)
    assert packs.warm(ds, root) == [packs.pack_path(ds, root, s) for s in (0, 1)]
    assert (matrix(packs.read_pack(ds, root, 1), (2, 4))[1] == TINY[1]).all() and packs.pack_sizes(ds, root, 2).count() == 2
    packs.invalidate(ds, root)
    assert packs.pack_sizes(ds, root, 2).count() == 0
    store.put_table(ds, "qc", spark.createDataFrame([(0, 1.0), (1, 2.0)], "row bigint, total float"), "row")
    assert store.get_table(ds, "qc").count() == 2
    with pytest.raises(ValueError):
        store.put_table(ds, "bad", spark.createDataFrame([(0, 1.0)], "row bigint, total float"), "row")
    with pytest.raises(PermissionError):
        store.put_table(store.open_dataset(spark, path, "executor"), "x", ids(spark, 2))
    assert store.put_attributes(ds, {"study": "demo"}).attributes == {"study": "demo"}
    assert cli.main(["inspect", path]) == 0 and cli.main(["validate", path]) == 0 and cli.main(["read-rows", path, "--start", "1"]) == 0
    out = capsys.readouterr().out
    assert '"rows": 2' in out and "valid" in out and "1\t3\t4.0" in out


def test_spans():
    s = Spans([0, 2, 2, 5, 9], [0, 5, 9])
    assert s.partition_of(4) == 2 and s.shard_of(5) == 1 and s.shard_partitions(0) == (0, 3) and s.shard_rows(1) == (5, 9)
    assert s.partition_rows(0) == (0, 2) and s.is_bound(5) and not s.is_bound(6) and s.shard_sums([1, 2, 3, 4]) == [6, 4]
    with pytest.raises(ValueError):
        Spans([0, 2], [0, 1, 2])
