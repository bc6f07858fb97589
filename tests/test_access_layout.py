"""Access, derivation, layouts and ordering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import access, layout, ordering, union
from shardloom.matrix import SparseMatrix
from shardloom.scratch import dense_index


def frame(spark, m):
    rows = [(int(r), int(c), float(m[r, c])) for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "row bigint, col bigint, value double")


def matrix(t, shape):
    out = np.zeros(shape)
    for r in t.collect():
        out[r.row, r.col] += r.value
    return out


TINY = np.array([[1, 0, 2, 0], [0, 3, 0, 4]])


def ids(spark, n, name="row"):
    return spark.range(n).withColumnRenamed("id", name)


def test_tiny_matrix_reads(spark):
    t = frame(spark, TINY)
    rows = access.csr(t, ids(spark, 2)).orderBy("row").collect()
    assert [list(r.cols) for r in rows] == [[0, 2], [1, 3]]
    got = access.gather(t, access.request(spark, [1, 0, 1], 2)).orderBy("ord", "col").collect()
    assert [(r.ord, r.col, r.value) for r in got] == [(0, 1, 3), (0, 3, 4), (1, 0, 1), (1, 2, 2), (2, 1, 3), (2, 3, 4)]
    assert [(r.row, r.col) for r in access.read_range(t, 1, 1, 2).orderBy("col").collect()] == [(0, 1), (0, 3)]
    with pytest.raises(IndexError):
        access.request(spark, [2], 2)
    with pytest.raises(IndexError):
        access.read_range(t, 1, 2, 2)
    assert access.point(t, 1, 3).first().value == 4 and access.point(t, 0, 1).count() == 0


def test_derive(spark):
    pick = lambda xs, k: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], f"{k} bigint, new_{k} bigint")
    t = access.csr(access.derived(frame(spark, TINY), pick([1, 0], "row"), pick([3, 2, 0], "col"))).orderBy("row").collect()
    assert [list(r.cols) for r in t] == [[0], [1, 2]] and [list(r.vals) for r in t] == [[4], [2, 1]]
    for bad in ([], [0, 0]):
        with pytest.raises(ValueError):
            access.check_selection(bad, 2, "row")
    with pytest.raises(IndexError):
        access.check_selection([5], 2, "row")
    labels = ids(spark, 4).select(access.group_label(F.col("row"), [(0, 1, "late"), (2, 3, "early")]).alias("x")).collect()
    assert [r.x for r in labels] == ["late", "", "early", ""]
    with pytest.raises(ValueError):
        access.group_label(F.col("row"), [(0, 2, "a"), (1, 3, "b")])


def test_compaction(spark):
    m = np.arange(12).reshape(3, 4)
    obs = spark.createDataFrame([(0, True, "a"), (1, False, "b"), (2, True, "c")], "row bigint, keep boolean, n string")
    var = spark.createDataFrame([(c, c != 1) for c in range(4)], "col bigint, keep boolean")
    t, o, v = access.finalize(frame(spark, m), obs, var)
    assert (matrix(t, (2, 3)) == m[[0, 2]][:, [0, 2, 3]]).all()
    assert [(r.row, r.n) for r in o.orderBy("row").collect()] == [(0, "a"), (1, "c")] and v.count() == 3


def test_spans_many_and_few(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in (-1, 0, 4, 5, 9, 10)], "x bigint")
    spans = spark.createDataFrame([(0, 0, 5), (1, 5, 10)], "id bigint, row_begin bigint, row_end bigint")
    want = [(-1, None), (0, 0), (4, 0), (5, 1), (9, 1), (10, None)]
    assert sorted((r.x, r.id) for r in access.span_of(df, "x", spans, "id").collect()) == want
    monkeypatch.setattr(access, "BROADCAST_SPANS", 1)
    assert sorted((r.x, r.id) for r in access.span_of(df, "x", spans, "id").collect()) == want


@pytest.mark.parametrize("seed", range(2))
def test_layout_laws(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(1, 9, (21, 17)) * (rng.random((21, 17)) < 0.2)
    t, rows, cols = frame(spark, m), ids(spark, 21), ids(spark, 17, "col")
    assert (matrix(layout.transpose(t), (17, 21)) == m.T).all()
    assert (matrix(layout.from_csr(access.csr(t)), m.shape) == m).all()
    assert (matrix(layout.from_csc(layout.csc(t, cols)), m.shape) == m).all()
    assert (matrix(layout.from_diagonals(layout.diagonals(t)), m.shape) == m).all()
    assert [r.vals for r in layout.dense(t, rows, 17).orderBy("row").collect()] == m.tolist()
    for b in (2, 4):
        assert (matrix(layout.from_blocked_ell(layout.blocked_ell(t, b), b), m.shape) == m).all()
    assert (matrix(layout.from_sliced_ell(layout.sliced_ell(t, rows, 4)), m.shape) == m).all()
    for tune in layout.tune_blocked_ell(t, 21, (2, 4)).collect():
        b = tune.block_size
        tiles = np.array([[m[i : i + b, j : j + b].any() for j in range(0, 17, b)] for i in range(0, 21, b)])
        assert (tune.width, tune.blocks, tune.padded_bytes) == (tiles.sum(1).max(), tiles.sum(), 21 * tiles.sum(1).max() * b * 2)
    nnz = (m != 0).sum(1)
    for tune in layout.tune_sliced_ell(t, 21, (4, 8)).collect():
        h = tune.slice_rows
        slots = sum(len(nnz[i : i + h]) * nnz[i : i + h].max() for i in range(0, 21, h))
        assert tune.slots == slots and abs(tune.score - (slots / nnz.sum() + 0.25 * tune.slices / 21)) < 1e-12


def test_blocked_ell_last_wins(spark):
    t = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 5.0, 2), (0, 1, 2.0, 1), (0, 1, 0.0, 2)], "row bigint, col bigint, value double, o int")
    assert [tuple(r) for r in layout.from_blocked_ell(layout.blocked_ell(t, 2, "o"), 2).collect()] == [(0, 0, 5.0)]


def test_ordering(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(1, 9, (23, 11)) * (rng.random((23, 11)) < 0.3)
    m[:, 4] = 0
    t, rows, cols = frame(spark, m), ids(spark, 23), ids(spark, 11, "col")
    for k in (1, 5, 40):
        got = ordering.nnz_buckets(t, rows, k, 23).orderBy("rank").collect()
        assert [r.row for r in got] == sorted(range(23), key=lambda r: ((m[r] != 0).sum(), r))
        sizes = np.bincount([r.bucket for r in got])
        assert len(sizes) == min(k, 23) and sizes.tolist() == [23 // len(sizes) + (i < 23 % len(sizes)) for i in range(len(sizes))]
    pos = {r.col: r.pos for r in ordering.barycenter_order(t, cols, "col").collect()}
    key = {c: (not m[:, c].any(), np.nonzero(m[:, c])[0].mean() if m[:, c].any() else 0, c) for c in range(11)}
    assert [c for c, _ in sorted(pos.items(), key=lambda x: x[1])] == sorted(range(11), key=key.get)
    p = ordering.barycenter_order(t, cols, "col").select(F.col("col").alias("old"), F.col("pos").alias("new"))
    assert ordering.check_permutation(p, 11) and not ordering.check_permutation(p, 12)
    back = ordering.apply_order(ordering.apply_order(t, cols=p), cols=ordering.invert(p))
    assert (matrix(back, m.shape) == m).all()
    r, c = ordering.barycenter_orders(t, rows, cols)
    assert sorted(x.pos for x in r.collect()) == [*range(23)] and sorted(x.pos for x in c.collect()) == [*range(11)]
    assert sorted(x.pos for x in ordering.signature_order(t, cols, 4).collect()) == [*range(11)]
    assert ordering.block_order(layout.blocked_ell(t, 4)).count() == 6
    assert (matrix(ordering.systematic_sample(t, 23, 8), (8, 11)) == m[::3]).all()


def test_width_segments_are_optimal():
    import itertools
    import random

    rng = random.Random(0)
    for _ in range(60):
        h = {rng.randint(0, 20): rng.randint(1, 9) for _ in range(rng.randint(1, 7))}
        k, widths = rng.randint(1, 5), sorted(h)
        best = min(sum(16 + 6 * sum(h[w] for w in widths[a:b]) * widths[b - 1] for a, b in itertools.pairwise((0, *cut, len(widths)))) for n in range(min(k, len(widths))) for cut in itertools.combinations(range(1, len(widths)), n))
        cost, parts = ordering.width_segments(h, k)
        assert cost == best == sum(16 + 6 * n * w for n, w in parts) and sum(n for n, _ in parts) == sum(h.values())


def test_concat_and_union(spark):
    a, b = np.array([[1, 0], [0, 2]]), np.array([[0, 3]])
    m = union.concat_rows(SparseMatrix(frame(spark, a), 2, 2), SparseMatrix(frame(spark, b), 1, 2))
    assert (matrix(m.entries, (3, 2)) == np.vstack([a, b])).all() and m.shards == (0, 2, 3)
    with pytest.raises(ValueError):
        union.concat_rows(SparseMatrix(frame(spark, a), 2, 2), SparseMatrix(frame(spark, b), 1, 3))
    f = spark.createDataFrame([(0, 0, "x", "n", None), (0, 1, "y", "n", ""), (1, 0, "y", "n", ""), (1, 1, "z", "n", ""), (1, 2, "x", "n", "t")], "source int, local_col bigint, id string, name string, type string")
    assert sorted(tuple(r) for r in union.feature_union(f).collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_dense_index(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = dense_index(df, ["k"], "n").collect()
    assert all(r.k == r.n for r in got) and len(got) == 1000
    assert dense_index(df.limit(0), ["k"], "n").count() == 0


def test_scope_deletes_its_tables(spark):
    from pathlib import Path

    from shardloom import scratch

    with scratch.scope(spark):
        df = scratch.written(spark.range(3), "t")
        at = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert at.exists() and df.count() == 3
    assert not at.exists()
