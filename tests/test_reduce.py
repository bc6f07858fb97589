"""Masked and grouped reductions on literal matrices and against NumPy."""

import numpy as np
import pytest

from shardloom.matrix import SparseMatrix, triplets
from shardloom.operators import access, reduce

# 4 x 5, CSR literals.
PTR, IDX, VAL = [0, 3, 4, 8, 10], [0, 1, 2, 0, 0, 1, 2, 4, 1, 4], [5, 3, 7, 9, 1, 4, 6, 2, 8, 10]
MASKS, ROW_KEEP, FEATURE_KEEP = [1, 2, 3, 0, 4], [1, 0, 1, 1], [1, 1, 0, 1, 1]


def literal(spark):
    rows = [(r, IDX[k], float(VAL[k])) for r in range(4) for k in range(PTR[r], PTR[r + 1])]
    return spark.createDataFrame(rows, "row bigint, col bigint, value double")


def spine(spark, n=4, keep=None):
    return spark.createDataFrame([(i, True if keep is None else bool(keep[i])) for i in range(n)], "row bigint, row_keep boolean")


def test_masked_group_reduce(spark):
    features = spark.createDataFrame([(c, bool(FEATURE_KEEP[c]), MASKS[c]) for c in range(5)], "col bigint, feature_keep boolean, group_mask int")
    out = reduce.group_reduce(literal(spark), spine(spark, keep=ROW_KEEP), features, 3, reduce.GroupFilter(1, 1, 0.8, 0)).orderBy("row").collect()
    assert [(r.total, r.detected, r.max_value, r.g0, r.g1, r.g2, r.keep) for r in out] == [(8, 2, 5, 5, 3, 0, 1), (0, 0, 0, 0, 0, 0, 0), (7, 3, 4, 1, 4, 2, 1), (18, 2, 10, 0, 8, 10, 1)]
    assert out[0].pct0 == 62.5 and out[1].pct1 == 0 and abs(out[2].pct1 - 57.142857) < 1e-4


def test_no_masks(spark):
    out = reduce.group_reduce(literal(spark), spine(spark).select("row")).orderBy("row").collect()
    assert [r.total for r in out] == [15, 9, 13, 18] and [r.detected for r in out] == [3, 1, 4, 2]


def test_zeros_negatives_and_bounds(spark):
    t = spark.createDataFrame([(0, 0, 0.0), (1, 0, -2.0), (1, 1, -3.0)], "row bigint, col bigint, value double")
    f = spark.createDataFrame([(0, 1 << 31 - 1)], "col bigint, group_mask int")
    out = reduce.group_reduce(t, spine(spark, 3).select("row"), f, 1, reduce.GroupFilter(group=5)).orderBy("row").collect()
    assert [(r.total, r.detected, r.max_value, r.keep) for r in out] == [(0, 0, 0, 1), (-5, 2, 0, 0), (0, 0, 0, 1)]
    with pytest.raises(ValueError):
        reduce.group_reduce(t, spine(spark), None, 33)


@pytest.mark.parametrize("seed", range(3))
def test_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 6, (30, 12)) * (rng.random((30, 12)) < 0.3)
    masks, keep_r, keep_c = rng.integers(0, 8, 12), rng.random(30) < 0.8, rng.random(12) < 0.8
    t = spark.createDataFrame([(int(r), int(c), float(m[r, c])) for r, c in zip(*m.nonzero(), strict=True)], "row bigint, col bigint, value double")
    f = spark.createDataFrame([(c, bool(keep_c[c]), int(masks[c])) for c in range(12)], "col bigint, feature_keep boolean, group_mask int")
    out = reduce.group_reduce(t, spine(spark, 30, keep_r), f, 3).orderBy("row").collect()
    own = m * keep_c[None] * keep_r[:, None]
    assert [r.total for r in out] == own.sum(1).tolist() and [r.detected for r in out] == (own != 0).sum(1).tolist()
    assert [r.max_value for r in out] == np.maximum(own.max(1), 0).tolist()
    for g in range(3):
        assert [r[f"g{g}"] for r in out] == (own * (masks >> g & 1)[None]).sum(1).tolist()
    stats = reduce.feature_stats(t, spark.range(12).withColumnRenamed("id", "col"), 30).orderBy("col").collect()
    assert np.allclose([r.variance for r in stats], m.var(0)) and np.allclose([r["mean"] for r in stats], m.mean(0))


def test_masked_rebuild(spark):
    rows = spark.createDataFrame([(0, 0), (2, 1), (3, 2)], "row bigint, new_row bigint")
    cols = spark.createDataFrame([(0, 0), (1, 1), (3, 2), (4, 3)], "col bigint, new_col bigint")
    out = access.csr(access.remap(literal(spark), rows, cols, 3, 4)).orderBy("row").collect()
    assert [list(r.cols) for r in out] == [[0, 1], [0, 1, 3], [1, 3]] and [list(r.vals) for r in out] == [[5, 3], [1, 4, 2], [8, 10]]
    assert access.rebuild_stats(literal(spark), access.remap(literal(spark), rows, cols), 3, 4).first().live_nnz == 7
    assert access.remap(literal(spark), rows, cols, 2, 2).count() == 4


def test_duplicates(spark):
    d = spark.createDataFrame([(0, 1, 2.0, 1), (0, 1, 5.0, 2), (0, 2, 3.0, 1), (0, 2, -3.0, 2), (1, 1, None, 1)], "a int, b int, v double, o int")
    get = lambda **k: sorted(tuple(r) for r in triplets(d, "a", "b", "v", **k).collect())
    assert get() == [(0, 1, 7.0)]
    assert get(duplicates="last", ordinal="o") == [(0, 1, 5.0), (0, 2, -3.0)]
    assert len(get(duplicates="keep")) == 4
    assert SparseMatrix(triplets(d, "a", "b", "v"), 2, 3).nnz() == 1
