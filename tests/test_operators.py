import math

import numpy as np
import pytest
from helpers import coords, feats, frame, line, table, xs
from pyspark.sql import functions as F

from gridstone import ops
from gridstone.frame import numbered
from gridstone.operators import grads
from gridstone.operators.conv import kernel_weights
from gridstone.geometry import KernelSpec

W3 = np.array([1.0, 2.0, 3.0]).reshape(3, 1, 1)


def test_conv(spark):
    x = line(spark)
    assert feats(ops.conv3d(x, W3, kernel_size=(3, 1, 1))) == [(8,), (14,), (8,)]
    target = frame(spark, [(0, 1, 0, 0), (0, 3, 0, 0)], [[0], [0]])
    assert feats(ops.conv3d(x, W3, kernel_size=(3, 1, 1), coordinates=target)) == [(14,), (3,)]
    assert feats(ops.conv3d(x, [[[2.0]]], kernel_size=1, coordinates=target)) == [(4,), (0,)]
    y = ops.conv3d(line(spark, 4), [[[1.0]]], kernel_size=1, stride=2)
    assert feats(y) == [(1,), (3,)] and xs(y.df) == [0, 1] and y.stride == (2, 2, 2)
    ones = np.ones((3, 1, 1))
    z = ops.subm_conv3d(x, ones, kernel_size=(3, 1, 1))
    assert feats(z) == [(3,), (6,), (5,)] and z.same_coords(x)


def test_transposed(spark):
    x = frame(spark, [(0, 1, 0, 0)], [[4]], stride=(2, 1, 1))
    w = np.array([2.0, 3.0]).reshape(2, 1, 1)
    for f in (ops.conv_transpose3d, ops.generative_conv_transpose3d):
        y = f(x, w, kernel_size=(2, 1, 1), stride=(2, 1, 1))
        assert table(y.df, "x", "f0") == [(2, 8), (3, 12)] and y.stride == (1, 1, 1)
    with pytest.raises(ValueError):
        ops.conv_transpose3d(line(spark), w, kernel_size=(2, 1, 1), stride=(2, 1, 1))


def test_layouts_and_wide_path_agree(spark):
    rng = np.random.default_rng(1)
    x = frame(spark, [(0, i % 3, i // 3, 0) for i in range(9)], rng.integers(-4, 5, (9, 10)).tolist())
    dense = rng.integers(-4, 5, (12, 3, 3, 1, 10)) / 8
    major = dense.reshape(12, 9, 10).transpose(1, 2, 0)
    a, b = feats(ops.conv3d(x, dense, kernel_size=(3, 3, 1))), feats(ops.conv3d(x, major, kernel_size=(3, 3, 1)))
    assert a == b
    narrow = feats(ops.conv3d(x, major[:, :, :4], kernel_size=(3, 3, 1)))
    assert [r[:4] for r in a] == narrow
    assert kernel_weights(dense, KernelSpec.of((3, 3, 1)), 10).shape == (9, 10, 12)


def test_conv_rejects(spark):
    x = line(spark)
    for bad in (lambda: ops.conv3d(x, np.ones((2, 1, 1)), kernel_size=(3, 1, 1)), lambda: ops.conv3d(x, np.ones((3, 2, 1)), kernel_size=(3, 1, 1)), lambda: ops.conv3d(x, W3, [1, 2], kernel_size=(3, 1, 1)), lambda: ops.conv3d(x, W3, kernel_size=(3, 1, 1), stride=0)):
        with pytest.raises(ValueError):
            bad()


def test_conv_gradients_are_adjoint(spark):
    rng = np.random.default_rng(2)
    x = frame(spark, [(0, i % 4, i // 4, 0) for i in range(12)], rng.integers(-4, 5, (12, 2)).tolist())
    w = rng.integers(-4, 5, (9, 2, 3)) / 8
    relation = ops.kernel_relation(x, (3, 3, 1))
    y = ops.conv3d(x, w, kernel_size=(3, 3, 1))
    c = rng.integers(-4, 5, (12, 3))
    cot = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(c)], "row_id long, f0 double, f1 double, f2 double")
    back = sorted(grads.conv_input_grad(x, relation, w, cot).collect())
    inner = float((np.array(feats(y)) * c).sum())
    assert inner == pytest.approx(float((np.array([r[1:] for r in back]) * np.array(feats(x))).sum()))
    g = {r["kernel_id"]: r for r in grads.conv_weight_grad(x, relation, cot).collect()}
    assert inner == pytest.approx(sum(g[k][f"g{a}_{b}"] * w[k, a, b] for k in range(9) for a in range(2) for b in range(3)))


def test_pools(spark):
    x = line(spark, feats=[[1, 10], [2, 20], [3, 30]])
    args = {"kernel_size": (3, 1, 1), "stride": 1}
    assert feats(ops.sum_pool3d(x, **args)) == [(3, 30), (6, 60), (5, 50)]
    assert feats(ops.max_pool3d(x, **args)) == [(2, 20), (3, 30), (3, 30)]
    assert feats(ops.avg_pool3d(x, **args)) == [(1.5, 15), (2, 20), (2.5, 25)]
    y = frame(spark, [(0, 1, 0, 0)], [[5]])
    assert feats(ops.sum_pool3d(y, 1, 2)) == [(0,)] and feats(ops.max_pool3d(y, 1, 2)) == [(-math.inf,)]
    nan = frame(spark, [(0, 0, 0, 0), (0, 1, 0, 0)], [[math.nan], [2]])
    assert feats(ops.max_pool3d(nan)) == [(2,)]


def test_tiling_pool_equals_the_relation(spark):
    rows = [(0, x, y, -x) for x in range(-3, 3) for y in range(2)] + [(0, 0, 0, 0), (1, 0, 0, 0)]
    x = frame(spark, rows, [[i] for i in range(len(rows))])
    from gridstone.operators.pool import pool_relation

    for mode in ("sum", "max", "avg"):
        want = pool_relation(x, ops.kernel_relation(x, 2, 2), mode)
        assert sorted(ops.pool3d(x, mode).df.collect()) == sorted(want.collect())


def test_pool_gradients(spark):
    x, ones = line(spark), spark.createDataFrame([(i, 1.0) for i in range(3)], "row_id long, f0 double")
    r = ops.kernel_relation(x, (3, 1, 1))
    rows = lambda df: [v for _, v in sorted(df.collect())]
    assert rows(grads.pool_vjp(x, r, "sum", ones)) == [2, 3, 2]
    assert rows(grads.pool_vjp(x, r, "avg", ones)) == pytest.approx([5 / 6, 4 / 3, 5 / 6])
    assert rows(grads.pool_vjp(x, r, "max", ones)) == [0, 1, 2]
    t = line(spark, feats=[[2], [2], [1]])
    r = ops.kernel_relation(t, (3, 1, 1))
    assert rows(grads.pool_vjp(t, r, "max", ones)) == [1, 2, 0]
    tangent = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 30.0)], "row_id long, f0 double")
    assert rows(grads.pool_jvp(t, r, "max", tangent)) == [10, 10, 20]


def test_global_pools(spark):
    x = frame(spark, [(1, 0, 0, 0)], [[3, 30]], batches=2)
    assert sorted(ops.global_sum_pool(x).collect()) == [(0, 0, 0), (1, 3, 30)]
    assert sorted(ops.global_avg_pool(x).collect()) == [(0, 0, 0), (1, 3, 30)]
    with pytest.raises(Exception, match="empty batch"):
        ops.global_max_pool(x).collect()


def test_alignment_and_algebra(spark):
    a = frame(spark, [(0, x, 0, 0) for x in (0, 1, 2)], [[0]] * 3)
    b = frame(spark, [(0, x, 0, 0) for x in (2, 3, 1)], [[0]] * 3)
    pairs = lambda join: [(r["lhs_row"], r["rhs_row"]) for r in sorted(ops.align_sparse(a, b, join).collect())]
    assert pairs("inner") == [(1, 2), (2, 0)]
    assert pairs("outer") == [(0, -1), (1, 2), (2, 0), (-1, 1)]
    assert pairs("right") == [(2, 0), (-1, 1), (1, 2)]
    l, r = frame(spark, [(0, 0, 0, 0), (0, 1, 0, 0)], [[1], [2]]), frame(spark, [(0, 1, 0, 0), (0, 2, 0, 0)], [[20], [30]])
    assert feats(l + r) == [(1,), (22,), (30,)] and feats(l - r) == [(1,), (-18,), (-30,)]
    assert feats(l * r) == [(40,)] and feats(l & r) == [(40,)]
    assert feats(ops.sparse_maximum(l, r)) == [(20,)] and feats(ops.sparse_minimum(l, r)) == [(2,)]
    assert feats(ops.cat([l, r], "outer")) == [(1, 0), (2, 20), (0, 30)] and feats(ops.cat([l, r])) == [(2, 20)]
    assert feats(ops.sparse_add(l, l)) == [(2,), (4,)]
    assert "Join" not in ops.sparse_add(l, l).df._jdf.queryExecution().optimizedPlan().toString()


def test_duplicates_meet_the_lowest_row(spark):
    a = frame(spark, [(0, 1, 0, 0), (0, 1, 0, 0)], [[1], [2]])
    b = frame(spark, [(0, 1, 0, 0), (0, 1, 0, 0), (0, 5, 0, 0), (0, 5, 0, 0)], [[10], [20], [30], [40]])
    assert feats(ops.sparse_add(a, b)) == [(11,), (12,), (30,), (40,)]


def test_rows(spark):
    x = frame(spark, [(0, 0, 0, 0), (0, 2, 0, 0), (0, 4, 0, 0)], [[1], [2], [3]])
    assert table(ops.crop(x, (1, 0, 0), (3, 0, 0)).df, "x", "f0") == [(2, 2)]
    assert feats(ops.prune_mask(x, F.col("f0") != 2)) == [(1,), (3,)]
    rows = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "position long, row long")
    assert feats(ops.prune(x, rows)) == [(3,), (1,), (3,)]
    two = frame(spark, [(0, 0, 0, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0)], [[0.5], [2], [3], [1]])
    assert feats(ops.prune(two, ops.topk_rows(two, [1, 1]))) == [(2,), (3,)]
    parts = [spark.createDataFrame([(0, i, 0, 0, 1.0 * i)], "row_id long, x int, y int, z int, f0 double") for i in (7, 8)]
    y = ops.sparse_collate(parts)
    assert table(y.df, "row_id", "batch", "x", "f0") == [(0, 0, 7, 7), (1, 1, 8, 8)] and y.batches == 2
    with pytest.raises(ValueError):
        ops.crop(x, (1, 0, 0), (0, 0, 0))


def _points(spark, rows, n=1):
    kinds = ", ".join(["point_id long, batch int, px float, py float, pz float", *(f"f{i} double" for i in range(n))])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], kinds)


def test_quantize(spark):
    p = _points(spark, [(0, 0.2, 0.2, 0.2), (0, 0.8, 0.1, 0.1), (0, 1.2, 0.0, 0.0), (0, -0.1, 0.0, 0.0), (1, 0.0, 2.1, 0.0)], 0)
    q = ops.sparse_quantize(p)
    assert table(q.voxels, "row_id", "batch", "x", "y", "z", "count") == [(0, 0, 0, 0, 0, 2), (1, 0, 1, 0, 0, 1), (2, 0, -1, 0, 0, 1), (3, 1, 0, 2, 0, 1)]
    assert [r[1] for r in table(q.assignment, "point_id", "voxel_row")] == [0, 0, 1, 2, 3]
    p = _points(spark, [(0, 0.0, 0.0, 0.0), (0, 1.9, 0.0, 0.0), (0, 2.1, 0.0, 0.0), (0, 99.0, 0.0, 0.0)], 0)
    q = ops.sparse_quantize(p, (2, 1, 1), (0.5, 0, 0), F.col("point_id") < 3)
    assert table(q.voxels, "x", "count") == [(-1, 1), (0, 2)]
    assert [r[1] for r in table(q.assignment, "point_id", "voxel_row")] == [0, 1, 1, -1]
    assert table(ops.sparse_quantize(_points(spark, [(0, 0.7, 0.0, 0.0)], 0), 0.1).voxels, "x") == [(7,)]
    with pytest.raises(ValueError):
        ops.sparse_quantize(p, 0)


def test_voxelize_and_back(spark):
    p = _points(spark, [(0, 0.1, 0.0, 0.0, 1.0, 10.0), (0, 0.9, 0.0, 0.0, 3.0, 30.0), (0, 1.1, 0.0, 0.0, 5.0, 50.0)], 2)
    assert feats(ops.voxelize(p)) == [(2, 20), (5, 50)] and feats(ops.voxelize(p, reduction="sum")) == [(4, 40), (5, 50)]
    v = frame(spark, [(0, x, 0, 0) for x in range(3)], [[10], [20], [30]])
    near = _points(spark, [(0, 0.1, 0.0, 0.0), (0, 1.2, 0.0, 0.0), (0, 9.0, 0.0, 0.0)], 0)
    assert table(ops.devoxelize(near, v, interpolation="nearest"), "point_id", "f0") == [(0, 10), (1, 20), (2, 0)]
    cube = frame(spark, [(0, i & 1, i >> 1 & 1, i >> 2) for i in range(8)], [[i] for i in range(8)])
    assert table(ops.devoxelize(_points(spark, [(0, 0.5, 0.5, 0.5)], 0), cube), "f0") == [(3.5,)]


def test_features(spark):
    x = frame(spark, [(0, 0, 0, 0), (0, 1, 0, 0)], [[-1, 2], [3, -4]])
    assert feats(ops.linear(x, [[2, 3], [5, 7]], [1, -1])) == [(5, 8), (-5, -14)] and feats(ops.relu(x)) == [(0, 2), (3, 0)]
    y = frame(spark, [(0, 0, 0, 0), (0, 1, 0, 0)], [[1, 3], [3, 7]])
    out = np.array(feats(ops.batch_norm(y, [2, 5], [1, 4], [2, 3], [0.5, -0.5], eps=0)))
    assert out == pytest.approx(np.array([[-1.5, -3.5], [2.5, 2.5]]))
    assert np.array(feats(ops.batch_norm(y))).mean(axis=0) == pytest.approx([0, 0])
    assert feats(ops.gelu(x))[0][1] == pytest.approx(2 * 0.5 * (1 + math.erf(2 / math.sqrt(2))))
    assert feats(ops.dropout(x, 0.5, training=False)) == feats(x)
    with pytest.raises(ValueError):
        ops.dropout(x, 1.0)
    with pytest.raises(ValueError):
        ops.linear(x, [[1, 2, 3]])


def test_dropout_rate(spark):
    n = 4000
    x = frame(spark, [(0, i, 0, 0) for i in range(n)], [[1]] * n)
    kept = [v for (v,) in feats(ops.dropout(x, 0.25, seed=4))]
    assert set(kept) <= {0.0, 1 / 0.75} and abs(np.mean(kept) - 1) < 0.05


def test_frame(spark):
    x = line(spark)
    assert x.shape == (3, 1) and x.same_coords(x.project(lambda c: c + 1)) and not x.same_coords(line(spark))
    assert not x.same_coords(x.replace(stride=2)) and x.replace(stride=2).batches is None
    assert x.astype("float").dtype == "float"
    with pytest.raises(ValueError):
        x.decomposed_features()
    assert coords(spark, []).count() == 0


def test_sparse_ids_are_numbered_in_levels(spark):
    ids = sorted({(i * 2654435761) ** 2 % (1 << 63) - (1 << 62) for i in range(500)} | set(range(-3, 3)) | {65535, 65536, 1 << 48, -(1 << 62)})
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "k long")
    for sparse in (False, True):
        got = table(numbered(df, "k", "n", sparse), "k", "n")
        assert got == [(k, n) for n, k in enumerate(ids)]
    assert numbered(df.where("k is null"), "k", "n", True).count() == 0


def test_gradient_of_a_maximum_passes_nan_by(spark):
    x = line(spark, 4, [[math.nan], [2.0], [math.nan], [math.nan]])
    relation = ops.build_kernel_relation(x.coords, 2, 2)
    one = relation.out.select("row_id", F.lit(1.0).alias("f0"))
    assert table(grads.pool_vjp(x, relation, "max", one), "row_id", "f0") == [(0, 0.0), (1, 1.0), (2, 0.0), (3, 0.0)]
    tangent = x.df.select("row_id", (F.col("row_id") + 5.0).alias("f0"))
    assert table(grads.pool_jvp(x, relation, "max", tangent), "row_id", "f0") == [(0, 6.0), (1, 0.0)]


def test_direct_view_needs_an_exclusive_kernel(spark):
    x = line(spark, 4)
    assert table(ops.build_kernel_relation(x.coords, 2, 3).direct_view(), "in_row", "out_row") == [(0, 0), (1, 0), (3, 1)]
    with pytest.raises(ValueError):
        ops.build_kernel_relation(x.coords, 3, 2).direct_view()


def test_wide_generative_convolution_equals_narrow_ones(spark):
    x = line(spark, 3, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    w = np.arange(8 * 2 * 40).reshape(8, 2, 40) % 7 - 3
    wide = table(ops.generative_conv_transpose3d(x.replace(stride=2), w).df, "row_id", "f0", "f39")
    for c, at in ((0, 1), (39, 2)):
        narrow = table(ops.generative_conv_transpose3d(x.replace(stride=2), w[:, :, [c]]).df, "row_id", "f0")
        assert [(r[0], r[at]) for r in wide] == narrow
