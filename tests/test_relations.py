import random

import pytest
from helpers import coords, first_rows, frame, line, model_edges, table

from gridstone import ops
from gridstone.geometry import KernelSpec

EDGE = ("in_row", "out_row", "kernel_id")


def test_line(spark):
    r = ops.build_kernel_relation(coords(spark, [(0, x, 0, 0) for x in range(3)]), (3, 1, 1))
    assert r.counts() == (7, 3)
    assert table(r.edges, "out_row", "kernel_id", "in_row") == [(0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)]
    assert [r["offset"] for r in sorted(r.kernel_view().collect(), key=lambda r: r["kernel_id"])] == [0, 2, 5]
    gemm = {r["out_row"]: r for r in r.implicit_gemm().collect()}
    assert [gemm[i]["map"] for i in range(3)] == [[-1, 0, 1], [0, 1, 2], [1, 2, -1]]
    assert [gemm[i]["masks"] for i in range(3)] == [[6], [7], [3]]


def test_sorted_gemm(spark):
    r = ops.build_kernel_relation(coords(spark, [(0, x, 0, 0) for x in range(3)]), (3, 1, 1))
    assert [r["out_row"] for r in sorted(r.sorted_implicit_gemm().collect(), key=lambda r: r["place"])] == [2, 0, 1]


def test_target_strided_transposed(spark):
    r = ops.build_target_kernel_relation(coords(spark, [(0, x, 0, 0) for x in range(3)]), coords(spark, [(0, 1, 0, 0), (0, 3, 0, 0)]), (3, 1, 1))
    assert table(r.edges, *EDGE) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (2, 1, 0)]
    r = ops.build_kernel_relation(coords(spark, [(0, x, 0, 0) for x in range(4)]), 1, 2)
    assert table(r.edges, *EDGE) == [(0, 0, 0), (2, 1, 0)] and table(r.out, "x") == [(0,), (1,)]
    one = coords(spark, [(0, 1, 0, 0)])
    for r in (ops.build_generative_relation(one, (2, 1, 1), (2, 1, 1)), ops.build_transposed_kernel_relation(one, (2, 1, 1), (2, 1, 1))):
        assert table(r.out, "x") == [(2,), (3,)]


@pytest.mark.parametrize("geometry", [((3, 3, 3), 1, 0, 1), ((2, 2, 2), 2, 0, 1), ((3, 1, 2), 2, 1, 1), ((3, 3, 1), 1, 0, 2)])
def test_against_model(spark, geometry):
    rng = random.Random(3)
    rows = [(rng.randrange(2), *(rng.randrange(-4, 4) for _ in range(3))) for _ in range(80)]
    spec = KernelSpec.of(*geometry)
    if spec.keeps_support:
        out = rows
    else:
        out = list(first_rows([(b, *(v // s for v, s in zip(p, spec.stride))) for b, *p in rows]))
    r = ops.build_kernel_relation(coords(spark, rows), *geometry)
    assert table(r.out, "row_id", "batch", "x", "y", "z") == [(i, *o) for i, o in enumerate(out)]
    assert table(r.edges, *EDGE) == model_edges(rows, out, spec.offsets, spec.stride, spec.padding)


def test_transposed_merges(spark):
    rows = [(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 0)]
    r = ops.build_transposed_kernel_relation(coords(spark, rows), (3, 1, 1), (2, 1, 1))
    assert table(r.out, "row_id", "x") == [(0, -1), (1, 0), (2, 1), (3, 2), (4, 3)]
    assert r.edges.count() == 9


def test_neighbours(spark):
    source = coords(spark, [(0, 0, 0, 0), (0, 2, 0, 0), (0, 5, 0, 0), (1, 0, 0, 0)])
    query = coords(spark, [(0, 1, 0, 0), (0, 4, 0, 0), (1, 1, 0, 0)])
    got = table(ops.build_knn_relation(source, query, 2), "query_row", "neighbor_id", "source_row", "distance")
    assert got == [(0, 0, 0, 1.0), (0, 1, 1, 1.0), (1, 0, 2, 1.0), (1, 1, 1, 4.0), (2, 0, 3, 1.0)]
    got = table(ops.build_radius_relation(source, query, 1.5), "query_row", "source_row")
    assert got == [(0, 0), (0, 1), (1, 2), (2, 3)]
    assert table(ops.build_radius_relation(source, query, 1.5, 1), "query_row", "source_row") == [(0, 0), (1, 2), (2, 3)]


def test_knn_is_exact_on_sparse_data(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), *(rng.randrange(-300, 300) for _ in range(3))) for _ in range(60)] + [(0, 1, 1, 1)] * 3
    got = table(ops.build_knn_relation(coords(spark, rows), k=4), "query_row", "neighbor_id", "source_row", "distance")
    want = []
    for q, (b, *p) in enumerate(rows):
        near = sorted((float(sum((u - v) ** 2 for u, v in zip(p, s))), i) for i, (c, *s) in enumerate(rows) if c == b)
        want += [(q, n, i, d) for n, (d, i) in enumerate(near[:4])]
    assert got == sorted(want)


def test_cache_and_rejections(spark):
    x = line(spark)
    with ops.RelationCache() as cache:
        assert ops.kernel_relation(x, cache=cache) is ops.kernel_relation(x, cache=cache)
        assert ops.kernel_relation(x, 1, cache=cache) is not ops.kernel_relation(x, cache=cache)
    with pytest.raises(ValueError):
        ops.build_submanifold_kernel_relation(x.coords, 2)
    with pytest.raises(ValueError):
        ops.build_knn_relation(x.coords, k=0)
    with pytest.raises(ValueError):
        ops.knn_relation(x, frame(spark, [(0, 0, 0, 0)], [[1]], stride=2))
