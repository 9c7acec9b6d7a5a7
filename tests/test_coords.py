import pytest
from helpers import coords, table, xs

from gridstone import ops


def test_union_intersection_lookup_downsample(spark):
    lhs = coords(spark, [(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 0)])
    rhs = coords(spark, [(0, 1, 0, 0), (0, 2, 0, 0)])
    assert xs(ops.union_coords(lhs, rhs)) == [0, 1, 2]
    assert xs(ops.intersection_coords(lhs, rhs)) == [1]
    assert table(ops.lookup_coords(lhs, rhs), "row_id", "found") == [(0, 1), (1, -1)]
    assert table(ops.contains_coords(lhs, rhs), "row_id", "contained") == [(0, True), (1, False)]
    assert xs(ops.downsample_coords(rhs, 2)) == [0, 1]


def test_downsample_rounds_down(spark):
    assert xs(ops.downsample_coords(coords(spark, [(0, -7, 0, 0), (0, -1, 0, 0), (0, 0, 0, 0)]), 2)) == [-4, -1, 0]


def test_empty_sides(spark):
    none, one = coords(spark, []), coords(spark, [(0, 1, 0, 0)])
    assert xs(ops.union_coords(none, one)) == [1] and xs(ops.union_coords(one, none)) == [1]
    assert ops.intersection_coords(none, one).count() == 0


def test_morton(spark):
    c = coords(spark, [(0, 1, 1, 0), (1, 0, 0, 0), (0, 0, 1, 1), (0, 0, 0, 0)])
    order = ops.morton_order(c)
    assert [r[0] for r in sorted(((r["row_id"], r["position"]) for r in order.collect()), key=lambda t: t[1])] == [3, 0, 2, 1]
    assert [p for _, p in table(order, "row_id", "position")] == [1, 3, 2, 0]
    assert [r["order"] for r in sorted(ops.morton_sort_coords(c).collect(), key=lambda r: r["position"])] == [3, 0, 2, 1]


def test_morton_wraps_like_64_bit_arithmetic(spark):
    rows = [(b, x, -x, 3 * x) for b in (0, 1, 7, 15) for x in (-(2**20), -5, -1, 0, 1, 12345, 2**20)]

    def code(b, *p):
        out = b << 60
        for i, v in enumerate(p):
            out += sum(((v & 0x1FFFFF) >> k & 1) << (3 * k + i) for k in range(21))
        out %= 1 << 64
        return out - (1 << 64) if out >> 63 else out

    got = dict(table(ops.morton_codes(coords(spark, rows)), "row_id", "code"))
    assert got == {i: code(*r) for i, r in enumerate(rows)}


def test_occupancy(spark):
    cube = [(0, x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    down = ops.occupancy_downsample(coords(spark, [*cube, (0, 2, 0, 0)]))
    assert [(r["x"], r["occupancy"]) for r in sorted(down.collect(), key=lambda r: r["row_id"])] == [(0, 255), (1, 1)]
    up = ops.occupancy_expand(down)
    rows = sorted(up.collect(), key=lambda r: r["row_id"])
    assert [(r["parent_row"], r["child"]) for r in rows] == [(0, i) for i in range(8)] + [(1, 0)]
    assert [(r["batch"], r["x"], r["y"], r["z"]) for r in rows] == [*cube, (0, 2, 0, 0)]


def test_child_coords(spark):
    parents = coords(spark, [(0, 0, 0, 0), (0, 1, 0, 0)])
    idx = spark.createDataFrame([(0, 0, 7), (1, 1, 0)], "row_id long, parent_row long, child int")
    assert table(ops.child_coords_from_indices(parents, idx), "batch", "x", "y", "z") == [(0, 1, 1, 1), (0, 2, 0, 0)]


def test_offsets():
    assert ops.kernel_offsets((3, 1, 1)) == [(-1, 0, 0), (0, 0, 0), (1, 0, 0)]
    assert ops.kernel_offsets(2)[:3] == [(0, 0, 0), (0, 0, 1), (0, 1, 0)]
    with pytest.raises(ValueError):
        ops.kernel_offsets(0)
