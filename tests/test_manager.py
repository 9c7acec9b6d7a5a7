import pytest
from helpers import coords, table

from gridstone.manager import CoordinateManager
from gridstone.plans.graph import REGISTRY, iter_operation_specs


def test_manager(spark):
    m, a = CoordinateManager(), coords(spark, [(0, 0, 0, 0), (0, 1, 0, 0), (0, 2, 0, 0)])
    k = m.insert_coords(a)
    assert m.insert_coords(a) == k and m.insert_coords(a, 2) != k and m.owns(k) and not CoordinateManager().owns(k)
    part = m.insert_coords(a, active_rows=2)
    assert m.active_rows(part) == 2 and m.active_rows(k) == 3
    assert table(m.inverse_map(part, k), "row_id", "found") == [(0, 0), (1, 1), (2, -1)]
    with pytest.raises(KeyError):
        CoordinateManager().coords(k)


def test_specs():
    assert len(iter_operation_specs()) == len(REGISTRY)
