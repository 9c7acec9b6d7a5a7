"""Registry of coordinate sets by identity, and of the relations built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridstone.frame import LatticeFrame
from gridstone.geometry import Triple, triple
from gridstone.operators.coords import lookup_coords
from gridstone.operators.relations import RelationCache


@dataclass(frozen=True)
class CoordinateKey:
    """Identity of a coordinate set; its stride is part of it."""

    id: int
    stride: Triple
    manager: int


class CoordinateManager:
    """Holds coordinate tables under keys; the same table at another stride has another key."""

    def __init__(self) -> None:
        self._held: dict[CoordinateKey, tuple[DataFrame, int | None]] = {}
        self.relations = RelationCache()

    def insert_coords(self, coords: DataFrame | LatticeFrame, stride=1, active_rows: int | None = None) -> CoordinateKey:
        """``active_rows``: only rows below that number count."""
        table = coords.coords if isinstance(coords, LatticeFrame) else coords
        steps = coords.stride if isinstance(coords, LatticeFrame) else triple(stride, "stride")
        for key, (held, active) in self._held.items():
            if held is table and key.stride == steps and active == active_rows:
                return key
        key = CoordinateKey(len(self._held), steps, id(self))
        self._held[key] = (table, active_rows)
        return key

    def owns(self, key: CoordinateKey) -> bool:
        return key.manager == id(self) and key in self._held

    def _at(self, key: CoordinateKey) -> tuple[DataFrame, int | None]:
        if not self.owns(key):
            raise KeyError("the key is not of this manager")
        return self._held[key]

    def coords(self, key: CoordinateKey) -> DataFrame:
        table, active = self._at(key)
        return table if active is None else table.where(table["row_id"] < active)

    def active_rows(self, key: CoordinateKey) -> int:
        return self.coords(key).count()

    def inverse_map(self, source: CoordinateKey, target: CoordinateKey) -> DataFrame:
        """Row of ``source`` for each row of ``target``, or -1."""
        return lookup_coords(self.coords(source), self.coords(target))
