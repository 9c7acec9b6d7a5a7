"""The sparse lattice as a DataFrame with driver-side metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.geometry import COORDS, Triple, triple

#: Ids numbered in one task; totals of such ranges are one row each.
RANGE_BITS = 16


def starts_before(counts: DataFrame, key: str, levels: int = 1) -> DataFrame:
    """``key`` and ``_at``: the sum of ``_n`` over all smaller keys; ``counts`` has one row (key, _n) for each key.

    A level sums keys that agree but for their last 16 bits on their own and hands their totals to the next; the last one
    sums what is left in one task. Keys of 48 bits in three levels leave no task more than 65,536 rows.
    """
    if levels == 1:
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    above = f"_above{levels}"
    rows = counts.withColumn(above, F.shiftright(key, RANGE_BITS))
    totals = starts_before(rows.groupBy(above).agg(F.sum("_n").alias("_n")), above, levels - 1)
    before = Window.partitionBy(above).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(totals, above).select(key, (F.col("_at") + F.col("_in")).alias("_at"))


def numbered(df: DataFrame, order: str, name: str, sparse: bool = False) -> DataFrame:
    """Add a gapless number from 0 in the order of the unique LONG column ``order``.

    Ids are cut into ranges of 65,536; each is numbered on its own, and only totals of ranges are summed in order. Ids
    that lie far apart (``sparse``: codes, packed coordinates) fill nearly as many ranges as there are rows, so their totals
    are summed in levels, see ``starts_before``; no task sees all rows.
    """
    part = F.shiftright(F.col(order), RANGE_BITS).alias("_part")
    rows = df.withColumn("_part", F.shiftright(F.col(order), RANGE_BITS))
    starts = starts_before(df.groupBy(part).agg(F.count("*").alias("_n")), "_part", 3 if sparse else 1)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return rows.join(starts, "_part").withColumn(name, (F.col("_at") + within - 1).cast("long")).drop("_part", "_at")


def first_seen(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """row_id, batch, x, y, z: the distinct coordinates of ``rows``, numbered as they first occur by ``order``."""
    return numbered(rows.groupBy(*COORDS).agg(F.min(order).alias("_first")), "_first", "row_id").select("row_id", *COORDS)


def lookup_side(rows: DataFrame, name: str = "in_row") -> DataFrame:
    """batch, x, y, z and the lowest row at each coordinate."""
    return rows.groupBy(*COORDS).agg(F.min("row_id").alias(name))


@dataclass(frozen=True)
class LatticeFrame:
    """Rows ``row_id, batch, x, y, z, f0 .. f{channels - 1}`` and what the driver knows of them.

    stride: of the lattice. key: identity of the coordinates; frames that share it have the same rows, so they need
    no join. batches: how many batches there are, including empty ones (None: unknown). unique: no coordinate
    occurs twice.
    """

    df: DataFrame
    channels: int
    stride: Triple = (1, 1, 1)
    key: object = field(default_factory=object, compare=False)
    batches: int | None = None
    unique: bool = False

    @classmethod
    def of(cls, df: DataFrame, stride=1, batches: int | None = None, unique: bool = False) -> LatticeFrame:
        """Check columns and wrap; features are the columns f0, f1, ... in order."""
        missing = [c for c in ("row_id", *COORDS) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        n = sum(c[0] == "f" and c[1:].isdigit() for c in df.columns)
        names = [f"f{i}" for i in range(n)]
        if any(c not in df.columns for c in names):
            raise ValueError("features must be f0, f1, ... without a gap")
        return cls(df.select("row_id", *COORDS, *names), n, triple(stride, "stride"), batches=batches, unique=unique)

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.channels)]

    @property
    def coords(self) -> DataFrame:
        return self.df.select("row_id", *COORDS)

    @property
    def feats(self) -> DataFrame:
        return self.df.select("row_id", *self.names)

    @property
    def shape(self) -> tuple[int, int]:
        return self.active_count(), self.channels

    @property
    def dtype(self) -> str | None:
        return dict(self.df.dtypes).get("f0")

    def active_count(self) -> int:
        return self.df.count()

    capacity = active_count

    def batch_indices(self) -> DataFrame:
        return self.df.select("row_id", "batch")

    def batch_rows(self) -> DataFrame:
        """batch and its number of rows, empty batches included where their number is known."""
        counts = self.df.groupBy("batch").agg(F.count("*").alias("rows"))
        if self.batches is None:
            return counts
        every = self.df.sparkSession.range(self.batches).select(F.col("id").cast("int").alias("batch"))
        return every.join(counts, "batch", "left").select("batch", F.coalesce("rows", F.lit(0)).alias("rows"))

    def _needs_batches(self) -> int:
        if self.batches is None:
            raise ValueError("the number of batches is not known")
        return self.batches

    def decomposed_coordinates(self) -> list[DataFrame]:
        return [self.coords.where(F.col("batch") == b).drop("batch") for b in range(self._needs_batches())]

    def decomposed_features(self) -> list[DataFrame]:
        return [self.df.where(F.col("batch") == b).select("row_id", *self.names) for b in range(self._needs_batches())]

    def same_coords(self, other: LatticeFrame) -> bool:
        """Identity, not equality: whether rows correspond without a join."""
        return self.key is other.key and self.stride == other.stride

    def reuse_coords_from(self, other: LatticeFrame) -> LatticeFrame:
        """These features on the other's coordinates, row by row."""
        return replace(other, df=other.coords.join(self.feats, "row_id"), channels=self.channels)

    def astype(self, kind: str) -> LatticeFrame:
        return self.project(lambda c: c.cast(kind))

    def project(self, f: Callable[[Column], Column]) -> LatticeFrame:
        """Each feature through ``f``; coordinates and identity stay."""
        return self.with_features([f(F.col(c)) for c in self.names])

    def with_features(self, columns: Iterable[Column]) -> LatticeFrame:
        columns = list(columns)
        return replace(self, df=self.df.select("row_id", *COORDS, *[c.alias(f"f{i}") for i, c in enumerate(columns)]), channels=len(columns))

    def replace(self, coords: DataFrame | None = None, feats: DataFrame | None = None, stride=None) -> LatticeFrame:
        """New features keep the identity; new coordinates or stride get another and forget the batches."""
        names = self.names if feats is None else [c for c in feats.columns if c != "row_id"]
        df = (self.coords if coords is None else coords.select("row_id", *COORDS)).join(self.feats if feats is None else feats, "row_id")
        if feats is None and coords is None:
            df = self.df
        new = replace(self, df=df.select("row_id", *COORDS, *[F.col(c).alias(f"f{i}") for i, c in enumerate(names)]), channels=len(names))
        if coords is None and stride is None:
            return new
        return replace(new, key=object(), batches=None, unique=self.unique and coords is None, stride=self.stride if stride is None else triple(stride, "stride"))

    def renewed(self, df: DataFrame, **changes) -> LatticeFrame:
        """Other rows: a new identity."""
        return replace(self, df=df, key=object(), **changes)

    def __add__(self, other: LatticeFrame) -> LatticeFrame:
        from gridstone.operators.algebra import sparse_add

        return sparse_add(self, other)

    def __sub__(self, other: LatticeFrame) -> LatticeFrame:
        from gridstone.operators.algebra import sparse_sub

        return sparse_sub(self, other)

    def __mul__(self, other: LatticeFrame) -> LatticeFrame:
        from gridstone.operators.algebra import sparse_mul

        return sparse_mul(self, other)

    __and__ = __mul__
