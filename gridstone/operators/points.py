"""Points to voxels and back. Voxel arithmetic is in 32-bit floats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame, lookup_side, numbered
from gridstone.geometry import COORDS, triple


def _triple(value, name: str) -> tuple[float, float, float]:
    out = (float(value),) * 3 if isinstance(value, (int, float)) else tuple(map(float, value))
    if len(out) != 3:
        raise ValueError(f"{name} must be one or three numbers")
    return out


def _sizes(voxel_size) -> tuple[float, float, float]:
    size = _triple(voxel_size, "voxel_size")
    if min(size) <= 0:
        raise ValueError("voxel_size must be positive")
    return size


def _place(axis: str, size: float, origin: float) -> Column:
    """(p - origin) / size in 32 bits: SQL divides in 64, which rounds 0.7 / 0.1 down to 6."""
    return ((F.col(f"p{axis}").cast("float") - F.lit(origin).cast("float")).cast("float") / F.lit(size).cast("float")).cast("float")


@dataclass(frozen=True)
class SparseQuantization:
    """voxels: row_id, batch, x, y, z, count; assignment: point_id, voxel_row (-1 for an inactive point)."""

    voxels: DataFrame
    assignment: DataFrame


def _cells(points: DataFrame, voxel_size, origin) -> DataFrame:
    size, start = _sizes(voxel_size), _triple(origin, "origin")
    batch = F.col("batch").cast("int") if "batch" in points.columns else F.lit(0)
    cells = [F.floor(_place(a, s, o)).cast("int").alias(a) for a, s, o in zip("xyz", size, start, strict=True)]
    rest = [c for c in points.columns if c not in ("batch", "px", "py", "pz")]
    return points.select(*rest, batch.alias("batch"), *cells)


def sparse_quantize(points: DataFrame, voxel_size=1.0, origin=0.0, active: Column | None = None) -> SparseQuantization:
    """Voxels of points (point_id, batch?, px, py, pz), numbered as first seen by point_id, and the voxel of each point."""
    cells = _cells(points, voxel_size, origin).select("point_id", *COORDS)
    used = _cells(points if active is None else points.where(active), voxel_size, origin)
    voxels = used.groupBy(*COORDS).agg(F.min("point_id").alias("_first"), F.count("*").alias("count"))
    voxels = numbered(voxels, "_first", "row_id").select("row_id", *COORDS, "count")
    rows = (cells if active is None else used.select("point_id", *COORDS)).join(voxels, list(COORDS)).select("point_id", F.col("row_id").alias("voxel_row"))
    if active is not None:
        rows = points.select("point_id").join(rows, "point_id", "left").select("point_id", F.coalesce("voxel_row", F.lit(-1)).cast("long").alias("voxel_row"))
    return SparseQuantization(voxels, rows)


def _reduced(reduction: str, column: str) -> Column:
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be mean or sum")
    return (F.avg if reduction == "mean" else F.sum)(F.col(column).cast("double"))


def voxelize(points: DataFrame, voxel_size=1.0, origin=0.0, reduction: str = "mean", stride=1) -> LatticeFrame:
    """Mean or sum of the points' features f0, f1, ... by voxel: one aggregate, of which only sums are shuffled."""
    names = [c for c in points.columns if c[0] == "f" and c[1:].isdigit()]
    cells = _cells(points, voxel_size, origin)
    sums = cells.groupBy(*COORDS).agg(F.min("point_id").alias("_first"), *[_reduced(reduction, c).alias(c) for c in names])
    df = numbered(sums, "_first", "row_id").select("row_id", *COORDS, *names)
    return LatticeFrame(df, len(names), triple(stride, "stride"), unique=True)


def voxelize_with_quantization(quantization: SparseQuantization, feats: DataFrame, reduction: str = "mean", stride=1) -> LatticeFrame:
    """Other features (point_id, f0, ...) over voxels found before."""
    names = [c for c in feats.columns if c != "point_id"]
    rows = quantization.assignment.where("voxel_row >= 0").join(feats, "point_id")
    sums = rows.groupBy(F.col("voxel_row").alias("row_id")).agg(*[_reduced(reduction, c).alias(c) for c in names])
    df = quantization.voxels.select("row_id", *COORDS).join(sums, "row_id", "left").na.fill(0.0, names)
    return LatticeFrame(df.select("row_id", *COORDS, *names), len(names), triple(stride, "stride"), unique=True)


def build_point_voxel_map(points: DataFrame, voxels: DataFrame, voxel_size=1.0, origin=0.0, interpolation: str = "linear") -> DataFrame:
    """point_id, corner, voxel_row, weight: the voxels each point reads. Voxel i is the grid vertex i.

    linear: the eight vertices around a point with trilinear weights, corner bits x, y, z lowest first; nearest: the
    vertex at floor(p + 0.5). Vertices that are no voxel are left out and weights not scaled up for them.
    """
    size, start = _sizes(voxel_size), _triple(origin, "origin")
    batch = F.col("batch").cast("int") if "batch" in points.columns else F.lit(0)
    at = [_place(a, s, o).alias(f"q{a}") for a, s, o in zip("xyz", size, start, strict=True)]
    rows = points.select("point_id", batch.alias("batch"), *at)
    if interpolation == "nearest":
        rows = rows.select("point_id", "batch", F.lit(0).alias("corner"), *[F.floor((F.col(f"q{a}") + F.lit(0.5).cast("float")).cast("float")).cast("int").alias(a) for a in "xyz"], F.lit(1.0).cast("float").alias("weight"))
    elif interpolation == "linear":
        rows = rows.select("point_id", "batch", *[F.floor(f"q{a}").cast("int").alias(f"b{a}") for a in "xyz"], *[(F.col(f"q{a}") - F.floor(f"q{a}").cast("float")).cast("float").alias(f"t{a}") for a in "xyz"], F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner"))
        bit = lambda i: F.shiftright(F.col("corner"), i).bitwiseAND(F.lit(1))
        weight = F.lit(1.0).cast("float")
        for i, a in enumerate("xyz"):
            weight = (weight * F.when(bit(i) == 1, F.col(f"t{a}")).otherwise((F.lit(1.0).cast("float") - F.col(f"t{a}")).cast("float"))).cast("float")
        rows = rows.select("point_id", "batch", "corner", *[(F.col(f"b{a}") + bit(i)).cast("int").alias(a) for i, a in enumerate("xyz")], weight.alias("weight"))
    else:
        raise ValueError("interpolation must be linear or nearest")
    return rows.join(lookup_side(voxels, "voxel_row"), list(COORDS)).select("point_id", "corner", "voxel_row", "weight")


def interpolate_point_features(points: DataFrame, voxels: LatticeFrame, mapping: DataFrame) -> DataFrame:
    """point_id and the weighted sum of its voxels' features; 0 for a point that reads none."""
    rows = mapping.join(voxels.feats.withColumnRenamed("row_id", "voxel_row"), "voxel_row")
    sums = rows.groupBy("point_id").agg(*[F.sum(F.col("weight").cast("double") * F.col(c)).alias(c) for c in voxels.names])
    return points.select("point_id").join(sums, "point_id", "left").na.fill(0.0, voxels.names)


def devoxelize(points: DataFrame, voxels: LatticeFrame, voxel_size=1.0, origin=0.0, interpolation: str = "linear", mapping: DataFrame | None = None) -> DataFrame:
    mapping = build_point_voxel_map(points, voxels.coords, voxel_size, origin, interpolation) if mapping is None else mapping
    return interpolate_point_features(points, voxels, mapping)
