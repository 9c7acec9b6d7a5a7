"""Coordinate-aligned joins and arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame, lookup_side, numbered
from gridstone.geometry import COORDS

JOINS = ("inner", "left", "right", "outer")


def build_sparse_alignment(lhs: DataFrame, rhs: DataFrame, join: str = "inner") -> DataFrame:
    """row_id, batch, x, y, z, lhs_row, rhs_row (-1: missing).

    inner: lhs rows with a match; left: all lhs rows; right: all rhs rows in their order; outer: all lhs rows, then the
    rhs rows whose coordinates lhs lacks. A lookup finds the lowest row, so a full join (which would pair
    duplicates) is not it: outer is a left join and an anti join.
    """
    if join not in JOINS:
        raise ValueError(f"join must be one of {JOINS}")
    on = list(COORDS)
    own, other = ("rhs_row", "lhs_row") if join == "right" else ("lhs_row", "rhs_row")
    first, second = (rhs, lhs) if join == "right" else (lhs, rhs)
    rows = first.select(F.col("row_id").alias(own), *COORDS).join(lookup_side(second, other), on, "inner" if join == "inner" else "left")
    rows = rows.select(*COORDS, "lhs_row", "rhs_row", F.col(own).alias("_order"))
    if join == "outer":
        top = lhs.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("_top"))
        extra = rhs.select(F.col("row_id").alias("rhs_row"), *COORDS).join(lhs.select(*COORDS), on, "left_anti").join(F.broadcast(top))
        rows = rows.unionByName(extra.select(*COORDS, F.lit(None).cast("long").alias("lhs_row"), "rhs_row", (F.col("rhs_row") + F.col("_top")).alias("_order")))
    missing = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return numbered(rows, "_order", "row_id").select("row_id", *COORDS, missing("lhs_row"), missing("rhs_row"))


def align_sparse(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "inner") -> DataFrame:
    if lhs.stride != rhs.stride:
        raise ValueError("strides differ")
    return build_sparse_alignment(lhs.coords, rhs.coords, join)


def gather_aligned_features(x: LatticeFrame, rows: DataFrame, column: str = "found", fill: float = 0.0) -> DataFrame:
    """row_id and the features of the row that ``column`` names; ``fill`` where it is negative."""
    feats = x.df.select(F.col("row_id").alias(column), *x.names)
    joined = rows.select("row_id", column).join(feats, column, "left")
    return joined.select("row_id", *[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) for c in x.names])


def _aligned(lhs: LatticeFrame, rhs: LatticeFrame, join: str, lhs_fill: float, rhs_fill: float) -> DataFrame:
    """row_id, batch, x, y, z, l0, ..., r0, ...; frames of one identity need a join on rows only if they are different tables."""
    left = [F.col(c).alias(f"l{i}") for i, c in enumerate(lhs.names)]
    right = [F.col(c).alias(f"r{i}") for i, c in enumerate(rhs.names)]
    if lhs.same_coords(rhs):
        if lhs.df is rhs.df:
            return lhs.df.select("row_id", *COORDS, *left, *right)
        return lhs.df.select("row_id", *COORDS, *left).join(rhs.df.select("row_id", *right), "row_id")
    rows = align_sparse(lhs, rhs, join)
    rows = rows.join(lhs.df.select(F.col("row_id").alias("lhs_row"), *left), "lhs_row", "left")
    rows = rows.join(rhs.df.select(F.col("row_id").alias("rhs_row"), *right), "rhs_row", "left")
    filled = [F.coalesce(F.col(f"l{i}").cast("double"), F.lit(lhs_fill)).alias(f"l{i}") for i in range(lhs.channels)]
    filled += [F.coalesce(F.col(f"r{i}").cast("double"), F.lit(rhs_fill)).alias(f"r{i}") for i in range(rhs.channels)]
    return rows.select("row_id", *COORDS, *filled)


def _result(lhs: LatticeFrame, rhs: LatticeFrame, df: DataFrame, channels: int) -> LatticeFrame:
    if lhs.same_coords(rhs):
        return replace(lhs, df=df, channels=channels)
    return lhs.renewed(df, channels=channels, batches=None, unique=lhs.unique and rhs.unique)


def sparse_binary_op(lhs: LatticeFrame, rhs: LatticeFrame, op: Callable[[Column, Column], Column], join: str = "outer", lhs_fill: float = 0.0, rhs_fill: float = 0.0) -> LatticeFrame:
    if lhs.channels != rhs.channels:
        raise ValueError("channels differ")
    rows = _aligned(lhs, rhs, join, lhs_fill, rhs_fill)
    out = [op(F.col(f"l{i}"), F.col(f"r{i}")).alias(f"f{i}") for i in range(lhs.channels)]
    return _result(lhs, rhs, rows.select("row_id", *COORDS, *out), lhs.channels)


def sparse_add(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "outer") -> LatticeFrame:
    return sparse_binary_op(lhs, rhs, lambda a, b: a + b, join)


def sparse_sub(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "outer") -> LatticeFrame:
    return sparse_binary_op(lhs, rhs, lambda a, b: a - b, join)


def sparse_mul(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "inner") -> LatticeFrame:
    return sparse_binary_op(lhs, rhs, lambda a, b: a * b, join)


def sparse_maximum(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "inner") -> LatticeFrame:
    return sparse_binary_op(lhs, rhs, F.greatest, join)


def sparse_minimum(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "inner") -> LatticeFrame:
    either = lambda a, b: F.when(F.isnan(a) | F.isnan(b), float("nan")).otherwise(F.least(a, b))
    return sparse_binary_op(lhs, rhs, either, join)


def sparse_cat_aligned(lhs: LatticeFrame, rhs: LatticeFrame, join: str = "inner") -> LatticeFrame:
    """Channels of both side by side; 0 where one is missing."""
    rows = _aligned(lhs, rhs, join, 0.0, 0.0)
    both = [f"l{i}" for i in range(lhs.channels)] + [f"r{i}" for i in range(rhs.channels)]
    return _result(lhs, rhs, rows.select("row_id", *COORDS, *[F.col(c).alias(f"f{i}") for i, c in enumerate(both)]), len(both))


def cat(frames: list[LatticeFrame], join: str = "inner") -> LatticeFrame:
    """Any number of frames of one identity, else two."""
    if not frames:
        raise ValueError("nothing to concatenate")
    if len(frames) > 2 and not all(frames[0].same_coords(f) for f in frames):
        raise ValueError("more than two frames must share their coordinates")
    out = frames[0]
    for f in frames[1:]:
        out = sparse_cat_aligned(out, f, join)
    return out
