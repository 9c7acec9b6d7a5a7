"""Local and global pooling, and their gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame, numbered
from gridstone.geometry import COORDS, KernelSpec, floor_div
from gridstone.operators import relations as R

MODES = ("sum", "max", "avg")


def pooled(mode: str, column: str) -> Column:
    """NaN never wins a maximum."""
    if mode == "max":
        return F.max(F.when(~F.isnan(column), F.col(column)))
    return F.sum(column) if mode == "sum" else F.avg(column)


def _empty(mode: str) -> Column:
    return F.lit(float("-inf")) if mode == "max" else F.lit(0.0)


def pool_relation(x: LatticeFrame, relation: R.Relation, mode: str) -> DataFrame:
    """Every output row; one that no edge reaches has 0, or minus infinity for max."""
    rows = relation.edges.join(x.feats.withColumnRenamed("row_id", "in_row"), "in_row")
    sums = rows.groupBy("out_row").agg(*[pooled(mode, c).alias(c) for c in x.names]).withColumnRenamed("out_row", "row_id")
    out = relation.out.join(sums, "row_id", "left")
    return out.select("row_id", *COORDS, *[F.coalesce(F.col(c).cast("double"), _empty(mode)).alias(c) for c in x.names])


def pool3d(x: LatticeFrame, mode: str = "sum", kernel_size=2, stride=2, padding=0, dilation=1, cache: R.RelationCache | None = None) -> LatticeFrame:
    """Pool over a forward relation; avg divides by the edges an output has.

    A kernel that tiles the lattice needs no relation: one aggregate by floor(coordinate / stride), of which only
    sums are shuffled. It sees the lowest row of each coordinate, as relations do.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spec = KernelSpec.of(kernel_size, stride, padding, dilation)
    out_stride = tuple(a * b for a, b in zip(x.stride, spec.stride, strict=True))
    if spec.tiles and not spec.keeps_support:
        rows = x.df
        if not x.unique:
            first = F.min_by(F.struct(*x.names), "row_id").alias("f")
            rows = rows.groupBy(*COORDS).agg(F.min("row_id").alias("row_id"), first).select("row_id", *COORDS, "f.*")
        cells = rows.select("row_id", "batch", *[floor_div(F.col(c), s).alias(c) for c, s in zip("xyz", spec.stride, strict=True)], *x.names)
        sums = cells.groupBy(*COORDS).agg(F.min("row_id").alias("_first"), *[pooled(mode, c).alias(c) for c in x.names])
        filled = [F.coalesce(F.col(c).cast("double"), _empty(mode)).alias(c) for c in x.names]
        return x.renewed(numbered(sums, "_first", "row_id").select("row_id", *COORDS, *filled), stride=out_stride, unique=True)
    relation = R.kernel_relation(x, kernel_size, stride, padding, dilation, cache=cache)
    df = pool_relation(x, relation, mode)
    if spec.keeps_support:
        return LatticeFrame(df, x.channels, x.stride, x.key, x.batches, x.unique)
    return x.renewed(df, stride=out_stride, unique=True)


def sum_pool3d(x: LatticeFrame, kernel_size=2, stride=2, padding=0, dilation=1, cache=None) -> LatticeFrame:
    return pool3d(x, "sum", kernel_size, stride, padding, dilation, cache)


def max_pool3d(x: LatticeFrame, kernel_size=2, stride=2, padding=0, dilation=1, cache=None) -> LatticeFrame:
    return pool3d(x, "max", kernel_size, stride, padding, dilation, cache)


def avg_pool3d(x: LatticeFrame, kernel_size=2, stride=2, padding=0, dilation=1, cache=None) -> LatticeFrame:
    return pool3d(x, "avg", kernel_size, stride, padding, dilation, cache)


def _global(x: LatticeFrame, mode: str) -> DataFrame:
    """batch, f0, ...: empty batches (where the frame knows how many there are) give 0; for max they raise."""
    sums = x.df.groupBy("batch").agg(*[pooled(mode, c).cast("double").alias(c) for c in x.names])
    if x.batches is None:
        return sums
    every = x.df.sparkSession.range(x.batches).select(F.col("id").cast("int").alias("batch"))
    if mode == "max":
        message = F.raise_error(F.lit("maximum of an empty batch")).cast("double")
        fill = lambda c: F.when(F.col("_n").isNull(), message).otherwise(F.col(c))
    else:
        fill = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = every.join(sums.withColumn("_n", F.lit(1)), "batch", "left")
    return rows.select("batch", *[fill(c).alias(c) for c in x.names])


def global_sum_pool(x: LatticeFrame) -> DataFrame:
    return _global(x, "sum")


def global_avg_pool(x: LatticeFrame) -> DataFrame:
    return _global(x, "avg")


def global_max_pool(x: LatticeFrame) -> DataFrame:
    return _global(x, "max")
