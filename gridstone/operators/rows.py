"""Choosing and collating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame, numbered
from gridstone.geometry import COORDS, triple


def crop(x: LatticeFrame, min_coord, max_coord) -> LatticeFrame:
    """Rows inside a box, both ends included; a plain filter, so it reaches the scan. Rows keep their order."""
    low, high = tuple(min_coord), tuple(max_coord)
    if len(low) != 3 or len(high) != 3 or any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("the box needs three coordinates each, min not above max")
    inside = [F.col(c).between(a, b) for c, a, b in zip("xyz", low, high, strict=True)]
    kept = x.df.where(reduce(lambda a, b: a & b, inside))
    return x.renewed(_renumbered(kept, x), batches=None)


def _renumbered(df: DataFrame, x: LatticeFrame) -> DataFrame:
    return numbered(df.withColumnRenamed("row_id", "_old"), "_old", "row_id").select("row_id", *COORDS, *x.names)


def prune(x: LatticeFrame, rows: DataFrame) -> LatticeFrame:
    """Rows named by ``rows`` (position LONG, row LONG), in order of position; a row may be named again."""
    named = rows.select(F.col("position").alias("_position"), F.col("row").alias("row_id"))
    df = x.df.join(named, "row_id").drop("row_id")
    return x.renewed(numbered(df, "_position", "row_id").select("row_id", *COORDS, *x.names), batches=None, unique=False)


def prune_mask(x: LatticeFrame, mask: Column) -> LatticeFrame:
    """Rows for which a condition over their columns holds, in their order."""
    return x.renewed(_renumbered(x.df.where(mask), x), batches=None)


def topk_rows(x: LatticeFrame, counts: list[int], rho: float = 1.0) -> DataFrame:
    """position, row: of each batch the int(int(count) * rho) rows largest in channel 0, ascending; batches in order.

    Ties are ordered by row. The rank filter stands before the shuffle of a batch is complete, so that each task
    sends at most as many rows as are wanted.
    """
    keep = [int(int(c) * rho) for c in counts]
    most = F.element_at(F.array(*[F.lit(k) for k in keep]), F.col("batch") + 1)
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("f0"), F.desc("row_id")))
    top = x.df.where((F.col("batch") >= 0) & (F.col("batch") < len(keep))).select("batch", "row_id", "f0", rank.alias("rank"))
    top = top.where(F.col("rank") <= max(keep, default=0)).where(F.col("rank") <= most)
    before = [sum(keep[:b]) for b in range(len(keep))]
    size = F.count("*").over(Window.partitionBy("batch"))
    # a batch with fewer rows than wanted leaves a gap in position, which only orders rows
    position = F.element_at(F.array(*[F.lit(v) for v in before]), F.col("batch") + 1) + size - F.col("rank")
    return top.select(position.cast("long").alias("position"), F.col("row_id").alias("row"))


def sparse_collate(frames: list[DataFrame], stride=1) -> LatticeFrame:
    """Frames without batch (row_id, x, y, z, f0, ...) one after the other; the batch is the place in the list."""
    if not frames:
        raise ValueError("nothing to collate")
    names = [c for c in frames[0].columns if c not in ("row_id", "x", "y", "z")]
    if any([c for c in f.columns if c not in ("row_id", "x", "y", "z")] != names for f in frames):
        raise ValueError("features differ")
    parts = [f.select(F.lit(b).alias("batch"), F.col("row_id").alias("_old"), "x", "y", "z", *names) for b, f in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, parts)
    tops = rows.groupBy("batch").agg((F.max("_old") + 1).alias("_size"))
    starts = tops.select("batch", F.coalesce(F.sum("_size").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(F.broadcast(starts), "batch").withColumn("_order", F.col("_base") + F.col("_old"))
    df = numbered(rows, "_order", "row_id").select("row_id", *COORDS, *names)
    return LatticeFrame(df, len(names), triple(stride, "stride"), batches=len(frames))
