"""Coordinate sets: union, intersection, lookup, ordering, occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.frame import first_seen, lookup_side, numbered
from gridstone.geometry import COORDS, Triple, child_index, floor_div, morton_code, triple


def downsample_coords(coords: DataFrame, stride: int | Triple = 2) -> DataFrame:
    """Distinct floor(coordinate / stride), numbered as first seen."""
    steps = triple(stride, "stride")
    return first_seen(coords.select("row_id", "batch", *[floor_div(F.col(c), s).alias(c) for c, s in zip("xyz", steps, strict=True)]))


def union_coords(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """Distinct coordinates of both, those of ``lhs`` first, each side as first seen."""
    left = lhs.select(F.lit(0).alias("side"), "row_id", *COORDS)
    right = rhs.select(F.lit(1).alias("side"), "row_id", *COORDS)
    # the two sides interleave nowhere: right ids follow the largest left one
    top = lhs.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("top"))
    seen = left.unionByName(right).join(F.broadcast(top)).withColumn("order", F.col("row_id") + F.col("side") * (F.col("top") + 1))
    return first_seen(seen, "order")


def intersection_coords(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    """Distinct coordinates of ``lhs`` that ``rhs`` has too, as first seen in ``lhs``."""
    return first_seen(lhs.join(rhs.select(*COORDS), list(COORDS), "left_semi"))


def lookup_coords(coords: DataFrame, queries: DataFrame) -> DataFrame:
    """row_id of each query and ``found``: the lowest row with its coordinates, or -1."""
    return queries.join(lookup_side(coords, "found"), list(COORDS), "left").select("row_id", F.coalesce("found", F.lit(-1)).cast("long").alias("found"))


def contains_coords(coords: DataFrame, queries: DataFrame) -> DataFrame:
    return lookup_coords(coords, queries).select("row_id", (F.col("found") >= 0).alias("contained"))


def inverse_map(source: DataFrame, target: DataFrame) -> DataFrame:
    return lookup_coords(source, target)


def morton_codes(coords: DataFrame) -> DataFrame:
    return coords.select("row_id", morton_code().alias("code"))


def morton_order(coords: DataFrame) -> DataFrame:
    """row_id and its position in Morton order (ties by row).

    Codes are ranked in ranges between quantiles; only totals of ranges are summed in order.
    """
    codes = morton_codes(coords)
    marks = codes.agg(F.percentile_approx("code", [i / 64 for i in range(1, 64)], 1000).alias("marks"))
    part = F.size(F.filter("marks", lambda m: m < F.col("code")))
    rows = codes.join(F.broadcast(marks)).select("row_id", "code", part.alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("code", "row_id"))
    return rows.join(F.broadcast(starts), "part").select("row_id", "code", (F.col("at") + within - 1).cast("long").alias("position"))


def morton_sort_coords(coords: DataFrame) -> DataFrame:
    """The coordinates by position: position, order (the row that stands there), batch, x, y, z; inverse is position by row."""
    return coords.join(morton_order(coords), "row_id").select("position", F.col("row_id").alias("order"), *COORDS)


def occupancy_downsample(coords: DataFrame) -> DataFrame:
    """Parents (floor(coordinate / 2), as first seen) and the bit set of their occupied cells."""
    bit = F.call_function("shiftleft", F.lit(1), child_index()).alias("bit")
    cells = coords.select("row_id", "batch", *[floor_div(F.col(c), 2).alias(c) for c in "xyz"], bit)
    parents = cells.groupBy(*COORDS).agg(F.min("row_id").alias("_first"), F.bit_or("bit").cast("int").alias("occupancy"))
    return numbered(parents, "_first", "row_id").select("row_id", *COORDS, "occupancy")


def occupancy_expand(parents: DataFrame) -> DataFrame:
    """The occupied cells of each parent in ascending bit order: row_id, batch, x, y, z, parent_row, child."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("occupancy"), i).bitwiseAND(F.lit(1)) == 1)
    rows = parents.select(F.col("row_id").alias("parent_row"), *COORDS, F.explode(bits).alias("child"))
    rows = rows.withColumn("order", F.col("parent_row") * 8 + F.col("child"))
    return numbered(_children(rows), "order", "row_id").select("row_id", *COORDS, "parent_row", "child")


def _children(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: (F.col(c) * 2 + F.call_function("shiftright", F.col("child"), F.lit(i)).bitwiseAND(F.lit(1))).cast("int") for i, c in enumerate("xyz")})


def child_coords_from_indices(parents: DataFrame, indices: DataFrame) -> DataFrame:
    """Of each row of ``indices`` (row_id, parent_row, child) the cell 2 * parent + bits of child."""
    rows = indices.join(parents.select(F.col("row_id").alias("parent_row"), *COORDS), "parent_row")
    return _children(rows).select("row_id", *COORDS)
