"""Reading and writing lattices and points as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame, numbered
from gridstone.geometry import COORDS, morton_code


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_lattice(spark: SparkSession, path: str, stride=1, batches: int | None = None, unique: bool = False) -> LatticeFrame:
    """Columns row_id, batch, x, y, z, f0, ...; filters on coordinates and unused channels reach the scan."""
    return LatticeFrame.of(spark.read.parquet(path), stride, batches, unique)


def write_lattice(x: LatticeFrame, path: str, files: int | None = None) -> None:
    """Rows clustered along the Morton curve, so that a box touches few row groups; ``files`` ranges of it if given."""
    rows = x.df.withColumn("_code", morton_code())
    rows = rows.repartitionByRange("_code") if files is None else rows.repartitionByRange(files, "_code")
    rows.sortWithinPartitions("_code").drop("_code").write.parquet(path)


def lattice_from(rows: DataFrame, coords: dict[str, Column], features: list[Column], order: str | None = None, **known) -> LatticeFrame:
    """A lattice over any table: expressions for batch, x, y, z and features, one row each.

    order: a unique LONG column that numbers rows; without one, coordinates must be unique and number them by Morton code.
    """
    df = rows.select(
        *[coords[c].cast("int").alias(c) for c in COORDS], *[f.alias(f"f{i}") for i, f in enumerate(features)], *([F.col(order).alias("_order")] if order else [])
    )
    if not order:
        df = df.withColumn("_order", morton_code())
        known["unique"] = True
    return LatticeFrame.of(numbered(df, "_order", "row_id", sparse=not order).drop("_order"), **known)
