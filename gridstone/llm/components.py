"""Connected components by alternating large-star and small-star passes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import discard, durable, tidy


def _stars(links: DataFrame) -> bool:
    """Whether every node on the left of a link has that link alone and is on the right of none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    sums = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.count("*").alias("all"))
    return sums.where("outs > 0 and all > 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``a``, ``b`` (LONG) of links to columns ``node``, ``root``: the smallest id that a node reaches.

    Only ids that occur in a link between two different ids are returned. Null ends and self links are
    dropped, repeated links are harmless. Each pass links every node straight to a smaller node it already
    reaches, so chains shrink geometrically; passes go on until all links are stars around a smallest id.
    A pass aggregates minima map-side before it shuffles, and joins split hot hubs under AQE; nothing but the
    answer whether that is so comes to the driver, whose memory of the passes' plans is freed at the end. Every pass is written to the shared folder.
    """
    links = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = durable(large, name)
        discard(links)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = durable(down.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        discard(large)
    tidy(links.sparkSession)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
