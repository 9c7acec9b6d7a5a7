"""Exact set-similarity links that are left between components: joins on common lists, and on what sets differ from a reference by.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import discard, durable


#: So many lists (12 bytes each) are broadcast to rows that hold whole sets; more are joined.
BROADCAST_LISTS = 1_000_000


def references(held_against: DataFrame) -> DataFrame:
    """node, ref: of a node and the members it was held against (node, b) the one that most were held against."""
    degrees = held_against.groupBy(F.col("b").alias("ref")).agg(F.count("*").alias("degree"))
    each = held_against.select("node", F.col("b").alias("ref")).join(degrees, "ref").unionByName(degrees.withColumn("node", F.col("ref")))
    return each.groupBy("node").agg(F.max(F.struct("degree", "ref")).alias("top")).select("node", "top.ref")


def _holds(condition: str, threshold: int, whole: bool = False) -> str:
    """Rows s and t of one list are near enough in size and meet ``condition``; see ``met``."""
    both = "array_intersect(s.held, t.held)"
    most = condition.replace("size(both)", "least(size(s.held), size(t.held))")
    first = f"{both}[0] = s.v and " if whole else ""
    return f"s.v = t.v and 100 * least(s.n, t.n) >= {threshold} * greatest(s.n, t.n) and {most} and {first}{condition.replace('both', both)}"


def met(looked: DataFrame, before: str, condition: str, threshold: int, block: int, name: str, done: tuple[DataFrame, ...] = (), whole: bool = False) -> DataFrame:
    """Pairs (a, b) of different roots that look up a common list v and meet ``before`` and ``condition`` on both rows (s and t).

    Each row holds its lists from v on, rarest first (``held``); ``both`` in the condition stands for the common ones. A pair
    meets the condition at the rarest list it shares, where all common ones are held; further on fewer are, so that it may
    be made again there, but never instead. What is held from v on bounds ``both``, so that pairs which meet late, at common
    lists, are let go by their lengths before any lists are intersected (``whole``: rows hold the lists before v too, which
    tell the rarest shared one but bound nothing). A list is dealt in blocks of ``block`` members, each against the
    whole list; all of the condition is taken inside the join, so pairs that do not meet it make no rows. ``done``: tables
    of ``durable`` that only ``looked`` reads, deleted once it is written.
    """
    looked = durable(looked, f"{name}-looked")
    discard(*done)
    sizes = looked.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 < r1")
    sizes = durable(sizes.select("v", F.ceil(F.col("m") / block).cast("int").alias("blocks")), f"{name}-lists")
    looked = looked.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LISTS else sizes, "v")
    few, many = looked.where("blocks = 1").drop("blocks"), looked.where("blocks > 1")
    one = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    on = f"s.root < t.root and {before} and {_holds(condition, threshold, whole)}"
    short = few.alias("s").join(few.alias("t"), F.expr(on))  # both sides are one shuffle
    long = one.alias("s").join(every.alias("t"), F.expr(f"s.block = t.block and {on}"))
    ends = [F.col("s.node").alias("a"), F.col("t.node").alias("b")]
    return short.select(*ends).unionByName(long.select(*ends))


def links_within(found: DataFrame, threshold: int, block: int, name: str) -> DataFrame:
    """All links (a, b) between different roots among the nodes of one reference, exactly.

    ``found``: node, root, n (size of the node's set), ref, m (size of the reference's set), d (the elements that only
    one of both has); a table of ``durable``, which is deleted. Two sets differ by |D| + |D'| - 2 |D and D'| elements, and are linked where that is at most
    (100 - threshold) / (100 + threshold) of both sizes together. Linked nodes of different roots therefore share at least
    ``t`` elements of D (two that may share none are both linked to the reference), and elements of D are edits,
    shared by few; a node looks up its rarest ``|D| - t + 1`` ones.
    """
    up, down = 100 + threshold, 100 - threshold
    t = F.greatest(F.lit(1), F.expr(f"cast(({up} * size(d) - {down} * (n + m) + 199) div 200 as int)"))
    each = found.select("node", "root", "n", F.size("d").alias("size"), t.alias("t"), "ref", F.explode("d").alias("v")).withColumn("v", F.xxhash64("ref", "v"))
    lists = each.groupBy("v").agg(F.count("*").alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("v", "c")
    looked = (
        each.join(lists, "v")
        .groupBy("node", "root", "n", "size", "t")
        .agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"))
        .where("size(held) >= t")
        .select("node", "root", "n", "size", F.col("held.v").alias("held"), F.posexplode(F.slice("held.v", F.lit(1), F.expr("size(held) - t + 1"))).alias("i", "v"))
        .select("node", "root", "n", "size", F.expr("slice(held, i + 1, size(held))").alias("held"), "v")
    )
    return met(looked, "true", f"{2 * up} * size(both) >= {up} * (s.size + t.size) - {down} * (s.n + t.n)", threshold, block, name, (found,))
