"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing, in levels."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import durable


@dataclass(frozen=True)
class Sharding:
    """Parameters.

    shards: how many shards. overhead: bytes added to the text of every document.
    leaf: groups differenced in one task at most on average. fan: partial partitions combined in one task.
    slot_rows: documents numbered in one task on average.
    """

    shards: int = 40
    overhead: int = 16
    leaf: int = 20_000
    fan: int = 64
    slot_rows: int = 50_000


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions into one; ``parts`` has one row of m sums each. Returns where each sum goes (n x m).

    Karmarkar-Karp: the two partitions with the largest spread (largest less smallest sum) are added, one in
    descending and the other in ascending order, until one is left. Ties go by position.
    """
    n, m = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = {i: parts[i, order[i]] for i in range(n)}
    heap = [(int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        by = np.argsort(-both, kind="stable")
        both = both[by]
        new = n + len(merged)
        merged.append((a, b, by))
        sums[new] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), new))
    place = {n + len(merged) - 1: np.arange(m)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, by = merged[k]
        final = place.pop(n + k)
        for child, slots in ((a, by), (b, m - 1 - by)):
            at = np.empty(m, np.int64)
            at[slots] = final
            place[child] = at
    out = np.empty((n, m), np.int64)
    for i in range(n):
        out[i, order[i]] = place[i]
    return out


def _leaves(groups: DataFrame, p: Sharding, buckets: int) -> DataFrame:
    """node, key, slot, bytes: the groups of each bucket differenced into ``shards`` slots."""
    m = p.shards

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        parts = np.zeros((len(pdf), m), np.int64)
        parts[:, 0] = pdf["bytes"]
        return pdf.assign(slot=difference(parts)[:, 0])[["node", "key", "slot", "bytes"]]

    keyed = groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return keyed.groupBy("node").applyInPandas(run, "node long, key string, slot long, bytes long")


def _level(nodes: DataFrame, p: Sharding) -> DataFrame:
    """node, slot, parent, to: ``fan`` partial partitions at a time combined into one."""
    m = p.shards

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="node", columns="slot", values="bytes").reindex(columns=range(m)).fillna(0).astype("int64")
        wide = wide.sort_index()
        to = difference(wide.to_numpy())
        return pd.DataFrame(
            {
                "node": np.repeat(wide.index.to_numpy(), m),
                "slot": np.tile(np.arange(m), len(wide)),
                "parent": int(pdf["parent"].iloc[0]),
                "to": to.ravel(),
            }
        )

    rows = nodes.withColumn("parent", F.floor(F.col("node") / p.fan))
    return rows.groupBy("parent").applyInPandas(run, "node long, slot long, parent long, to long")


def assign_groups(groups: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """key, shard for groups given as key (STRING) and bytes (LONG).

    Groups are dealt by hash into buckets of about ``leaf``; each is differenced on its own, and the partial
    partitions that result are combined ``fan`` at a time, level by level, by the same rule. A task holds at most a
    bucket of sizes, whatever the input; the driver holds none.
    """
    buckets = max(1, -(-groups.count() // p.leaf))
    leaves = durable(_leaves(groups, p, buckets), "shard-leaves")
    nodes = leaves.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    where = leaves.select("key", "node", "slot")
    while buckets > 1:
        step = durable(_level(nodes, p), "shard-level")
        nodes = nodes.join(step, ["node", "slot"]).groupBy(F.col("parent").alias("node"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        where = where.join(step, ["node", "slot"]).select("key", F.col("parent").alias("node"), F.col("to").alias("slot"))
        buckets = -(-buckets // p.fan)
    return where.select("key", F.col("slot").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every document in a shard, equal texts together, bytes near equal.

    size: UTF-8 bytes of the text and ``overhead``. slot: place in the shard, gapless from 0, in an order that a
    rerun repeats. Equal texts are recognised by a 128-bit digest and their length. Defined cases: a null text counts
    as the empty text; null or repeated doc_ids and repeated rows each have a slot of their own; extra columns
    are ignored; an empty table gives an empty result. A group larger than its share of the bytes stays whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + p.overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat_ws("-", F.octet_length(text).cast("string"), F.md5(text)).alias("key"),
    )
    keyed = durable(keyed, "shard-keys")
    groups = durable(keyed.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    parts = max(1, -(-keyed.count() // p.slot_rows))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).alias("part")
    placed = durable(
        keyed.join(assign_groups(groups, p), "key").select("doc_id", "size", "text_crc32", "shard", part), "shard-placed"
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("row", F.row_number().over(within)).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("row") - 1).alias("slot")
    )
