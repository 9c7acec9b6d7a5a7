"""Near-duplicate documents by bottom-k sketches from one hash function.

Inverted lists of retained values give overlaps, union sketches estimate similarity, whole shingle sets decide.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.common import durable
from gridstone.llm.components import connected_components
from gridstone.llm.differences import links_within, met, references


@dataclass(frozen=True)
class NearDup:
    """Parameters.

    shingle: words in a shingle. threshold: Jaccard similarity of shingle sets, in hundredths (70 to 100).
    k: values a sketch retains. Inverted lists belong to two neighbouring retained values, which unrelated documents
    seldom share. overlap: lists that two linked sketches have in common at least. With k = 64 and similarity 0.8 they share 40
    to 44 of 63 on average with deviation 5, so a bound of 15 loses about one link at exactly 0.8 in a million (smaller
    sets are held whole, and there the bound follows from the threshold without loss).
    extra: how many common lists beyond one are asked for in the (accordingly longer) rarest-first prefixes.
    slack: how far below the threshold an estimate may be and still be verified; four deviations.
    rounds: in which members picked from each list are held against the others, before all that still differ are joined.
    near: lists that a class and its reference have in common at least.
    block: members of a list that stand in one block of that join.
    broadcast_ids: so many ids of candidates (8 bytes each) are broadcast to find their texts; more are joined.
    """

    shingle: int = 5
    threshold: int = 80
    k: int = 64
    overlap: int = 15
    extra: int = 3
    slack: float = 0.2
    rounds: int = 3
    near: int = 6
    block: int = 1_000
    broadcast_ids: int = 1_000_000
    seed: int = 23


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle values (63 bits) of every text."""
    words, cuts = common.word_hashes(column, common.SPACES)
    for i in range(len(column)):
        yield np.unique(common.shingles(words[cuts[i] : cuts[i + 1]], size) >> np.uint64(1)).view(np.int64)


def _sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, n (set size), fp (digest of the whole set), sketch (the k smallest values) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            n, digests, low = [], [], []
            for values in _sets(batch.column(1), p.shingle):
                n.append(len(values))
                digests.append(hashlib.blake2b(values, digest_size=16).digest())
                low.append(values[: p.k])
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], schema=schema
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, fp binary, sketch array<long>")


def _whole_sets(docs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """node, members: the whole shingle sets of the documents named, as packed sorted values (a table)."""
    if nodes.count() <= p.broadcast_ids:
        nodes = F.broadcast(nodes)
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            packed = [x.tobytes() for x in _sets(batch.column(1), p.shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return durable(rows.join(nodes, "node", "left_semi").mapInArrow(run, "node long, members binary"), "neardup-sets")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) that meet the threshold: first by the estimate from union sketches, then on whole sets."""
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, p.k)
    estimate = F.size(F.array_intersect(F.array_intersect("x", "y"), "u")) / F.size("u")
    likely = (
        pairs.join(sketches.toDF("a", "x"), "a")
        .join(sketches.toDF("b", "y"), "b")
        .select("a", "b", "x", "y", union.alias("u"))
        .where(estimate >= p.threshold / 100 - p.slack)
        .select("a", "b")
    )
    likely = durable(likely, "neardup-likely")
    sets = _whole_sets(docs, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), p)
    threshold = p.threshold
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(schema)

    return likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _prefixes(classes: DataFrame, p: NearDup) -> DataFrame:
    """node, n, need, score, held: of each class the rarest of its lists, commonest last, as (length, list).

    Two classes with ``o`` lists in common share ``1 + extra`` of their rarest ``size - o + 1 + extra`` ones (lists of
    one member are the rarest and are not stored). need: lists in common, in prefixes, that a link needs. Classes with fewer lists
    than that are done and have no row. score: members of all lists together; of edited copies the one nearest to the others has most.
    """
    steps = F.arrays_zip(F.slice("sketch", F.lit(1), F.size("sketch") - 1).alias("v"), F.slice("sketch", F.lit(2), F.size("sketch") - 1).alias("w"))
    postings = classes.where("size(sketch) > 1").select("node", "n", F.explode(steps).alias("at")).select("node", "n", F.xxhash64("at.v", "at.w").alias("v"))
    frequent = postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").hint("shuffle_hash")  # few, and so postings need no sort
    least = F.least(F.lit(p.overlap), F.expr(f"({2 * p.threshold - 100} * n + 99) div 100 - 1"))
    return (
        postings.join(frequent, "v")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"), F.sum("c").alias("score"))
        .withColumn("own", F.least(F.size("held"), F.size("held") - least + 1 + p.extra))
        .withColumn("need", F.greatest(F.lit(1), F.least(least, F.lit(1 + p.extra))))
        .where("own >= need")
        .select("node", "n", "need", "score", F.slice("held", F.lit(1), F.col("own").cast("int")).alias("held"))
    )


def _candidates(classes: DataFrame, prefix: DataFrame, docs: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """Sketches and texts of the classes that have a prefix, as tables: only these are ever in a pair, and every round reads them."""
    nodes = prefix.select("node")
    if nodes.count() <= p.broadcast_ids:
        nodes = F.broadcast(nodes)
    sketches = classes.select("node", "sketch").join(nodes, "node", "left_semi")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    return durable(sketches, "neardup-candidates"), durable(texts, "neardup-texts")


def _across(state: DataFrame, p: NearDup) -> DataFrame:
    """All pairs (a, b) of different components and references that have ``need`` lists of their prefixes in common.

    Lists within one component or one reference have no such pair and go. Of what is left a class looks up only its
    rarest: two classes with ``need`` common ones share one among these.
    """
    rows = state.select("node", "root", "ref", "n", "need", F.explode("held").alias("at")).select("node", "root", "ref", "n", "need", "at.c", "at.v")
    mixed = rows.groupBy("v").agg(*[f("root").alias(f"{x}0") for x, f in (("a", F.min), ("b", F.max))], *[f("ref").alias(f"{x}1") for x, f in (("a", F.min), ("b", F.max))])
    looked = (
        rows.join(mixed.where("a0 < b0 and a1 < b1").select("v"), "v")
        .groupBy("node", "root", "ref", "n", "need")
        .agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("held"))
        .where("size(held) >= need")
        .select("node", "root", "ref", "n", "need", F.col("held.v").alias("held"), F.explode(F.slice("held.v", F.lit(1), F.expr("size(held) - need + 1"))).alias("v"))
    )
    return met(looked, "s.ref <> t.ref", "size(both) >= greatest(s.need, t.need)", p.threshold, p.block, "neardup-across", whole=True)


def _within(state: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame:
    """All links (a, b) between different components among the classes of one reference; see ``links_within``."""
    groups = state.groupBy("ref").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("ref")
    rows = durable(state.select("node", "root", "n", "ref").join(groups, "ref"), "neardup-groups")
    sets = _whole_sets(docs, rows.select("node").union(rows.select("ref")).distinct(), p)
    rows = rows.join(sets.toDF("node", "x"), "node").join(sets.toDF("ref", "y"), "ref").select("node", "root", "n", "ref", "x", "y")
    kinds = [("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("ref", pa.int64()), ("m", pa.int64()), ("d", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(i)] for i in (4, 5)]
            differ = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(*sides, strict=True)]
            columns = [*batch.columns[:4], pa.array([len(y) for y in sides[1]], pa.int64()), pa.array(differ, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    found = durable(rows.mapInArrow(run, "node long, root long, n long, ref long, m long, d array<long>"), "neardup-differences")
    return links_within(found, p.threshold, p.block, "neardup-within")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), a row per document.

    Documents with equal sets form one class, whose node is its smallest doc_id; copies cost no comparison. Of a class's
    inverted lists, ordered rarest first, only a prefix is looked up, see ``_prefixes``.

    Lists are compared in rounds that are linear in their lengths: every member against the most central one (that with the
    commonest lists: of the edited copies of one text that is the text itself, or the copy nearest to it) and another. Classes
    linked so are contracted, and lists that still hold several components take other members in further rounds; of a
    class's lists its commonest few stand for all then. This only contracts. All pairs that are left between different
    components are compared then: classes that were first held against the same member (their reference) by what they
    differ from it, ``_within``, and all others by common lists, ``_across``.

    Defined cases: null texts and texts without words have an empty set, are linked with nothing and kept. Rows
    without doc_id are linked with nothing, have a null component and are kept. Rows that repeat a doc_id count as one
    document. Extra columns are ignored; an empty table gives an empty result; a text of any length is one set.
    """
    if not 70 <= p.threshold <= 100:
        raise ValueError("the threshold must be from 70 to 100")
    feats = durable(_sketches(docs, p), "neardup-sketches")
    classes = (
        feats.where("doc_id is not null and n > 0")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    classes = durable(classes, "neardup-classes")
    prefix = durable(_prefixes(classes, p), "neardup-prefixes")
    sketches, texts = _candidates(classes, prefix, docs, p)

    masks = random.Random(p.seed)
    state, found = prefix.withColumn("root", F.col("node")), None
    for _ in range(p.rounds):
        held = F.col("held") if found is None else F.slice("held", -F.least(F.lit(4), F.size("held")), 4)
        lists = state.select("node", "root", "need", "score", F.explode(held).alias("at")).select("node", "root", "need", "score", "at.v")
        other = F.lit(masks.getrandbits(63))
        pivots = lists.groupBy("v").agg(
            F.max(F.struct("score", "node", "root")).alias("top"),
            F.min(F.struct(F.col("node").bitwiseXOR(other).alias("x"), "node", "root")).alias("other"),
            F.min("root").alias("r0"),
            F.max("root").alias("r1"),
        ).where("r0 < r1").select("v", F.explode(F.array("top", F.struct(F.lit(0).alias("score"), "other.node", "other.root"))).alias("at"))
        pairs = lists.join(pivots.select("v", F.col("at.node").alias("b"), F.col("at.root").alias("r")), "v").where("root <> r")
        pairs = pairs.groupBy("node", "b").agg(F.count_distinct("v").alias("c"), F.max("need").alias("need"))
        if found is None:
            pairs = durable(pairs, "neardup-met")
            refs = durable(references(pairs.where(F.col("c") >= p.near)), "neardup-references")
            pairs = pairs.where("c >= need")
        pairs = pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        links = durable(_verified(pairs, sketches, texts, p), "neardup-links")
        if links.isEmpty():
            break
        if found is not None:
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = connected_components(links, "neardup-components")
        state = prefix.join(found.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")

    state = state.join(refs, "node", "left").withColumn("ref", F.coalesce("ref", "node"))
    links = _verified(_across(state, p), sketches, texts, p).unionByName(_within(state, texts, p))
    if found is not None:
        links = links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    final = connected_components(links, "neardup-components")

    named = classes.select("fp", "node").join(final, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    known = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return (
        feats.select("doc_id", "n", "fp")
        .join(named, "fp", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), known).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
