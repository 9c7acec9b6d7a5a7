"""Fuzzy line de-duplication: MinHash over character shingles, banding, exact Jaccard, union-find. Native operations only."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import discard, durable
from gridstone.llm.components import connected_components
from gridstone.llm.differences import links_within, references


@dataclass(frozen=True)
class LineDedup:
    """Parameters.

    shingle: characters (UTF-16 units) in a character shingle; a shorter line is one shingle.
    bands x rows: of minima of the signature. At similarity 0.8 a pair shares a band with probability
    1 - (1 - 0.8 ** rows) ** bands, 0.997 with the default; at 0.9 it is 0.99997.
    threshold: Jaccard similarity of the whole shingle sets, in hundredths.
    rounds: in which picked members of buckets are compared, before all pairs that still differ; see ``_classes``.
    near: minima that a line and its reference agree on at least.
    block: members of a bucket that stand in one block of that join.
    broadcast_ids: so many ids of candidate lines (8 bytes each) are broadcast to find their bodies; more are joined.
    min_words: only lines with so many words are compared fuzzily or exactly (1: all but blank lines).
    """

    shingle: int = 8
    bands: int = 8
    rows: int = 3
    threshold: int = 80
    min_words: int = 1
    rounds: int = 2
    near: int = 12
    block: int = 1_000
    broadcast_ids: int = 1_000_000
    seed: int = 11


#: Left shifts that take windows of 32 bits out of a 64-bit hash; their first ten bits, which decide most minima, are disjoint.
SHIFTS = (0, 11, 21, 32)
#: Shingles whose minima are taken in registers before they go into the aggregate, which costs more than the hashing does.
STEP = 4

#: Times that the way from lines to their references is doubled.
HOPS = 2


def family(p: LineDedup) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Masks of the 64-bit words drawn from a shingle's hash, and (word, shift, 32-bit mask) of each minimum, by band and row.

    The rows of a band come from different words, so they are independent; bands share a word at different shifts.
    """
    random_ = random.Random(p.seed)
    signed = lambda bits: random_.getrandbits(bits) - (1 << bits - 1)
    each = -(-p.bands // len(SHIFTS))
    words = [signed(64) for _ in range(p.rows * each)]
    return words, [(r * each + b // len(SHIFTS), SHIFTS[b % len(SHIFTS)], signed(32)) for b in range(p.bands) for r in range(p.rows)]


def _lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    """One row per line that is not blank: doc_id, pos, id and chk (two 64-bit hashes of the line), line."""
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.trim("line") != "")
    if p.min_words > 1:
        rows = rows.where(F.size(F.split(F.trim("line"), r"\s+")) >= p.min_words)
    return rows.select(
        "doc_id",
        "pos",
        F.xxhash64("line").alias("id"),
        F.xxhash64(F.lit(p.seed), F.col("line")).alias("chk"),
        "line",
    )


def _last(body: Column, p: LineDedup) -> Column:
    """Where the last shingle begins in UTF-16, in bytes from 1."""
    return F.greatest(2 * F.shiftright(F.length(body), 1) - (2 * p.shingle - 1), F.lit(1))


def _signatures(lines: DataFrame, p: LineDedup) -> DataFrame:
    """id, copies (occurrences) and minima (ARRAY<INT>) of every distinct line.

    Each minimum is over a 32-bit window of a hash of the shingle, xor a mask: every shingle is equally likely to win
    it, so two lines agree on it with the probability of their Jaccard similarity. Shingles stream, ``STEP`` at a time (the
    last one of a line is repeated), through one generated-code stage into a map-side aggregate and are never stored.
    Windows stand in the upper half of a word, and the lower half, which is cut off, only parts ties. Two different lines with the same 64-bit id
    (then chk differs) are left out, and so are never taken for copies.
    """
    words, minima = family(p)
    at, end, span = F.col("i"), F.col("last"), range(STEP)
    rows = lines.select("id", "chk", F.encode("line", "utf-16be").alias("body")).select("id", "chk", "body", _last(F.col("body"), p).alias("last"))
    each = rows.select("id", "chk", "body", "last", F.explode(F.sequence(F.lit(1), end, F.lit(2 * STEP))).alias("i"))
    each = each.select("id", "chk", "i", *[F.xxhash64(F.substring("body", F.least(at + 2 * k, end), F.lit(2 * p.shingle))).alias(f"h{k}") for k in span])
    each = each.select("id", "chk", "i", *[F.xxhash64(F.col(f"h{k}").bitwiseXOR(F.lit(m))).alias(f"w{w}_{k}") for w, m in enumerate(words) for k in span])
    window = lambda w, s, m, k: F.shiftleft(f"w{w}_{k}", s).bitwiseXOR(F.lit(m << 32).cast("long"))
    columns = [F.min(F.least(*[window(*x, k) for k in span])).alias(f"m{j}") for j, x in enumerate(minima)]
    copies = F.count_if(at == 1).alias("copies")
    sums = each.groupBy("id").agg(F.min("chk").alias("c0"), F.max("chk").alias("c1"), copies, *columns).where("c0 = c1")
    return sums.select("id", "copies", F.array(*[F.shiftright(f"m{j}", 32).cast("int") for j in range(len(minima))]).alias("minima"))


def _set(name: str, p: LineDedup) -> Column:
    """The distinct shingles of a column of lines (stored as UTF-16, so that this is not encoded for every shingle), as 64-bit hashes.

    The line is bound to a variable first: read from its row, it would be copied whole for every shingle.
    """
    places = lambda body: F.sequence(F.lit(1), _last(body, p), F.lit(2))
    each = lambda body: F.transform(places(body), lambda i: F.xxhash64(F.substring(body, i, F.lit(2 * p.shingle))))
    return F.array_distinct(F.transform(F.array(name), each)[0])


def _similar(pairs: DataFrame, bodies: DataFrame, p: LineDedup) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets meet the threshold."""
    # sets come out of a generator: as columns they would be made anew for every size that a pushed filter takes of them
    sets = F.explode(F.array(F.struct(_set("x", p).alias("x"), _set("y", p).alias("y")))).alias("s")
    near = lambda n, m: 100 * F.least(n, m) >= p.threshold * F.greatest(n, m)
    enough = lambda n, m, both: (100 + p.threshold) * both >= p.threshold * (n + m)
    n, m, both = F.size("s.x"), F.size("s.y"), F.size(F.array_intersect("s.x", "s.y"))
    found = pairs.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b").select("a", "b", sets)
    return found.where(near(n, m) & enough(n, m, both)).select("a", "b")


def _bound(p: LineDedup) -> int:
    """As many minima as a similar pair agrees on in 997 cases of 1000."""
    n, share = p.bands * p.rows, p.threshold / 100
    return int(n * share - 2.6 * (n * share * (1 - share)) ** 0.5)


def _agree(x: str, y: str, p: LineDedup) -> Column:
    return sum(F.when(F.col(x)[i] == F.col(y)[i], 1).otherwise(0) for i in range(p.bands * p.rows))


def _agreeing(pairs: DataFrame, sig: DataFrame, p: LineDedup) -> DataFrame:
    """node, b, agree: the pairs with the number of minima their signatures agree on."""
    left, right = sig.toDF("node", "x"), sig.toDF("b", "y")
    return pairs.join(left, "node").join(right, "b").select("node", "b", _agree("x", "y", p).alias("agree"))


def _rest(members: DataFrame, sig: DataFrame, p: LineDedup) -> DataFrame:
    """All pairs (a, b) of different classes and references that share a bucket and are alike.

    Only buckets that hold several classes and references are looked at, in blocks of members, each against the whole
    bucket. The signatures are compared inside the join, so pairs that are not alike make no rows.
    """
    ends = [f(c).alias(f"{c}{i}") for c in ("root", "ref") for i, f in enumerate((F.min, F.max))]
    mixed = members.groupBy("key").agg(*ends, F.count("*").alias("m")).where("root0 < root1 and ref0 < ref1")
    rows = members.join(mixed.select("key", F.ceil(F.col("m") / p.block).cast("int").alias("blocks")), "key").join(sig, "id")
    rows = durable(rows.select("id", "key", "root", "ref", "minima", "blocks"), "line-mixed")
    one = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = F.expr("s.key = t.key and s.block = t.block and s.root < t.root and s.ref <> t.ref") & (_agree("s.minima", "t.minima", p) >= _bound(p))
    return one.alias("s").join(every.alias("t"), met).select(F.col("s.id").alias("a"), F.col("t.id").alias("b")).distinct()


def _hubs(refs: DataFrame) -> DataFrame:
    """node, ref: the reference of the reference, and of that again, so that the lines of a family have few references.

    Members of a family stand in many buckets and so have many references near each other; all pairs of lines of
    different ones are candidates in ``_rest``, most of them just below the threshold. ``_within`` is exact for any reference.
    """
    for _ in range(HOPS):
        refs = refs.join(refs.select(F.col("node").alias("ref"), F.col("ref").alias("next")), "ref").select("node", F.col("next").alias("ref"))
    return refs


def _within(state: DataFrame, bodies: DataFrame, p: LineDedup) -> DataFrame:
    """All links (a, b) between different classes among the lines of one reference, see ``links_within``, and those to it."""
    groups = state.groupBy("ref").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("ref")
    rows = durable(state.join(groups, "ref").select("id", "root", "ref"), "line-groups")
    sets = bodies.join(rows.select("id"), "id", "left_semi").select(F.col("id").alias("node"), _set("body", p).alias("x"))
    pivots = bodies.join(rows.select("ref").distinct(), F.col("id") == F.col("ref"), "left_semi").select(F.col("id").alias("ref"), _set("body", p).alias("y"))
    found = (
        rows.withColumnRenamed("id", "node")
        .join(sets, "node")
        .join(pivots, "ref")
        .select("node", "root", "ref", F.size("x").alias("n"), F.size("y").alias("m"), F.array_union(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    )
    found = durable(found, "line-differences")
    to_ref = found.where((100 + p.threshold) * F.size("d") <= (100 - p.threshold) * (F.col("n") + F.col("m")))
    to_ref = durable(to_ref.where("node <> ref").select(F.col("node").alias("a"), F.col("ref").alias("b")), "line-to-references")
    return links_within(found, p.threshold, p.block, "line-within").unionByName(to_ref)


def _classes(lines: DataFrame, sig: DataFrame, p: LineDedup) -> DataFrame:
    """id, root: lines (by hash) that are linked to other lines, with the id of their class.

    In every bucket of a band a random member is held against all the others; classes found so are contracted, and in the
    buckets that still hold several classes another member is held against those of other classes, in so many
    ``rounds``. A round makes as many comparisons as buckets have members. This only contracts. All pairs of a bucket that
    are left between different classes are compared then: lines near the same member (their reference) by what they
    differ from it, ``_within``, and all others by signatures first, ``_rest``. ``sig`` is deleted when it is no longer needed.
    """
    keys = [F.xxhash64(F.lit(b), *[F.col("minima")[b * p.rows + r] for r in range(p.rows)]) for b in range(p.bands)]
    bands = sig.select("id", F.explode(F.array(*keys)).alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q")).where("p < q").select("key")
    members = durable(bands.join(shared, "key").select("id", "key", F.col("id").alias("root")), "line-buckets")
    ids = members.select("id").distinct()
    if ids.count() <= p.broadcast_ids:
        ids = F.broadcast(ids)
    bodies = durable(lines.select("id", F.encode("line", "utf-16be").alias("body")).join(ids, "id", "left_semi").dropDuplicates(["id"]), "line-bodies")
    of_all, sig = sig, durable(sig.join(ids, "id", "left_semi").select("id", "minima"), "line-minima")
    discard(of_all)
    masks = random.Random(p.seed + 1)
    found = None
    for _ in range(p.rounds):
        mask = F.lit(masks.getrandbits(63))
        pivot = F.min(F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask)
        mixed = members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), pivot.alias("b"))
        pairs = members.withColumnRenamed("id", "node").join(mixed.where("r0 < r1").select("key", "b"), "key").where("node <> b")
        if found is not None:
            other = found.select(F.col("id").alias("b"), F.col("root").alias("r"))
            pairs = pairs.join(other, "b", "left").where(F.col("root") != F.coalesce("r", "b"))
        pairs = _agreeing(pairs.select("node", "b").distinct(), sig, p)
        if found is None:
            pairs = durable(pairs.where(F.col("agree") >= p.near), "line-near")
            refs = durable(_hubs(durable(references(pairs), "line-references")).withColumnRenamed("node", "id"), "line-hubs")
        pairs = pairs.where(F.col("agree") >= _bound(p)).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        links = durable(_similar(pairs, bodies, p), "line-links")
        if found is not None:
            links = links.unionByName(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = connected_components(links, "line-components").withColumnRenamed("node", "id")
        found = durable(roots, "line-roots")
        named = members.select("id", "key").join(found, "id", "left")
        before, members = members, durable(named.select("id", "key", F.coalesce("root", "id").alias("root")), "line-buckets")
        discard(before)
    members = members.join(refs, "id", "left").withColumn("ref", F.coalesce("ref", "id"))
    state = members.select("id", "root", "ref").distinct()
    links = _similar(_rest(members, sig, p), bodies, p).unionByName(_within(state, bodies, p))
    links = durable(links, "line-links")
    discard(members, bodies, sig)
    links = links.unionByName(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return durable(connected_components(links, "line-components").withColumnRenamed("node", "id"), "line-roots")


def line_drops(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """doc_id, pos: occurrences to drop. Of each class the first one by doc_id, then position, stays.

    Exact copies (same id and chk) form a class even where no other line is near. Defined cases: null or
    empty texts and blank lines have no line to drop; rows without a doc_id are left as they are; rows that repeat a
    doc_id count as one document, so a line at the same place of both is one occurrence; a line of any length is compared
    whole; extra columns are ignored; an empty table gives an empty result.
    """
    lines = _lines(docs, p)
    sig = durable(_signatures(lines, p), "line-signatures")
    copies = durable(sig.where("copies > 1").select("id"), "line-copies")
    classes = _classes(lines, sig, p)
    named = durable(
        copies.join(classes, "id", "full_outer").select("id", F.coalesce("root", "id").alias("class")), "line-classes"
    )
    of = durable(lines.select("doc_id", "pos", "id").join(named, "id").select("doc_id", "pos", "class"), "line-members")
    first = durable(of.groupBy("class").agg(F.min("doc_id").alias("d0")), "line-firsts")  # a table, so that hot classes are split below
    later = F.when(F.col("doc_id") > F.col("d0"), F.col("at")).otherwise(F.array_except("at", F.array(F.array_min("at"))))
    return (
        of.join(first, "class")
        .groupBy("doc_id", "class", "d0")
        .agg(F.collect_set("pos").alias("at"))
        .select("doc_id", later.alias("at"))
        .where("size(at) > 0")
        .groupBy("doc_id")
        .agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("dropped"))
    )


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup(), drop_emptied: bool = False) -> DataFrame:
    """``docs`` with all its columns; ``text`` without its dropped lines.

    No document is removed unless ``drop_emptied``: then those go that had lines and have none left but blank ones.
    """
    free = [c for c in (f"_line{i}" for i in range(len(docs.columns) + 2)) if c not in docs.columns]
    drops = line_drops(docs, p).toDF(*free[:2])
    dropped = F.col(free[1])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(dropped, i)), "\n")
    text = F.when(dropped.isNull(), F.col("text")).otherwise(kept).alias("text")
    joined = docs.join(drops, F.col("doc_id") == F.col(free[0]), "left").select(*[text if c == "text" else docs[c] for c in docs.columns], dropped)
    if drop_emptied:
        joined = joined.where(dropped.isNull() | (F.trim(F.translate("text", "\n", "")) != ""))
    return joined.drop(free[1])
