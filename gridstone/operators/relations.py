"""Stencil relations, nearest neighbours and radius neighbours as materialisable edge tables."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.frame import RANGE_BITS, LatticeFrame, first_seen, lookup_side, starts_before
from gridstone.geometry import COORDS, KernelSpec, ball_offsets, floor_div, offset_column


@dataclass(frozen=True)
class Relation:
    """Edges (in_row, out_row, kernel_id) and the rows they lead to (row_id, batch, x, y, z)."""

    edges: DataFrame
    out: DataFrame
    spec: KernelSpec
    kind: str
    unique_out: bool = False

    def counts(self) -> tuple[int, int]:
        return self.edges.count(), self.out.count()

    def _view(self, key: str, order: list[str], universe: DataFrame) -> DataFrame:
        groups = universe.join(self.edges.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("edges")), key, "left")
        return groups.select(key, F.coalesce("edges", F.array().cast(groups.schema["edges"].dataType)).alias("edges"))

    def out_view(self) -> DataFrame:
        """Edges of each output row, by kernel id; a row holds at most as many as the kernel has cells."""
        return self._view("out_row", ["kernel_id", "in_row"], self.out.select(F.col("row_id").alias("out_row")))

    def in_view(self) -> DataFrame:
        """Edges of each input row that has any."""
        return self._view("in_row", ["out_row", "kernel_id"], self.edges.select("in_row").distinct())

    def direct_view(self) -> DataFrame:
        """The one edge of each input row that has any: in_row, out_row, kernel_id; the kernel must be exclusive.

        No aggregate is needed: an exclusive forward kernel meets each input once.
        """
        if self.kind not in ("forward", "target") or not self.spec.exclusive:
            raise ValueError("inputs may have several edges")
        return self.edges

    def kernel_view(self) -> DataFrame:
        """Number of edges of each kernel cell and where its group begins."""
        cells = self.edges.sparkSession.range(self.spec.volume).select(F.col("id").cast("int").alias("kernel_id"))
        counts = cells.join(self.edges.groupBy("kernel_id").agg(F.count("*").alias("n")), "kernel_id", "left").na.fill(0, ["n"])
        return counts.withColumn("offset", F.sum("n").over(Window.orderBy("kernel_id")) - F.col("n"))

    def implicit_gemm(self) -> DataFrame:
        """out_row, map (input row for each kernel id, -1 for none) and masks (bits of present ids, 32 to a word)."""
        k = self.spec.volume
        at = [F.max(F.when(F.col("kernel_id") == i, F.col("in_row"))).alias(f"k{i}") for i in range(k)]
        wide = self.out.select(F.col("row_id").alias("out_row")).join(self.edges.groupBy("out_row").agg(*at), "out_row", "left")
        rows = [F.coalesce(f"k{i}", F.lit(-1)).cast("long") for i in range(k)]
        words = [sum((F.when(F.col(f"k{i}").isNotNull(), F.lit(1 << (i % 32))).otherwise(0).cast("long") for i in range(w, min(k, w + 32))), F.lit(0).cast("long")) for w in range(0, k, 32)]
        return wide.select("out_row", F.array(*rows).alias("map"), F.array(*words).alias("masks"))

    def sorted_implicit_gemm(self, tile: int = 64) -> DataFrame:
        """``implicit_gemm`` with each row's place by mask and its tile; kernels of at most 32 cells."""
        if self.spec.volume > 32:
            raise ValueError("a kernel of at most 32 cells is needed")
        gemm = self.implicit_gemm().withColumn("mask", F.col("masks")[0])
        gemm = gemm.withColumn("part", F.shiftright("out_row", RANGE_BITS))
        # a mask may be that of most rows, so its rows are numbered in ranges too
        parts = gemm.groupBy("mask", "part").agg(F.count("*").alias("n"))
        starts = starts_before(parts.groupBy("mask").agg(F.sum("n").alias("_n")), "mask", 2)
        before = Window.partitionBy("mask").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "mask")
        parts = parts.select("mask", "part", (F.col("_at") + F.col("before")).alias("at"))
        within = F.row_number().over(Window.partitionBy("mask", "part").orderBy("out_row"))
        placed = gemm.join(parts, ["mask", "part"]).withColumn("place", F.col("at") + within - 1)
        return placed.select("out_row", "map", "mask", "place", F.floor(F.col("place") / tile).alias("tile"))


def _edges(out: DataFrame, source: DataFrame, spec: KernelSpec) -> DataFrame:
    """Output rows fan out by the kernel with keys only, then meet the lowest source row at each place."""
    fanned = out.select(F.col("row_id").alias("out_row"), *COORDS, offset_column(spec.offsets).alias("k"))
    places = [
        (F.col(c) * s + F.col(f"k.d{c}") - p).cast("int").alias(c) for c, s, p in zip("xyz", spec.stride, spec.padding, strict=True)
    ]
    places = fanned.select("out_row", F.col("k.kernel_id").alias("kernel_id"), "batch", *places)
    return places.join(lookup_side(source), list(COORDS)).select("in_row", "out_row", "kernel_id")


def build_kernel_relation(coords: DataFrame, size=3, stride=1, padding=0, dilation=1) -> Relation:
    """Outputs are the inputs for stride 1 and padding 0, else distinct floor(input / stride); the kernel adds none."""
    spec = KernelSpec.of(size, stride, padding, dilation)
    if spec.keeps_support:
        out = coords.select("row_id", *COORDS)
    else:
        out = first_seen(coords.select("row_id", "batch", *[floor_div(F.col(c), s).alias(c) for c, s in zip("xyz", spec.stride, strict=True)]))
    return Relation(_edges(out, coords, spec), out, spec, "forward", not spec.keeps_support)


def build_submanifold_kernel_relation(coords: DataFrame, size=3, dilation=1) -> Relation:
    spec = KernelSpec.of(size, 1, 0, dilation)
    if any(k % 2 == 0 for k in spec.size):
        raise ValueError("a submanifold kernel must be odd")
    out = coords.select("row_id", *COORDS)
    return Relation(_edges(out, coords, spec), out, spec, "submanifold")


def build_target_kernel_relation(coords: DataFrame, target: DataFrame, size=3, stride=1, padding=0, dilation=1) -> Relation:
    spec = KernelSpec.of(size, stride, padding, dilation)
    out = target.select("row_id", *COORDS)
    return Relation(_edges(out, coords, spec), out, spec, "target")


def _sent(coords: DataFrame, spec: KernelSpec) -> DataFrame:
    """Every input sent to each place of its kernel; ``at`` orders them by input, then kernel id."""
    fanned = coords.select(F.col("row_id").alias("in_row"), *COORDS, offset_column(spec.offsets).alias("k"))
    places = [(F.col(c) * s + F.col(f"k.d{c}") - p).cast("int").alias(c) for c, s, p in zip("xyz", spec.stride, spec.padding, strict=True)]
    at = (F.col("in_row") * spec.volume + F.col("k.kernel_id")).cast("long").alias("at")
    return fanned.select("in_row", F.col("k.kernel_id").alias("kernel_id"), at, "batch", *places)


def build_transposed_kernel_relation(coords: DataFrame, size=2, stride=2, padding=0, dilation=1) -> Relation:
    """Outputs are the distinct places ``input * stride + offset - padding``, as first seen.

    Where places of different inputs cannot meet, each place is an output as it stands: no aggregate, no join.
    """
    spec = KernelSpec.of(size, stride, padding, dilation)
    sent = _sent(coords, spec)
    if spec.spreads:
        direct = sent.withColumnRenamed("at", "out_row")
        return Relation(direct.select("in_row", "out_row", "kernel_id"), direct.select(F.col("out_row").alias("row_id"), *COORDS), spec, "transposed")
    out = first_seen(sent, "at")
    edges = sent.join(out, list(COORDS)).select("in_row", F.col("row_id").alias("out_row"), "kernel_id")
    return Relation(edges, out, spec, "transposed", True)


def build_generative_relation(coords: DataFrame, size=2, stride=2) -> Relation:
    """One output for each input and kernel id; nothing is merged and nothing shuffled."""
    spec = KernelSpec.of(size, stride)
    direct = _sent(coords, spec).withColumnRenamed("at", "out_row")
    return Relation(direct.select("in_row", "out_row", "kernel_id"), direct.select(F.col("out_row").alias("row_id"), *COORDS), spec, "generative")


_TOP = "query_row long, source_row long, neighbor_id int, distance float"


def _ranked(pairs: DataFrame, most: int | None) -> DataFrame:
    """query_row, source_row, neighbor_id, distance (squared): by distance, then source row."""
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("d", "source_row")) - 1
    rows = pairs.withColumn("neighbor_id", rank.cast("int"))
    if most is not None:
        rows = rows.where(F.col("neighbor_id") < most)
    return rows.select("query_row", "source_row", "neighbor_id", F.col("d").cast("float").alias("distance"))


def _squared() -> F.Column:
    return sum(((F.col(f"q{c}") - F.col(c)).cast("long") * (F.col(f"q{c}") - F.col(c)) for c in "xyz"), F.lit(0).cast("long")).alias("d")


def build_knn_relation(source: DataFrame, query: DataFrame | None = None, k: int = 8) -> DataFrame:
    """The k nearest source rows of the same batch for every query, exactly; duplicates are kept, ties go to the lower row.

    Space is cut into blocks; a query sees the 27 blocks around its own. Whoever has k neighbours no farther than
    a block's side is done, as anything outside is farther; the rest go on with blocks four times as wide, until
    a block covers everything. So a round costs what lies near its queries, and only sparse regions go on.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    query = source if query is None else query
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    both = source.select(*COORDS).unionByName(query.select(*COORDS))
    row = both.agg(*[s.alias(c) for s, c in zip(spans, "xyz", strict=True)]).first()
    if row["x"] is None:
        return source.sparkSession.createDataFrame([], _TOP)
    widest = max(row) + 1
    count, volume = source.groupBy("batch").count().agg(F.avg("count")).first()[0] or 1.0, 1.0
    for span in row:
        volume *= span + 1
    side = max(1, min(widest, round((k * volume / count / 4) ** (1 / 3))))
    open_, done = query.select(F.col("row_id").alias("query_row"), "batch", *[F.col(c).alias(f"q{c}") for c in "xyz"]), None
    around = offset_column([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    while True:
        blocks = source.select(F.col("row_id").alias("source_row"), *COORDS, *[floor_div(F.col(c), side).alias(f"b{c}") for c in "xyz"])
        asked = open_.select("query_row", "batch", "qx", "qy", "qz", around.alias("o"))
        asked = asked.select("query_row", "batch", "qx", "qy", "qz", *[(floor_div(F.col(f"q{c}"), side) + F.col(f"o.d{c}")).alias(f"b{c}") for c in "xyz"])
        near = asked.join(blocks, ["batch", "bx", "by", "bz"]).select("query_row", "source_row", _squared())
        top = _ranked(near, k)
        if side >= widest:
            return top if done is None else done.unionByName(top)
        top = top.persist(StorageLevel.MEMORY_AND_DISK)
        full = top.groupBy("query_row").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == k) & (F.col("far") <= float(side) * side))
        kept = top.join(full.select("query_row"), "query_row", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        open_ = open_.join(full.select("query_row"), "query_row", "left_anti")
        if open_.isEmpty():
            return done
        side *= 4


def build_radius_relation(source: DataFrame, query: DataFrame | None = None, radius: float = 1.0, max_neighbors: int | None = None) -> DataFrame:
    """Source rows (the lowest at each coordinate) within a radius of every query, by distance, then row.

    The ball's lattice offsets are enumerated, so that neighbours are found by equality and not by distance.
    """
    if radius < 0 or max_neighbors is not None and max_neighbors < 1:
        raise ValueError("radius must not be negative, and max_neighbors at least 1")
    query = source if query is None else query
    offsets = ball_offsets(radius)
    places = query.select(F.col("row_id").alias("query_row"), *COORDS, offset_column(offsets).alias("o"))
    d = (F.col("o.dx") * F.col("o.dx") + F.col("o.dy") * F.col("o.dy") + F.col("o.dz") * F.col("o.dz")).alias("d")
    places = places.select("query_row", "batch", *[(F.col(c) + F.col(f"o.d{c}")).cast("int").alias(c) for c in "xyz"], d)
    return _ranked(places.join(lookup_side(source, "source_row"), list(COORDS)), max_neighbors)


def _strides(source: LatticeFrame, query: LatticeFrame | None) -> None:
    if query is not None and query.stride != source.stride:
        raise ValueError("strides differ")


def knn_relation(source: LatticeFrame, query: LatticeFrame | None = None, k: int = 8) -> DataFrame:
    _strides(source, query)
    return build_knn_relation(source.coords, None if query is None else query.coords, k)


def radius_relation(source: LatticeFrame, query: LatticeFrame | None = None, radius: float = 1.0, max_neighbors: int | None = None) -> DataFrame:
    _strides(source, query)
    return build_radius_relation(source.coords, None if query is None else query.coords, radius, max_neighbors)


def gather_neighbor_features(source: LatticeFrame, relation: DataFrame) -> DataFrame:
    """The edges of a neighbour relation with the features of their source rows."""
    return relation.join(source.feats.withColumnRenamed("row_id", "source_row"), "source_row")


class RelationCache:
    """Persisted relations by (coordinates, target, spec, kind); the least recently used goes first."""

    def __init__(self, most: int = 16) -> None:
        self.most = most
        self._held: OrderedDict[tuple, tuple[Relation, tuple]] = OrderedDict()

    def get(self, x: LatticeFrame, kind: str, build, spec: KernelSpec, target: LatticeFrame | None = None) -> Relation:
        key = (id(x.key), None if target is None else id(target.key), spec, kind)
        if key not in self._held:
            made = build()
            made = Relation(made.edges.persist(StorageLevel.MEMORY_AND_DISK), made.out.persist(StorageLevel.MEMORY_AND_DISK), made.spec, made.kind, made.unique_out)
            self._held[key] = (made, (x.key, target and target.key))  # keys stay alive, so their ids stay theirs
            while len(self._held) > self.most:
                self._drop(self._held.popitem(last=False)[1][0])
        self._held.move_to_end(key)
        return self._held[key][0]

    @staticmethod
    def _drop(relation: Relation) -> None:
        relation.edges.unpersist()
        relation.out.unpersist()

    def clear(self) -> None:
        for relation, _ in self._held.values():
            self._drop(relation)
        self._held.clear()

    def __enter__(self) -> RelationCache:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()


def kernel_relation(x: LatticeFrame, size=3, stride=1, padding=0, dilation=1, cache: RelationCache | None = None) -> Relation:
    build = lambda: build_kernel_relation(x.coords, size, stride, padding, dilation)
    return build() if cache is None else cache.get(x, "forward", build, KernelSpec.of(size, stride, padding, dilation))


def submanifold_kernel_relation(x: LatticeFrame, size=3, dilation=1, cache: RelationCache | None = None) -> Relation:
    build = lambda: build_submanifold_kernel_relation(x.coords, size, dilation)
    return build() if cache is None else cache.get(x, "submanifold", build, KernelSpec.of(size, 1, 0, dilation))


def transposed_kernel_relation(x: LatticeFrame, size=2, stride=2, padding=0, dilation=1, cache: RelationCache | None = None) -> Relation:
    build = lambda: build_transposed_kernel_relation(x.coords, size, stride, padding, dilation)
    return build() if cache is None else cache.get(x, "transposed", build, KernelSpec.of(size, stride, padding, dilation))


def target_kernel_relation(x: LatticeFrame, target: LatticeFrame, size=3, stride=1, padding=0, dilation=1, cache: RelationCache | None = None) -> Relation:
    build = lambda: build_target_kernel_relation(x.coords, target.coords, size, stride, padding, dilation)
    return build() if cache is None else cache.get(x, "target", build, KernelSpec.of(size, stride, padding, dilation), target)


def generative_kernel_relation(x: LatticeFrame, size=2, stride=2, cache: RelationCache | None = None) -> Relation:
    build = lambda: build_generative_relation(x.coords, size, stride)
    return build() if cache is None else cache.get(x, "generative", build, KernelSpec.of(size, stride))
