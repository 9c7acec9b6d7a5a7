"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.common import durable


@dataclass(frozen=True)
class IvfPq:
    """Parameters.

    sample: vectors the index is fitted on at most (smallest hashes of vec_id). cells: coarse centroids; 0 takes the
    square root of the row count, up to ``most_cells``. probes: share of the cells searched for a query.
    subspaces, codes: of the product quantiser. shortlist: candidates of a block for each of its cells reranked on their vectors.
    block_rows, block_queries: rows and queries that meet in one task at most on average; a cell with more is split, small
    cells share a block. Where they meet changes no distance: a query goes to a block once, whatever cells it probes there.
    """

    sample: int = 20_000
    cells: int = 0
    most_cells: int = 1024
    probes: float = 0.65
    subspaces: int = 16
    codes: int = 256
    shortlist: int = 300
    block_rows: int = 20_000
    block_queries: int = 4_000
    k: int = 10
    seed: int = 3


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = (norms - 2 * part @ centres.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's iteration from distinct rows; an empty one moves to the row farthest from its own."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[random.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        of = _nearest(x, centres)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            far = np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")
            centres[~full] = x[far[: int((~full).sum())]]
    return centres


@dataclass
class Index:
    """Coarse centroids and, for each subspace, the centroids of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    bounds: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, p: IvfPq) -> Index:
        random = np.random.default_rng(p.seed)
        coarse = kmeans(x, cells, random)
        rest = x - coarse[_nearest(x, coarse)]
        bounds = np.linspace(0, x.shape[1], min(p.subspaces, x.shape[1]) + 1).astype(int)
        books = [kmeans(np.ascontiguousarray(rest[:, a:b]), p.codes, random) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return cls(coarse, books, bounds)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        parts = zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)
        return cell, np.stack([_nearest(rest[:, a:b], book) for a, b, book in parts], axis=1).astype(np.uint8 if len(self.books[0]) <= 256 else np.uint16)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for. Distances from a query to these are its asymmetric distances."""
        out = self.coarse[cell]
        for j, (a, b, book) in enumerate(zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)):
            out[:, a:b] += book[codes[:, j]]
        return out


def _usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


#: Distances in one matrix product, and bytes of vectors in one batch of probes.
_PRODUCTS, _PROBED = 2_000_000, 4 << 20


def _blocks(held: np.ndarray, p: IvfPq) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each cell its first block and how many parts it is split into, each a block; and the number of blocks.
    Cells in order share a block until it is full, or holds a 64th of all rows."""
    parts = np.maximum(1, -(-held // p.block_rows))
    full = min(p.block_rows, max(1, int(held.sum()) // 64))
    first, block, filled = np.zeros(len(held), np.int64), 0, 0
    for cell, n in enumerate(held):
        if filled and filled + n > full:
            block, filled = block + 1, 0
        first[cell] = block
        filled += n
        if parts[cell] > 1:
            block, filled = block + parts[cell], 0
    return first, parts, int((first + parts).max())


def search(rows: DataFrame, queries: Column, p: IvfPq = IvfPq()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row that ``queries`` selects.

    ``rows`` has vec_id and embedding. Every usable row is indexed; the fit alone uses a bounded sample. A query goes to
    the cells nearest to it; there asymmetric distances choose a shortlist, and only Euclidean distances
    of original vectors in double precision decide. Rows and queries meet in blocks of cells or of parts of a cell, so neither a
    cell with a third of all rows nor many queries make a large task; no side is broadcast but the fitted index.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; neither do
    rows without vec_id or of another than the most common length. Rows that repeat a vec_id are candidates
    each, but never of a query with that id. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows.
    """
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("q"))
    usable = usable.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], empty)
    size, total = sizes[0]
    usable = usable.where(F.size("v") == size)
    sample = _matrix(usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).select("v").toArrow().column(0).combine_chunks())
    index = Index.fit(sample, p.cells or max(1, min(p.most_cells, int(total**0.5))), p)
    probes = max(1, int(np.ceil(p.probes * len(index.coarse))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cell, codes = index.encode(x) if len(x) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["vec_id", "cell", "codes", "vector"],
            )

    plain = usable.select("vec_id", "v")
    placed = durable(plain.mapInArrow(place, "vec_id long, cell long, codes binary, vector binary"), "ann-index")
    held = np.zeros(len(index.coarse), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]

    first, parts, blocks = _blocks(held, p)
    asking = usable.where("q").select("vec_id", "v")
    turns = max(1, -(-asking.count() // p.block_queries))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (index.coarse**2).sum(1)
        rows_at_once = max(1, _PROBED // (8 * size * blocks + 64 * len(held)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(at, rows_at_once)
                ids, x = some.column(0).to_pylist(), _matrix(some.column(1))
                order = np.argsort(norms - 2 * x @ index.coarse.T, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                # so many cells, and more while they hold too few candidates besides the query
                take = (np.arange(order.shape[1]) < probes) | (before <= p.k)
                out: dict[str, list] = {"query_id": [], "block": [], "cells": [], "vector": []}
                for i, query in enumerate(ids):
                    cells = np.sort(order[i][take[i] & (held[order[i]] > 0)])
                    single = cells[parts[cells] == 1]
                    groups = np.split(single, np.flatnonzero(np.diff(first[single])) + 1) if len(single) else []
                    places = [(int(first[g[0]]), g) for g in groups]
                    places += [(int(first[c]) + j, np.array([c])) for c in cells[parts[cells] > 1] for j in range(int(parts[c]))]
                    out["query_id"] += [query] * len(places)
                    out["block"] += [block for block, _ in places]
                    out["cells"] += [g.astype(np.int32).tobytes() for _, g in places]
                    out["vector"] += [x[i].tobytes()] * len(places)
                kinds = {"query_id": pa.int64(), "block": pa.int64(), "cells": pa.binary(), "vector": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in kinds.items()], names=list(kinds))

    asked = asking.mapInArrow(probe, "query_id long, block long, cells binary, vector binary")
    asked = durable(asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns))), "ann-queries")
    plan = [(c, int(first[c]), int(parts[c])) for c in range(len(held))]
    plan = rows.sparkSession.createDataFrame(plan, "cell long, first long, parts long")
    left = placed.join(F.broadcast(plan), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "cell", "vec_id", "codes", "vector"
    ).withColumn("turn", F.col("turn").cast("long"))
    kind = np.uint8 if len(index.books[0]) <= 256 else np.uint16

    def meet(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(block) and len(asks):
            block = block.sort_values("vec_id", kind="stable", ignore_index=True)
            ids, cell = block["vec_id"].to_numpy(), block["cell"].to_numpy()
            codes = np.frombuffer(b"".join(block["codes"]), kind).reshape(len(block), -1)
            vectors = np.frombuffer(b"".join(block["vector"]), np.float64).reshape(len(block), -1)
            norms = (vectors**2).sum(1)
            # equal codes of a cell are decoded once, so that their rows tie exactly
            packed = np.ascontiguousarray(np.concatenate([cell.astype("<u4")[:, None].view(np.uint8), codes.view(np.uint8)], axis=1))
            _, one, same = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
            coded, of = index.decode(cell[one], codes[one]), cell[one]
            coded_norms, same, distinct = (coded**2).sum(1), same.ravel(), len(one) == len(block)
            if distinct:
                coded, coded_norms, of, same = coded[same], coded_norms[same], cell, None
            known = np.unique(cell)
            shortlist, column = p.shortlist * len(known), np.searchsorted(known, of)
            whole = np.frombuffer(b"".join(asks["vector"]), np.float64).reshape(len(asks), -1)
            probed = np.zeros((len(asks), len(known)), bool)
            for i, raw in enumerate(asks["cells"]):
                probed[i, np.searchsorted(known, np.frombuffer(raw, np.int32))] = True
            at_once = max(1, _PRODUCTS // len(block))
            for at in range(0, len(asks), at_once):
                q, open_ = whole[at : at + at_once], probed[at : at + at_once]
                roughs = coded_norms - 2 * q @ coded.T
                exacts = norms - 2 * q @ vectors.T
                for v, rough, exact, query, mine in zip(q, roughs, exacts, asks["query_id"].to_numpy()[at : at + at_once], open_, strict=True):
                    if not mine.all():
                        rough[~mine[column]] = np.inf
                    if same is not None:
                        rough = rough[same]
                    low, high = np.searchsorted(ids, [query, query + 1])
                    rough[low:high] = np.inf
                    # rows stand by vec_id, so the first of equal ones have the smaller
                    if shortlist < len(rough):
                        edge = np.partition(rough, shortlist - 1)[shortlist - 1]
                        near = np.flatnonzero(rough < edge)
                        some = np.concatenate([near, np.flatnonzero(rough == edge)[: shortlist - len(near)]])
                    else:
                        some = np.arange(len(rough))
                    some = some[np.isfinite(rough[some])]
                    if len(some) > p.k:
                        # products are off by rounding alone: what may be among the k nearest is measured exactly
                        near = exact[some]
                        edge = np.partition(near, p.k - 1)[p.k - 1]
                        some = some[near <= edge + 1e-9 * (v @ v + norms[some])]
                    score = np.sqrt(((vectors[some] - v) ** 2).sum(1))
                    best = np.lexsort((ids[some], score))[: p.k]
                    out.append((np.full(len(best), query), ids[some][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    by = ["block", "turn"]
    found = left.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
