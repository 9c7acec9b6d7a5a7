"""Benchmark passages in documents by CGK embedding, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.tokens import latest_per_process


@dataclass(frozen=True)
class Decontamination:
    """Parameters.

    edits: edit operations allowed, in hundredths of the item's length (rounded down).
    seeds: pieces of an item that must stand unchanged near one diagonal. An item is cut into ``edits + seeds``
    pieces; so many edits leave ``seeds`` of them whole, so this loses no match.
    walks, bits: random walks, and bits sampled from each embedding. If a share d of the embedded characters
    differs, a window is found with probability 1 - (1 - (1 - d) ** bits) ** walks: 0.998 at d = 0.35.
    items: items held in one automaton at a time; more are taken in further rounds over the documents.
    """

    edits: int = 10
    seeds: int = 4
    walks: int = 32
    bits: int = 4
    items: int = 50_000
    seed: int = 5


def normal(text: str) -> str:
    """Lower case, every run of white space one space."""
    return " ".join(text.lower().split())


def edit_distance_within(item: str, text: str) -> tuple[int, int]:
    """The least edit distance between ``item`` and any substring of ``text``, and where the first such one ends.

    Bit-parallel dynamic programming: one column of the table is two bit vectors as long as the item.
    """
    size = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    everything, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, at = everything, 0, size, size, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (everything & ~(horizontal | up))
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & everything, (minus << 1) & everything
        up = minus | (everything & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, at = score, j
    return best, at


class Detector:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], p: Decontamination) -> None:
        self.p = p
        self.items = [(k, t) for k, t in ((k, normal(t)) for k, t in items) if t]
        self.allowed = [len(t) * p.edits // 100 for _, t in self.items]
        self.need: list[int] = []
        pieces: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(self.items):
            need = max(1, min(p.seeds, len(text) // 4 - self.allowed[i]))
            n = self.allowed[i] + need
            self.need.append(need)
            cuts = [len(text) * k // n for k in range(n + 1)]
            for k in range(n):
                pieces[text[cuts[k] : cuts[k + 1]]].append((i, k, cuts[k]))
        self.automaton = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.automaton.add_word(piece, (len(piece), of))
        if pieces:
            self.automaton.make_automaton()
        longest = max((len(t) for _, t in self.items), default=1)
        random = np.random.default_rng(p.seed)
        self.steps = 3 * longest
        # one random bit for each walk, step and character class: whether the walk moves on in the text
        self.moves = random.integers(0, 2, (p.walks, self.steps, 256), dtype=np.int8)
        self.draws = random.random((p.walks, p.bits))
        self.keys = [self.sampled(np.array([[ord(c) for c in t]], np.int64), len(t))[0] for _, t in self.items]

    def sampled(self, windows: np.ndarray, size: int) -> np.ndarray:
        """The sampled characters (windows x walks x bits) of the CGK embeddings of code-point rows.

        A walk writes the character it stands on and moves on or stays by a random bit of that step and character;
        one edit shifts it only until the walks of both texts meet again. Past the end it writes a blank.
        """
        n, width = windows.shape
        padded = np.full((n, width + 1), -1, np.int64)
        padded[:, :-1] = windows
        where = (self.draws * (3 * size)).astype(np.int64)
        out = np.empty((n, self.p.walks, self.p.bits), np.int64)
        walk = np.arange(self.p.walks)[None, :]
        row = np.arange(n)[:, None]
        at = np.zeros((n, self.p.walks), np.int64)
        for j in range(3 * size):
            here = padded[row, at]
            for w, b in zip(*np.nonzero(where == j), strict=True):
                out[:, w, b] = here[:, w]
            at = np.minimum(at + self.moves[walk, j, here & 255], width)
        return out

    def _clusters(self, hits: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int]]:
        """Ranges of diagonals within the allowed edits that hold enough different pieces; hits: (diagonal, piece)."""
        hits.sort()
        width, low, region = self.allowed[i], 0, None
        count: dict[int, int] = defaultdict(int)
        for diagonal, piece in hits:
            count[piece] += 1
            while diagonal - hits[low][0] > width:
                gone = hits[low][1]
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
                low += 1
            if len(count) >= self.need[i]:
                if region and hits[low][0] <= region[1]:
                    region = (region[0], diagonal)
                else:
                    if region:
                        yield region
                    region = (hits[low][0], diagonal)
        if region:
            yield region

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """item id, edits and start (in the normalised text) of the best match of each item found."""
        if not self.items:
            return []
        text = normal(text)
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, of) in self.automaton.iter(text):
            for i, k, offset in of:
                by_item[i].append((end + 1 - size - offset, k))
        best: dict[int, tuple[int, int]] = {}
        for i, hits in by_item.items():
            if len(hits) < self.need[i]:
                continue
            item, allowed = self.items[i][1], self.allowed[i]
            for low, high in self._clusters(hits, i):
                step = max(1, allowed)
                starts = sorted({max(0, s) for s in (*range(low, high, step), high)})
                exact = any(text.startswith(item, s) for s in starts)  # then the embeddings are equal
                rows = [[ord(c) for c in text[s : s + len(item)]] for s in starts]
                windows = np.array([r + [-1] * (len(item) - len(r)) for r in rows], np.int64)
                if not exact and not (self.sampled(windows, len(item)) == self.keys[i]).all(axis=2).any():
                    continue
                first = max(0, low - allowed)
                edits, end = edit_distance_within(item, text[first : high + len(item) + allowed])
                if edits <= allowed:
                    best[i] = min(best.get(i, (edits + 1, 0)), (edits, max(0, first + end - len(item))))
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]


def _blocks(items: DataFrame, p: Decontamination) -> list[list[tuple[int, str]]]:
    """The items, ``p.items`` at most in a block; each block is shipped with the tasks that use it."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n = rows.count()
    parts = max(1, -(-n // p.items))
    if parts == 1:
        return [sorted((r[0], r[1]) for r in rows.collect())]
    part = F.pmod(F.xxhash64("item_id"), F.lit(2 * parts))
    return [sorted((r[0], r[1]) for r in rows.where(part == k).collect()) for k in range(2 * parts)]


def _detector(block: list[tuple[int, str]], p: Decontamination) -> Detector:
    return latest_per_process("heavy", ("detector", hash(tuple(block)), p), lambda: Detector(block, p))


def contaminated(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, item_id, edits, start: each item (its whole text, up to the allowed edits) found in each document.

    The walk needs item-sized windows to embed: an Aho-Corasick scan over the whole text for the items' pieces
    says where one can stand at all (no match is lost by that), then windows are embedded, their sampled
    characters compared with the item's, and what agrees in one walk is verified by exact edit distance. start
    counts characters of the lower-cased text with runs of white space as one. Documents are scanned where they are.

    Defined cases: null or empty texts hold nothing; null or empty items are never found; a document that holds
    an item several times has one row, the best; null or repeated doc_ids give rows of their own; empty tables and
    extra columns are fine.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(items, p):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            detector = _detector(block, p)
            for batch in common.slices(batches, "text"):
                out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in detector.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)], schema=schema)

        one = rows.mapInArrow(run, "doc_id long, item_id long, edits long, start long")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds none of the items; nothing is shuffled."""
    for block in _blocks(items, p):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            detector = _detector(block, p)
            for batch in common.slices(batches, "text"):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not (t and detector.find(t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
