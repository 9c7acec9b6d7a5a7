"""Byte-level BPE by a minimal acyclic transducer of frequent words, memory-mapped; unseen words are merged exactly."""

from __future__ import annotations

import atexit
import hashlib
import mmap
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.common import durable
from gridstone.llm.tokens import Chunked, Memo, Vocabulary, latest_per_process

_HEAD = struct.Struct("<8sQQQQ")
_MAGIC = b"GSWORDS1"


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to id sequences, as one buffer.

    Words are added in order; a suffix that cannot change any more is replaced by an equal one that is there already.
    Each arc carries how many words come before those behind it; the sum along a path is the word's number, and
    ids stand in an array by number.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""

    def fold(down_to: int) -> None:
        while len(path) - 1 > down_to:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

    ordered = sorted(words)
    for word in ordered:
        shared = len(os.path.commonprefix([last, word]))
        fold(shared)
        for _ in word[shared:]:
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    fold(0)
    root = settle(*path[0])

    below = np.zeros(len(states), np.int64)
    first, byte, target, skip = [0], bytearray(), [], []
    for number, (final, arcs) in enumerate(states):  # children have smaller numbers
        seen = int(final)
        for label, child in arcs:
            byte.append(label)
            target.append(child)
            skip.append(seen)
            seen += int(below[child])
        below[number] = seen
        first.append(len(target))
    final = np.array([s[0] for s in states], np.uint8)
    ends = np.cumsum([0, *(len(words[w]) for w in ordered)])
    ids = np.array([i for w in ordered for i in words[w]], np.uint32)
    arrays = [np.array(first, np.uint32), np.array(target, np.uint32), np.array(skip, np.uint32), ends.astype(np.uint32), ids]
    head = _HEAD.pack(_MAGIC, len(states), len(target), len(ordered), root)
    return b"".join([head, *(a.tobytes() for a in arrays), final.tobytes(), bytes(byte)])


class Lexicon:
    """A compiled lexicon, memory-mapped: processes of a machine share its pages."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n_states, n_arcs, n_words, self._root = _HEAD.unpack_from(self._map)
        if magic != _MAGIC:
            raise ValueError("not a lexicon")
        view, at = memoryview(self._map), _HEAD.size

        def numbers(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self._first, self._target, self._skip = numbers(n_states + 1), numbers(n_arcs), numbers(n_arcs)
        self._ends = numbers(n_words + 1)
        self._ids = numbers(self._ends[n_words])
        self._final = view[at : at + n_states]
        self._bytes_at = at + n_states

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if it is not in the lexicon."""
        state, number, first, base, find = self._root, 0, self._first, self._bytes_at, self._map.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            number += self._skip[arc]
            state = self._target[arc]
        if not self._final[state]:
            return None
        return self._ids[self._ends[number] : self._ends[number + 1]].tolist()


@dataclass(frozen=True)
class Bpe:
    """Parameters.

    tokenizer: path of a byte-level BPE file on every machine. words: of the whole corpus, the most frequent (chunks:
    white space and what follows up to the next) that are compiled into the lexicon; that many at most. memo: words
    remembered in a process at most.
    """

    tokenizer: str
    words: int = 1 << 15
    memo: int = 1_000_000


def count_words(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """word, n of each slice of about ``limit`` bytes; a slice takes many times its size, so it is small."""
    latest_per_process("heavy", "words", lambda: None)  # what an earlier operator left in this worker goes
    for batch in common.slices(batches, "text", limit):
        found = Chunked.of(batch.column(0))
        size = found.end - found.start
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(found.start - ends[:-1], size) + np.arange(ends[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.buf[at])])
        yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(found.number, minlength=len(size)))], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word (see ``Chunked``) occurs in all texts, summed in each task first."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, p: Bpe) -> DataFrame:
    """The words that occur at least 2 ** j times, for the smallest j of at least 1 that leaves ``words`` of them or fewer."""
    counts = durable(word_counts(docs).where("n > 1"), "bpe-words")
    above = counts.agg(*[F.count_if(F.col("n") >= 1 << j).alias(f"j{j}") for j in range(1, 60)]).first()
    j = next(j for j in range(1, 60) if (above[f"j{j}"] or 0) <= p.words)
    return counts.where(F.col("n") >= 1 << j).select("word")


def build_lexicon(docs: DataFrame, p: Bpe) -> str:
    """Compile the most frequent words and hand the file to all executors; returns its name.

    One task compiles ``words`` words at most, whatever the input; the driver gets the finished buffer, a few megabytes. The
    file travels with Spark's own file service, which also serves executors that start later.
    """

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(p.tokenizer)
        words = [w for batch in batches for w in batch.column(0).to_pylist()]
        buffer = compile_lexicon({w: vocabulary.encode(w.decode()) for w in words})
        yield pa.RecordBatch.from_arrays([pa.array([buffer], pa.binary())], names=["lexicon"])

    spark = docs.sparkSession
    rows = frequent_words(docs, p).repartition(1).mapInArrow(compiled, "lexicon binary").collect()
    folder = tempfile.mkdtemp(prefix="gridstone-")
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
    with open(path, "wb") as f:
        f.write(rows[0]["lexicon"] if rows else compile_lexicon({}))
    spark.sparkContext.addFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # it is served from there as long as the driver runs
    return os.path.basename(path)


class Encoder:
    """Texts to ids: remembered words, then the lexicon, then exact merging.

    Of a word its ids are kept as decimals with a comma after each. The ids of every distinct word are decoded once; the rare
    word that decodes to something else than itself is kept in ``odd``.
    """

    def __init__(self, p: Bpe, lexicon: str) -> None:
        self.vocabulary = Vocabulary(p.tokenizer)
        self.lexicon = Lexicon(lexicon)
        self.memo = Memo(p.memo)
        self._decimal = [b"%d," % i for i in range(len(self.vocabulary.bytes_of))]
        self.odd: dict[int, bytes] = {}

    def ids(self, word: bytes) -> list[int]:
        found = self.lexicon.get(word)
        return self.vocabulary.encode(word.decode()) if found is None else found

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: how many ids, the decimal ids with a comma after each, the decoded bytes."""
        chunks = Chunked.of(column)
        keys = chunks.keys.tolist()
        fresh = self.memo.unknown(keys)
        memo, bytes_of = self.memo.now, self.vocabulary.bytes_of
        for i in fresh:
            word = chunks.raw(i)
            ids = self.ids(word)
            memo[keys[i]] = b"".join([self._decimal[k] for k in ids])
            if (decoded := b"".join([bytes_of[k] for k in ids])) != word:
                self.odd[keys[i]] = decoded
        found = [memo[k] for k in keys]
        n_ids = np.array([x.count(b",") for x in found], np.int64)
        before = np.concatenate([[0], np.cumsum(n_ids[chunks.number])])
        odd = {i: self.odd[k] for i, k in enumerate(keys) if k in self.odd} if self.odd else {}
        for t in range(len(column)):
            a, b = chunks.cuts[t], chunks.cuts[t + 1]
            numbers = chunks.number[a:b].tolist()
            decoded = chunks.buf[chunks.offsets[t] : chunks.offsets[t + 1]].tobytes()  # each word decodes to itself
            if odd and not odd.keys().isdisjoint(numbers):
                decoded = b"".join([odd.get(i) or chunks.raw(i) for i in numbers])
            yield int(before[b] - before[a]), b"".join([found[i] for i in numbers]), decoded


def encode_decode(docs: DataFrame, p: Bpe, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; with ``texts`` also ids and decoded.

    ids_sha256: of the decimal ids joined by commas. decoded_sha256: of the UTF-8 text that decoding the ids gives.
    Defined cases: a null text is empty and has no ids; null and repeated doc_ids keep a row each; extra columns
    are ignored; a text of any length is encoded whole; an empty table gives an empty result.
    """
    name = build_lexicon(docs, p)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if texts:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = latest_per_process("heavy", name, lambda: Encoder(p, SparkFiles.get(name)))
        for batch in common.slices(batches, "text", 2 << 20):
            rows: list[tuple] = []
            for n, joined, decoded in encoder(batch.column(1)):
                decoded = decoded.decode("utf-8", "replace")
                row = (n, hashlib.sha256(joined[:-1]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, [int(i) for i in joined[:-1].split(b",") if i], decoded) if texts else row)
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
