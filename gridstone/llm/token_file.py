"""Token-id files: blocks of concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm import common
from gridstone.llm.common import durable
from gridstone.llm.tokens import Chunked, Memo, Vocabulary, gather, latest_per_process

_HEAD = struct.Struct("<8sQQQBBH")
_NAMES = struct.Struct("<QqQBQ")
_MAGIC = b"GSTOKEN2"
_SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value.

    Low bits are packed side by side; high parts are a unary bit string in which the i-th one stands at
    ``high[i] + i``. Every 64th one's position is sampled, so ``select`` reads a few bytes.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.width, self.samples = n, width, samples
        self._low, self._high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        bits = bits[:, ::-1]  # the highest first, so that a value's bits are read as one number
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel()).tobytes(), np.packbits(high).tobytes(), ones[::_SAMPLE].astype(np.uint32))

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self._low.tobytes(), self._high.tobytes(), self.samples.tobytes()

    def _low_at(self, i: int) -> int:
        if not self.width:
            return 0
        first, last = i * self.width, (i + 1) * self.width
        piece = int.from_bytes(self._low[first // 8 : (last + 7) // 8].tobytes(), "big") >> -last % 8
        return piece & (1 << self.width) - 1

    def select(self, i: int) -> int:
        """The i-th value, from 0: from the sample before it a few 64-bit words are counted, then bits of one byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at // 8
        word = int.from_bytes(self._high[byte : byte + 8].tobytes().ljust(8, b"\0"), "big") & (1 << 64 - at % 8) - 1
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self._high[byte : byte + 8].tobytes().ljust(8, b"\0"), "big")
        for _ in range(word.bit_count() - left - 1):
            word &= word - 1  # bits after the one wanted go
        at = byte * 8 + 63 - ((word & -word).bit_length() - 1)
        return (at - i) << self.width | self._low_at(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.width
        if not self.width:
            return high
        bits = np.unpackbits(self._low)[: self.n * self.width].reshape(self.n, self.width)
        return high | (bits.astype(np.int64) << np.arange(self.width)[::-1]).sum(axis=1)


def write_block(ends: np.ndarray, ids: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """One block: header, Elias-Fano coded ends of its documents, ids in 2 or 4 bytes each (little-endian), and
    the ascending doc_ids: how many are null, the smallest, and Elias-Fano coded distances from it."""
    coded = EliasFano.encode(np.asarray(ends, np.int64))
    size = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    low, high, samples = coded.parts()
    head = _HEAD.pack(_MAGIC, coded.n, len(ids), len(high), coded.width, size, 0)
    known = [] if doc_ids is None else [d for d in doc_ids if d is not None]
    names = EliasFano.encode(np.array([d - known[0] for d in known], np.uint64))
    tail = _NAMES.pack(len(doc_ids or ()) - len(known), known[0] if known else 0, names.n, names.width, len(names.parts()[1]))
    return b"".join((head, low, high, samples, ids.astype(f"<u{size}").tobytes(), tail, *names.parts()))


def _coded(view: memoryview, n: int, width: int, high: int) -> tuple[EliasFano, int]:
    """A sequence that stands at the start of ``view``, and where it ends."""
    low, samples = (n * width + 7) // 8, 4 * -(-n // _SAMPLE)
    coded = EliasFano(n, width, view[:low], view[low : low + high], np.frombuffer(view[low + high : low + high + samples], np.uint32))
    return coded, low + high + samples


def read_block(block: bytes | memoryview) -> tuple[EliasFano, np.ndarray, list[int | None]]:
    """The boundaries, the ids (a view) and the doc_ids of a block."""
    magic, n, n_ids, high, width, size, _ = _HEAD.unpack_from(block)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    view = memoryview(block)[_HEAD.size :]
    coded, at = _coded(view, n, width, high)
    ids = np.frombuffer(view[at:], f"<u{size}", n_ids)
    view = view[at + size * n_ids :]
    nulls, first, n, width, high = _NAMES.unpack_from(view)
    names, _ = _coded(view[_NAMES.size :], n, width, high)
    return coded, ids, [None] * nulls + [first + names.select(i) for i in range(n)]


@dataclass(frozen=True)
class TokenFiles:
    """Parameters.

    tokenizer: path of a tokenizers file on every machine. end_id: id appended to every document.
    block_ids: a block is closed once it holds so many ids. memo: chunks remembered in a process at most.
    """

    tokenizer: str
    end_id: int = 2
    block_ids: int = 1 << 16
    memo: int = 1_000_000


class LibraryEncoder:
    """Ids by the tokenizers library; each distinct chunk goes through it once and is then remembered.

    Byte-level BPE merges within a pre-token only and no pre-token crosses the edge of a chunk (see ``Chunked``), so the ids
    of a text are those of its chunks in order. Another kind of file is refused by ``Vocabulary``.
    """

    def __init__(self, path: str, most: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        Vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo = Memo(most)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts end to end, and n + 1 offsets into them."""
        chunks = Chunked.of(column)
        keys = chunks.keys.tolist()
        fresh = self.memo.unknown(keys)
        memo = self.memo.now
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            texts = [chunks.raw(i).decode() for i in some]
            for i, e in zip(some, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                memo[keys[i]] = np.array(e.ids, "<u4").tobytes()
        found = [memo[k] for k in keys]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        ids, at = gather(np.frombuffer(b"".join(found), "<u4"), sizes, chunks.number)
        return ids, at[chunks.cuts]


def write_token_files(docs: DataFrame, p: TokenFiles) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order into block files in the shared folder; returns them as read back.

    Columns: part and block (place in the order), n_ids, payload (``write_block``). The text is dealt by
    range of doc_id once and encoded in place, so every file holds a range; nothing is gathered.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = latest_per_process("heavy", ("library", p), lambda: LibraryEncoder(p.tokenizer, p.memo))
        end = np.array([p.end_id], "<u4").tobytes()
        number, doc_ids, chunks, filled, part = 0, [], [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(chunks), "<u4")
            ends = np.cumsum([len(c) // 4 for c in chunks])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([write_block(ends, ids, doc_ids)], pa.binary())],
                schema=schema,
            )

        for batch in common.slices(batches, "text", 4 << 20):
            part = batch.column(0)[0].as_py()
            flat, at = encode(batch.column(2))
            for doc_id, a, b in zip(batch.column(1).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                doc_ids.append(doc_id)
                chunks.append(flat[a:b].tobytes() + end)
                filled += b - a + 1
                if filled >= p.block_ids:
                    yield block()
                    number, doc_ids, chunks, filled = number + 1, [], [], 0
        if chunks:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return durable(dealt.mapInArrow(run, "part int, block long, n_ids long, payload binary"), "token-blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the block files alone.

    start: ids of all documents before it, over all files. Offsets of files come from their totals: one row a
    partition in the first step, one a block within its partition in the second.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                coded, ids, doc_ids = read_block(batch.column(2)[row].as_buffer())
                ends = np.array([coded.select(i) for i in range(coded.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[row].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[row].as_py(), np.int64)), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    schema=schema,
                )

    docs = blocks.select("part", "block", "payload").mapInArrow(run, "part int, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    sums = blocks.select("part", "block", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_at"))
    offsets = sums.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_at")).join(parts, "part")
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("part_at") + F.col("block_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, p: TokenFiles) -> DataFrame:
    """Write token files for ``docs``, read them back and return ``read_token_files``.

    Defined cases: a null text is empty and holds the end id alone; rows without doc_id come first; repeated doc_ids
    each have a row, ordered by text; extra columns are ignored; an empty table gives an empty result.
    """
    return read_token_files(write_token_files(docs, p))
