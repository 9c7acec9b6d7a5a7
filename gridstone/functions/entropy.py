"""Entropy coding: normalised 16-bit CDFs, an arithmetic coder and a byte-wise rANS coder.

A stream is coded sequentially, so streams are the unit of parallelism: rows are grouped by stream and each group
is coded in one task. Streams carry their own magic and shape and are no persistence format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = 1 << 16
_RANGE, _RANS = b"GSRANGE1", b"GSRANS01"
_SHAPE = struct.Struct("<II")
_LOW = 1 << 23


def normalized_cdf(prob: Column) -> Column:
    """ARRAY<INT> of alphabet + 1 values from ARRAY<FLOAT>: 0, then rounded running sums, then 65536.

    Every symbol keeps a width of at least one: the running sum (32-bit, of values cut to 0 .. 1) is scaled to 65536
    less the alphabet, rounded half away from zero, and the column's number added. A non-finite value raises.
    """
    size = F.size(prob)
    scale = (F.lit(TOTAL) - size).cast("float")
    bad = F.exists(prob, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    prob = F.when(bad, F.raise_error(F.lit("probabilities must be finite")).cast("array<float>")).otherwise(prob)
    start = F.struct(F.lit(0.0).cast("float").alias("sum"), F.array(F.lit(0)).alias("cdf"))

    def add(state: Column, value: Column) -> Column:
        total = (state["sum"] + F.greatest(F.least(value.cast("float"), F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))).cast("float")
        column = F.size(state["cdf"])
        scaled = F.floor((total * scale).cast("float").cast("double") + 0.5).cast("int") + column
        scaled = F.least(F.greatest(scaled, column), F.lit(TOTAL) - size + column)
        return F.struct(total.alias("sum"), F.concat(state["cdf"], F.array(scaled)).alias("cdf"))

    inner = F.aggregate(F.slice(prob, 1, size - 1), start, add, lambda s: s["cdf"])
    return F.concat(inner, F.array(F.lit(TOTAL)))


def cdf_rows(prob: np.ndarray) -> np.ndarray:
    """``normalized_cdf`` of the rows of a matrix."""
    p = np.asarray(prob, np.float32)
    if p.ndim != 2 or not p.shape[1]:
        raise ValueError("prob must have two axes and an alphabet")
    if not np.isfinite(p).all():
        raise ValueError("probabilities must be finite")
    n = p.shape[1]
    out = np.zeros((len(p), n + 1), np.int64)
    running = np.zeros(len(p), np.float32)
    for column in range(1, n):
        running = running + np.clip(p[:, column - 1], np.float32(0), np.float32(1))
        value = np.floor((running * np.float32(TOTAL - n)).astype(np.float64) + 0.5).astype(np.int64) + column
        out[:, column] = np.clip(value, column, TOTAL - n + column)
    out[:, n] = TOTAL
    return out


def _checked(cdf: np.ndarray, symbols: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Low and high end of each symbol."""
    n = cdf.shape[1] - 1
    for row, symbol in zip(cdf.tolist(), symbols, strict=True):
        if not 0 <= symbol < n:
            raise ValueError(f"symbol {symbol} is outside the alphabet of {n}")
        yield row[symbol], row[symbol + 1]


def _cdf(cdf) -> np.ndarray:
    cdf = np.asarray(cdf, np.int64)
    if cdf.ndim != 2 or cdf.shape[1] < 2:
        raise ValueError("cdf must have two axes and an alphabet")
    if (cdf[:, 0] != 0).any() or (cdf[:, -1] != TOTAL).any() or (np.diff(cdf, axis=1) <= 0).any():
        raise ValueError("cdf rows must rise from 0 to 65536")
    return cdf


def range_encode(cdf, symbols: Iterable[int]) -> bytes:
    """Carry-less arithmetic coding with 32-bit bounds: settled leading bits go out, straddling ones are counted."""
    cdf, symbols = _cdf(cdf), [int(s) for s in symbols]
    low, high, waiting, bits = 0, 0xFFFFFFFF, 0, []
    for a, b in _checked(cdf, symbols):
        span = high - low + 1
        low, high = low + (span * a >> 16), low + (span * b >> 16) - 1
        while True:
            if (low ^ high) >> 31 == 0:
                bit = low >> 31
                bits.append(bit)
                bits.extend([1 - bit] * waiting)
                waiting = 0
            elif low >> 30 == 1 and high >> 30 == 2:
                waiting += 1
                low, high = low & 0x3FFFFFFF, high | 0x40000000
            else:
                break
            low, high = (low << 1) & 0xFFFFFFFF, (high << 1 | 1) & 0xFFFFFFFF
    bit = low >> 30 & 1
    bits.extend([bit, *[1 - bit] * (waiting + 1)])
    return _RANGE + _SHAPE.pack(*(len(cdf), cdf.shape[1] - 1)) + np.packbits(np.array(bits, np.uint8)).tobytes()


def _open(stream: bytes, magic: bytes, cdf: np.ndarray) -> bytes:
    head = len(magic) + _SHAPE.size
    if len(stream) < head or stream[: len(magic)] != magic:
        raise ValueError("not a stream of this coder")
    if _SHAPE.unpack_from(stream, len(magic)) != (len(cdf), cdf.shape[1] - 1):
        raise ValueError("the stream has another shape")
    return stream[head:]


def range_decode(cdf, stream: bytes) -> list[int]:
    cdf = _cdf(cdf)
    bits = iter(np.unpackbits(np.frombuffer(_open(bytes(stream), _RANGE, cdf), np.uint8)).tolist())
    code, low, high, out = 0, 0, 0xFFFFFFFF, []
    for _ in range(32):
        code = code << 1 | next(bits, 0)
    for row in cdf:
        span = high - low + 1
        target = ((code - low + 1 << 16) - 1) // span
        symbol = int(np.searchsorted(row, target, "right")) - 1
        out.append(symbol)
        low, high = low + (span * int(row[symbol]) >> 16), low + (span * int(row[symbol + 1]) >> 16) - 1
        while True:
            if (low ^ high) >> 31 == 0:
                pass
            elif low >> 30 == 1 and high >> 30 == 2:
                low, high, code = low & 0x3FFFFFFF, high | 0x40000000, code ^ 0x40000000
            else:
                break
            low, high = (low << 1) & 0xFFFFFFFF, (high << 1 | 1) & 0xFFFFFFFF
            code = (code << 1 | next(bits, 0)) & 0xFFFFFFFF
    return out


def range_encode_from_prob(prob, symbols: Iterable[int]) -> bytes:
    return range_encode(cdf_rows(prob), symbols)


def range_decode_from_prob(prob, stream: bytes) -> list[int]:
    return range_decode(cdf_rows(prob), stream)


def rans_encode_from_prob(prob, symbols: Iterable[int]) -> bytes:
    """Symbols are pushed last to first onto a state held in 2**23 .. 2**31; bytes spill from its low end."""
    cdf, symbols = cdf_rows(prob), [int(s) for s in symbols]
    state, spilled = _LOW, bytearray()
    for a, b in reversed(list(_checked(cdf, symbols))):
        width = b - a
        while state >= width << 15:
            spilled.append(state & 0xFF)
            state >>= 8
        whole, rest = divmod(state, width)
        state = (whole << 16) + rest + a
    return _RANS + _SHAPE.pack(len(cdf), cdf.shape[1] - 1) + struct.pack("<I", state) + bytes(reversed(spilled))


def rans_decode_from_prob(prob, stream: bytes) -> list[int]:
    """Rejects a stream that ends early or late."""
    cdf = cdf_rows(prob)
    body = _open(bytes(stream), _RANS, cdf)
    if len(body) < 4:
        raise ValueError("the stream ends early")
    (state,), at, out = struct.unpack_from("<I", body), 4, []
    for row in cdf:
        slot = state & 0xFFFF
        symbol = int(np.searchsorted(row, slot, "right")) - 1
        out.append(symbol)
        state = int(row[symbol + 1] - row[symbol]) * (state >> 16) + slot - int(row[symbol])
        while state < _LOW:
            if at >= len(body):
                raise ValueError("the stream ends early")
            state = state << 8 | body[at]
            at += 1
    if at != len(body):
        raise ValueError("the stream ends late")
    return out


_ENCODERS = {"range": range_encode_from_prob, "rans": rans_encode_from_prob}
_DECODERS = {"range": range_decode_from_prob, "rans": rans_decode_from_prob}


def encode_streams(rows: DataFrame, coder: str = "range") -> DataFrame:
    """stream_id, stream from rows of stream_id, row, prob (ARRAY), symbol; each stream is coded in one task."""
    encode = _ENCODERS[coder]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        stream = encode(np.stack(pdf["prob"].to_numpy()), pdf["symbol"])
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "stream": [stream]})

    return rows.groupBy("stream_id").applyInPandas(run, "stream_id long, stream binary")


def decode_streams(rows: DataFrame, streams: DataFrame, coder: str = "range") -> DataFrame:
    """stream_id, row, symbol from the same rows of probabilities and the streams."""
    decode = _DECODERS[coder]

    def run(pdf: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        if not len(pdf) or not len(coded):
            return pd.DataFrame({"stream_id": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "symbol": pd.Series(dtype="int32")})
        symbols = decode(np.stack(pdf["prob"].to_numpy()), coded["stream"].iloc[0])
        return pd.DataFrame({"stream_id": pdf["stream_id"].to_numpy(), "row": pdf["row"].to_numpy(), "symbol": symbols})

    return rows.groupBy("stream_id").cogroup(streams.groupBy("stream_id")).applyInPandas(run, "stream_id long, row long, symbol int")
