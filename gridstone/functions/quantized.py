"""Affine 4- and 8-bit weights, packed little-end first into 32-bit words. Weights are small and live on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class QuantizedWeight:
    """words (rows, words a row), scales and biases (rows, groups); rows are all axes but the input channels."""

    words: np.ndarray
    scales: np.ndarray
    biases: np.ndarray
    group_size: int
    bits: int
    shape: tuple[int, ...]
    layout: str


def _rows(w: np.ndarray, layout: str) -> np.ndarray:
    """Input channels last, all else in rows."""
    if layout == "kernel_major":
        w = w.transpose(0, 2, 1)
    return w.reshape(-1, w.shape[-1])


def layout_of(shape: tuple[int, ...]) -> str:
    names = {2: "linear", 3: "kernel_major", 5: "dense"}
    if len(shape) not in names:
        raise ValueError(f"a weight has 2, 3 or 5 axes, not {len(shape)}")
    return names[len(shape)]


def quantize_weight(weight, group_size: int | None = None, bits: int = 4) -> QuantizedWeight:
    """Each group of input channels becomes codes 0 .. 2 ** bits - 1 with weight = scale * code + bias."""
    w = np.asarray(weight, np.float32)
    layout = layout_of(w.shape)
    rows = _rows(w, layout)
    n = rows.shape[1]
    group_size = (64 if n >= 64 else 32) if group_size is None else group_size
    if bits not in (4, 8) or group_size not in (32, 64, 128):
        raise ValueError("bits must be 4 or 8, and group_size 32, 64 or 128")
    padded = np.zeros((len(rows), -(-n // group_size) * group_size), np.float32)
    padded[:, :n] = rows
    groups = padded.reshape(len(rows), -1, group_size)
    low, high = groups.min(axis=2), groups.max(axis=2)
    scales = ((high - low) / (2**bits - 1)).astype(np.float32)
    scales[scales == 0] = 1
    codes = np.clip(np.rint((groups - low[:, :, None]) / scales[:, :, None]), 0, 2**bits - 1).astype(np.uint32)
    per = 32 // bits
    words = codes.reshape(len(rows), -1, per)
    words = (words << (np.arange(per, dtype=np.uint32) * np.uint32(bits))).sum(axis=2, dtype=np.uint64).astype(np.uint32)
    return QuantizedWeight(words, scales, low, group_size, bits, w.shape, layout)


def dequantize_weight(q: QuantizedWeight) -> np.ndarray:
    """The weight in its own layout, without the padding."""
    per = 32 // q.bits
    codes = (q.words[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(q.bits))) & np.uint32(2**q.bits - 1)
    groups = codes.reshape(len(q.words), -1, q.group_size).astype(np.float32)
    rows = (groups * q.scales[:, :, None] + q.biases[:, :, None]).reshape(len(q.words), -1)
    if q.layout == "kernel_major":
        k, n, m = q.shape
        return rows[:, :n].reshape(k, m, n).transpose(0, 2, 1)
    return rows[:, : q.shape[-1]].reshape(q.shape)


def quantized_matmul(x, q: QuantizedWeight, bias=None):
    """A row-wise linear layer with packed (out, in) weights."""
    from gridstone.operators.features import linear

    if q.layout != "linear":
        raise ValueError("a linear weight is needed")
    return linear(x, dequantize_weight(q), bias)
