"""Kernel geometry and coordinate arithmetic as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = ("batch", "x", "y", "z")
Triple = tuple[int, int, int]


def triple(value: int | tuple[int, int, int] | list[int], name: str, least: int = 1) -> Triple:
    """One number for all axes, or three; each at least ``least``."""
    out = (value,) * 3 if isinstance(value, int) else tuple(value)
    if len(out) != 3 or any(isinstance(v, bool) or not isinstance(v, int) or v < least for v in out):
        raise ValueError(f"{name} must be one or three integers of at least {least}, not {value!r}")
    return out


@dataclass(frozen=True)
class KernelSpec:
    """Size, stride, padding and dilation of a stencil."""

    size: Triple
    stride: Triple = (1, 1, 1)
    padding: Triple = (0, 0, 0)
    dilation: Triple = (1, 1, 1)

    @classmethod
    def of(cls, size=3, stride=1, padding=0, dilation=1) -> KernelSpec:
        return cls(triple(size, "kernel size"), triple(stride, "stride"), triple(padding, "padding", 0), triple(dilation, "dilation"))

    @property
    def volume(self) -> int:
        return self.size[0] * self.size[1] * self.size[2]

    @property
    def offsets(self) -> list[Triple]:
        return kernel_offsets(self.size, self.dilation)

    @property
    def pointwise(self) -> bool:
        """A plain matrix product per row."""
        return self == KernelSpec((1, 1, 1))

    @property
    def keeps_support(self) -> bool:
        """The outputs of a forward relation are the inputs themselves."""
        return self.stride == (1, 1, 1) and self.padding == (0, 0, 0)

    @property
    def tiles(self) -> bool:
        """Every input falls into exactly one output cell, at floor(coordinate / stride)."""
        plain = self.padding == (0, 0, 0) and self.dilation == (1, 1, 1)
        return plain and self.size == self.stride and all(s % 2 == 0 or s == 1 for s in self.size)

    @property
    def exclusive(self) -> bool:
        """Each input of a forward relation feeds one output at most: the stride exceeds the range of offsets on every axis."""
        return all(s > (k - 1) * d for s, k, d in zip(self.stride, self.size, self.dilation, strict=True))

    @property
    def spreads(self) -> bool:
        """Transposed outputs of different inputs cannot meet; the same test."""
        return self.exclusive


def kernel_offsets(size=3, dilation=1) -> list[Triple]:
    """Offsets by kernel id, z fastest: odd sizes centred on 0, even ones from 0."""
    axes = []
    for k, d in zip(triple(size, "kernel size"), triple(dilation, "dilation"), strict=True):
        first = -(k // 2) if k % 2 else 0
        axes.append([(first + i) * d for i in range(k)])
    return list(product(*axes))


def ball_offsets(radius: float) -> list[Triple]:
    """Lattice offsets whose squared length is at most radius squared."""
    reach = int(radius)
    line = range(-reach, reach + 1)
    return [(i, j, k) for i, j, k in product(line, line, line) if i * i + j * j + k * k <= radius * radius]


def offset_column(offsets: list[Triple]) -> Column:
    """One row for each offset: a struct of kernel_id, dx, dy, dz, from a literal (no join)."""
    rows = ", ".join(f"named_struct('kernel_id', {i}, 'dx', {a}, 'dy', {b}, 'dz', {c})" for i, (a, b, c) in enumerate(offsets))
    return F.explode(F.expr(f"array({rows})"))


def floor_div(value: Column, by: int) -> Column:
    """Quotient rounded down, for either sign (SQL's ``div`` rounds towards zero)."""
    if by == 1:
        return value
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("int")


def coordinates() -> list[Column]:
    return [F.col(c) for c in COORDS]


def _spread(value: Column) -> Column:
    """The low 21 bits with two zero bits between each."""
    value = value.cast("long").bitwiseAND(F.lit(0x1FFFFF))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def morton_code() -> Column:
    """Bits of x, y and z interleaved, plus batch * 2 ** 60 modulo 2 ** 64."""
    code = _spread(F.col("x")).bitwiseOR(F.shiftleft(_spread(F.col("y")), 1)).bitwiseOR(F.shiftleft(_spread(F.col("z")), 2))
    low = code.bitwiseAND(F.lit((1 << 60) - 1))
    high = F.shiftrightunsigned(code, 60) + F.col("batch").cast("long")
    return low.bitwiseOR(F.shiftleft(high, 60))


def child_index() -> Column:
    """Which of its parent's eight cells a cell is: bits of x, y and z, lowest first."""
    return sum((F.pmod(F.col(c), F.lit(2)) * (1 << i) for i, c in enumerate("xyz")), F.lit(0)).cast("int")
