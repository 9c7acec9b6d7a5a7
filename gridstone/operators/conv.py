"""Sparse convolutions: relation joined with features and weights, summed by output row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame
from gridstone.functions.quantized import QuantizedWeight, dequantize_weight
from gridstone.geometry import COORDS, KernelSpec
from gridstone.operators import relations as R
from gridstone.operators.features import linear

#: Above so many products a row, batches are multiplied as matrices instead of generated expressions.
WIDE = 64


def kernel_weights(weight, spec: KernelSpec, channels: int) -> np.ndarray:
    """Weights as (kernel id, in, out) from that layout, from (out, kx, ky, kz, in), from packed ones, or (out, in) for one cell."""
    if isinstance(weight, QuantizedWeight):
        weight = dequantize_weight(weight)
    w = np.asarray(weight, np.float64)
    if w.ndim == 5:
        if w.shape[1:4] != spec.size:
            raise ValueError(f"weight has kernel {w.shape[1:4]}, not {spec.size}")
        w = w.reshape(w.shape[0], spec.volume, w.shape[4]).transpose(1, 2, 0)
    elif w.ndim == 2 and spec.volume == 1:
        w = w.T[None]
    if w.ndim != 3 or w.shape[:2] != (spec.volume, channels):
        raise ValueError(f"weight {np.shape(weight)} does not fit {spec.volume} cells and {channels} channels")
    return w


def weight_table(df: DataFrame, w: np.ndarray) -> DataFrame:
    """kernel_id and w{in}_{out}: a row for each kernel cell, small enough to broadcast."""
    k, n, m = w.shape
    rows = [(i, *map(float, w[i].ravel())) for i in range(k)]
    kinds = ", ".join(["kernel_id int", *(f"w{a}_{b} double" for a in range(n) for b in range(m))])
    return F.broadcast(df.sparkSession.createDataFrame(rows, kinds))


def multiply(edges: DataFrame, feats: DataFrame, w: np.ndarray, into: str = "out_row", on: str = "in_row") -> DataFrame:
    """into, c0 .. c{out - 1}: sums over edges of feature times weight of the edge's kernel cell."""
    _, n, m = w.shape
    rows = edges.join(feats.withColumnRenamed("row_id", on), on)
    if n * m <= WIDE:
        sums = [F.sum(sum(F.col(f"f{a}") * F.col(f"w{a}_{b}") for a in range(n))).alias(f"c{b}") for b in range(m)]
        return rows.join(weight_table(edges, w), "kernel_id").groupBy(into).agg(*sums)
    names = [f"f{a}" for a in range(n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, kernel = pdf[names].to_numpy(np.float64), pdf["kernel_id"].to_numpy()
            groups, number = np.unique(pdf[into].to_numpy(), return_inverse=True)
            out = np.zeros((len(groups), m))
            for k in np.unique(kernel):
                np.add.at(out, number[kernel == k], x[kernel == k] @ w[k])
            yield pd.DataFrame(out, columns=[f"c{b}" for b in range(m)]).assign(**{into: groups})

    kinds = ", ".join([f"{into} long", *(f"c{b} double" for b in range(m))])
    part = rows.select(into, "kernel_id", *names).mapInPandas(lambda it: (p[[into, *[f"c{b}" for b in range(m)]]] for p in run(it)), kinds)
    return part.groupBy(into).agg(*[F.sum(f"c{b}").alias(f"c{b}") for b in range(m)])


def _bias(bias, m: int) -> list[float]:
    if bias is None:
        return [0.0] * m
    out = np.asarray(bias, np.float64).ravel().tolist()
    if len(out) != m:
        raise ValueError(f"bias has {len(out)} entries, not {m}")
    return out


def convolve(x: LatticeFrame, relation: R.Relation, w: np.ndarray, bias=None) -> DataFrame:
    """Every output row of the relation, also those that no edge reaches (0 plus bias)."""
    m = w.shape[2]
    b = _bias(bias, m)
    one_edge = relation.kind == "generative" or relation.kind == "transposed" and not relation.unique_out
    if one_edge and w.shape[1] * m <= WIDE:  # nothing to sum
        table = weight_table(x.df, w)
        one = relation.edges.join(x.feats.withColumnRenamed("row_id", "in_row"), "in_row").join(table, "kernel_id")
        sums = one.select("out_row", *[sum(F.col(f"f{a}") * F.col(f"w{a}_{c}") for a in range(w.shape[1])).alias(f"c{c}") for c in range(m)])
    else:
        sums = multiply(relation.edges, x.feats, w)
    rows = relation.out.join(sums.withColumnRenamed("out_row", "row_id"), "row_id", "left")
    return rows.select("row_id", *COORDS, *[(F.coalesce(f"c{c}", F.lit(0.0)) + b[c]).alias(f"f{c}") for c in range(m)])


def conv3d(x: LatticeFrame, weight, bias=None, kernel_size=3, stride=1, padding=0, dilation=1, coordinates: LatticeFrame | DataFrame | None = None, cache: R.RelationCache | None = None) -> LatticeFrame:
    """Convolution onto the strided support, or onto given coordinates (a frame's, which must have the output stride)."""
    spec = KernelSpec.of(kernel_size, stride, padding, dilation)
    w = kernel_weights(weight, spec, x.channels)
    if spec.pointwise and coordinates is None:
        return linear(x, w[0].T, bias)
    out_stride = tuple(a * b for a, b in zip(x.stride, spec.stride, strict=True))
    args = (kernel_size, stride, padding, dilation)
    if isinstance(coordinates, LatticeFrame):
        if coordinates.stride != out_stride:
            raise ValueError(f"the target has stride {coordinates.stride}, the output {out_stride}")
        if not (coordinates.key is x.key and spec.keeps_support):
            relation = R.target_kernel_relation(x, coordinates, *args, cache=cache)
            return replace(coordinates, df=convolve(x, relation, w, bias), channels=w.shape[2])
    elif coordinates is not None:
        relation = R.build_target_kernel_relation(x.coords, coordinates, *args)
        return x.renewed(convolve(x, relation, w, bias), channels=w.shape[2], stride=out_stride, unique=False)
    relation = R.kernel_relation(x, *args, cache=cache)
    df = convolve(x, relation, w, bias)
    if spec.keeps_support:
        return replace(x, df=df, channels=w.shape[2])
    return x.renewed(df, channels=w.shape[2], stride=out_stride, unique=True)


def subm_conv3d(x: LatticeFrame, weight, bias=None, kernel_size=3, dilation=1, cache: R.RelationCache | None = None) -> LatticeFrame:
    """Convolution that keeps the support and identity; the kernel must be odd."""
    spec = KernelSpec.of(kernel_size, 1, 0, dilation)
    w = kernel_weights(weight, spec, x.channels)
    if spec.pointwise:
        return linear(x, w[0].T, bias)
    relation = R.submanifold_kernel_relation(x, kernel_size, dilation, cache=cache)
    return replace(x, df=convolve(x, relation, w, bias), channels=w.shape[2])


def _finer(x: LatticeFrame, spec: KernelSpec) -> tuple[int, int, int]:
    if any(a % b for a, b in zip(x.stride, spec.stride, strict=True)):
        raise ValueError(f"stride {spec.stride} does not divide the frame's {x.stride}")
    return tuple(a // b for a, b in zip(x.stride, spec.stride, strict=True))


def conv_transpose3d(x: LatticeFrame, weight, bias=None, kernel_size=2, stride=2, padding=0, dilation=1, cache: R.RelationCache | None = None) -> LatticeFrame:
    spec = KernelSpec.of(kernel_size, stride, padding, dilation)
    w = kernel_weights(weight, spec, x.channels)
    relation = R.transposed_kernel_relation(x, kernel_size, stride, padding, dilation, cache=cache)
    return x.renewed(convolve(x, relation, w, bias), channels=w.shape[2], stride=_finer(x, spec), unique=relation.unique_out or x.unique)


def generative_conv_transpose3d(x: LatticeFrame, weight, bias=None, kernel_size=2, stride=2, cache: R.RelationCache | None = None) -> LatticeFrame:
    spec = KernelSpec.of(kernel_size, stride)
    w = kernel_weights(weight, spec, x.channels)
    relation = R.generative_kernel_relation(x, kernel_size, stride, cache=cache)
    return x.renewed(convolve(x, relation, w, bias), channels=w.shape[2], stride=_finer(x, spec), unique=x.unique and spec.spreads)
