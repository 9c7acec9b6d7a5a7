"""Row-wise feature functions: expressions over the feature columns; coordinates and identity stay."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame
from gridstone.geometry import COORDS


def linear(x: LatticeFrame, weight, bias=None) -> LatticeFrame:
    """Features times the transpose of an (out, in) weight, plus bias."""
    from gridstone.functions.quantized import QuantizedWeight, dequantize_weight

    w = np.asarray(dequantize_weight(weight) if isinstance(weight, QuantizedWeight) else weight, np.float64)
    if w.ndim != 2 or w.shape[1] != x.channels:
        raise ValueError(f"weight {w.shape} does not fit {x.channels} channels")
    b = [0.0] * len(w) if bias is None else np.asarray(bias, np.float64).ravel().tolist()
    if len(b) != len(w):
        raise ValueError(f"bias has {len(b)} entries, not {len(w)}")
    if w.size > 1024:
        names = x.names

        def run(batches):
            for pdf in batches:
                out = pd.DataFrame(pdf[names].to_numpy(np.float64) @ w.T + b, columns=[f"f{i}" for i in range(len(w))])
                yield pd.concat([pdf[["row_id", *COORDS]].reset_index(drop=True), out], axis=1)

        kinds = ", ".join([f"{c} {t}" for c, t in x.coords.dtypes] + [f"f{i} double" for i in range(len(w))])
        return replace(x, df=x.df.mapInPandas(run, kinds), channels=len(w))
    return x.with_features([sum((F.col(c) * float(v) for c, v in zip(x.names, row, strict=True)), F.lit(0.0)) + b[i] for i, row in enumerate(w)])


def replace_feature(x: LatticeFrame, feats) -> LatticeFrame:
    """Other features (row_id, f0, ...) on the same coordinates."""
    return x.replace(feats=feats)


def relu(x: LatticeFrame) -> LatticeFrame:
    return x.project(lambda c: F.greatest(c, F.lit(0.0)))


def _sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def sigmoid(x: LatticeFrame) -> LatticeFrame:
    return x.project(_sigmoid)


def silu(x: LatticeFrame) -> LatticeFrame:
    return x.project(lambda c: c * _sigmoid(c))


def tanh(x: LatticeFrame) -> LatticeFrame:
    return x.project(F.tanh)


def leaky_relu(x: LatticeFrame, negative_slope: float = 0.01) -> LatticeFrame:
    return x.project(lambda c: F.when(c >= 0, c).otherwise(c * negative_slope))


def gelu(x: LatticeFrame, approx: str = "none") -> LatticeFrame:
    """none or precise: by the error function (a vectorised function, as SQL has none); tanh; fast: c * sigmoid(1.702 c)."""
    if approx == "fast":
        return x.project(lambda c: c * _sigmoid(1.702 * c))
    if approx == "tanh":
        return x.project(lambda c: 0.5 * c * (1 + F.tanh(math.sqrt(2 / math.pi) * (c + 0.044715 * c * c * c))))
    if approx not in ("none", "precise"):
        raise ValueError(f"unknown approximation {approx!r}")

    @F.pandas_udf("double")
    def exact(v: pd.Series) -> pd.Series:
        return v.map(lambda u: 0.5 * u * (1 + math.erf(u / math.sqrt(2))))

    return x.project(exact)


def softplus(x: LatticeFrame, beta: float = 1.0, threshold: float = 20.0) -> LatticeFrame:
    return x.project(lambda c: F.when(c * beta > threshold, c).otherwise(F.log1p(F.exp(F.least(c * beta, F.lit(threshold)))) / beta))


def dropout(x: LatticeFrame, p: float = 0.5, training: bool = True, seed: int = 0) -> LatticeFrame:
    """Each value is zeroed with probability p and the rest scaled by 1 / (1 - p), by a hash of seed, row and channel."""
    if not 0 <= p < 1:
        raise ValueError("p must be at least 0 and below 1")
    if not training or p == 0:
        return x
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), "row_id", F.lit(i)), F.lit(1 << 52)) / float(1 << 52)
    return x.with_features([F.when(draw(i) < p, 0.0).otherwise(F.col(c) / (1 - p)) for i, c in enumerate(x.names)])


def batch_statistics(x: LatticeFrame):
    """One row: mean and population variance of each channel over all rows."""
    return x.df.agg(*[F.avg(c).alias(f"mean_{c}") for c in x.names], *[F.var_pop(c).alias(f"var_{c}") for c in x.names])


def batch_norm(x: LatticeFrame, mean=None, var=None, weight=None, bias=None, eps: float = 1e-5) -> LatticeFrame:
    """(c - mean) / sqrt(var + eps) * weight + bias by channel; statistics of the rows where not given (one extra row, broadcast)."""
    w = [1.0] * x.channels if weight is None else np.asarray(weight, np.float64).tolist()
    b = [0.0] * x.channels if bias is None else np.asarray(bias, np.float64).tolist()
    if (mean is None) != (var is None):
        raise ValueError("give both mean and var, or neither")
    if mean is not None:
        m, v = np.asarray(mean, np.float64).tolist(), np.asarray(var, np.float64).tolist()
        return x.with_features([(F.col(c) - m[i]) / math.sqrt(v[i] + eps) * w[i] + b[i] for i, c in enumerate(x.names)])
    rows = x.df.join(F.broadcast(batch_statistics(x)))
    out = [((F.col(c) - F.col(f"mean_{c}")) / F.sqrt(F.col(f"var_{c}") + eps) * w[i] + b[i]).alias(c) for i, c in enumerate(x.names)]
    return replace(x, df=rows.select("row_id", *COORDS, *out))


def layer_norm(x: LatticeFrame, weight=None, bias=None, eps: float = 1e-5) -> LatticeFrame:
    """Over the channels of each row."""
    n = x.channels
    w = [1.0] * n if weight is None else np.asarray(weight, np.float64).tolist()
    b = [0.0] * n if bias is None else np.asarray(bias, np.float64).tolist()
    mean = sum((F.col(c) for c in x.names), F.lit(0.0)) / n
    rows = x.df.withColumn("_mean", mean)
    rows = rows.withColumn("_var", sum(((F.col(c) - F.col("_mean")) * (F.col(c) - F.col("_mean")) for c in x.names), F.lit(0.0)) / n)
    out = [((F.col(c) - F.col("_mean")) / F.sqrt(F.col("_var") + eps) * w[i] + b[i]).alias(c) for i, c in enumerate(x.names)]
    return replace(x, df=rows.select("row_id", *COORDS, *out))


def rms_norm(x: LatticeFrame, weight=None, eps: float = 1e-5) -> LatticeFrame:
    n = x.channels
    w = [1.0] * n if weight is None else np.asarray(weight, np.float64).tolist()
    rows = x.df.withColumn("_ms", sum((F.col(c) * F.col(c) for c in x.names), F.lit(0.0)) / n)
    return replace(x, df=rows.select("row_id", *COORDS, *[(F.col(c) / F.sqrt(F.col("_ms") + eps) * w[i]).alias(c) for i, c in enumerate(x.names)]))
