"""Explicit gradients: each is the operator's relation joined the other way round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.frame import LatticeFrame
from gridstone.operators.conv import multiply
from gridstone.operators.pool import MODES, pooled
from gridstone.operators.relations import Relation


def _all_rows(x: LatticeFrame, sums: DataFrame, names: list[str]) -> DataFrame:
    """row_id and values of every row of ``x``; 0 where nothing arrives."""
    rows = x.df.select("row_id").join(sums, "row_id", "left")
    return rows.select("row_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(names)])


def conv_input_grad(x: LatticeFrame, relation: Relation, w: np.ndarray, cotangent: DataFrame) -> DataFrame:
    """Cotangent (row_id of outputs, f0, ...) times the transposed weights, summed by input row."""
    back = np.ascontiguousarray(np.asarray(w, np.float64).transpose(0, 2, 1))
    sums = multiply(relation.edges, cotangent, back, into="in_row", on="out_row").withColumnRenamed("in_row", "row_id")
    return _all_rows(x, sums, [f"c{b}" for b in range(back.shape[2])])


def conv_weight_grad(x: LatticeFrame, relation: Relation, cotangent: DataFrame) -> DataFrame:
    """kernel_id, g{in}_{out}: products of features and cotangents summed over the edges of each cell; a row for every cell."""
    outs = [c for c in cotangent.columns if c != "row_id"]
    grad = cotangent.select(F.col("row_id").alias("out_row"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(outs)])
    rows = relation.edges.join(x.feats.withColumnRenamed("row_id", "in_row"), "in_row").join(grad, "out_row")
    sums = [F.sum(F.col(a) * F.col(f"y{b}")).alias(f"g{i}_{b}") for i, a in enumerate(x.names) for b in range(len(outs))]
    cells = x.df.sparkSession.range(relation.spec.volume).select(F.col("id").cast("int").alias("kernel_id"))
    return cells.join(rows.groupBy("kernel_id").agg(*sums), "kernel_id", "left").na.fill(0.0)


def pool_vjp(x: LatticeFrame, relation: Relation, mode: str, cotangent: DataFrame) -> DataFrame:
    """sum: the cotangent of each output; avg: by its number of edges; max: split among the inputs that tie for it (never NaN)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    grad = cotangent.select(F.col("row_id").alias("out_row"), *[F.col(c).alias(f"y_{c}") for c in x.names])
    rows = relation.edges.join(x.feats.withColumnRenamed("row_id", "in_row"), "in_row").join(grad, "out_row")
    if mode == "sum":
        shares = [F.sum(f"y_{c}").alias(c) for c in x.names]
    elif mode == "avg":
        degree = relation.edges.groupBy("out_row").agg(F.count("*").alias("_n"))
        rows = rows.join(degree, "out_row")
        shares = [F.sum(F.col(f"y_{c}") / F.col("_n")).alias(c) for c in x.names]
    else:
        tops = rows.groupBy("out_row").agg(*[pooled("max", c).alias(f"m_{c}") for c in x.names])
        rows = rows.join(tops, "out_row")
        ties = rows.groupBy("out_row").agg(*[F.count_if(F.col(c) == F.col(f"m_{c}")).alias(f"t_{c}") for c in x.names])
        rows = rows.join(ties, "out_row")
        shares = [F.sum(F.when(F.col(c) == F.col(f"m_{c}"), F.col(f"y_{c}") / F.col(f"t_{c}")).otherwise(0.0)).alias(c) for c in x.names]
    return _all_rows(x, rows.groupBy(F.col("in_row").alias("row_id")).agg(*shares), x.names)


def pool_jvp(x: LatticeFrame, relation: Relation, mode: str, tangent: DataFrame) -> DataFrame:
    """Tangents of the outputs; max takes that of the first input that ties, by input row, then kernel id; 0 where all are NaN."""
    t = tangent.select(F.col("row_id").alias("in_row"), *[F.col(c).alias(f"y_{c}") for c in x.names])
    rows = relation.edges.join(x.feats.withColumnRenamed("row_id", "in_row"), "in_row").join(t, "in_row")
    if mode == "max":
        order = F.struct(-F.col("in_row"), -F.col("kernel_id"))
        some = lambda c, v: F.when(~F.isnan(c), F.col(v))
        sums = [F.max_by(some(c, f"y_{c}"), F.struct(some(c, c).alias("v"), order.alias("o"))).alias(c) for c in x.names]
    else:
        sums = [(F.sum if mode == "sum" else F.avg)(f"y_{c}").alias(c) for c in x.names]
    out = rows.groupBy(F.col("out_row").alias("row_id")).agg(*sums)
    return relation.out.select("row_id").join(out, "row_id", "left").na.fill(0.0)


def voxelize_grad(assignment: DataFrame, counts: DataFrame, cotangent: DataFrame, reduction: str = "mean") -> DataFrame:
    """point_id and the cotangent of its voxel (for mean divided by the voxel's points); 0 for a point without voxel."""
    names = [c for c in cotangent.columns if c != "row_id"]
    by = counts.select(F.col("row_id").alias("voxel_row"), "count").join(cotangent.withColumnRenamed("row_id", "voxel_row"), "voxel_row")
    rows = assignment.join(by, "voxel_row", "left")
    share = (lambda c: F.col(c) / F.col("count")) if reduction == "mean" else F.col
    return rows.select("point_id", *[F.coalesce(share(c), F.lit(0.0)).alias(c) for c in names])


def interpolation_grad(voxels: LatticeFrame, mapping: DataFrame, cotangent: DataFrame) -> DataFrame:
    """Each point's cotangent times its weights, summed by voxel; mapping: point_id, corner, voxel_row, weight."""
    names = [c for c in cotangent.columns if c != "point_id"]
    rows = mapping.join(cotangent, "point_id")
    sums = rows.groupBy(F.col("voxel_row").alias("row_id")).agg(*[F.sum(F.col("weight").cast("double") * F.col(c)).alias(c) for c in names])
    return _all_rows(voxels, sums, names)
