"""Registered queries over the driver tables and the SQL each must agree with.

Weights are multiples of 1/8 and counts are whole, so that sums are exact in any order; what is not is rounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone import ops
from gridstone.frame import LatticeFrame, numbered
from gridstone.functions import entropy
from gridstone.functions.quantized import dequantize_weight, quantize_weight
from gridstone.geometry import COORDS
from gridstone.operators import grads
from gridstone.plans.graph import GraphBuilder, LatticeModel
from gridstone.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


# --- fixtures ------------------------------------------------------------------------------


def _placed(df: DataFrame, names: list[str], **known) -> LatticeFrame:
    """Number unique coordinates of -128 to 127 by batch, x, y, z; eight batches of them are 2,048 ranges of ids."""
    order = F.col("batch").cast("long")
    for c in "xyz":
        order = order * 256 + F.col(c) + 128
    rows = numbered(df.withColumn("_order", order), "_order", "row_id")
    return LatticeFrame(rows.select("row_id", *COORDS, *names), len(names), unique=True, **known)


def lattice(spark: SparkSession, sf_dir: str) -> LatticeFrame:
    """lineitem by line number, quantity, discount and tax; features: count and total quantity."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("batch"),
        (F.floor("l_quantity") - 25).cast("int").alias("x"),
        F.round(F.col("l_discount") * 100).cast("int").alias("y"),
        (F.round(F.col("l_tax") * 100) - 4).cast("int").alias("z"),
        F.col("l_quantity").cast("double").alias("q"),
    )
    cells = rows.groupBy(*COORDS).agg(F.count("*").cast("double").alias("f0"), F.sum("q").alias("f1"))
    return _placed(cells, ["f0", "f1"], batches=8)


def shifted(spark: SparkSession, sf_dir: str) -> LatticeFrame:
    """Every other cell of the lattice, three further along x."""
    x = lattice(spark, sf_dir)
    rows = x.df.where(F.pmod(F.col("x") + F.col("y"), F.lit(2)) == 0)
    return _placed(rows.select("batch", (F.col("x") + 3).alias("x"), "y", "z", (F.col("f0") + 1).alias("f0"), (F.col("f1") * 2).alias("f1")), ["f0", "f1"], batches=8)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: the first three components are the place, the next two the features, the label the batch."""
    at = [F.col("embedding")[i].cast("float").alias(f"p{a}") for i, a in enumerate("xyz")]
    feats = [F.col("embedding")[3 + i].cast("double").alias(f"f{i}") for i in range(2)]
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("int").alias("batch"), *at, *feats)


def weights(volume: int, n: int = 2, m: int = 2) -> np.ndarray:
    return np.array([[[((k * 5 + a * 3 + b * 7) % 9 - 4) / 8 for b in range(m)] for a in range(n)] for k in range(volume)])


def _w(k: str, a: int, b: int) -> str:
    return f"(((({k})*5+{a * 3 + b * 7})%9-4)/8.0)"


LATTICE = """cells AS (SELECT CAST(l_linenumber AS INT) batch, CAST(floor(l_quantity) AS INT)-25 x, CAST(round(l_discount*100) AS INT) y,
 CAST(round(l_tax*100) AS INT)-4 z, CAST(count(*) AS DOUBLE) f0, CAST(sum(l_quantity) AS DOUBLE) f1 FROM lineitem GROUP BY 1,2,3,4),
vox AS (SELECT row_number() OVER (ORDER BY batch,x,y,z)-1 row_id, * FROM cells)"""
SHIFTED = """moved AS (SELECT batch, x+3 x, y, z, f0+1 f0, f1*2 f1 FROM vox WHERE (x+y)%2=0),
oth AS (SELECT row_number() OVER (ORDER BY batch,x,y,z)-1 row_id, * FROM moved)"""
POINTS = """pts AS (SELECT vec_id point_id, CAST(label AS INT) batch, embedding[1] px, embedding[2] py, embedding[3] pz,
 CAST(embedding[4] AS DOUBLE) f0, CAST(embedding[5] AS DOUBLE) f1 FROM embeddings)"""
VOXELS = POINTS + """, placed AS (SELECT point_id, batch, CAST(floor(px/CAST(0.1 AS FLOAT)) AS INT) x, CAST(floor(py/CAST(0.1 AS FLOAT)) AS INT) y,
 CAST(floor(pz/CAST(0.1 AS FLOAT)) AS INT) z, f0, f1 FROM pts),
seen AS (SELECT batch,x,y,z,min(point_id) first,count(*) n,avg(f0) m0,avg(f1) m1,sum(f0) s0,sum(f1) s1 FROM placed GROUP BY 1,2,3,4),
pv AS (SELECT row_number() OVER (ORDER BY first)-1 row_id, * FROM seen)"""


def _off(size: int, name: str = "off") -> str:
    low = size // 2 if size % 2 else 0
    axis = [f"CAST({v}.range-{low} AS INT) d{c}" for v, c in zip("abc", "xyz", strict=True)]
    return f"{name} AS (SELECT CAST((a.range*{size}+b.range)*{size}+c.range AS INT) k, {', '.join(axis)} FROM range({size}) a, range({size}) b, range({size}) c)"


DOWN = """parents AS (SELECT batch, CAST(floor(x/2.0) AS INT) x, CAST(floor(y/2.0) AS INT) y, CAST(floor(z/2.0) AS INT) z, min(row_id) first FROM vox GROUP BY 1,2,3,4),
down AS (SELECT row_number() OVER (ORDER BY first)-1 row_id, batch, x, y, z FROM parents)"""


def _edges(out: str, size: int = 3, stride: int = 1, padding: int = 0, source: str = "vox") -> str:
    at = [f"o.{c}*{stride}+f.d{c}-{padding} {c}" for c in "xyz"]
    return f"""{_off(size)}, fan AS (SELECT o.row_id out_row, f.k kernel_id, o.batch, {', '.join(at)} FROM {out} o CROSS JOIN off f),
edges AS (SELECT v.row_id in_row, fan.out_row, fan.kernel_id FROM fan JOIN {source} v USING (batch,x,y,z))"""


SENT = _off(2) + """, sent AS (SELECT v.row_id in_row, f.k kernel_id, v.row_id*8+f.k place, v.batch, v.x*2+f.dx x, v.y*2+f.dy y, v.z*2+f.dz z FROM vox v CROSS JOIN off f)"""
# size 3, stride 2: places of neighbours coincide
MET = _off(3) + """, sent AS (SELECT v.row_id in_row, f.k kernel_id, v.row_id*27+f.k place, v.batch, v.x*2+f.dx x, v.y*2+f.dy y, v.z*2+f.dz z FROM vox v CROSS JOIN off f),
places AS (SELECT batch,x,y,z,min(place) first FROM sent GROUP BY 1,2,3,4), met AS (SELECT row_number() OVER (ORDER BY first)-1 row_id, batch,x,y,z FROM places),
edges AS (SELECT in_row, row_id out_row, kernel_id FROM sent JOIN met USING (batch,x,y,z))"""


def _conv(out: str, m: int = 2, bias: tuple[float, ...] = (0.5, -0.25)) -> str:
    sums = [f"sum(v.f0*{_w('e.kernel_id', 0, b)}+v.f1*{_w('e.kernel_id', 1, b)}) c{b}" for b in range(m)]
    cols = [f"CAST(coalesce(c{b},0)+({bias[b]}) AS DOUBLE) f{b}" for b in range(m)]
    return f"""conv AS (SELECT out_row, {', '.join(sums)} FROM edges e JOIN vox v ON v.row_id=e.in_row GROUP BY 1)
SELECT o.row_id, o.batch, o.x, o.y, o.z, {', '.join(cols)} FROM {out} o LEFT JOIN conv ON conv.out_row=o.row_id"""


BIAS = [0.5, -0.25]
COLS = "row_id, batch, x, y, z"


# --- points and voxels -----------------------------------------------------------------------


@query(f"WITH {VOXELS} SELECT {COLS}, round(m0,6) f0, round(m1,6) f1 FROM pv")
def voxelize_mean(spark, d):
    return ops.voxelize(points(spark, d), 0.1).project(lambda c: F.round(c, 6)).df


@query(f"WITH {VOXELS} SELECT {COLS}, round(s0,6) f0, round(s1,6) f1 FROM pv")
def voxelize_sum(spark, d):
    return ops.voxelize(points(spark, d), 0.1, reduction="sum").project(lambda c: F.round(c, 6)).df


@query(f"WITH {LATTICE} SELECT {COLS}, f0, f1 FROM vox")
def lattice_source(spark, d):
    return lattice(spark, d).df


@query(f"WITH {VOXELS} SELECT point_id, pv.row_id voxel_row, pv.n \"count\" FROM placed JOIN pv USING (batch,x,y,z)")
def sparse_quantize(spark, d):
    q = ops.sparse_quantize(points(spark, d), 0.1)
    return q.assignment.join(q.voxels.select(F.col("row_id").alias("voxel_row"), "count"), "voxel_row")


@query(f"WITH {VOXELS} SELECT {COLS}, round(s0*2,6) f0 FROM pv")
def voxelize_with_quantization(spark, d):
    p = points(spark, d)
    feats = p.select("point_id", (F.col("f0") * 2).alias("f0"))
    return ops.voxelize_with_quantization(ops.sparse_quantize(p, 0.1), feats, "sum").project(lambda c: F.round(c, 6)).df


_T = [f"p{a}/CAST(0.1 AS FLOAT) q{a}" for a in "xyz"]
CORNERS = f"""spot AS (SELECT point_id, batch, {', '.join(_T)} FROM pts),
corners AS (SELECT point_id, batch, CAST(c.range AS INT) corner, {', '.join(f"CAST(floor(q{a}) AS INT)+CAST((c.range>>{i})&1 AS INT) {a}" for i, a in enumerate("xyz"))},
 {', '.join(f"CASE WHEN (c.range>>{i})&1=1 THEN q{a}-floor(q{a}) ELSE CAST(1 AS FLOAT)-(q{a}-floor(q{a})) END w{a}" for i, a in enumerate("xyz"))} FROM spot, range(8) c),
map AS (SELECT point_id, corner, pv.row_id voxel_row, CAST(wx*wy*wz AS FLOAT) weight FROM corners JOIN pv USING (batch,x,y,z))"""


@query(f"WITH {VOXELS}, {CORNERS} SELECT point_id, corner, voxel_row, round(CAST(weight AS DOUBLE),4) weight FROM map")
def point_voxel_map(spark, d):
    p = points(spark, d)
    return ops.build_point_voxel_map(p, ops.voxelize(p, 0.1).coords, 0.1).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


@query(f"""WITH {VOXELS}, {CORNERS}, got AS (SELECT point_id, sum(CAST(weight AS DOUBLE)*m0) f0, sum(CAST(weight AS DOUBLE)*m1) f1 FROM map JOIN pv ON pv.row_id=voxel_row GROUP BY 1)
SELECT point_id, round(coalesce(got.f0,0),4) f0, round(coalesce(got.f1,0),4) f1 FROM pts LEFT JOIN got USING (point_id)""")
def devoxelize_linear(spark, d):
    p = points(spark, d)
    return ops.devoxelize(p, ops.voxelize(p, 0.1), 0.1).select("point_id", F.round("f0", 4).alias("f0"), F.round("f1", 4).alias("f1"))


@query(f"""WITH {VOXELS}, near AS (SELECT point_id, batch, {', '.join(f"CAST(floor(p{a}/CAST(0.1 AS FLOAT)+CAST(0.5 AS FLOAT)) AS INT) {a}" for a in "xyz")} FROM pts)
SELECT point_id, round(coalesce(m0,0),6) f0, round(coalesce(m1,0),6) f1 FROM near LEFT JOIN pv USING (batch,x,y,z)""")
def devoxelize_nearest(spark, d):
    p = points(spark, d)
    return ops.devoxelize(p, ops.voxelize(p, 0.1), 0.1, interpolation="nearest").select("point_id", F.round("f0", 6).alias("f0"), F.round("f1", 6).alias("f1"))


@query(f"WITH {VOXELS} SELECT point_id, (pv.row_id%16)/8.0/n f0 FROM placed JOIN pv USING (batch,x,y,z)")
def voxelize_grad(spark, d):
    q = ops.sparse_quantize(points(spark, d), 0.1)
    return grads.voxelize_grad(q.assignment, q.voxels, q.voxels.select("row_id", (F.pmod("row_id", F.lit(16)) / 8).alias("f0")))


@query(f"""WITH {VOXELS}, {CORNERS}, got AS (SELECT voxel_row, sum(CAST(weight AS DOUBLE)*((point_id%8)/8.0)) g FROM map GROUP BY 1)
SELECT row_id, round(coalesce(g,0),4) f0 FROM pv LEFT JOIN got ON voxel_row=row_id""")
def interpolation_grad(spark, d):
    p = points(spark, d)
    v = ops.voxelize(p, 0.1)
    cotangent = p.select("point_id", (F.pmod("point_id", F.lit(8)) / 8).alias("f0"))
    out = grads.interpolation_grad(v, ops.build_point_voxel_map(p, v.coords, 0.1), cotangent)
    return out.select("row_id", F.round("f0", 4).alias("f0"))


# --- coordinates -----------------------------------------------------------------------------


@query(f"""WITH {LATTICE}, {SHIFTED}, both_ AS (SELECT 0 side, row_id, batch,x,y,z FROM vox UNION ALL SELECT 1, row_id, batch,x,y,z FROM oth),
firsts AS (SELECT batch,x,y,z,min(side*1000000000+row_id) first FROM both_ GROUP BY 1,2,3,4)
SELECT row_number() OVER (ORDER BY first)-1 row_id, batch,x,y,z FROM firsts""")
def union_coords(spark, d):
    return ops.union_coords(lattice(spark, d).coords, shifted(spark, d).coords)


@query(f"WITH {LATTICE}, {SHIFTED} SELECT row_number() OVER (ORDER BY row_id)-1 row_id, batch,x,y,z FROM vox SEMI JOIN oth USING (batch,x,y,z)")
def intersection_coords(spark, d):
    return ops.intersection_coords(lattice(spark, d).coords, shifted(spark, d).coords)


@query(f"WITH {LATTICE}, {DOWN} SELECT {COLS} FROM down")
def downsample_coords(spark, d):
    return ops.downsample_coords(lattice(spark, d).coords, 2)


@query(f"WITH {LATTICE}, {SHIFTED} SELECT oth.row_id, coalesce(vox.row_id,-1) found FROM oth LEFT JOIN vox USING (batch,x,y,z)")
def lookup_coords(spark, d):
    return ops.lookup_coords(lattice(spark, d).coords, shifted(spark, d).coords)


QUERIES["inverse_map"] = lambda spark, d: ops.inverse_map(lattice(spark, d).coords, shifted(spark, d).coords)
ORACLES["inverse_map"] = ORACLES["lookup_coords"]


@query(f"WITH {LATTICE}, {SHIFTED} SELECT oth.row_id, vox.row_id IS NOT NULL contained FROM oth LEFT JOIN vox USING (batch,x,y,z)")
def contains_coords(spark, d):
    return ops.contains_coords(lattice(spark, d).coords, shifted(spark, d).coords)


def _bits(c: str) -> str:
    """2 ** 21 added to negatives before the bits are taken."""
    v = f"CAST(CASE WHEN {c}<0 THEN {c}+2097152 ELSE {c} END AS HUGEINT)"
    return "+".join(f"(({v}//{1 << i})%2)*{1 << 3 * i}" for i in range(21))


MORTON = f"""raw AS (SELECT row_id, (({_bits('x')})+2*({_bits('y')})+4*({_bits('z')})+CAST(batch AS HUGEINT)*1152921504606846976)%18446744073709551616 u FROM vox),
codes AS (SELECT row_id, CAST(CASE WHEN u>=9223372036854775808 THEN u-18446744073709551616 ELSE u END AS BIGINT) code FROM raw)"""


@query(f"WITH {LATTICE}, {MORTON} SELECT row_id, code FROM codes")
def morton_codes(spark, d):
    return ops.morton_codes(lattice(spark, d).coords)


@query(f"WITH {LATTICE}, {MORTON} SELECT row_id, code, row_number() OVER (ORDER BY code,row_id)-1 AS \"position\" FROM codes")
def morton_order(spark, d):
    return ops.morton_order(lattice(spark, d).coords)


@query(f"WITH {LATTICE}, {MORTON} SELECT row_number() OVER (ORDER BY code,row_id)-1 AS \"position\", row_id AS \"order\", batch,x,y,z FROM codes JOIN vox USING (row_id)")
def morton_sort_coords(spark, d):
    return ops.morton_sort_coords(lattice(spark, d).coords)


OCCUPIED = """occ AS (SELECT batch, CAST(floor(x/2.0) AS INT) x, CAST(floor(y/2.0) AS INT) y, CAST(floor(z/2.0) AS INT) z, min(row_id) first,
 CAST(bit_or(1<<(((x%2+2)%2)+2*((y%2+2)%2)+4*((z%2+2)%2))) AS INT) occupancy FROM vox GROUP BY 1,2,3,4),
par AS (SELECT row_number() OVER (ORDER BY first)-1 row_id, batch,x,y,z,occupancy FROM occ)"""


@query(f"WITH {LATTICE}, {OCCUPIED} SELECT {COLS}, occupancy FROM par")
def occupancy_downsample(spark, d):
    return ops.occupancy_downsample(lattice(spark, d).coords)


@query(f"""WITH {LATTICE}, {OCCUPIED} SELECT row_number() OVER (ORDER BY row_id,c.range)-1 row_id, batch, CAST(x*2+c.range%2 AS INT) x, CAST(y*2+(c.range//2)%2 AS INT) y,
 CAST(z*2+c.range//4 AS INT) z, par.row_id parent_row, CAST(c.range AS INT) child FROM par, range(8) c WHERE (occupancy>>CAST(c.range AS INT))&1=1""")
def occupancy_expand(spark, d):
    return ops.occupancy_expand(ops.occupancy_downsample(lattice(spark, d).coords))


@query(f"""WITH {LATTICE} SELECT row_id, batch, CAST(x*2+row_id%2 AS INT) x, CAST(y*2+(row_id//2)%2 AS INT) y, CAST(z*2+(row_id//4)%2 AS INT) z FROM vox""")
def child_coords_from_indices(spark, d):
    c = lattice(spark, d).coords
    return ops.child_coords_from_indices(c, c.select("row_id", F.col("row_id").alias("parent_row"), F.pmod("row_id", F.lit(8)).cast("int").alias("child")))


@query(f"WITH {_off(3)} SELECT k kernel_id, dx, dy, dz FROM off")
def kernel_offsets(spark, d):
    return spark.createDataFrame([(i, *o) for i, o in enumerate(ops.kernel_offsets(3))], "kernel_id int, dx int, dy int, dz int")


# --- relations -------------------------------------------------------------------------------

EDGE = "in_row, out_row, kernel_id"


@query(f"WITH {LATTICE}, {_edges('vox')} SELECT {EDGE} FROM edges")
def kernel_relation(spark, d):
    return ops.kernel_relation(lattice(spark, d)).edges


@query(f"WITH {LATTICE}, {DOWN}, {_edges('down', 3, 2, 1)} SELECT {EDGE} FROM edges")
def strided_relation(spark, d):
    return ops.build_kernel_relation(lattice(spark, d).coords, 3, 2, 1).edges


@query(f"WITH {LATTICE}, {_edges('vox')} SELECT {EDGE} FROM edges")
def submanifold_relation(spark, d):
    return ops.submanifold_kernel_relation(lattice(spark, d)).edges


@query(f"WITH {LATTICE}, {SHIFTED}, {_edges('oth')} SELECT {EDGE} FROM edges")
def target_relation(spark, d):
    return ops.target_kernel_relation(lattice(spark, d), shifted(spark, d)).edges


@query(f"WITH {LATTICE}, {SENT} SELECT in_row, place out_row, kernel_id, batch, x, y, z FROM sent")
def transposed_relation(spark, d):
    r = ops.transposed_kernel_relation(lattice(spark, d))
    return r.edges.join(r.out.withColumnRenamed("row_id", "out_row"), "out_row")


@query(f"WITH {LATTICE}, {MET} SELECT {EDGE} FROM edges")
def transposed_relation_merging(spark, d):
    return ops.build_transposed_kernel_relation(lattice(spark, d).coords, 3, 2).edges


@query(f"WITH {LATTICE}, {SENT} SELECT in_row, place out_row, kernel_id FROM sent")
def generative_relation(spark, d):
    return ops.generative_kernel_relation(lattice(spark, d)).edges


@query(f"""WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)}, m AS (SELECT out_row, CAST(sum(1<<kernel_id) AS BIGINT) mask, count(*) n FROM edges GROUP BY 1)
SELECT row_id out_row, coalesce(mask,0) mask, coalesce(n,0) n FROM down LEFT JOIN m ON out_row=row_id""")
def implicit_gemm_masks(spark, d):
    g = ops.build_kernel_relation(lattice(spark, d).coords, 2, 2).implicit_gemm()
    return g.select("out_row", F.col("masks")[0].alias("mask"), F.size(F.filter("map", lambda v: v >= 0)).cast("long").alias("n"))


@query(f"""WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)}, m AS (SELECT out_row, CAST(sum(1<<kernel_id) AS BIGINT) mask FROM edges GROUP BY 1),
g AS (SELECT row_id out_row, coalesce(mask,0) mask FROM down LEFT JOIN m ON out_row=row_id), p AS (SELECT *, row_number() OVER (ORDER BY mask,out_row)-1 place FROM g)
SELECT out_row, mask, place, place//64 tile FROM p""")
def sorted_implicit_gemm(spark, d):
    return ops.build_kernel_relation(lattice(spark, d).coords, 2, 2).sorted_implicit_gemm().select("out_row", "mask", "place", "tile")


@query(f"""WITH {LATTICE}, {_edges('vox')}, n AS (SELECT kernel_id, count(*) n FROM edges GROUP BY 1)
SELECT k kernel_id, CAST(coalesce(n,0) AS BIGINT) n, CAST(sum(coalesce(n,0)) OVER (ORDER BY k)-coalesce(n,0) AS BIGINT) AS \"offset\" FROM off LEFT JOIN n ON kernel_id=k""")
def kernel_view(spark, d):
    return ops.kernel_relation(lattice(spark, d)).kernel_view()


@query(f"WITH {LATTICE}, {DOWN}, {_edges('down', 3, 2, 1)} SELECT row_id out_row, e.kernel_id, e.in_row FROM down LEFT JOIN edges e ON e.out_row=row_id")
def out_view(spark, d):
    view = ops.build_kernel_relation(lattice(spark, d).coords, 3, 2, 1).out_view()
    return view.select("out_row", F.explode_outer("edges").alias("e")).select("out_row", "e.kernel_id", "e.in_row")


@query(f"WITH {LATTICE}, {DOWN}, {_edges('down', 3, 2, 1)} SELECT in_row, out_row, kernel_id FROM edges")
def in_view(spark, d):
    view = ops.build_kernel_relation(lattice(spark, d).coords, 3, 2, 1).in_view()
    return view.select("in_row", F.explode("edges").alias("e")).select("in_row", "e.out_row", "e.kernel_id")


@query(f"WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)} SELECT {EDGE} FROM edges")
def direct_view(spark, d):
    return ops.build_kernel_relation(lattice(spark, d).coords, 2, 2).direct_view()


# queries every 20th row; sources: all rows of the batch
KNN = """asked AS (SELECT row_id query_row, batch, x qx, y qy, z qz FROM vox WHERE row_id%20=0),
near AS (SELECT query_row, v.row_id source_row, (qx-x)*(qx-x)+(qy-y)*(qy-y)+(qz-z)*(qz-z) d FROM asked JOIN vox v USING (batch)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY d,source_row)-1 r FROM near)"""


@query(f"WITH {LATTICE}, {KNN} SELECT query_row, source_row, CAST(r AS INT) neighbor_id, CAST(d AS FLOAT) distance FROM ranked WHERE r<8")
def knn(spark, d):
    c = lattice(spark, d).coords
    return ops.build_knn_relation(c, c.where(F.col("row_id") % 20 == 0), 8)


BALL = """axis AS (SELECT CAST(range-2 AS INT) v FROM range(5)), ball AS (SELECT a.v dx, b.v dy, c.v dz, a.v*a.v+b.v*b.v+c.v*c.v d FROM axis a, axis b, axis c WHERE a.v*a.v+b.v*b.v+c.v*c.v<=4),
reach AS (SELECT o.row_id query_row, o.batch, o.x+dx x, o.y+dy y, o.z+dz z, d FROM vox o CROSS JOIN ball),
hits AS (SELECT query_row, v.row_id source_row, d, row_number() OVER (PARTITION BY query_row ORDER BY d, v.row_id)-1 r FROM reach JOIN vox v USING (batch,x,y,z))"""


@query(f"WITH {LATTICE}, {BALL} SELECT query_row, source_row, CAST(r AS INT) neighbor_id, CAST(d AS FLOAT) distance FROM hits")
def radius(spark, d):
    return ops.radius_relation(lattice(spark, d), radius=2.0)


@query(f"WITH {LATTICE}, {BALL} SELECT query_row, source_row, CAST(r AS INT) neighbor_id, CAST(d AS FLOAT) distance FROM hits WHERE r<8")
def radius_capped(spark, d):
    return ops.radius_relation(lattice(spark, d), radius=2.0, max_neighbors=8)


@query(f"WITH {LATTICE}, {BALL} SELECT query_row, CAST(r AS INT) neighbor_id, v.f0, v.f1 FROM hits JOIN vox v ON v.row_id=source_row WHERE r<4")
def gather_neighbor_features(spark, d):
    x = lattice(spark, d)
    return ops.gather_neighbor_features(x, ops.radius_relation(x, radius=2.0, max_neighbors=4)).select("query_row", "neighbor_id", "f0", "f1")


# --- convolution -----------------------------------------------------------------------------


@query(f"WITH {LATTICE}, {_edges('vox')}, {_conv('vox')}")
def conv3d(spark, d):
    return ops.conv3d(lattice(spark, d), weights(27), BIAS).df


@query(f"WITH {LATTICE}, {DOWN}, {_edges('down', 3, 2, 1)}, {_conv('down')}")
def conv3d_strided(spark, d):
    return ops.conv3d(lattice(spark, d), weights(27), BIAS, 3, 2, 1).df


@query(f"WITH {LATTICE} SELECT {COLS}, f0*{_w('0', 0, 0)}+f1*{_w('0', 1, 0)}+0.5 f0, f0*{_w('0', 0, 1)}+f1*{_w('0', 1, 1)}-0.25 f1 FROM vox")
def conv3d_pointwise(spark, d):
    return ops.conv3d(lattice(spark, d), weights(1), BIAS, 1).df


@query(f"WITH {LATTICE}, {SHIFTED}, {_edges('oth')}, {_conv('oth')}")
def conv3d_target(spark, d):
    return ops.conv3d(lattice(spark, d), weights(27), BIAS, coordinates=shifted(spark, d)).df


@query(f"WITH {LATTICE}, {_edges('vox')}, {_conv('vox')}")
def subm_conv3d(spark, d):
    return ops.subm_conv3d(lattice(spark, d), weights(27), BIAS).df


@query(f"WITH {LATTICE}, {_edges('vox')}, {_conv('vox', 40, (0.0,) * 40)}")
def subm_conv3d_wide(spark, d):
    return ops.subm_conv3d(lattice(spark, d), weights(27, 2, 40)).df


# every place has one edge: nothing to sum
@query(f"""WITH {LATTICE}, {_off(2)} SELECT row_id*8+k row_id, batch, x*2+dx x, y*2+dy y, z*2+dz z,
 {', '.join(f"CAST(f0*{_w('k', 0, b)}+f1*{_w('k', 1, b)}+({BIAS[b]}) AS DOUBLE) f{b}" for b in range(2))} FROM vox CROSS JOIN off""")
def conv_transpose3d(spark, d):
    return ops.conv_transpose3d(_coarse(lattice(spark, d)), weights(8), BIAS).df


@query(f"WITH {LATTICE}, {MET}, {_conv('met')}")
def conv_transpose3d_merging(spark, d):
    return ops.conv_transpose3d(_coarse(lattice(spark, d)), weights(27), BIAS, 3, 2).df


QUERIES["generative_conv_transpose3d"] = lambda spark, d: ops.generative_conv_transpose3d(_coarse(lattice(spark, d)), weights(8), BIAS).df
ORACLES["generative_conv_transpose3d"] = ORACLES["conv_transpose3d"]


def _coarse(x: LatticeFrame) -> LatticeFrame:
    return x.replace(stride=2)


def _cotangent(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", (F.pmod("row_id", F.lit(8)) / 8).alias("f0"), (F.pmod("row_id", F.lit(4)) / 4).alias("f1"))


COT = "(e.out_row%8)/8.0", "(e.out_row%4)/4.0"


@query(f"""WITH {LATTICE}, {_edges('vox')}, g AS (SELECT in_row, {', '.join(f"sum({COT[0]}*{_w('e.kernel_id', a, 0)}+{COT[1]}*{_w('e.kernel_id', a, 1)}) g{a}" for a in range(2))} FROM edges e GROUP BY 1)
SELECT row_id, CAST(coalesce(g0,0) AS DOUBLE) f0, CAST(coalesce(g1,0) AS DOUBLE) f1 FROM vox LEFT JOIN g ON in_row=row_id""")
def conv_input_grad(spark, d):
    x = lattice(spark, d)
    return grads.conv_input_grad(x, ops.kernel_relation(x), weights(27), _cotangent(x.df))


@query(f"""WITH {LATTICE}, {_edges('vox')} SELECT kernel_id, {', '.join(f"CAST(sum(v.f{a}*{COT[b]}) AS DOUBLE) g{a}_{b}" for a in range(2) for b in range(2))} FROM edges e JOIN vox v ON v.row_id=in_row GROUP BY 1""")
def conv_weight_grad(spark, d):
    x = lattice(spark, d)
    return grads.conv_weight_grad(x, ops.kernel_relation(x), _cotangent(x.df))


# --- pooling ---------------------------------------------------------------------------------

POOLS = {"sum": "sum({c})", "max": "max({c})", "avg": "round(avg({c}),6)"}


def _pool_sql(mode: str, size: int, stride: int, padding: int) -> str:
    empty = "CAST('-inf' AS DOUBLE)" if mode == "max" else "0"
    sums = ", ".join(f"{POOLS[mode].format(c=f'v.f{i}')} p{i}" for i in range(2))
    return f"""WITH {LATTICE}, {DOWN}, {_edges('down', size, stride, padding)}, p AS (SELECT out_row, {sums} FROM edges JOIN vox v ON v.row_id=in_row GROUP BY 1)
SELECT {COLS}, CAST(coalesce(p0,{empty}) AS DOUBLE) f0, CAST(coalesce(p1,{empty}) AS DOUBLE) f1 FROM down LEFT JOIN p ON out_row=row_id"""


def _pool_query(mode: str, size: int, padding: int) -> Query:
    def run(spark, d):
        out = ops.pool3d(lattice(spark, d), mode, size, 2, padding)
        return (out.project(lambda c: F.round(c, 6)) if mode == "avg" else out).df

    return run


for _mode in POOLS:
    QUERIES[f"{_mode}_pool3d"], ORACLES[f"{_mode}_pool3d"] = _pool_query(_mode, 2, 0), _pool_sql(_mode, 2, 2, 0)
    QUERIES[f"{_mode}_pool3d_overlapping"], ORACLES[f"{_mode}_pool3d_overlapping"] = _pool_query(_mode, 3, 0), _pool_sql(_mode, 3, 2, 0)
    if _mode != "max":
        QUERIES[f"global_{_mode}_pool"] = lambda spark, d, m=_mode: _rounded(ops.OPERATORS[f"global_{m}_pool"](lattice(spark, d)))
        ORACLES[f"global_{_mode}_pool"] = f"""WITH {LATTICE}, p AS (SELECT batch, {_mode}(f0) p0, {_mode}(f1) p1 FROM vox GROUP BY 1)
SELECT CAST(range AS INT) batch, round(coalesce(p0,0),6) f0, round(coalesce(p1,0),6) f1 FROM range(8) LEFT JOIN p ON batch=range"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query(f"WITH {LATTICE} SELECT batch, max(f0) f0, max(f1) f1 FROM vox GROUP BY 1")
def global_max_pool(spark, d):
    x = lattice(spark, d)
    return ops.global_max_pool(LatticeFrame(x.df, 2))


VJP = {
    "sum": "sum({y})",
    "avg": "sum({y}/n)",
    "max": "sum(CASE WHEN {v}={m} THEN {y}/{t} ELSE 0 END)",
}


def _vjp_sql(mode: str) -> str:
    cols = ", ".join(VJP[mode].format(y=COT[i], v=f"v.f{i}", m=f"m{i}", t=f"t{i}") + f" g{i}" for i in range(2))
    return f"""WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)}, top AS (SELECT out_row, count(*) n, max(v.f0) m0, max(v.f1) m1 FROM edges JOIN vox v ON v.row_id=in_row GROUP BY 1),
ties AS (SELECT out_row, sum(CAST(v.f0=m0 AS INT)) t0, sum(CAST(v.f1=m1 AS INT)) t1 FROM edges JOIN vox v ON v.row_id=in_row JOIN top USING (out_row) GROUP BY 1),
g AS (SELECT in_row, {cols} FROM edges e JOIN vox v ON v.row_id=in_row JOIN top USING (out_row) JOIN ties USING (out_row) GROUP BY 1)
SELECT row_id, round(coalesce(g0,0),6) f0, round(coalesce(g1,0),6) f1 FROM vox LEFT JOIN g ON in_row=row_id"""


def _vjp_query(mode: str) -> Query:
    def run(spark, d):
        x = lattice(spark, d)
        r = ops.kernel_relation(x, 2, 2)
        return _rounded(grads.pool_vjp(x, r, mode, _cotangent(r.out)))

    return run


for _mode in VJP:
    QUERIES[f"{_mode}_pool_vjp"], ORACLES[f"{_mode}_pool_vjp"] = _vjp_query(_mode), _vjp_sql(_mode)


@query(f"""WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)}, r AS (SELECT out_row, (in_row%8)/8.0 y0, (in_row%4)/4.0 y1,
 row_number() OVER (PARTITION BY out_row ORDER BY v.f0 DESC, in_row, kernel_id) a, row_number() OVER (PARTITION BY out_row ORDER BY v.f1 DESC, in_row, kernel_id) b FROM edges JOIN vox v ON v.row_id=in_row)
SELECT out_row row_id, CAST(max(CASE WHEN a=1 THEN y0 END) AS DOUBLE) f0, CAST(max(CASE WHEN b=1 THEN y1 END) AS DOUBLE) f1 FROM r GROUP BY 1""")
def max_pool_jvp(spark, d):
    x = lattice(spark, d)
    return grads.pool_jvp(x, ops.kernel_relation(x, 2, 2), "max", _cotangent(x.df))


# --- joins and algebra -----------------------------------------------------------------------

ALIGN = {
    "inner": "SELECT vox.row_id o, batch,x,y,z, vox.row_id l, oth.row_id r FROM vox JOIN oth USING (batch,x,y,z)",
    "left": "SELECT vox.row_id o, batch,x,y,z, vox.row_id l, oth.row_id r FROM vox LEFT JOIN oth USING (batch,x,y,z)",
    "right": "SELECT oth.row_id o, batch,x,y,z, vox.row_id l, oth.row_id r FROM oth LEFT JOIN vox USING (batch,x,y,z)",
}
ALIGN["outer"] = ALIGN["left"] + " UNION ALL SELECT 1000000000+oth.row_id, batch,x,y,z, NULL, oth.row_id FROM oth ANTI JOIN vox USING (batch,x,y,z)"


def _align(join: str) -> str:
    return f"{LATTICE}, {SHIFTED}, al AS ({ALIGN[join]}), al2 AS (SELECT row_number() OVER (ORDER BY o)-1 row_id, batch,x,y,z,l,r FROM al)"


for _join in ALIGN:
    QUERIES[f"align_{_join}"] = lambda spark, d, j=_join: ops.align_sparse(lattice(spark, d), shifted(spark, d), j)
    ORACLES[f"align_{_join}"] = f"WITH {_align(_join)} SELECT {COLS}, coalesce(l,-1) lhs_row, coalesce(r,-1) rhs_row FROM al2"

ALGEBRA = {"add": ("outer", "{a}+{b}"), "sub": ("outer", "{a}-{b}"), "mul": ("inner", "{a}*{b}"), "maximum": ("inner", "greatest({a},{b})"), "minimum": ("inner", "least({a},{b})")}


def _algebra_sql(join: str, form: str) -> str:
    cols = ", ".join(form.format(a=f"coalesce(v.f{i},0)", b=f"coalesce(t.f{i},0)") + f" f{i}" for i in range(2))
    return f"WITH {_align(join)} SELECT a.row_id, a.batch, a.x, a.y, a.z, {cols} FROM al2 a LEFT JOIN vox v ON v.row_id=l LEFT JOIN oth t ON t.row_id=r"


for _name, (_join, _form) in ALGEBRA.items():
    QUERIES[f"sparse_{_name}"] = lambda spark, d, n=_name: ops.OPERATORS[f"sparse_{n}"](lattice(spark, d), shifted(spark, d)).df
    ORACLES[f"sparse_{_name}"] = _algebra_sql(_join, _form)


def _cat_sql(join: str) -> str:
    return f"WITH {_align(join)} SELECT a.row_id, a.batch, a.x, a.y, a.z, coalesce(v.f0,0) f0, coalesce(v.f1,0) f1, coalesce(t.f0,0) f2, coalesce(t.f1,0) f3 FROM al2 a LEFT JOIN vox v ON v.row_id=l LEFT JOIN oth t ON t.row_id=r"


@query(_cat_sql("outer"))
def cat_outer(spark, d):
    return ops.cat([lattice(spark, d), shifted(spark, d)], "outer").df


@query(_cat_sql("inner"))
def sparse_cat_aligned(spark, d):
    return ops.sparse_cat_aligned(lattice(spark, d), shifted(spark, d)).df


@query(f"WITH {LATTICE}, {SHIFTED} SELECT oth.row_id, coalesce(vox.f0,-1) f0, coalesce(vox.f1,-1) f1 FROM oth LEFT JOIN vox USING (batch,x,y,z)")
def gather_aligned_features(spark, d):
    x = lattice(spark, d)
    return ops.gather_aligned_features(x, ops.lookup_coords(x.coords, shifted(spark, d).coords), fill=-1.0)


# --- rows ------------------------------------------------------------------------------------


@query(f"WITH {LATTICE} SELECT row_number() OVER (ORDER BY row_id)-1 row_id, batch,x,y,z,f0,f1 FROM vox WHERE x BETWEEN -10 AND 10 AND y BETWEEN 2 AND 8 AND z BETWEEN -2 AND 3")
def crop(spark, d):
    return ops.crop(lattice(spark, d), (-10, 2, -2), (10, 8, 3)).df


@query(f"WITH {LATTICE} SELECT row_number() OVER (ORDER BY row_id)-1 row_id, batch,x,y,z,f0,f1 FROM vox WHERE f1>50")
def prune_mask(spark, d):
    return ops.prune_mask(lattice(spark, d), F.col("f1") > 50).df


@query(f"WITH {LATTICE} SELECT row_number() OVER (ORDER BY row_id DESC)-1 row_id, batch,x,y,z,f0,f1 FROM vox WHERE row_id%3=0")
def prune(spark, d):
    x = lattice(spark, d)
    rows = x.df.where(F.col("row_id") % 3 == 0).select((F.lit(1 << 40) - F.col("row_id")).alias("position"), F.col("row_id").alias("row"))
    return ops.prune(x, rows).df


@query(f"""WITH {LATTICE}, r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY f0 DESC,row_id DESC) k FROM vox), t AS (SELECT * FROM r WHERE k<=batch*5)
SELECT row_number() OVER (ORDER BY batch,k DESC)-1 row_id, batch,x,y,z,f0,f1 FROM t""")
def topk_rows(spark, d):
    x = lattice(spark, d)
    return ops.prune(x, ops.topk_rows(x, [5 * b for b in range(8)])).df


@query(f"WITH {LATTICE} SELECT row_number() OVER (ORDER BY batch DESC,row_id)-1 row_id, CAST(7-batch AS INT) batch, x,y,z,f0,f1 FROM vox")
def sparse_collate(spark, d):
    """All batches (line numbers 1 to 7), the last one first."""
    x = lattice(spark, d)
    parts = [numbered(x.df.where(F.col("batch") == b).withColumnRenamed("row_id", "_o"), "_o", "row_id").select("row_id", "x", "y", "z", "f0", "f1") for b in range(7, 0, -1)]
    return ops.sparse_collate(parts).df


# --- features --------------------------------------------------------------------------------


def _feature(name: str, form: str, *args, **kwargs) -> None:
    """An operator on (f0 - 3) / 2 and (f1 - 40) / 16; ``form`` has {c}."""
    shifted_ = ("((f0-3)/2)", "((f1-40)/16)")

    def run(spark, d):
        x = lattice(spark, d).with_features([(F.col("f0") - 3) / 2, (F.col("f1") - 40) / 16])
        return _rounded(ops.OPERATORS[name](x, *args, **kwargs).df)

    QUERIES[name if not args else f"{name}_{args[0]}"] = run
    if form:
        ORACLES[name if not args else f"{name}_{args[0]}"] = f"WITH {LATTICE} SELECT {COLS}, " + ", ".join(f"round({form.format(c=c)},6) f{i}" for i, c in enumerate(shifted_)) + " FROM vox"


_feature("relu", "greatest({c},0)")
_feature("sigmoid", "1/(1+exp(-{c}))")
_feature("silu", "{c}/(1+exp(-{c}))")
_feature("tanh", "tanh({c})")
_feature("leaky_relu", "CASE WHEN {c}>=0 THEN {c} ELSE {c}*0.01 END")
_feature("softplus", "CASE WHEN {c}>20 THEN {c} ELSE ln(1+exp(least({c},20))) END")
_feature("gelu", "0.5*{c}*(1+tanh(0.7978845608028654*({c}+0.044715*{c}*{c}*{c})))", "tanh")
_feature("gelu", "{c}/(1+exp(-1.702*{c}))", "fast")
_feature("gelu", "", "none")
_feature("dropout", "", 0.25)


@query(f"WITH {LATTICE} SELECT {COLS}, f0*0.5-f1*0.25+1 f0, f0*2+f1*0.125 f1, f1-f0-1 f2 FROM vox")
def linear(spark, d):
    return ops.linear(lattice(spark, d), [[0.5, -0.25], [2, 0.125], [-1, 1]], [1, 0, -1]).df


@query(f"WITH {LATTICE} SELECT {COLS}, f1 f0 FROM vox")
def replace_feature(spark, d):
    x = lattice(spark, d)
    return ops.replace_feature(x, x.df.select("row_id", F.col("f1").alias("f0"))).df


@query(f"""WITH {LATTICE}, s AS (SELECT avg(f0) a0, var_pop(f0) v0, avg(f1) a1, var_pop(f1) v1 FROM vox)
SELECT {COLS}, round((f0-a0)/sqrt(v0+1e-5)*2+0.5,6) f0, round((f1-a1)/sqrt(v1+1e-5)*0.5-1,6) f1 FROM vox, s""")
def batch_norm(spark, d):
    return _rounded(ops.batch_norm(lattice(spark, d), weight=[2, 0.5], bias=[0.5, -1]).df)


@query(f"WITH {LATTICE}, m AS (SELECT *, (f0+f1)/2 a FROM vox), v AS (SELECT *, ((f0-a)*(f0-a)+(f1-a)*(f1-a))/2 q FROM m) SELECT {COLS}, round((f0-a)/sqrt(q+1e-5)*2,6) f0, round((f1-a)/sqrt(q+1e-5)+0.5,6) f1 FROM v")
def layer_norm(spark, d):
    return _rounded(ops.layer_norm(lattice(spark, d), [2, 1], [0, 0.5]).df)


@query(f"WITH {LATTICE}, m AS (SELECT *, (f0*f0+f1*f1)/2 q FROM vox) SELECT {COLS}, round(f0/sqrt(q+1e-5)*2,6) f0, round(f1/sqrt(q+1e-5),6) f1 FROM m")
def rms_norm(spark, d):
    return _rounded(ops.rms_norm(lattice(spark, d), [2, 1]).df)


# --- packed weights and entropy --------------------------------------------------------------

#: Integers 0 .. 15 in every group of 32, so that codes are the values themselves.
PACKED = np.array([[(a * 3 + b) % 16 for a in range(32)] for b in range(4)], np.float32)


@query("SELECT CAST(b.range AS INT) c_out, CAST(a.range AS INT) c_in, CAST((a.range*3+b.range)%16 AS DOUBLE) w FROM range(4) b, range(32) a")
def dequantize_weight_table(spark, d):
    w = dequantize_weight(quantize_weight(PACKED, 32, 4))
    return spark.createDataFrame([(b, a, float(w[b, a])) for b in range(4) for a in range(32)], "c_out int, c_in int, w double")


@query(f"WITH {LATTICE} SELECT {COLS}, " + ", ".join(f"f0*{b % 16}+f1*{(3 + b) % 16} f{b}" for b in range(4)) + " FROM vox")
def quantized_linear(spark, d):
    x = lattice(spark, d)
    wide = x.with_features([F.col("f0"), F.col("f1"), *[F.lit(0.0)] * 30])
    return ops.linear(wide, quantize_weight(PACKED, 32, 4)).df


@query(f"""WITH {LATTICE}, {_edges('vox')}, conv AS (SELECT out_row, {', '.join(f"sum(v.f0*((e.kernel_id+{3 * b})%16)+v.f1*((e.kernel_id+{3 * b + 5})%16)) c{b}" for b in range(4))} FROM edges e JOIN vox v ON v.row_id=in_row GROUP BY 1)
SELECT {COLS}, {', '.join(f"CAST(coalesce(c{b},0) AS DOUBLE) f{b}" for b in range(4))} FROM vox LEFT JOIN conv ON out_row=row_id""")
def quantized_conv3d(spark, d):
    """Weights 0 .. 15 in packed 4-bit words, in groups of 32 input channels of which 30 are zero."""
    x = lattice(spark, d)
    wide = x.with_features([F.col("f0"), F.col("f1"), *[F.lit(0.0)] * 30])
    w = np.array([[[(k + 5 * a + 3 * b) % 16 for b in range(4)] for a in range(32)] for k in range(27)], np.float32)
    return ops.subm_conv3d(wide, quantize_weight(w, 32, 4)).df


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """Per batch a stream of row symbols 0 .. 3 with probabilities that depend on the row."""
    x = lattice(spark, d)
    p = F.array(F.lit(0.5), F.when(F.col("row_id") % 2 == 0, 0.25).otherwise(0.125), F.lit(0.125), F.lit(0.125)).cast("array<float>")
    return x.df.select(F.col("batch").cast("long").alias("stream_id"), F.col("row_id").alias("row"), p.alias("prob"), F.pmod(F.col("x") * 3 + F.col("y"), F.lit(4)).cast("int").alias("symbol"))


CDF = """p AS (SELECT row_id, [0.5, CASE WHEN row_id%2=0 THEN 0.25 ELSE 0.125 END, 0.125] p FROM vox),
c AS (SELECT row_id, i, CASE WHEN i=0 THEN 0 WHEN i=4 THEN 65536 ELSE CAST(floor(list_sum(p[1:i])*65532+0.5) AS INT)+i END v FROM p, (SELECT CAST(range AS INT) i FROM range(5)))"""


@query(f"WITH {LATTICE}, {CDF} SELECT row_id AS \"row\", i \"column\", CAST(v AS INT) \"value\" FROM c")
def normalized_cdf(spark, d):
    return _streams(spark, d).select("row", F.posexplode(entropy.normalized_cdf(F.col("prob"))).alias("column", "value"))


def _round_trip(coder: str) -> Query:
    def run(spark, d):
        rows = _streams(spark, d)
        return entropy.decode_streams(rows, entropy.encode_streams(rows, coder), coder)

    return run


for _coder in ("range", "rans"):
    QUERIES[f"{_coder}_round_trip"] = _round_trip(_coder)
    ORACLES[f"{_coder}_round_trip"] = f"WITH {LATTICE} SELECT CAST(batch AS BIGINT) stream_id, row_id AS \"row\", CAST(((x*3+y)%4+4)%4 AS INT) symbol FROM vox"


# --- workloads -------------------------------------------------------------------------------


@query(f"""WITH {LATTICE}, {_edges('vox')}, c1 AS (SELECT out_row, {', '.join(f"sum(v.f0*{_w('e.kernel_id', 0, b)}+v.f1*{_w('e.kernel_id', 1, b)}) c{b}" for b in range(2))} FROM edges e JOIN vox v ON v.row_id=in_row GROUP BY 1),
h AS (SELECT row_id, batch, greatest(coalesce(c0,0)+0.5,0) f0, greatest(coalesce(c1,0)-0.25,0) f1 FROM vox LEFT JOIN c1 ON out_row=row_id),
g AS (SELECT batch, sum(f0) f0, sum(f1) f1 FROM h GROUP BY 1) SELECT CAST(range AS INT) batch, CAST(coalesce(f0,0) AS DOUBLE) f0, CAST(coalesce(f1,0) AS DOUBLE) f1 FROM range(8) LEFT JOIN g ON batch=range""")
def mini_encoder(spark, d):
    """Submanifold convolution, relu, global sum, as a graph run by the model runner."""
    g = GraphBuilder()
    x = g.input("x")
    y = g.call("subm_conv3d", x, {"weight": g.add_parameter("w", weights(27)), "bias": g.add_parameter("b", BIAS)})
    g.output(g.add_op("pool.global_sum", {"input": g.call("relu", y)}, output="pooled"))
    return LatticeModel(g.manifest(), g.parameters)(x=lattice(spark, d))["pooled"]


@query(f"""WITH {LATTICE}, {DOWN}, {_edges('down', 2, 2)}, c1 AS (SELECT out_row, {', '.join(f"sum(v.f0*{_w('e.kernel_id', 0, b)}+v.f1*{_w('e.kernel_id', 1, b)}) c{b}" for b in range(2))} FROM edges e JOIN vox v ON v.row_id=in_row GROUP BY 1)
SELECT {COLS}, CAST(greatest(coalesce(c0,0)+0.5,0) AS DOUBLE) f0, CAST(greatest(coalesce(c1,0)-0.25,0) AS DOUBLE) f1 FROM down LEFT JOIN c1 ON out_row=row_id""")
def downsample_block(spark, d):
    return ops.relu(ops.conv3d(lattice(spark, d), weights(8), BIAS, 2, 2)).df
