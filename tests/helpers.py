"""Small lattices from literals, and a plain-Python model of relations to hold results against."""

from gridstone.frame import LatticeFrame


def coords(spark, rows):
    """Rows of (batch, x, y, z), numbered in order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, batch int, x int, y int, z int")


def frame(spark, rows, feats, stride=1, **known):
    n = len(feats[0]) if feats else 1
    kinds = ", ".join(["row_id long, batch int, x int, y int, z int", *(f"f{i} double" for i in range(n))])
    df = spark.createDataFrame([(i, *r, *map(float, f)) for i, (r, f) in enumerate(zip(rows, feats, strict=True))], kinds)
    return LatticeFrame.of(df, stride, **known)


def line(spark, n=3, feats=None):
    return frame(spark, [(0, x, 0, 0) for x in range(n)], feats or [[x + 1] for x in range(n)])


def table(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def xs(df):
    return [r["x"] for r in sorted(df.collect(), key=lambda r: r["row_id"])]


def feats(x):
    return [tuple(r[c] for c in x.names) for r in sorted(x.df.collect(), key=lambda r: r["row_id"])]


def first_rows(rows):
    seen = {}
    for i, r in enumerate(rows):
        seen.setdefault(r, i)
    return seen


def model_edges(source, out, offsets, stride, padding):
    """Edges of a relation by dictionary lookup."""
    seen = first_rows(source)
    edges = []
    for o, (b, *p) in enumerate(out):
        for k, d in enumerate(offsets):
            place = (b, *(p[i] * stride[i] + d[i] - padding[i] for i in range(3)))
            if place in seen:
                edges.append((seen[place], o, k))
    return sorted(edges)
