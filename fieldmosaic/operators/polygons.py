"""Polygons as tables of edges (poly, x1, y1, x2, y2): neighbours, outlines of unions, areas, and a precision structure over them."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmosaic.operators import sparse


def _undirected(edges: DataFrame) -> DataFrame:
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return edges.withColumn("a", F.least(p, q)).withColumn("b", F.greatest(p, q))


def neighbours(edges: DataFrame, queen: bool = True) -> DataFrame:
    """(src, dst) of polygons that share a corner, both ways round; without `queen`, of those that share an edge."""
    e = _undirected(edges)
    e = e.select(F.explode(F.array("a", "b")).alias("a"), "poly").distinct() if queen else e.select("a", "b", "poly").distinct()
    pairs = e.join(e.withColumnRenamed("poly", "other"), ["a"] if queen else ["a", "b"]).where("poly <> other")
    return pairs.select(F.col("poly").alias("src"), F.col("other").alias("dst")).distinct()


def outline(edges: DataFrame, parent: str) -> DataFrame:
    """The edges of each parent's union: those that only one of its polygons has."""
    return _undirected(edges).groupBy(parent, "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(parent, "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def areas(edges: DataFrame) -> DataFrame:
    """Area of each polygon from its directed edges."""
    return edges.groupBy("poly").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))


def precision(links: DataFrame, scaled: bool = False) -> DataFrame:
    """(i, j, q) of an intrinsic autoregression: the number of neighbours on the diagonal, -1 for each link. `scaled`: so that the geometric mean of the marginal variances, under a sum of zero, is 1 for each component."""
    diagonal = links.groupBy(F.col("src").alias("i")).agg(F.count(F.lit(1)).alias("q")).select("i", F.col("i").alias("j"), "q")
    q = diagonal.unionByName(links.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1).cast("long").alias("q")))
    return sparse.scaled(q) if scaled else q


def shapes(edges: DataFrame) -> DataFrame:
    """(poly, area, cx, cy, radius) of each polygon's largest ring: its centroid and the radius of a circle of its area. edges has ring."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    r = edges.groupBy("poly", "ring").agg(F.sum(cross).alias("s"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"))
    big = r.groupBy("poly").agg(F.max_by(F.struct("s", "sx", "sy"), F.abs("s")).alias("m")).select("poly", "m.*").where("s <> 0")
    area = F.abs("s") / 2
    return big.select("poly", area.alias("area"), (F.col("sx") / (3 * F.col("s"))).alias("cx"), (F.col("sy") / (3 * F.col("s"))).alias("cy"), F.sqrt(area / F.lit(3.141592653589793)).alias("radius"))


def _largest_ring(edges: DataFrame) -> DataFrame:
    """The edges of each polygon's ring of largest area."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    big = edges.groupBy("poly", "ring").agg(F.abs(F.sum(cross)).alias("s")).groupBy("poly").agg(F.max_by("ring", F.struct("s", -F.col("ring"))).alias("ring"))
    return edges.join(big, ["poly", "ring"])


def radii(edges: DataFrame, directions: int = 32) -> DataFrame:
    """(poly, radius, mean_radius) of each polygon's largest ring: half the distance of its two corners that are farthest apart, and the mean distance of its corners from its centroid. edges has ring, a number.

    Corners farthest out in some directions give a distance that the largest one reaches at least. How far any corner is from a given one is bounded by
    those farthest out, so only corners whose bound reaches that distance are compared with each other.
    """
    ring = _largest_ring(edges)
    p = ring.select("poly", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
    turns = [(cos(2 * pi * k / directions), sin(2 * pi * k / directions)) for k in range(directions)]
    out = lambda c, s: F.col("x") * F.lit(c) + F.col("y") * F.lit(s)
    ends = p.groupBy("poly").agg(F.array(*[F.max(out(c, s)) for c, s in turns]).alias("h"), F.array_distinct(F.array(*[F.max_by(F.struct("x", "y"), out(c, s)) for c, s in turns])).alias("e"))
    some = F.transform("e", lambda a: F.array_max(F.transform("e", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))))
    ends = ends.select("poly", "h", F.array_max(some).alias("least"))
    reach = F.greatest(*[F.col("h")[k] - out(c, s) for k, (c, s) in enumerate(turns)]) / F.lit(cos(pi / directions))
    far = p.join(ends, "poly").where(reach >= F.col("least") * (1 - 1e-12)).select("poly", "x", "y")
    other = far.select("poly", F.col("x").alias("u"), F.col("y").alias("v"))
    widest = far.join(other, "poly").groupBy("poly").agg((F.max(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))) / 2).alias("radius"))
    centre = shapes(ring).select("poly", "cx", "cy")
    mean = ring.join(centre, "poly").groupBy("poly").agg(F.avg(F.hypot(F.col("x1") - F.col("cx"), F.col("y1") - F.col("cy"))).alias("mean_radius"))
    return widest.join(mean, "poly")
