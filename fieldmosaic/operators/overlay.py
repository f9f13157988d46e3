"""Intersections of polygons that are tables of edges (poly, ring, x1, y1, x2, y2), of any shape, with holes and parts, whichever way their rings run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.operators.sparse import settled
from fieldmosaic.operators.spatial import in_polygons

ENDS = ("x1", "y1", "x2", "y2")
#: What counts as one place, as a part of the unit, and how far beside a piece its two sides are looked at, as a part of its length.
SAME, BESIDE = 1e-9, 1e-6


def _boxes(edges: DataFrame, name: str) -> DataFrame:
    ends = {f"{name}{k}{s}": f(g(f"{s}1", f"{s}2")) for s in "xy" for k, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))}
    return edges.groupBy(F.col("poly").alias(name)).agg(*[c.alias(n) for n, c in ends.items()])


def _cells(df: DataFrame, cell: float, *boxes: tuple[str, Column, Column]) -> DataFrame:
    """A row for each cell that a box touches."""
    for name, lo, hi in boxes:
        df = df.withColumn(name, F.explode(F.sequence(F.floor(lo / F.lit(float(cell))), F.floor(hi / F.lit(float(cell))))))
    return df


def _cuts(segments: DataFrame, cell: float) -> DataFrame:
    """(poly, other, side, edge, t) where an edge of one side of a pair meets one of the other: at crossings, touching ends, and the ends of stretches they share. Edges meet by the cells of their boxes."""
    box = [(n, F.least(f"{s}1", f"{s}2") - SAME, F.greatest(f"{s}1", f"{s}2") + SAME) for n, s in (("__i", "x"), ("__j", "y"))]
    held = _cells(segments.where("side = 0"), cell, *box)
    others = _cells(segments.where("side = 1"), cell, *box)
    b = others.select("poly", "other", "__i", "__j", F.col("edge").alias("o"), *[F.col(c).alias(f"b{c}") for c in ENDS])
    met = held.join(b, ["poly", "other", "__i", "__j"]).dropDuplicates(["poly", "other", "edge", "o"])
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    dx, dy = F.col("bx1") - F.col("x1"), F.col("by1") - F.col("y1")
    den = ax * by - ay * bx
    along = F.when(F.abs(den) > 1e-14 * F.hypot(ax, ay) * F.hypot(bx, by), den)
    met = met.withColumns({"t": (dx * by - dy * bx) / along, "u": (dx * ay - dy * ax) / along})

    def on(px: Column, py: Column, x: str, y: str, vx: Column, vy: Column) -> Column:
        """Where a point lies along an edge, if it lies on it."""
        at = ((px - F.col(x)) * vx + (py - F.col(y)) * vy) / (vx * vx + vy * vy)
        return F.when(F.abs((px - F.col(x)) * vy - (py - F.col(y)) * vx) <= SAME * F.hypot(vx, vy), at)

    crossing = F.col("t").between(0, 1) & F.col("u").between(0, 1)
    own = F.array(F.when(crossing, F.col("t")), *[on(F.col(f"bx{k}"), F.col(f"by{k}"), "x1", "y1", ax, ay) for k in (1, 2)])
    theirs = F.array(F.when(crossing, F.col("u")), *[on(F.col(f"x{k}"), F.col(f"y{k}"), "bx1", "by1", bx, by) for k in (1, 2)])
    both = [met.select("poly", "other", F.lit(s).alias("side"), F.col(e).alias("edge"), F.explode(ts).alias("t")) for s, e, ts in ((0, "edge", own), (1, "o", theirs))]
    return both[0].unionByName(both[1]).where("t > 0 AND t < 1")


def _pieces(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Edges cut at their places, each piece with a number within its edge."""
    keys = ["poly", "other", "side", "edge"]
    held = segments.join(cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("ts")), keys, "left")
    places = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    held = held.withColumn("ts", places).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("ts") - 2)))
    a, b = F.get("ts", F.col("k")), F.get("ts", F.col("k") + 1)
    at = lambda t, s: F.col(f"{s}1") + t * (F.col(f"{s}2") - F.col(f"{s}1"))
    ends = [at(t, s).alias(f"{s}{n}") for n, t in ((1, a), (2, b)) for s in "xy"]
    return held.select("poly", "other", "side", "edge", "k", *ends).where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > SAME)


def intersection(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(poly, other, x1, y1, x2, y2): the edges of the common part of each polygon of a (poly) and of b (other), its inside to their left; pairs without one have no rows.

    The boundary of the common part is made of the pieces of both boundaries, cut where they meet, that have the common part on one side only. So edges
    in common, holes, parts and the direction of rings need no rules of their own, and no ring is put together. Polygons meet
    by the cells of their boxes, edges of a pair by their own, and only edges in the other polygon's box are looked at.
    """
    a, b = (df.select("poly", *([F.col("ring")] if "ring" in df.columns else [F.lit(0).alias("ring")]), *[F.col(c).cast("double").alias(c) for c in ENDS]) for df in (a, b))
    cells = [_cells(_boxes(df, n), cell, *[(f"__{s}", F.col(f"{n}lo{s}"), F.col(f"{n}hi{s}")) for s in "xy"]) for df, n in ((a, "p"), (b, "o"))]
    pairs = cells[0].join(cells[1], ["__x", "__y"]).where("plox <= ohix AND olox <= phix AND ploy <= ohiy AND oloy <= phiy").drop("__x", "__y").distinct()
    inside = lambda n: " AND ".join(f"least({s}1, {s}2) <= {n}hi{s} AND greatest({s}1, {s}2) >= {n}lo{s}" for s in "xy")
    edge = F.struct(*ENDS, "ring").alias("edge")
    mine = pairs.join(a, F.col("p") == F.col("poly")).where(inside("o")).select("poly", F.col("o").alias("other"), F.lit(0).alias("side"), edge, *ENDS)
    theirs = pairs.join(b, F.col("o") == F.col("poly")).where(inside("p")).select(F.col("p").alias("poly"), F.col("o").alias("other"), F.lit(1).alias("side"), edge, *ENDS)
    segments = mine.unionByName(theirs)
    pieces = settled(_pieces(segments, _cuts(segments, cell)))  # three joins read them
    key = F.struct("poly", "other", "side", "edge", "k")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [F.struct(F.lit(left).alias("left"), ((F.col("x1") + F.col("x2")) / 2 - f * dy).alias("x"), ((F.col("y1") + F.col("y2")) / 2 + f * dx).alias("y")) for left, f in ((True, BESIDE), (False, -BESIDE))]
    looked = pieces.select(key.alias("piece"), F.inline(F.array(*sides))).withColumn("pid", F.struct("piece", "left"))
    held = [in_polygons(looked.select("pid", "x", "y"), edges, cell, holes=True).where(f"poly = pid.piece.{own}").select("pid") for edges, own in ((a, "poly"), (b, "other"))]
    common = held[0].join(held[1], "pid").select("pid.piece", F.col("pid.left").alias("left"))
    one = common.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left")).where("n = 1")
    kept = pieces.withColumn("piece", key).join(one, "piece")
    turned = [F.when(F.col("left"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in zip(ENDS, ("x2", "y2", "x1", "y1"), strict=True)]
    return kept.select("poly", "other", *turned).withColumns({f"__{c}": F.round(c, 8) for c in ENDS}).dropDuplicates(["poly", "other", *[f"__{c}" for c in ENDS]]).drop(*[f"__{c}" for c in ENDS])


def common_areas(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(poly, other, area) of the common parts."""
    return intersection(a, b, cell).groupBy("poly", "other").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
