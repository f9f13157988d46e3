"""Points, grid cells and polygons. Points meet others by the numbers of cells; no operator compares all with all."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import segment_distance
from fieldmosaic.operators.sparse import settled


def cell_join(points: DataFrame, grid: DataFrame, step: float, px: str, py: str, gx: str, gy: str) -> DataFrame:
    """Points with the grid centres whose cell (half-open, upper edge in) holds them. The centres needn't lie on a lattice: a point looks in its own block of `step` and the eight around it, and the range is checked."""
    at = lambda c: F.floor(F.col(c) / F.lit(step))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.withColumn("__i", F.explode(F.transform(around, lambda d: at(px) + d))).withColumn("__j", F.explode(F.transform(around, lambda d: at(py) + d)))
    g = grid.withColumn("__i", at(gx)).withColumn("__j", at(gy))
    held = lambda c, d: (F.col(d) - F.lit(step / 2) < F.col(c)) & (F.col(c) <= F.col(d) + F.lit(step / 2))
    return p.join(g, ["__i", "__j"]).where(held(px, gx) & held(py, gy)).drop("__i", "__j")


#: Rows of one cell that a task compares with the points that ask for it; a cell with more is dealt into salts.
CELL_ROWS = 4096
#: Cells, of some tens of bytes each, up to which their salts are broadcast.
BROADCAST_ROWS = 100_000


def _levels(ends: DataFrame, cell: float) -> int:
    """How often cells double until one covers all places (x, y); four numbers pass through the driver."""
    r = ends.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return max(0, ceil(log2(max(r[0] or 0.0, r[1] or 0.0, cell) / cell))) + 1


def _at(c: Column, cell: float, level: Column) -> Column:
    return F.floor(c / (F.lit(float(cell)) * F.pow(F.lit(2.0), level)))


def _around(df: DataFrame, x: str, y: str, cell: float, level: Column) -> DataFrame:
    """Rows for the nine cells around each point at a level."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    held = df.withColumn("__l", level).withColumn("__i", F.explode(F.transform(near, lambda d: _at(F.col(x), cell, F.col("__l")) + d)))
    return held.withColumn("__j", F.explode(F.transform(near, lambda d: _at(F.col(y), cell, F.col("__l")) + d)))


def _level_of(bound: Column, cell: float, levels: int) -> Column:
    """The smallest size of cell of which nine cover all within a bound."""
    return F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(bound * 1.000001, F.lit(float(cell))) / F.lit(float(cell)))))).cast("int")


def _compared(asked: DataFrame, spread, keys: list[str]) -> DataFrame:
    """asked, points with the cells that they ask for, joined with the rows that spread(levels) puts in cells.

    Rows are only put in cells of the sizes that are asked for, only cells that are asked for are kept, and a cell with many rows is dealt into salts, to which
    its points go. So no key has more than about CELL_ROWS rows, even where one far point asks for a cell that holds the whole table.
    """
    asked = settled(asked)
    cells = asked.select(*keys).distinct()
    sizes = sorted(r[0] for r in cells.select("__l").distinct().collect())  # some tens of numbers at most
    rows = spread(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"))
    salts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("__n")).join(cells, keys, "left_semi")
    salts = settled(salts)
    known = F.broadcast(salts) if salts.count() <= BROADCAST_ROWS else salts  # else a join that Spark can split where a cell is hot
    held = rows.join(known, keys).withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.col("__n")).cast("int")).drop("__n")
    return asked.join(salts, keys).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n").join(held, [*keys, "__s"])


def _finer(others: DataFrame, cell: float) -> float:
    """The size of cells of which there are as many over the others' box as others, or `cell`, if that is less: so that a cell doesn't fill as tables grow; three numbers pass through the driver."""
    r = others.agg(F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy"), F.count(F.lit(1))).first()
    side = max(r[0] or 0.0, r[1] or 0.0)
    return min(float(cell), side / r[2] ** 0.5) if side > 0 else float(cell)


def nearest(points: DataFrame, others: DataFrame, cell: float, point_id: str = "pid", other_id: str = "gid", by: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, other_id, dist): the nearest of the others, ties to the smaller id; with `by`, of those that agree in these columns. Null where there is none.

    points has px, py, the others gx, gy; others in one place go as one. Cells of about one place each, of `cell` at most, double in size until one covers all. A point first
    meets one of the others in each cell around it, at every size, which bounds its distance; then it meets
    all of the others in the nine cells around it of the smallest size that covers that bound. Most points end at small cells.
    """
    held, others = settled(points.select(point_id, "px", "py", *by)), settled(others.groupBy("gx", "gy", *by).agg(F.min(other_id).alias(other_id)))
    cell = _finer(others, cell)
    levels = _levels(held.select(F.col("px").alias("x"), F.col("py").alias("y")).union(others.select("gx", "gy")), cell)
    put = lambda sizes: others.withColumn("__l", F.explode(sizes)).withColumn("__i", _at(F.col("gx"), cell, F.col("__l"))).withColumn("__j", _at(F.col("gy"), cell, F.col("__l")))
    keys = [*by, "__l", "__i", "__j"]
    d2 = (F.col("px") - F.col("gx")) ** 2 + (F.col("py") - F.col("gy")) ** 2
    every = F.sequence(F.lit(0), F.lit(levels))
    one = put(every).groupBy(*keys).agg(F.min(F.struct(F.col(other_id), "gx", "gy")).alias("o")).select(*keys, "o.gx", "o.gy")
    first = _around(held, "px", "py", cell, F.explode(every)).join(one, keys)
    bound = first.groupBy(point_id, "px", "py", *by).agg(F.min(d2).alias("b"))
    asked = _around(bound, "px", "py", cell, _level_of(F.sqrt("b"), cell, levels))
    found = _compared(asked, put, keys).groupBy(point_id).agg(F.min(F.struct(d2.alias("d2"), F.col(other_id).alias("g"))).alias("m"))
    return points.select(point_id).join(found, point_id, "left").select(point_id, F.col("m.g").alias(other_id), F.sqrt("m.d2").alias("dist"))


def crowded(points: DataFrame, places: DataFrame, step: float, point_id: str = "pid") -> DataFrame:
    """Points that several centres' cells hold for sure: their block of a fifth of a step and the eight around it, which lie within half a step, have two centres or more (gx, gy, n of each place). Others may have several too."""
    at = lambda c: F.floor(F.col(c) / F.lit(step / 5))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    blocks = places.groupBy(at("gx").alias("__i"), at("gy").alias("__j")).agg(F.sum("n").alias("n"))
    p = points.select(point_id, F.explode(F.transform(around, lambda d: at("px") + d)).alias("__i"), "py").select(point_id, "__i", F.explode(F.transform(around, lambda d: at("py") + d)).alias("__j"))
    return p.join(blocks, ["__i", "__j"]).groupBy(point_id).agg(F.sum("n").alias("n")).where("n > 1").select(point_id)


def cell_or_nearest(points: DataFrame, grid: DataFrame, step: float, point_id: str = "pid", grid_id: str = "gid", far: float = 10.0) -> DataFrame:
    """(point_id, grid_id, dist, exact, far): the one grid centre whose cell holds a point, or, where there isn't exactly one, the nearest centre; and whether it is further than `far`."""
    places = settled(grid.groupBy("gx", "gy").agg(F.min(grid_id).alias(grid_id), F.count(F.lit(1)).alias("n")))
    alone = points.join(crowded(points, places, step, point_id), point_id, "left_anti")
    met = cell_join(alone, places, step, "px", "py", "gx", "gy").withColumn("d", F.hypot(F.col("px") - F.col("gx"), F.col("py") - F.col("gy")))
    one = settled(met.groupBy(point_id).agg(F.sum("n").alias("n"), F.min(grid_id).alias("g"), F.min("d").alias("d")).where("n = 1"))
    exact = one.select(point_id, F.col("g").alias(grid_id), F.col("d").alias("dist"), F.lit(True).alias("exact"))
    rest = nearest(points.join(one, point_id, "left_anti"), grid, step, point_id, grid_id)
    return exact.unionByName(rest.withColumn("exact", F.lit(False))).withColumn("far", F.coalesce(F.col("dist") > far, F.lit(False)))


def in_polygons(points: DataFrame, edges: DataFrame, cell: float, holes: bool = False) -> DataFrame:
    """(pid, poly) for each polygon one of whose rings holds a point; with `holes`, an odd number of them, so that a ring within a ring is a hole.

    points: pid, x, y. edges: poly, ring, x1, y1, x2, y2. Points meet rings by the cells of the rings' boxes, then only the ring's edges
    in the point's band of y, and the crossings of a ray along x are counted for each ring.
    """
    at = lambda c: F.floor(c / F.lit(float(cell)))
    box = edges.groupBy("poly", "ring").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    cells = box.withColumn("__i", F.explode(F.sequence(at(F.col("a")), at(F.col("b"))))).withColumn("__j", F.explode(F.sequence(at(F.col("c")), at(F.col("d")))))
    met = points.withColumn("__i", at(F.col("x"))).withColumn("__j", at(F.col("y"))).join(cells, ["__i", "__j"]).where("x BETWEEN a AND b AND y BETWEEN c AND d")
    bands = edges.where("y1 <> y2").withColumn("__j", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = met.select("pid", "x", "y", "poly", "ring", "__j").join(bands, ["poly", "ring", "__j"]).where(cross).groupBy("pid", "poly", "ring").agg(F.count(F.lit(1)).alias("n"))
    held = hits.where("n % 2 = 1")
    return held.groupBy("pid", "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("pid", "poly") if holes else held.select("pid", "poly").distinct()


def point_in_polygon(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """The smallest polygon id that holds each point (null outside all) and in how many it lies (n_poly). Edges without a column `ring` are one ring each polygon."""
    held = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    hits = in_polygons(points, held, cell).groupBy("pid").agg(F.min("poly").alias("poly"), F.count(F.lit(1)).alias("n_poly"))
    return points.select("pid").join(hits, "pid", "left").withColumn("n_poly", F.coalesce("n_poly", F.lit(0).cast("long")))


def within(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """The points that some polygon holds."""
    held = edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0))
    return points.join(in_polygons(points, held, cell), "pid", "left_semi")


def nearest_edge(points: DataFrame, edges: DataFrame, cell: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(pid, poly, dist): the polygon, or polyline, whose edge is nearest to each point, ties to the smaller id; with `by`, of those that agree in these columns.

    The nearest corner bounds the distance; then a point meets the edges whose boxes touch the nine cells around it of the smallest
    size that covers the bound.
    """
    points, edges = settled(points.select("pid", "x", "y", *by)), settled(edges.select("poly", *by, "x1", "y1", "x2", "y2"))
    corners = edges.select("poly", *by, F.col("x1").alias("gx"), F.col("y1").alias("gy")).union(edges.select("poly", *by, F.col("x2"), F.col("y2"))).distinct()
    levels = _levels(points.select("x", "y").union(corners.select("gx", "gy")), cell)
    p = points.select("pid", F.col("x").alias("px"), F.col("y").alias("py"), *by)
    bound = nearest(p, corners, cell, "pid", "poly", by).where("dist IS NOT NULL").select("pid", "dist")
    asked = _around(p.join(bound, "pid"), "px", "py", cell, _level_of(F.col("dist"), cell, levels))

    def put(sizes: Column) -> DataFrame:
        each = edges.withColumn("__l", F.explode(sizes))
        for name, a, b in (("__i", "x1", "x2"), ("__j", "y1", "y2")):
            each = each.withColumn(name, F.explode(F.sequence(_at(F.least(a, b), cell, F.col("__l")), _at(F.greatest(a, b), cell, F.col("__l")))))
        return each

    d = segment_distance(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")])
    found = _compared(asked, put, [*by, "__l", "__i", "__j"]).groupBy("pid").agg(F.min(F.struct(d.alias("d"), "poly")).alias("m"))
    return points.select("pid").join(found, "pid", "left").select("pid", "m.poly", F.col("m.d").alias("dist"))


def polygon_or_nearest(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(pid, poly, dist): the smallest polygon that holds a point, at distance 0, or the one with the nearest edge."""
    inside = point_in_polygon(points, edges, cell).where("poly IS NOT NULL").select("pid", "poly", F.lit(0.0).alias("dist"))
    return inside.unionByName(nearest_edge(points.join(inside, "pid", "left_anti"), edges, cell))


def polygon_within_parent(points: DataFrame, edges: DataFrame, cell: float, parent: str, far: float = 0.2) -> DataFrame:
    """(pid, poly, dist, far): the polygon that holds a point if it belongs to the point's own parent; otherwise the nearest of that parent's polygons, and whether it is further than `far`."""
    of = edges.select("poly", parent).distinct()
    hits = in_polygons(points, edges if "ring" in edges.columns else edges.withColumn("ring", F.lit(0)), cell).join(of, "poly")
    own = points.select("pid", parent).join(hits, ["pid", parent]).groupBy("pid").agg(F.min("poly").alias("poly")).withColumn("dist", F.lit(0.0))
    rest = nearest_edge(points.join(own, "pid", "left_anti"), edges, cell, (parent,))
    return own.unionByName(rest).withColumn("far", F.coalesce(F.col("dist") > far, F.lit(False)))
