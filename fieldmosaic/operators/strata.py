"""Integration points for strata: lattices refined until they have enough points, and weighted medoids of them. All strata go through each round together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import ratio
from fieldmosaic.operators.aggregate import calibrate
from fieldmosaic.operators.sparse import settled
from fieldmosaic.operators.spatial import cell_join, in_polygons, nearest


def _lattice(open_: DataFrame, boxes: DataFrame) -> DataFrame:
    """The lattice points of each stratum's box, from its lower left corner in its own step."""
    held = open_.join(boxes, "stratum")
    steps = lambda a, b: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(b) - F.col(a)) / F.col("step")).cast("long")))
    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.withColumn("i", steps("x0", "x1")).repartition(n, "stratum", "urban", "i").withColumn("j", steps("y0", "y1"))
    return held.select("stratum", "urban", "step", "i", "j", (F.col("x0") + F.col("i") * F.col("step")).alias("px"), (F.col("y0") + F.col("j") * F.col("step")).alias("py"))


def _on_pixels(points: DataFrame, edges: DataFrame, pixels: DataFrame, size: float) -> DataFrame:
    """Points inside their stratum, with its one pixel whose cell holds them, else its nearest; only those whose pixel is of the wanted kind, populated and complete."""
    pid = F.struct("stratum", "urban", "i", "j")
    held = points.withColumn("pid", pid)
    inside = in_polygons(held.select("pid", F.col("px").alias("x"), F.col("py").alias("y")), edges, size * 4).where("pid.stratum = poly").select("pid")
    held = settled(held.join(inside, "pid"))
    cells = pixels.select("pixel", F.col("stratum").alias("own"), F.col("east").alias("gx"), F.col("north").alias("gy"))
    met = cell_join(held, cells, size, "px", "py", "gx", "gy").where("own = stratum")
    one = met.groupBy("pid").agg(F.min("pixel").alias("pixel"), F.count(F.lit(1)).alias("n")).where("n = 1").select("pid", "pixel")
    far = nearest(held.join(one, "pid", "left_anti"), cells.withColumnRenamed("own", "stratum"), size, "pid", "pixel", ("stratum",)).where("pixel IS NOT NULL").select("pid", "pixel")
    named = held.join(one.unionByName(far), "pid").drop("pid")
    return named.join(pixels.where("pop > 0 AND complete").select("pixel", "urban", "subarea", "pop"), ["pixel", "urban"])


def fine_grid(edges: DataFrame, pixels: DataFrame, size: float, start: float, least: int, most: int, rounds: int = 40) -> DataFrame:
    """(stratum, urban, step, x, y, pixel, subarea, pop): lattice points of each stratum and kind, `least` to `most` of them.

    edges are the strata's outlines (poly, ring, x1, y1, x2, y2). pixels (pixel, stratum, subarea, urban, east, north, pop, complete) are centres of cells of a size;
    complete says whether their covariates are there. Steps begin at `start`: strata with too few points halve theirs, those with too many
    lengthen it by a tenth, and those within the bounds leave the rounds, which only count. Points of the other
    kind, without people or incomplete, don't count. At the end `pop` is the pixel's population, scaled to the sum of the pixels over each subarea and kind.
    A stratum without any pixel of a kind that could count has no rows of it. Raises if bounds aren't met after the rounds.
    """
    pixels = settled(pixels)
    edges = settled(edges)
    boxes = edges.groupBy(F.col("poly").alias("stratum")).agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1"))
    state = settled(pixels.where("pop > 0 AND complete").select("stratum", "urban").distinct().join(boxes.select("stratum"), "stratum").withColumns({"step": F.lit(float(start)), "open": F.lit(True)}))
    for _ in range(rounds):
        left = state.where("open").drop("open")
        if left.isEmpty():
            break
        counts = _on_pixels(_lattice(left, boxes), edges, pixels, size).groupBy("stratum", "urban").agg(F.count(F.lit(1)).alias("n"))
        seen = left.join(counts, ["stratum", "urban"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        step = F.when(F.col("n") < least, F.col("step") / 2).when(F.col("n") > most, F.col("step") * 1.1).otherwise(F.col("step"))
        state = settled(state.where("NOT open").unionByName(seen.select("stratum", "urban", step.alias("step"), ((F.col("n") < least) | (F.col("n") > most)).alias("open"))))
    else:
        raise ArithmeticError(f"grids aren't within {least} to {most} points after {rounds} rounds")
    points = _on_pixels(_lattice(state.drop("open"), boxes), edges, pixels, size)
    totals = pixels.groupBy("stratum", "subarea", "urban").agg(F.sum("pop").alias("target"))
    by = ["stratum", "subarea", "urban"]
    scaled = calibrate(points.join(totals, by), by, "pop", "target")
    return scaled.select("stratum", "urban", "step", F.col("px").alias("x"), F.col("py").alias("y"), "pixel", "subarea", F.col("calibrated").alias("pop"))


def _square(columns: tuple[str, ...], a: str, b: str) -> Column:
    return reduce(lambda s, c: s + (F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2, columns, F.lit(0.0))


def _assigned(points: DataFrame, medoids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each point's nearest medoid m, its squared distance d1, and that of the second nearest, d2 (infinite where there is one medoid)."""
    lists = medoids.groupBy("stratum").agg(F.collect_list(F.struct(F.col("id").alias("m"), *columns)).alias("medoids"))
    far = lambda m: reduce(lambda s, c: s + (F.col(c) - m[c]) * (F.col(c) - m[c]), columns, F.lit(0.0))
    held = points.join(lists, "stratum").withColumn("near", F.array_sort(F.transform("medoids", lambda m: F.struct(far(m).alias("d"), m["m"].alias("m")))))
    return held.withColumns({"m": F.col("near")[0]["m"], "d1": F.col("near")[0]["d"], "d2": F.coalesce(F.get("near", F.lit(1))["d"], F.lit(float("inf")))}).drop("medoids", "near")


def _first(places: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The place o of each stratum and start that lowers the sum most alone, or second most, ... by the start's number.

    Sums of weights times squared distances from a place grow with its squared distance from the weighted mean; of the places that this
    leaves equal to rounding, the sums themselves decide, then the smaller id.
    """
    by = Window.partitionBy("stratum")
    means = places.groupBy("stratum").agg(F.sum("weight").alias("all"), *[ratio(F.sum(F.col("weight") * F.col(c)), F.sum("weight")).alias(f"p_{c}") for c in columns])
    held = places.join(means, "stratum").withColumn("form", F.coalesce(F.col("all") * _square(columns, "", "p_"), F.lit(0.0)))
    held = held.withColumn("slack", 1e-9 * F.sum(F.coalesce(F.col("weight") * _square(columns, "", "p_"), F.lit(0.0))).over(by))
    held = held.withColumns({"rank": F.row_number().over(by.orderBy("form", "id")), "place": F.least(F.col("stratum.start"), F.count(F.lit(1)).over(by))})
    limit = held.where("rank = place").select("stratum", (F.col("form") + F.col("slack")).alias("limit"))
    sure = held.join(limit, "stratum").where("form <= limit").select("stratum", "place", F.col("id").alias("o"), *[F.col(c).alias(f"o_{c}") for c in columns])
    sums = places.join(sure, "stratum").groupBy("stratum", "place", "o").agg(F.sum(F.col("weight") * _square(columns, "", "o_")).alias("cost"))
    return sums.withColumn("rank", F.row_number().over(by.orderBy("cost", "o"))).where("rank = place").select("stratum", "o")


def _cells(open_: DataFrame, columns: tuple[str, ...], level: int, few: int) -> DataFrame:
    """Candidates with their cell: of a lattice of 2^level cells a column over each stratum's open candidates, or one for each candidate, where `few` or fewer are open."""
    ends = open_.groupBy("stratum").agg(F.count(F.lit(1)).alias("left"), *[g(c).alias(f"{n}_{c}") for c in columns for n, g in (("lo", F.min), ("hi", F.max))])
    at = [F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 2**level), F.lit(2**level - 1)) for c in columns]
    held = open_.join(ends, "stratum").withColumn("cell", F.struct(F.when(F.col("left") <= few, F.col("id")).alias("id"), *[F.when(F.col("left") > few, F.coalesce(x, F.lit(0))).alias(f"c{n}") for n, x in enumerate(at)]))
    return held.select("stratum", "cell", "id", *columns)


def _exchange(held: DataFrame, candidates: DataFrame, columns: tuple[str, ...], few: int, leave: bool) -> DataFrame:
    """(stratum, o, m, change): the candidate o of each stratum whose entry lowers the sum most; with `leave`, in exchange for the medoid m, and none where no exchange lowers it.

    held: points with their nearest medoid m and the squared distances d1, d2 of the two nearest. Candidates are searched by cells: no place in a cell's box is nearer to a point than the box is,
    which bounds what the cell's candidates can change; one of them shows what can be had. Cells that can't reach the best so far are left,
    the others are parted into smaller ones, until candidates stand alone. So a round meets points with cells, and only near the best with single candidates.
    """
    square = lambda xs: reduce(lambda s, x: s + x * x, xs, F.lit(0.0))
    rates = held.groupBy("stratum").agg((-1e-12 * F.sum(F.col("weight") * F.col("d1"))).alias("least"))
    points, open_, level = held.select("stratum", "weight", "m", "d1", "d2", *columns), candidates.select("stratum", "id", *columns), 3
    while True:
        dealt = settled(_cells(open_, columns, level, few if level < 40 else 2**62))  # no lattice parts places closer than that
        boxes = settled(dealt.groupBy("stratum", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", *columns)).alias("o"), *[g(c).alias(f"{n}_{c}") for c in columns for n, g in (("lo", F.min), ("hi", F.max))]))
        met = points.join(boxes, "stratum").withColumns({
            "low": square([F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in columns]),
            "at": square([F.col(c) - F.col(f"o.{c}") for c in columns])})
        near = [F.sum(F.col("weight") * (F.least(d, "d1") - F.col("d1"))).alias(f"near_{d}") for d in ("low", "at")]
        back = [F.sum(F.col("weight") * (F.least(d, "d2") - F.least(d, "d1"))).alias(f"back_{d}") for d in ("low", "at")]
        sums = met.groupBy("stratum", "cell", "m").agg(*near, *back)
        fall = [F.sum(f"near_{d}") + (F.min(f"back_{d}") if leave else F.lit(0.0)) for d in ("low", "at")]
        sums = sums.groupBy("stratum", "cell").agg(fall[0].alias("low"), fall[1].alias("at"), F.min(F.struct("back_at", "m"))["m"].alias("m"))
        bounds = sums.join(boxes.select("stratum", "cell", "n", F.col("o.id").alias("o")), ["stratum", "cell"]).join(rates, "stratum")
        bounds = settled(bounds.where(F.col("low") < F.col("least") if leave else F.lit(True)))
        tops = bounds.groupBy("stratum").agg(F.min("at").alias("top"))
        kept = bounds.join(tops, "stratum").where(F.col("low") <= F.col("top") + 1e-9 * F.abs("top"))
        if kept.where("n > 1").isEmpty():
            best = kept.groupBy("stratum").agg(F.min(F.struct(F.col("at").alias("change"), "o", "m")).alias("b"), F.first("least").alias("least"))
            return best.where(F.col("b.change") < F.col("least") if leave else F.lit(True)).select("stratum", "b.o", "b.m", "b.change")
        open_, level = dealt.join(kept.select("stratum", "cell"), ["stratum", "cell"], "left_semi").select("stratum", "id", *columns), level + 2


def medoids(points: DataFrame, columns: tuple[str, ...], k: int, rounds: int = 100, block_rows: int = 512, starts: int = 1) -> DataFrame:
    """(stratum, id, m, weight, share): each point's medoid of its stratum, and the medoid's share of the stratum's weight. points: stratum, id, weight, and the columns.

    k medoids (all points, if there are fewer) with a small sum of weights times squared distances: built one by one, each the point that lowers the sum most, then
    exchanged for other points while that lowers it, at each round the best exchange of every stratum. Points in one place go as one, and a round's best exchange is searched by cells;
    `block_rows` candidates of a stratum, or fewer, are compared one by one. The sum never rises, and in the end no exchange lowers it; with several starts, whose
    first medoids are the best, second best ... single ones, the best end counts. Ties go to smaller ids. Null or negative weights
    count as 0, points with a null among the columns are left out. The share is null where a stratum's weights are all 0.
    """
    complete = reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.lit(True))
    points = settled(points.where(complete).select("stratum", "id", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).cast("double").alias("weight"), *[F.col(c).cast("double").alias(c) for c in columns]))
    places = points.groupBy("stratum", *columns).agg(F.min("id").alias("id"), F.sum("weight").alias("weight"))
    places = settled(places.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts)))).withColumn("stratum", F.struct("stratum", "start")).drop("start"))
    tasks = points.sparkSession.sparkContext.defaultParallelism
    chosen = held = None
    for turn in range(k):
        best = _first(places, columns) if turn == 0 else _exchange(held, held.join(chosen, ["stratum", "id"], "left_anti"), columns, block_rows, False)
        new = best.select("stratum", F.col("o").alias("id"))
        chosen = settled(new if turn == 0 else chosen.unionByName(new))
        held = settled(_assigned(places, places.join(chosen, ["stratum", "id"]), columns).repartition(tasks))  # rounds meet all points with few cells: in all tasks
    moved = held.select("stratum").distinct()
    for _ in range(rounds if k > 1 else 0):  # the first medoid is the best single one
        now = held.join(moved, "stratum", "left_semi")
        best = settled(_exchange(now, now.join(chosen, ["stratum", "id"], "left_anti"), columns, block_rows, True))
        if best.isEmpty():
            break
        kept = chosen.join(best.select("stratum", F.col("m").alias("id")), ["stratum", "id"], "left_anti")
        chosen = settled(kept.unionByName(best.select("stratum", F.col("o").alias("id"))))
        held = settled(_assigned(places, places.join(chosen, ["stratum", "id"]), columns).repartition(tasks))  # rounds meet all points with few cells: in all tasks
        moved = best.select("stratum")
    ends = held.groupBy("stratum").agg(F.sum(F.col("weight") * F.col("d1")).alias("cost"))
    won = ends.groupBy(F.col("stratum.stratum").alias("name")).agg(F.min_by("stratum", F.struct(F.round("cost", 12), F.col("stratum.start"))).alias("stratum")).select("stratum")
    last = places.join(chosen, ["stratum", "id"]).join(won, "stratum", "left_semi").withColumn("stratum", F.col("stratum.stratum"))
    held = _assigned(points, last, columns).select("stratum", "id", "m", "weight")
    sums = held.groupBy("stratum", "m").agg(F.sum("weight").alias("w")).withColumn("share", ratio(F.col("w"), F.sum("w").over(Window.partitionBy("stratum"))))
    return held.join(sums.select("stratum", "m", "share"), ["stratum", "m"]).select("stratum", "id", "m", "weight", "share")


def integration_points(points: DataFrame, columns: tuple[str, ...], k: int) -> DataFrame:
    """(stratum, urban, k, id, w, columns) of every stratum and kind: the medoids of its points, weighted by the shares of population, numbered by id; fewer than k are filled up with points of weight 0.

    points: stratum, urban, id, weight, columns. A stratum without points of a kind has k of weight 0 in its own other points' place, so that every stratum has both kinds.
    """
    both = points.withColumn("stratum", F.struct("stratum", "urban"))
    found = medoids(both, columns, k).where("id = m").select("stratum.stratum", "stratum.urban", "id", F.col("share").alias("w"))
    place = F.row_number().over(Window.partitionBy("stratum", "urban").orderBy("id")) - 1
    held = found.withColumn("k", place).join(points.select("stratum", "urban", "id", *columns), ["stratum", "urban", "id"])
    frame = points.select("stratum").distinct().withColumn("urban", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    spare = held.groupBy("stratum").agg(F.min(F.struct("id", *columns)).alias("spare"))
    full = frame.join(held, ["stratum", "urban", "k"], "left").join(spare, "stratum")
    return full.select("stratum", "urban", "k", F.coalesce("id", "spare.id").alias("id"), F.coalesce("w", F.lit(0.0)).alias("w"), *[F.coalesce(c, f"spare.{c}").alias(c) for c in columns])
