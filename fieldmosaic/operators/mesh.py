"""Finite elements on a table of triangles: mass, stiffness and precision, and the projection of points on it. Nodes: node, x, y; triangles: tri, a, b, c, the nodes at their corners."""

from __future__ import annotations

from math import exp, log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.operators.sparse import product


def corners(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners and twice their signed area; flat ones and those with a missing node are left out."""
    held = triangles
    for c in "abc":
        held = held.join(nodes.select(F.col("node").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)
    cross = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    return held.withColumn("cross", cross).where("cross <> 0")


def finite_elements(nodes: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, q) of the lumped mass matrix, a third of the areas around each node on the diagonal, and of the stiffness matrix of linear elements."""
    t = corners(nodes, triangles)
    mass = t.select(F.explode(F.array("a", "b", "c")).alias("i"), (F.abs("cross") / 6).alias("q")).groupBy("i").agg(F.sum("q").alias("q")).select("i", F.col("i").alias("j"), "q")
    opposite = {"a": ("b", "c"), "b": ("c", "a"), "c": ("a", "b")}
    edge = {k: tuple(F.col(f"{v}{s}") - F.col(f"{u}{s}") for s in "xy") for k, (u, v) in opposite.items()}
    entries = [F.struct(F.col(m).alias("i"), F.col(n).alias("j"), ((edge[m][0] * edge[n][0] + edge[m][1] * edge[n][1]) / (2 * F.abs("cross"))).alias("q")) for m in "abc" for n in "abc"]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows of the matrix are dealt before they are summed: a task never holds many sums
    stiffness = t.select(F.inline(F.array(*entries))).repartition(tasks, "i").groupBy("i", "j").agg(F.sum("q").alias("q"))
    return mass, stiffness


def precision(mass: DataFrame, stiffness: DataFrame, log_kappa: float, log_tau: float) -> DataFrame:
    """(i, j, q) of tau^2 (kappa^4 M0 + 2 kappa^2 M1 + M2), M2 being the stiffness times the inverse mass times the stiffness."""
    kappa2, tau2 = exp(2 * log_kappa), exp(2 * log_tau)
    inverse = mass.select("i", "j", (1 / F.col("q")).alias("q"))
    second = product(product(stiffness, inverse), stiffness)
    part = lambda m, f: m.select("i", "j", (F.col("q") * F.lit(float(tau2 * f))).alias("q"))
    both = part(mass, kappa2 * kappa2).unionByName(part(stiffness, 2 * kappa2)).unionByName(part(second, 1.0))
    return both.groupBy("i", "j").agg(F.sum("q").alias("q"))


def matern_prior_log_density(log_tau: Column, log_kappa: Column, range_at: float, range_below: float, sigma_at: float, sigma_above: float) -> Column:
    """Log density of (log tau, log kappa) in two dimensions under exponential priors: the range is below range_at, and the deviation above sigma_at, with the probabilities given; up to a constant."""
    rho, sigma = F.lit(8**0.5) / F.exp(log_kappa), F.lit((4 * pi) ** -0.5) / F.exp(log_tau + log_kappa)
    return -2 * F.log(rho) - F.lit(-log(range_below) * range_at) / rho - F.lit(-log(sigma_above) / sigma_at) * sigma - log_tau - 2 * log_kappa


def project(points: DataFrame, nodes: DataFrame, triangles: DataFrame, cell: float, edge: float = 1e-9) -> DataFrame:
    """(pid, node, w): weights of the corners of the triangle that holds each point, summing to 1; points outside all triangles have no rows. points: pid, x, y.

    A triangle stands in the cells of a size that doubles with its own, four at most, and a point looks in its cell of each size that occurs. On a common edge, or
    within `edge` of it, the smallest triangle counts.
    """
    t = corners(nodes, triangles)
    box = {f"{f}{s}": g(*[F.col(f"{c}{s}") for c in "abc"]) for s in "xy" for f, g in (("lo", F.least), ("hi", F.greatest))}
    t = t.withColumns(box)
    t = t.withColumn("__l", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy")) / F.lit(float(cell)))).cast("int")))
    sizes = t.select("__l").distinct().agg(F.array_sort(F.collect_list("__l")).alias("l")).first()[0]  # some tens of numbers at most
    at = lambda c: F.floor(c / (F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__l"))))
    spread = t.withColumn("__i", F.explode(F.sequence(at(F.col("lox")), at(F.col("hix"))))).withColumn("__j", F.explode(F.sequence(at(F.col("loy")), at(F.col("hiy")))))
    p = points.select("pid", "x", "y").withColumn("__l", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"))).withColumn("__i", at(F.col("x"))).withColumn("__j", at(F.col("y")))
    met = p.join(spread, ["__l", "__i", "__j"])
    side = lambda u, v: ((F.col(f"{u}x") - F.col("x")) * (F.col(f"{v}y") - F.col("y")) - (F.col(f"{v}x") - F.col("x")) * (F.col(f"{u}y") - F.col("y"))) / F.col("cross")
    weighed = met.withColumns({"wa": side("b", "c"), "wb": side("c", "a")}).withColumn("wc", 1 - F.col("wa") - F.col("wb"))
    inside = weighed.where((F.col("wa") >= -edge) & (F.col("wb") >= -edge) & (F.col("wc") >= -edge))
    one = inside.groupBy("pid").agg(F.min(F.struct("tri", *[F.struct(F.col(c).alias("node"), F.col(f"w{c}").alias("w")).alias(f"s{c}") for c in "abc"])).alias("m"))
    return one.select("pid", F.inline(F.array("m.sa", "m.sb", "m.sc")))
