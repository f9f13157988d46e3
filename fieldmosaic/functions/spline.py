"""Logit-normal means by a monotone cubic spline of their logits: a table of knots for each sigma, and a column that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.integrals import logit_normal_moment
from fieldmosaic.functions.scalar import expit, let, logit

#: Knots for each sigma, and bytes that one takes as a segment with what holds it. With this many the error is under 1e-10.
KNOTS, KNOT_BYTES = 250, 72
#: Bytes of splines up to which they are broadcast; beyond, they are joined by sigma.
BROADCAST_BYTES = 32 << 20


def _lowest(sigma: Column) -> Column:
    """expit of the scaled argument at the first knot; under it the mean is less than 1e-15."""
    return expit(-(sigma * 10.0 + 40.0) / (sigma + 2.0))


def spline_table(sigmas: DataFrame, knots: int = KNOTS) -> DataFrame:
    """(sigma, spline) for the distinct sigmas above 0 of a table with that column: low, scale and segments (x, c0, c1, c2, c3, per), ascending in x from far below 0 to 0.

    The curve is the logit of the mean of expit(X) for X with mean x; its slope at a knot comes from exact moments, as the mean's derivative is
    E[p] - E[p^2]. Knots are evenly placed on the probability scale of x / (2 + sigma), so a row finds its segment by
    arithmetic. Slopes are held to three times the smaller of the chords beside them, which keeps the curve monotone. The mean at -x
    is one less the mean at x, so half the line is enough.
    """
    s = F.col("sigma")
    each = sigmas.where("sigma > 0").select(s.cast("double").alias("sigma")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(knots - 1))))
    held = each.repartition("sigma", "k").withColumn("low", _lowest(s)).withColumn("at", F.col("low") + (0.5 - F.col("low")) * F.col("k") / F.lit(float(knots - 1)))
    held = held.withColumn("x", F.when(F.col("k") == knots - 1, F.lit(0.0)).otherwise((s + 2.0) * logit(F.col("at"))))
    held = held.withColumns({"m": logit_normal_moment(F.col("x"), s), "m2": logit_normal_moment(F.col("x"), s, 2)})
    held = held.select("sigma", "low", "k", "x", logit(F.col("m")).alias("y"), ((F.col("m") - F.col("m2")) / (F.col("m") * (1 - F.col("m")))).alias("slope"))
    w = Window.partitionBy("sigma").orderBy("k")
    held = held.withColumns({"h": F.lead("x").over(w) - F.col("x"), "rise": F.lead("y").over(w) - F.col("y")})
    chord = F.col("rise") / F.col("h")
    held = held.withColumn("d", F.least("slope", F.least(chord, F.lag(chord).over(w)) * 3.0))  # least() leaves nulls out, so the ends have one chord
    held = held.withColumns({"c1": F.col("h") * F.col("d"), "end": F.col("h") * F.lead("d").over(w)}).where("h IS NOT NULL")
    segment = F.struct("k", "x", F.col("y").alias("c0"), "c1", (3 * F.col("rise") - 2 * F.col("c1") - F.col("end")).alias("c2"), (F.col("c1") + F.col("end") - 2 * F.col("rise")).alias("c3"), (1 / F.col("h")).alias("per"))
    return held.groupBy("sigma").agg(F.struct(F.first("low").alias("low"), (F.first("sigma") + 2.0).alias("scale"), F.array_sort(F.collect_list(segment)).alias("segments")).alias("spline"))


def spline_mean(mu: Column, sigma: Column, spline: Column) -> Column:
    """Mean of expit(X) from the spline of sigma; expit(mu) where sigma is 0, null where mu, sigma or the spline is null."""
    n = F.size(spline["segments"])

    def at(x: Column) -> Column:
        place = F.floor((expit(x / spline["scale"]) - spline["low"]) / (0.5 - spline["low"]) * n).cast("int")
        segment = let(F.greatest(F.lit(0), F.least(place, n - 1)), lambda i: F.get(spline["segments"], i))
        return let(segment, lambda g: let((x - g["x"]) * g["per"], lambda t: g["c0"] + t * (g["c1"] + F.when(t > 0, t * (g["c2"] + t * g["c3"])).otherwise(0.0))))

    p = let(let(-F.abs(mu), at), lambda y: 1.0 / (1.0 + F.exp(-y)))  # y is at most 0
    return F.when(sigma == 0, expit(mu)).otherwise(let(p, lambda q: F.when(mu > 0, 1 - q).otherwise(q)))


def spline_means(df: DataFrame, mu: str, sigma: str, name: str) -> DataFrame:
    """Adds `name`, the mean for each row's mu and sigma. Meant for many rows for each sigma, as a sigma has 250 knots. Splines are broadcast
    if their counted size allows, else joined by sigma. Rows with a null or a negative sigma have a null."""
    key = df.select(F.col(sigma).cast("double").alias("sigma"))
    table = spline_table(key)
    n = key.where("sigma > 0").distinct().count()
    side = F.broadcast(table) if n * KNOTS * KNOT_BYTES <= BROADCAST_BYTES else table
    held = df.withColumn("__sigma", F.col(sigma).cast("double")).join(side.select(F.col("sigma").alias("__sigma"), F.col("spline").alias("__spline")), "__sigma", "left")
    return held.withColumn(name, F.when(F.col("__sigma") >= 0, spline_mean(F.col(mu), F.col("__sigma"), F.col("__spline")))).drop("__sigma", "__spline")
