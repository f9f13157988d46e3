"""Predictions from draws of a fitted model's parameters. Draws are arrays, one place for each draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions import spline
from fieldmosaic.functions.integrals import logit_normal_moment
from fieldmosaic.functions.scalar import expit, ratio
from fieldmosaic.functions.variates import binomial, normal
from fieldmosaic.operators.scores import mean, quantile


def design(df: DataFrame, logs: tuple[str, ...] = (), roots: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> DataFrame:
    """Covariates as a model takes them: log1p, square root or as they are, then centred and scaled over the whole table. The moments, two numbers each, pass through the driver; a constant column becomes 0."""
    held = df.select("*", *[f.alias(f"__{c}") for cols, fn in ((logs, F.log1p), (roots, F.sqrt), (plain, lambda c: F.col(c).cast("double"))) for c in cols for f in (fn(c),)])
    names = [*logs, *roots, *plain]
    m = held.agg(*[f(f"__{c}").alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    scaled = {c: (F.col(f"__{c}") - F.lit(m[f"m_{c}"])) / F.lit(m[f"s_{c}"]) if m[f"s_{c}"] else F.lit(0.0) for c in names}
    return held.select(*[F.col(c) for c in df.columns if c not in names], *[scaled[c].alias(c) for c in names])


def area_effects(effects: DataFrame, area: str, draw: str, value: str) -> DataFrame:
    """(area, effect): each area's effect as an array in the order of the draws."""
    held = effects.groupBy(area).agg(F.array_sort(F.collect_list(F.struct(draw, value))).alias("e"))
    return held.select(area, F.col(f"e.{value}").alias("effect"))


def centred(effects: DataFrame, draw: str, value: str, share: Column, scale: Column) -> DataFrame:
    """Effects corrected to a sum of zero: each draw's total of `structured`, times an area's share of the correction and the draw's scale, is taken off."""
    total = effects.groupBy(draw).agg(F.sum("structured").alias("__total"))
    return effects.join(total, draw).withColumn(value, F.col(value) - share * F.col("__total") * scale).drop("__total")


def _slope(covariate: str):
    return lambda e, b: e + b * F.col(covariate)


def draw_splines(params: DataFrame) -> DataFrame | None:
    """One row with `splines`, that of each draw's sigma in the order of the draws; None where they would take more than may be broadcast."""
    n = params.select(F.size("sigma")).first()[0]
    if n * spline.KNOTS * spline.KNOT_BYTES > spline.BROADCAST_BYTES:
        return None
    each = params.select(F.posexplode("sigma").alias("draw", "sigma"))
    held = each.join(spline.spline_table(each), "sigma", "left")  # a sigma of 0 has no spline and needs none
    return held.groupBy().agg(F.array_sort(F.collect_list(F.struct("draw", "spline"))).alias("s")).select(F.col("s.spline").alias("splines"))


def predict_grid(pixels: DataFrame, effects: DataFrame, params: DataFrame, area: str, covariates: tuple[str, ...], offset: str | None = None, exact: bool = False) -> DataFrame:
    """Adds `draws`: each pixel's risk for each draw, the intercept plus covariates and its area's effect, with the nugget integrated out.

    params is one row with arrays alpha, sigma and beta_<covariate>; effects has a row for each area. Areas without an effect have none
    added. offset names one more array of params that is added, as for one of several surveys. The mean over the nugget comes from each draw's spline; with `exact`, or
    for more draws than splines may be broadcast for, from the quadrature. Pixels are dealt to all tasks first, as their table may be one small file.
    """
    held = pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))).join(effects, area, "left").join(F.broadcast(params))  # one row of params
    base = F.zip_with("alpha", F.coalesce("effect", F.array_repeat(F.lit(0.0), F.size("alpha"))), lambda a, w: a + w)
    for c in covariates:
        base = F.zip_with(base, f"beta_{c}", _slope(c))
    if offset:
        base = F.zip_with(base, offset, lambda e, o: e + o)
    splines = None if exact else draw_splines(params)
    if splines is None:
        drawn = F.zip_with(base, "sigma", lambda m, s: logit_normal_moment(m, s))
    else:
        held = held.join(F.broadcast(splines))  # one row, of a size that is checked
        drawn = F.transform(F.arrays_zip(base.alias("m"), F.col("sigma").alias("s"), F.col("splines").alias("k")), lambda d: spline.spline_mean(d["m"], d["s"], d["k"]))
    return held.withColumn("draws", drawn).drop("effect", "splines", *params.columns)


def summarised(df: DataFrame, draws: str = "draws", levels: tuple[float, ...] = (0.025, 0.1, 0.9, 0.975)) -> DataFrame:
    """Mean and quantiles of the draws as columns: mean, q1, q2, ..."""
    return df.select(*[c for c in df.columns if c != draws], mean(draws).alias("mean"), *[quantile(draws, p).alias(f"q{k + 1}") for k, p in enumerate(levels)])


def predict_areas(pixels: DataFrame, area: str, population: str, urban: Column, draws: str = "draws") -> DataFrame:
    """(area, draw, p, p_urb, p_rur): population-weighted means of the pixels' risks for each draw. Sums are combined before the shuffle; areas without people have nulls."""
    held = pixels.select(area, F.col(population).alias("n"), urban.alias("u"), F.posexplode(draws).alias("draw", "r"))
    parts = {"p": F.lit(True), "p_urb": F.col("u"), "p_rur": ~F.col("u")}
    sums = held.groupBy(area, "draw").agg(*[x for k, c in parts.items() for x in (F.sum(F.when(c, F.col("n") * F.col("r"))).alias(f"z{k}"), F.sum(F.when(c, F.col("n"))).alias(f"n{k}"))])
    return sums.select(area, "draw", *[ratio(F.col(f"z{k}"), F.col(f"n{k}")).alias(k) for k in parts])


def predict_clusters(points: DataFrame, cluster: str, weight: str, eta: str, sigma: str, seed: str, size: str | None = None) -> DataFrame:
    """(cluster, draw, p): the weighted mean of expit(eta + noise) over a cluster's points for each draw, within 0 and 1.

    eta and sigma are arrays, a place for each draw. The noise is normal with the draw's sigma, one number for a cluster and draw, the same for all its points
    and in any run. size, a column that is the same for a cluster's points, adds binomial noise: y of size, and rate = y / size.
    """
    n = [F.col(size).alias("__n")] if size else []
    held = points.select(cluster, weight, *n, F.posexplode(F.arrays_zip(F.col(eta).alias("e"), F.col(sigma).alias("s"))).alias("draw", "v"))
    keys = (F.col(cluster), F.col("draw"))
    # variates are made once for a cluster and draw, not for each point
    noise = held.select(cluster, "draw", "v.s").distinct().withColumn("noise", F.col("s") * normal(f"{seed}-nugget", *keys)).drop("s")
    held = held.join(noise, [cluster, "draw"])
    sums = held.groupBy(cluster, "draw").agg(F.sum(F.col(weight) * expit(F.col("v.e") + F.col("noise"))).alias("s"), F.sum(weight).alias("w"), *([F.max("__n").alias("__n")] if size else []))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col("s"), F.col("w"))))
    out = sums.select(cluster, "draw", p.alias("p"), *(["__n"] if size else []))
    if not size:
        return out
    out = out.withColumn("y", binomial(F.col("__n"), F.col("p"), f"{seed}-binomial", *keys))
    return out.select(cluster, "draw", "p", "y", ratio(F.col("y"), F.col("__n")).alias("rate"))


def summarise_parameters(draws: DataFrame, names: tuple[str, ...], levels: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(name, mean, q1, q2, ...) of parameters that stand in columns of a table of draws."""
    longer = draws.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names])).alias("v")).select("v.*")
    return longer.groupBy("name").agg(F.avg("x").alias("mean"), *[F.percentile("x", F.lit(p)).alias(f"q{k + 1}") for k, p in enumerate(levels)])


def average_parameters(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of parameter tables over folds, by the keys; nulls are left out."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
