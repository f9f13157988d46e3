"""Design-based estimates, folds, samples and weights."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.integrals import logit_normal_moment, logit_normal_variance
from fieldmosaic.functions.scalar import expit, ratio
from fieldmosaic.functions.variates import uniform


def expand_binary(df: DataFrame, y: str, n: str, weight: str | None = None) -> DataFrame:
    """A row for each of n trials, n - y zeros and then y ones; n = 0 gives none. A weight that is named is divided among the rows."""
    held = df if weight is None else df.withColumn(weight, F.when(F.col(n) > 0, F.col(weight) / F.when(F.col(n) > 0, F.col(n))))
    return held.where(F.col(n) >= 1).withColumn("hh", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).withColumn("y_hh", (F.col("hh") > F.col(n) - F.col(y)).cast("int"))


def direct_estimates(df: DataFrame, area: str, stratum: str, cluster: str, y: Column, w: Column) -> DataFrame:
    """Weighted proportion by area, its logit and the logit's linearised variance with clusters as sampling units.

    All clusters of a stratum count, those outside the area with zero; a stratum's single cluster is centred at 0.
    """
    c = df.groupBy(area, stratum, cluster).agg(F.sum(w * y).alias("wy"), F.sum(w).alias("w"))
    sizes = df.select(stratum, cluster).distinct().groupBy(stratum).agg(F.count(F.lit(1)).alias("nh"))
    p = c.groupBy(area).agg(F.sum("wy").alias("swy"), F.sum("w").alias("sw")).withColumn("est", ratio(F.col("swy"), F.col("sw")))
    z = c.join(p, area).withColumn("z", ratio(F.col("wy") - F.col("est") * F.col("w"), F.col("sw") * F.col("est") * (1 - F.col("est"))))
    h = z.groupBy(area, stratum).agg(F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("szz")).join(sizes, stratum)
    part = F.when(F.col("nh") > 1, F.col("nh") / F.when(F.col("nh") > 1, F.col("nh") - 1) * (F.col("szz") - F.col("sz") * F.col("sz") / F.col("nh"))).otherwise(F.col("szz"))
    var = h.groupBy(area).agg(F.sum(part).alias("logit_var"))
    return p.join(var, area).select(area, "est", F.when((F.col("est") > 0) & (F.col("est") < 1), F.log(F.col("est") / F.when(F.col("est") < 1, 1 - F.col("est")))).alias("logit_est"), "logit_var")


def estimates_with_intervals(direct: DataFrame, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95), areas: DataFrame | None = None, area: str = "area") -> DataFrame:
    """Direct estimates with est as the mean and var as the variance on the probability scale, intervals (lower_90, upper_90, ...), and converge: 0; 3 where a fit of the logit would run off, as all answers are 0 or all are 1; 1 where there is no estimate or no positive variance. areas: all areas that are asked for; those without people have converge 1."""
    direct = direct if areas is None else areas.select(area).distinct().join(direct, area, "left")
    ok = F.col("logit_est").isNotNull() & (F.col("logit_var") > 0)
    m, sd = F.col("logit_est"), F.sqrt(F.when(ok, F.col("logit_var")))
    direct_est = F.col("__est")
    out = direct.withColumn("__est", F.col("est")).withColumn("est", F.when(ok, logit_normal_moment(m, sd)).otherwise(F.col("est"))).withColumn("var", logit_normal_variance(m, sd))
    for level in levels:
        z, name = NormalDist().inv_cdf((1 + level) / 2), round(100 * level)
        out = out.withColumn(f"lower_{name}", expit(m - F.lit(z) * sd)).withColumn(f"upper_{name}", expit(m + F.lit(z) * sd))
    return out.withColumn("converge", F.when(ok, 0).when((direct_est <= 0) | (direct_est >= 1), 3).otherwise(1)).drop("__est")


def contrast(direct: DataFrame, area: str, urban: str) -> DataFrame:
    """(area, contrast, var): urban less rural log-odds. Urban and rural clusters are in different strata, so the variances add; areas that lack one have none."""
    by = direct.groupBy(area).agg(*[F.max(F.when(F.col(urban) == u, F.col(c))).alias(f"{c}_{u}") for u in (True, False) for c in ("logit_est", "logit_var")])
    return by.select(area, (F.col("logit_est_True") - F.col("logit_est_False")).alias("contrast"), (F.col("logit_var_True") + F.col("logit_var_False")).alias("var"))


def combine_logits(surveys: list[DataFrame], area: str, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """Inverse-variance means of logit estimates of several surveys, est and var on the probability scale, their intervals, and the largest converge code."""
    both = surveys[0].select(area, "logit_est", "logit_var", "converge")
    for s in surveys[1:]:
        both = both.unionByName(s.select(area, "logit_est", "logit_var", "converge"))
    w = F.when(F.col("logit_var") > 0, 1 / F.when(F.col("logit_var") > 0, F.col("logit_var")))
    got = both.groupBy(area).agg(ratio(F.sum(w * F.col("logit_est")), F.sum(w)).alias("logit_est"), ratio(F.lit(1.0), F.sum(w)).alias("logit_var"), F.max("converge").alias("converge"))
    sd = F.sqrt("logit_var")
    got = got.withColumns({"est": logit_normal_moment(F.col("logit_est"), sd), "var": logit_normal_variance(F.col("logit_est"), sd)})
    for level in levels:
        z, name = NormalDist().inv_cdf((1 + level) / 2), round(100 * level)
        got = got.withColumn(f"lower_{name}", expit(F.col("logit_est") - F.lit(z) * sd)).withColumn(f"upper_{name}", expit(F.col("logit_est") + F.lit(z) * sd))
    return got


def household_sample(households: DataFrame, ea: str, order: list[Column], n: int = 25) -> DataFrame:
    """n households of each area unit, or all where there are fewer, and p_hh, the chance that each had."""
    w = Window.partitionBy(ea)
    sizes = households.groupBy(ea).agg(F.count(F.lit(1)).alias("__n"))
    some = households.withColumn("__r", F.row_number().over(w.orderBy(*order))).where(F.col("__r") <= n)
    return some.join(sizes, ea).withColumn("p_hh", F.least(F.lit(1.0), F.lit(float(n)) / F.col("__n"))).drop("__r", "__n")


def sampling_weight(people: Column, p_hh: Column, p_ea: Column) -> Column:
    """People of a household over the chances of its being sampled and of its unit's."""
    return ratio(people.cast("double"), p_hh * p_ea)


def fold_split(df: DataFrame, fold: str, k: int, offset: int = 0) -> DataFrame:
    """Adds `held_out`: whether a row is in fold k, less an offset for a second survey's folds; the rest is the complement. Rows without a fold are in no split."""
    return df.where(F.col(fold).isNotNull()).withColumn("held_out", F.col(fold) == k - offset)


def fold_split_areal(df: DataFrame, area: str, held: object, fold: str, above: int) -> DataFrame:
    """Adds `held_out`: whether a row is of the area held out and in a fold above `above`."""
    return df.withColumn("held_out", F.coalesce((F.col(area) == held) & (F.col(fold) > above), F.lit(False)))


def stratified_folds(df: DataFrame, strata: list[str], place: Column, order: list[Column], k: int, buckets: int = 64) -> DataFrame:
    """Folds 1..k, dealt in the order of (place, *order), place being from 0 to 1; their sizes differ by one row at most within each stratum, and each stratum starts at a fold of its own, drawn from its name, so that the larger ones aren't the same everywhere. Rows are ranked within buckets of places, after the buckets' counts, so a large stratum is spread over many tasks."""
    held = df.withColumn("__b", F.least(F.floor(place * buckets), F.lit(buckets - 1)))
    counts = held.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*strata, "__b", (F.sum("__n").over(Window.partitionBy(*strata).orderBy("__b")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy(place, *order)) - 1
    return held.join(before, [*strata, "__b"]).withColumn("fold", (F.col("__before") + place + F.floor(uniform("folds", *[F.col(c) for c in strata]) * k)) % k + 1).drop("__b", "__before")


def srs_sample(df: DataFrame, strata: list[str], order: list[Column], n: int) -> DataFrame:
    """n rows of each stratum without replacement, with weight N / n. Each task keeps n rows of a stratum before they meet."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    some = df.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("__r") <= n)
    return some.join(sizes, strata).withColumn("weight", F.col("__n") / F.least("__n", F.lit(n))).drop("__r", "__n")
