"""Estimates after they are made: averages over folds, bins, samples by size, and distances between distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import ratio
from fieldmosaic.operators.aggregate import running_sum
from fieldmosaic.operators.clean import numbered


def fold_average(df: DataFrame, keys: list[str], weight: str, scores: tuple[str, ...]) -> DataFrame:
    """Weighted means over folds; a fold without a score leaves its weight to the others."""
    mean = lambda s: ratio(F.sum(F.col(s) * F.col(weight)), F.sum(F.when(F.col(s).isNotNull(), F.col(weight))))
    return df.groupBy(*keys).agg(*[mean(s).alias(s) for s in scores])


def bin_by_quantiles(df: DataFrame, value: str, bins: int) -> DataFrame:
    """A column `bin` (1..bins) of nearly equal counts. The edges, bins - 1 numbers, come to the driver."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("e")).first().e or []
    above = [(F.col(value) > e).cast("int") for e in edges]
    return df.withColumn("bin", sum(above, F.lit(1)))


def bin_by_counts(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds `bin` (1..bins) and `center`: bins of equal counts but for the last, an edge being the mean of the values on its two sides, and centres halfway between edges; the first begins at 0. Rows without a value go. The values at the edges, two for each, pass through the driver."""
    placed = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), [F.col("v")], "place")
    n = df.where(F.col(value).isNotNull()).count()
    per = max(1, -(-n // bins))
    wanted = [k for start in range(per + 1, n + 1, per) for k in (start - 1, start)] + [n]
    at = {r.place: r.v for r in placed.where(F.col("place").isin(wanted)).collect()}
    edges = [0.0] + [(at[s - 1] + at[s]) / 2 for s in range(per + 1, n + 1, per)] + [at.get(n, 0.0) + 1e-6]
    bin_ = F.least(F.lit(len(edges) - 1), sum([(F.col(value) > e).cast("int") for e in edges[1:-1]], F.lit(1)))
    centers = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:], strict=False)])
    return df.where(F.col(value).isNotNull()).withColumn("bin", bin_).withColumn("center", F.get(centers, F.col("bin") - 1))


def over_folds(df: DataFrame, keys: list[str], fold: str, values: tuple[str, ...]) -> DataFrame:
    """(keys, <value>_mean, <value>_median): means and medians over folds of the folds' own means; folds without a value don't count."""
    by = df.groupBy(*keys, fold).agg(*[F.avg(v).alias(v) for v in values])
    return by.groupBy(*keys).agg(*[x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.median(v).alias(f"{v}_median"))])


def survey_average(df: DataFrame, sizes: DataFrame, keys: list[str], survey: str, scores: tuple[str, ...]) -> DataFrame:
    """Averages of several surveys' scores by their sizes (survey, size), after `fold_average` within each; a survey without a score leaves its weight to the others."""
    return fold_average(df.join(sizes, survey), keys, "size", scores)


def pps_sample(df: DataFrame, strata: list[str], place: Column, order: list[Column], size: str, n: int) -> DataFrame:
    """Systematic sampling with probability proportional to size: n steps of equal length through each stratum's running sum, from half a step. `times` is how often a row is met, `weight` 1 / its expectation."""
    total = df.groupBy(*strata).agg((F.sum(size) / n).alias("__step"))
    held = running_sum(df.where(F.col(size) > 0), strata, place, order, size).join(total, strata)
    met = lambda c: F.floor(F.round(c / F.col("__step") + 0.5, 6))
    times = met(F.col("running")) - met(F.col("running") - F.col(size))
    return held.withColumn("times", times).where("times > 0").withColumn("weight", F.col("__step") / F.col(size)).drop("__step", "running")


def wasserstein(df: DataFrame, group: str, value: str, first: Column) -> DataFrame:
    """The area between the distribution functions of value where `first` holds and where it doesn't, by group. Values are counted before they are sorted."""
    c = df.groupBy(group, value).agg(F.sum(first.cast("int")).alias("f"), F.sum((~first).cast("int")).alias("g"))
    w = Window.partitionBy(group)
    up = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda x: ratio(F.sum(x).over(up), F.sum(x).over(w))
    gaps = c.withColumn("gap", F.lead(value).over(w.orderBy(value)) - F.col(value)).withColumn("d", F.abs(share("f") - share("g")))
    return gaps.groupBy(group).agg(F.coalesce(F.sum(F.col("gap") * F.col("d")), F.lit(0.0)).alias("distance"))


def _sides(df: DataFrame, group: str, value: str, first: Column) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(group, first.cast("int").alias("__s"), F.col(value).cast("double").alias("__x"))


def _distance(overlap: Column) -> Column:
    return F.when(overlap.isNotNull(), F.sqrt(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), overlap))))  # greatest() would take a null for 0


def hellinger_normal(df: DataFrame, group: str, value: str, first: Column) -> DataFrame:
    """(group, distance): the Hellinger distance of two normals with the means and deviations of value where `first` holds and where it doesn't; null with fewer than two values on a side."""
    m = _sides(df, group, value, first).groupBy(group).agg(*[f(F.when(F.col("__s") == s, F.col("__x"))).alias(f"{n}{s}") for s in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp))])
    both, gap = F.col("v0") + F.col("v1"), F.col("m0") - F.col("m1")
    overlap = F.when(both > 0, F.sqrt(2 * F.sqrt(F.col("v0") * F.col("v1")) / both) * F.exp(-gap * gap / (4 * both))).when(both == 0, (gap == 0).cast("double"))
    return m.select(group, _distance(overlap).alias("distance"))


def hellinger_kernel(df: DataFrame, group: str, value: str, first: Column, steps: int = 8, reach: int = 5) -> DataFrame:
    """(group, distance): the Hellinger distance of two kernel densities of value, where `first` holds and where it doesn't; null where a side has no spread.

    Bandwidths are 0.9 n^-0.2 times the smaller of the deviation and the interquartile range / 1.34. Values are counted in bins of a `steps`-th of the smaller
    bandwidth first; a bin adds to the grid points within `reach` bandwidths of it, so the work grows with bins, not with pairs of values.
    """
    held = _sides(df, group, value, first)
    spread = held.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__d"), ((F.percentile("__x", F.lit(0.75)) - F.percentile("__x", F.lit(0.25))) / 1.34).alias("__q"))
    band = spread.withColumn("__h", 0.9 * F.pow("__n", F.lit(-0.2)) * F.when(F.col("__q") > 0, F.least("__d", "__q")).otherwise(F.col("__d"))).where("__h > 0").select(group, "__s", "__n", "__h")
    width = band.groupBy(group).agg((F.min("__h") / steps).alias("__w"), F.count(F.lit(1)).alias("__k")).where("__k = 2").drop("__k")
    bins = held.join(band, [group, "__s"]).join(width, group).groupBy(group, "__s", "__n", "__h", "__w", F.floor(F.col("__x") / F.col("__w") + 0.5).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    far = F.ceil(F.lit(reach) * F.col("__h") / F.col("__w")).cast("int")
    each = bins.withColumn("__o", F.explode(F.sequence(-far, far)))
    z = F.col("__o") * F.col("__w") / F.col("__h")
    density = each.groupBy(group, "__w", (F.col("__b") + F.col("__o")).alias("__g")).agg(*[F.sum(F.when(F.col("__s") == s, F.col("__c") * F.exp(-z * z / 2) / (F.col("__n") * F.col("__h")))).alias(f"d{s}") for s in (0, 1)])
    overlap = density.groupBy(group).agg((F.coalesce(F.sum(F.sqrt(F.col("d0") * F.col("d1")) * F.col("__w")), F.lit(0.0)) / F.lit((2 * 3.141592653589793) ** 0.5)).alias("o"))
    groups = held.select(group).distinct()
    return groups.join(overlap, group, "left").select(group, _distance(F.col("o")).alias("distance"))


def hellinger_bernoulli(q: Column) -> Column:
    """The Hellinger distance of a fair coin from one with probability q."""
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.sqrt((1 - q) / 2) - F.sqrt(q / 2)))


def bernoulli_at(h: Column) -> Column:
    """The probability of one half or more at that Hellinger distance from a fair coin."""
    return (1 + F.sqrt(F.greatest(F.lit(0.0), 1 - 4 * ((1 - h * h) * (1 - h * h) - 0.5) ** 2))) / 2
