"""Scores of predictive draws. Draws are an array column; nulls among them are left out, and without any draw a score is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import expit, normal_cdf, normal_pdf, ratio
from fieldmosaic.functions.variates import normal


def kept(draws: str) -> Column:
    return F.filter(draws, lambda x: x.isNotNull())


def mean(draws: str) -> Column:
    held = kept(draws)
    return ratio(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))


def crps_ensemble(draws: str, truth: Column) -> Column:
    """Mean distance to the truth less half the mean distance between draws, from the sorted draws."""
    held = kept(draws)
    s, m = F.array_sort(held), F.size(held)
    spread = F.aggregate(F.transform(s, lambda x, i: x * (2 * (i + 1) - m - 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(m > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + F.abs(x - truth)) / F.when(m > 0, m) - spread / F.when(m > 0, m * m))


def crps_gauss(truth: Column, est: Column, var: Column) -> Column:
    z = (truth - est) / F.sqrt(var)
    return F.sqrt(var) * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - F.lit(3.141592653589793**-0.5))


def sorted_quantile(s: str | Column, p: float) -> Column:
    """Linear interpolation between draws that are sorted and have no nulls."""
    at = F.greatest(F.size(s) - 1, F.lit(0)) * F.lit(p)
    held = F.col(s) if isinstance(s, str) else s
    lo, hi = F.get(held, F.floor(at).cast("int")), F.get(held, F.ceil(at).cast("int"))
    return lo + (at - F.floor(at)) * (hi - lo)


def quantile(draws: str, p: float) -> Column:
    """Linear interpolation between sorted draws."""
    return sorted_quantile(F.array_sort(kept(draws)), p)


def interval_score(lower: Column, upper: Column, truth: Column, level: float) -> Column:
    a = 2 / (1 - level)
    return upper - lower + F.lit(a) * F.greatest(lower - truth, F.lit(0.0)) + F.lit(a) * F.greatest(truth - upper, F.lit(0.0))


def fuzzy_interval(df: DataFrame, ordered: str, truth: Column, level: float, step: Column) -> DataFrame:
    """Adds score, cover and width (score80, ...) of the central interval at a level, with truths at an endpoint covered in part. ordered: sorted draws without nulls.

    Such a truth is rejected with the probability that makes the interval's tail exact: what the tail lacks beyond the endpoint, over the share of draws at it
    (one half if there are none). The endpoint moves inward by step times that; a truth outside still pays by
    where it was, measured from the moved endpoint.
    """
    tail, name = (1 - level) / 2, round(100 * level)
    share = lambda f: ratio(F.size(F.filter(ordered, f)), F.size(ordered))

    def rejected(end: str, beyond) -> Column:
        at = F.col(f"{end}_at")
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(tail) - share(beyond)) / F.when(at > 0, at)))
        return F.when(truth == F.col(end), F.when(at > 0, part).otherwise(0.5)).otherwise(0.0)

    ends = df.withColumns({"__lo": sorted_quantile(ordered, tail), "__hi": sorted_quantile(ordered, 1 - tail)})
    ends = ends.withColumns({f"{e}_at": F.when(truth == F.col(e), share(_equals(e))).otherwise(0.0) for e in ("__lo", "__hi")})
    ends = ends.withColumns({"__rl": rejected("__lo", _under("__lo")), "__rh": rejected("__hi", _over("__hi"))})
    ends = ends.withColumns({"__a": F.col("__lo") + step * F.col("__rl"), "__b": F.col("__hi") - step * F.col("__rh")})
    lo, hi, a, b = (F.col(c) for c in ("__lo", "__hi", "__a", "__b"))
    out = F.when(truth < lo, a - truth).when(truth > hi, truth - b).otherwise(0.0)
    covered = F.when((truth >= lo) & (truth <= hi), 1 - F.least(F.lit(1.0), F.col("__rl") + F.col("__rh"))).otherwise(0.0)
    none = F.when(F.size(ordered) > 0, 1)
    named = {f"score{name}": none * (b - a + F.lit(2 / (1 - level)) * out), f"cover{name}": none * covered, f"width{name}": none * (b - a)}
    return ends.withColumns(named).drop("__lo", "__hi", "__lo_at", "__hi_at", "__rl", "__rh", "__a", "__b")


def _equals(end: str):
    return lambda x: x == F.col(end)


def _under(end: str):
    return lambda x: x < F.col(end)


def _over(end: str):
    return lambda x: x > F.col(end)


def scored(df: DataFrame, draws: str, truth: Column, step: Column, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """Adds error, crps and, for each level, score, cover and width (score80, cover80, width80, ...) to every row; all null without draws."""
    out = df.withColumn("error", mean(draws) - truth).withColumn("crps", crps_ensemble(draws, truth)).withColumn("__s", F.array_sort(kept(draws)))
    for level in levels:
        out = fuzzy_interval(out, "__s", truth, level, step)
    return out.drop("__s")


def weighted_errors(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """By the keys: bias, mse, var and rmse of `error`, with weights that are scaled to 1 over the rows that have one."""
    w = F.when(F.col("error").isNotNull(), F.col(weight))
    got = df.groupBy(*keys).agg(ratio(F.sum(w * F.col("error")), F.sum(w)).alias("bias"), ratio(F.sum(w * F.col("error") * F.col("error")), F.sum(w)).alias("mse"))
    return got.withColumn("var", F.col("mse") - F.col("bias") * F.col("bias")).withColumn("rmse", F.sqrt("mse"))


def average_scores(df: DataFrame, keys: list[str], weight: str, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """By the keys: bias, mse, var, rmse, crps and the interval scores of `scored` rows, with weights that are scaled to 1 over the rows that have a score."""
    over = lambda c: ratio(F.sum(F.col(weight) * c), F.sum(F.when(c.isNotNull(), F.col(weight))))
    names = ["crps"] + [f"{n}{round(100 * x)}" for x in levels for n in ("score", "cover", "width")]
    got = df.groupBy(*keys).agg(over(F.col("error")).alias("bias"), over(F.col("error") * F.col("error")).alias("mse"), *[over(F.col(n)).alias(n) for n in names])
    return got.withColumn("var", F.col("mse") - F.col("bias") * F.col("bias")).withColumn("rmse", F.sqrt("mse"))


def score_table(df: DataFrame, keys: list[str], urban: str, weight: str, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """`average_scores` of `scored` rows by the keys, as model and fold, for all, urban and rural rows (part)."""
    part = F.explode(F.array(F.lit("total"), F.when(F.col(urban), "urban").otherwise("rural")))
    return average_scores(df.withColumn("part", part), [*keys, "part"], weight, levels)


def merge_binned(tables: list[DataFrame], bin_: str, count: str, values: list[str]) -> DataFrame:
    """Tables of binned scores as one, weighted by their counts; a bin that a table lacks weighs nothing there."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy(bin_).agg(F.sum(count).alias(count), *[ratio(F.sum(F.col(count) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(count)))).alias(v) for v in values])


def against_direct(df: DataFrame, draws: str, logit_est: str, logit_sd: str, seed: str, *keys: str, levels: tuple[float, ...] = (0.8,)) -> DataFrame:
    """Scores draws against a direct estimate that is uncertain itself: error, crps and, for each level, score, cover and width of draws less draws of expit of a normal with that mean and deviation, against 0.

    Each draw has a normal number of its own, made from the seed, the keys (which name a row) and its place.
    """
    own = F.transform(draws, lambda d, k: d - expit(F.col(logit_est) + F.col(logit_sd) * normal(seed, *[F.col(c) for c in keys], k)))
    held = df.withColumn("difference", own)
    out = held.withColumns({"error": mean("difference"), "crps": crps_ensemble("difference", F.lit(0.0))})
    for level in levels:
        t, n = (1 - level) / 2, round(100 * level)
        lo, hi = quantile("difference", t), quantile("difference", 1 - t)
        out = out.withColumns({f"score{n}": interval_score(lo, hi, F.lit(0.0), level), f"cover{n}": F.when(lo.isNotNull(), ((lo <= 0) & (hi >= 0)).cast("double")), f"width{n}": hi - lo})
    return out
