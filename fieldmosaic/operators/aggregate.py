"""Grouped sums, ratios and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmosaic.functions.scalar import ratio


def agg_area(df: DataFrame, area: str, num: Column, den: Column, urban: Column) -> DataFrame:
    """Sums and their ratio per area, for all, urban and rural rows, in one pass. Null numerators count as 0; a zero denominator gives null."""
    n, d = F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(0))
    kinds = {"": F.lit(True), "_urb": urban, "_rur": ~urban}
    sums = df.groupBy(area).agg(*[f for k, c in kinds.items() for f in (F.sum(F.when(c, n).otherwise(0)).alias(f"z{k}"), F.sum(F.when(c, d).otherwise(0)).alias(f"n{k}"))])
    return sums.select(area, *[c for k in kinds for c in (f"z{k}", f"n{k}", ratio(F.col(f"z{k}"), F.col(f"n{k}")).alias(f"p{k}"))])


def pixel_to_area(df: DataFrame, area: str, families: dict[str, Column], weight: Column, urban: Column) -> DataFrame:
    """agg_area for several families of results in one pass; each family's columns end in its name."""
    kinds = {"": F.lit(True), "_urb": urban, "_rur": ~urban}
    n = F.coalesce(weight, F.lit(0))
    sums = [F.sum(F.when(c, n).otherwise(0)).alias(f"__n{k}") for k, c in kinds.items()]
    sums += [F.sum(F.when(c, F.coalesce(n * x, F.lit(0))).otherwise(0)).alias(f"z{k}_{f}") for k, c in kinds.items() for f, x in families.items()]
    got = df.groupBy(area).agg(*sums)
    return got.select(area, *[x for f in families for k in kinds for x in (f"z{k}_{f}", ratio(F.col(f"z{k}_{f}"), F.col(f"__n{k}")).alias(f"p{k}_{f}"))])


def roll_up(areas: DataFrame, mapping: DataFrame, key: str, to: str) -> DataFrame:
    """Area sums, urban and rural ones too where there are, to coarser areas; ratios are made anew from the sums, never averaged."""
    kinds = [k for k in ("", "_urb", "_rur") if f"z{k}" in areas.columns]
    sums = areas.join(mapping, key).groupBy(to).agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in kinds for c in ("z", "n")])
    return sums.withColumns({f"p{k}": ratio(F.col(f"z{k}"), F.col(f"n{k}")) for k in kinds})


def expectation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of an empirical distribution: each value times its step of the distribution function. Values are counted first."""
    steps = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return steps.groupBy(*keys).agg((F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("mean"))


def count_complete(df: DataFrame, a: str, b: str, keys: DataFrame | None = None) -> DataFrame:
    """Counts of all pairs of keys, b being true or false, with 0 for empty cells. keys is the frame's table of a; without it the keys that occur."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = (keys if keys is not None else counts).select(a).distinct().withColumn(b, F.explode(F.array(F.lit(True), F.lit(False))))
    return cells.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def misclassified(df: DataFrame, areas: DataFrame, area: str, a: Column, b: Column) -> DataFrame:
    """(area, rate): the share of rows where a and b differ, for all areas of a table; null for those without rows."""
    rates = df.groupBy(area).agg(F.avg((a != b).cast("double")).alias("rate"))
    return areas.select(area).distinct().join(rates, area, "left")


def covariate_averages(fine: DataFrame, points: DataFrame, keys: list[str], weight: str, columns: tuple[str, ...]) -> DataFrame:
    """(keys, name, fine, points): weighted averages of columns over a fine grid and over integration points that stand for it; null on a side without weights."""
    held = lambda df, f: df.select(*keys, F.col(weight).alias("__w"), *columns, F.lit(f).alias("__f"))
    longer = held(fine, True).unionByName(held(points, False)).select(*keys, "__w", "__f", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("__x")) for c in columns]))).where("__x IS NOT NULL")
    mean = lambda c: ratio(F.sum(F.when(c, F.col("__w") * F.col("__x"))), F.sum(F.when(c, F.col("__w"))))
    return longer.groupBy(*keys, "name").agg(mean(F.col("__f")).alias("fine"), mean(~F.col("__f")).alias("points"))


def calibrate(df: DataFrame, region: list[str], value: str, target: str) -> DataFrame:
    """Scales value so that each region's sum is its target. A zero sum shares the target equally; a null target leaves values as they are. Sums are grouped before the join."""
    sums = df.groupBy(*region).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__k"))
    v, t = F.col(value), F.col(target)
    return df.join(sums, region).withColumn("calibrated", F.when(t.isNull(), v).when(F.col("__s") == 0, t / F.col("__k")).otherwise(v * t / F.when(F.col("__s") != 0, F.col("__s")))).drop("__s", "__k")


def weighted_moments(df: DataFrame, key: str, x: Column, w: Column, kind: str = "reliability") -> DataFrame:
    """Weighted mean and variance about it, in two passes. The sum of squares is divided by the sum of weights, less 1 for frequencies, less V2 / V1 for reliability weights, or as it is ("none")."""
    held = df.where(x.isNotNull() & w.isNotNull()).select(key, x.cast("double").alias("x"), w.cast("double").alias("w"))
    s = held.groupBy(key).agg(F.sum("w").alias("v1"), F.sum(F.col("w") * F.col("w")).alias("v2"), ratio(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("mean"))
    squares = held.join(s.select(key, "mean"), key).groupBy(key).agg(F.sum(F.col("w") * (F.col("x") - F.col("mean")) ** 2).alias("s2"))
    off = {"reliability": ratio(F.col("v2"), F.col("v1")), "frequency": F.lit(1.0), "none": F.lit(0.0)}[kind]
    return s.join(squares, key).select(key, "mean", ratio(F.col("s2"), F.col("v1") - off).alias("var"))


def threshold_by_share(df: DataFrame, area: str, value: str, share: str, always: tuple = ()) -> DataFrame:
    """Per area, the smallest value whose cumulative sum, ascending, reaches total * (1 - share); minus infinity for areas that are `always` urban.

    Sums run over buckets of the area's range of values first, so that a large area is spread over many tasks.
    """
    ends = df.groupBy(area).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.sum(value).alias("__t"))
    held = df.where(F.col(value).isNotNull()).join(ends, area)
    place = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))).otherwise(0.0)
    held = running_sum(held, [area], place, [F.col(value)], value)
    found = held.groupBy(area).agg(F.min(F.when(F.col("running") >= F.col("__t") * (1 - F.col(share)), F.col(value))).alias("threshold"))
    return found.withColumn("threshold", F.when(F.col(area).isin(*always), F.lit(float("-inf"))).otherwise(F.col("threshold"))) if always else found


def running_sum(df: DataFrame, strata: list[str], place: Column, order: list[Column], value: str, buckets: int = 64) -> DataFrame:
    """`running`: the sum of value within the strata in the order of (place, *order), place being from 0 to 1.

    Places are cut into buckets, whose totals are summed first, so that a large stratum is spread over many tasks.
    """
    held = df.withColumn("__b", F.least(F.floor(place * buckets), F.lit(buckets - 1)))
    totals = held.groupBy(*strata, "__b").agg(F.sum(value).alias("__t_b"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t_b").over(Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = Window.partitionBy(*strata, "__b").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = held.join(before.drop("__t_b"), [*strata, "__b"])
    return joined.withColumn("running", F.col("__before") + F.sum(value).over(within)).drop("__b", "__before")


def ring_shares(df: DataFrame, keys: list[str], ring: str, value: str) -> DataFrame:
    """(keys, ring, share, up_to): each ring's share of its keys' total, and that of all rings up to it. Rings are summed first."""
    sums = df.where(F.col(ring).isNotNull()).groupBy(*keys, ring).agg(F.sum(value).alias("__v"))
    w = Window.partitionBy(*keys)  # as many rows as there are rings
    up = F.sum("__v").over(w.orderBy(ring).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("__v").over(w)
    return sums.select(*keys, ring, ratio(F.col("__v"), total).alias("share"), ratio(up, total).alias("up_to"))


def mixed(df: DataFrame, key: str, sums: tuple[str, ...]) -> DataFrame:
    """Per key: sums of the columns named, means of the other numbers, and the smallest of all else."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    of = lambda c: F.sum(c) if c in sums else F.avg(c) if c in numbers else F.min(c)
    return df.groupBy(key).agg(*[of(c).alias(c) for c in df.columns if c != key])
