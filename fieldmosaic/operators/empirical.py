"""Empirical distributions as tables of ranges: sampling by a bucketed join, masses, and sums of samples; and partial results of draws that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.variates import uniform
from fieldmosaic.operators.aggregate import running_sum

#: Buckets of (0, 1] by which samples meet ranges.
BUCKETS = 256


def ranges(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, value, mass, lo, hi) of each distinct value: its share of the keys' weights, and the distribution function before and at it. Nulls and weights of 0 or less are left out; values are counted first."""
    held = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).cast("double").alias("__w"))
    ends = held.groupBy(*keys).agg(F.min(value).alias("__least"), F.max(value).alias("__most"), F.sum("__w").alias("__sum"))
    held = held.join(ends, keys)
    place = F.when(F.col("__most") > F.col("__least"), (F.col(value) - F.col("__least")) / F.when(F.col("__most") > F.col("__least"), F.col("__most") - F.col("__least"))).otherwise(0.0)
    run = running_sum(held, keys, place, [F.col(value)], "__w")
    hi = F.when(F.col(value) == F.col("__most"), F.lit(1.0)).otherwise(F.col("running") / F.col("__sum"))
    return run.select(*keys, value, (F.col("__w") / F.col("__sum")).alias("mass"), ((F.col("running") - F.col("__w")) / F.col("__sum")).alias("lo"), hi.alias("hi"))


def sample(table: DataFrame, keys: list[str], value: str, rows: DataFrame, ids: list[str], u: str) -> DataFrame:
    """(ids, value): for each row the smallest value of its keys of which the distribution function is u or more. table is made by `ranges`; ids name a row.

    Rows and ranges meet by bucket of u, so rows of one key are spread over many tasks and no row meets all values. Rows of
    keys without a distribution aren't returned.
    """
    bucket = lambda c: F.greatest(F.lit(0), F.least(F.floor(c * BUCKETS).cast("int"), F.lit(BUCKETS - 1)))
    spread = table.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("lo") - 1e-9), bucket(F.col("hi")))))
    met = rows.select(*keys, *ids, F.col(u).alias("__u")).withColumn("__bucket", bucket(F.col("__u"))).join(spread, [*keys, "__bucket"])
    reached = met.where((F.col("hi") >= F.col("__u")) & (F.col("lo") - 1e-9 < F.col("__u")))  # the sums behind lo and hi differ by rounding
    return reached.groupBy(*ids).agg(F.min(F.struct("hi", value)).alias("m")).select(*ids, F.col(f"m.{value}").alias(value))


def sample_composed(tables: list[tuple[DataFrame, list[str], str]], rows: DataFrame, ids: list[str], seed: str) -> DataFrame:
    """(ids, total): one sample of the first distribution for each row, then for each unit of the total a sample of the next, and so on, as persons in households of a block. Tables are (ranges, keys, value); rows has the keys."""
    columns = sorted({k for _, keys, _ in tables for k in keys})
    held = rows.select(*ids, *[c for c in columns if c not in ids]).withColumn("total", F.lit(1).cast("long"))
    for level, (table, keys, value) in enumerate(tables):
        each = held.where("total > 0").withColumn("__unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total"))))
        each = each.withColumn("__p", uniform(f"{seed}-{level}", *[F.col(c) for c in ids], F.col("__unit")))
        found = sample(table, keys, value, each, [*ids, "__unit"], "__p").groupBy(*ids).agg(F.sum(value).cast("long").alias("total"))
        held = held.drop("total").join(found, ids, "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return held.select(*ids, "total")


def mass(table: DataFrame, keys: list[str], value: str, rows: DataFrame) -> DataFrame:
    """Adds `mass`, the share of each row's value in its keys' distribution, 0 where the value doesn't occur."""
    return rows.join(table.select(*keys, value, "mass"), [*keys, value], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def partials(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """What a batch of draws keeps: (keys, bin, n, total) for the bins of a width that its values fall in. Counts are whole and totals decimal, so partial results add up to the same in any order."""
    v = F.col(value).cast("double")
    held = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.floor(v / width).alias("bin"), v.cast("decimal(38, 18)").alias("__v"))
    return held.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").cast("decimal(38, 18)").alias("total"))


def merged(parts: DataFrame, keys: list[str], width: float, levels: tuple[float, ...]) -> DataFrame:
    """(keys, n, mean, q1, q2, ...) from the partial results of any batches. A quantile is placed within its bin as if values were spread evenly there, so it is off by a width at most."""
    held = parts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy(*keys)  # as many rows as a key has bins
    up = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = held.withColumns({"__up": up, "__all": F.sum("n").over(w)})
    at = lambda p: (F.col("__up") >= F.col("__all") * p) & (F.col("__up") - F.col("n") < F.greatest(F.col("__all") * F.lit(p), F.lit(1e-300)))
    inside = lambda p: (F.col("bin") + (F.col("__all") * p - F.col("__up") + F.col("n")) / F.col("n")) * width
    quantiles = [F.min(F.when(at(p), inside(p))).alias(f"q{k + 1}") for k, p in enumerate(levels)]
    mean = (F.sum("total").cast("double") / F.sum("n")).alias("mean")
    return run.groupBy(*keys).agg(F.sum("n").alias("n"), mean, *quantiles)


def store_batch(df: DataFrame, path: str, batch: str, keys: list[str], value: str, width: float) -> None:
    """Writes a batch's partial results in a folder of its own under path; a batch that runs again replaces its own results only."""
    partials(df, keys, value, width).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, keys: list[str], width: float, levels: tuple[float, ...]) -> DataFrame:
    """`merged` over all stored batches; the draws aren't read again."""
    return merged(spark.read.parquet(path), keys, width, levels)
