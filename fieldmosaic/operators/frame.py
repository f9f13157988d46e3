"""Population frames and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import ratio


def expected_per_ea(grid: DataFrame, strata: list[str], pop: str) -> DataFrame:
    """Adds per_ea: each stratum's population over its number of rows, grouped before the join."""
    sums = grid.groupBy(*strata).agg(ratio(F.sum(pop), F.count(F.lit(1))).alias("per_ea"))
    return grid.join(sums, strata, "left")


def frame_of_clusters(clusters: DataFrame, area: str, urban: str, pop: str, households: int = 25) -> DataFrame:
    """(area, ea_urb, ea_rur, ea_total, hh_urb, ..., pop_urb, ...): an area's units, households (a fixed number for each unit) and people, in one pass of sums. Areas without units of a kind have 0."""
    parts = {"urb": F.col(urban), "rur": ~F.col(urban), "total": F.lit(True)}
    sums = [x for k, c in parts.items() for x in (F.count(F.when(c, 1)).alias(f"ea_{k}"), (F.count(F.when(c, 1)) * households).alias(f"hh_{k}"), F.sum(F.when(c, F.col(pop)).otherwise(0.0)).alias(f"pop_{k}"))]
    return clusters.groupBy(area).agg(*sums)


def block_means(grid: DataFrame, x: str, y: str, value: str, step: float) -> DataFrame:
    """Means over square blocks, upper edges in."""
    block = lambda c: F.ceil(F.col(c) / F.lit(step)).cast("long")
    return grid.groupBy(block(x).alias("i"), block(y).alias("j")).agg(F.avg(value).alias("mean"))


def adjust_grid(grid: DataFrame, targets: DataFrame, strata: list[str], pop: str) -> DataFrame:
    """Adds adjusted: values scaled to each stratum's target. Strata without people or target get 0."""
    factor = grid.groupBy(*strata).agg(F.sum(pop).alias("__s")).join(targets, strata, "left")
    factor = factor.select(*strata, F.coalesce(ratio(F.col("target"), F.col("__s")), F.lit(0.0)).alias("__f"))
    return grid.join(factor, strata, "left").withColumn("adjusted", F.col(pop) * F.col("__f")).drop("__f")


def target_population(hh: DataFrame, area: str, per_urb: float, per_rur: float) -> DataFrame:
    """Persons from households (hh_urb, hh_rur) by area, the urban share and the area's share of all in percent. The total is one row."""
    p = hh.select(area, (F.col("hh_urb") * F.lit(per_urb)).alias("pop_urb"), (F.col("hh_rur") * F.lit(per_rur)).alias("pop_rur"))
    both = F.col("pop_urb") + F.col("pop_rur")
    total = p.agg(F.sum(both).alias("__all"))
    return p.join(F.broadcast(total)).select(area, "pop_urb", "pop_rur", (100 * ratio(F.col("pop_urb"), both)).alias("pct_urb"), (100 * ratio(both, F.col("__all"))).alias("pct_total"))


def resolution(grid: DataFrame) -> DataFrame:
    """The least step of north among the points of the most frequent east, ties to the smaller; one row."""
    most = grid.groupBy("east").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "east").limit(1).select("east")
    north = grid.join(F.broadcast(most), "east").select("east", "north").distinct()
    gap = F.col("north") - F.lag("north").over(Window.partitionBy("east").orderBy("north"))
    return north.select(gap.alias("gap")).agg(F.min("gap").alias("resolution"))


def split_by_share(df: DataFrame, total: str, share: str, low: float, high: float) -> DataFrame:
    """Shares under `low` become 0 and those over `high` 1, and the total is split by them anew: urb and rur."""
    s = F.when(F.col(share) < low, 0.0).when(F.col(share) > high, 1.0).otherwise(F.col(share))
    return df.withColumn(share, s).withColumn("urb", F.col(total) * F.col(share)).withColumn("rur", F.col(total) - F.col("urb"))
