"""Rasters as tables of cells (r, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_sum(cells: DataFrame, k: int) -> DataFrame:
    """Sums of k x k blocks, combined before the shuffle."""
    block = lambda x: F.floor(F.col(x) / F.lit(k)).alias(x)
    return cells.groupBy(block("r"), block("c")).agg(F.sum("v").alias("v"))


def bilinear(points: DataFrame, cells: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    """The value at each point between the four cells around it: an equi-join of cell numbers. Missing cells leave their weight to the others."""
    i, j = F.floor(F.col(x)), F.floor(F.col(y))
    u, v = F.col(x) - i, F.col(y) - j
    corner = lambda a, b, w: F.struct((j + b).alias("r"), (i + a).alias("c"), w.alias("w"))
    corners = points.select(point_id, F.inline(F.array(corner(0, 0, (1 - u) * (1 - v)), corner(1, 0, u * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 1, u * v))))
    w = F.sum("w")
    return corners.where("w > 0").join(cells, ["r", "c"]).groupBy(point_id).agg((F.sum(F.col("w") * F.col("v")) / w).alias("value"))
