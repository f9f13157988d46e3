"""Longitude and latitude to kilometres east and north by a transverse Mercator projection, and back, as column arithmetic.

The series are Krueger's, to the third order of the flattening; the error is under a millimetre within a few degrees of the meridian.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zone:
    """A projection's fixed values. The defaults are an ellipsoid and a zone in published use for western Nigeria."""

    radius_km: float = 6378.249145
    inverse_flattening: float = 293.465
    meridian: float = 4.5
    parallel: float = 4.0
    scale: float = 0.99975
    east_km: float = 230.738
    north_km: float = 0.0

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def unit(self) -> float:
        n = self.n
        return self.radius_km / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def forward(self) -> tuple[float, ...]:
        n = self.n
        return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)

    def backward(self) -> tuple[float, ...]:
        n = self.n
        return (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)

    def latitude(self) -> tuple[float, ...]:
        n = self.n
        return (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)


def _north_of(lon: Column, lat: Column, z: Zone) -> tuple[Column, Column]:
    e = F.lit(2 * z.n**0.5 / (1 + z.n))
    phi, lam = F.radians(lat), F.radians(lon - F.lit(z.meridian))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(z.forward(), 1):
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    k = F.lit(z.scale * z.unit)
    return k * east, k * north


def to_km(lon: Column, lat: Column, z: Zone = Zone()) -> tuple[Column, Column]:
    """East and north in kilometres."""
    east, north = _north_of(lon, lat, z)
    base = _north_of(F.lit(z.meridian), F.lit(z.parallel), z)[1]
    return F.lit(z.east_km) + east, F.lit(z.north_km) + north - base


def to_degrees(east: Column, north: Column, z: Zone = Zone()) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    base = _north_of(F.lit(z.meridian), F.lit(z.parallel), z)[1]
    k = F.lit(z.scale * z.unit)
    xi, eta = (north - F.lit(z.north_km) + base) / k, (east - F.lit(z.east_km)) / k
    x, y = xi, eta
    for j, b in enumerate(z.backward(), 1):
        x = x - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(z.latitude(), 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.lit(z.meridian) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def edges_to_km(edges: DataFrame, z: Zone = Zone(), back: bool = False) -> DataFrame:
    """Edges (x1, y1, x2, y2) of polygons with both ends projected, or taken back; other columns stay."""
    ends = {}
    for k in (1, 2):
        ends[f"x{k}"], ends[f"y{k}"] = (to_degrees if back else to_km)(F.col(f"x{k}"), F.col(f"y{k}"), z)
    return edges.withColumns(ends)


def box_to_km(boxes: DataFrame, key: str, z: Zone = Zone(), points: int = 100, back: bool = False) -> DataFrame:
    """(key, x0, x1, y0, y1): the box around each projected box (x0, x1, y0, y1), from points evenly placed along its four sides, as projected sides are curves."""
    t = F.col("__k") / F.lit(float(points - 1))
    along = lambda a, b: F.col(a) + t * (F.col(b) - F.col(a))
    sides = [(along("x0", "x1"), F.col("y0")), (along("x0", "x1"), F.col("y1")), (F.col("x0"), along("y0", "y1")), (F.col("x1"), along("y0", "y1"))]
    held = boxes.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(key, F.inline(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in sides])))
    x, y = (to_degrees if back else to_km)(F.col("x"), F.col("y"), z)
    return held.select(key, x.alias("x"), y.alias("y")).groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
