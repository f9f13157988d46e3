"""Refined grids, medoids and polygon intersections, against exhaustive search and areas that must add up."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.operators import overlay, strata

POINTS = "stratum string, id int, weight double, a double, b double"


def cost(rows, chosen):
    return sum(max(w or 0, 0) * min((x - rows[m][3]) ** 2 + (y - rows[m][4]) ** 2 for m in chosen) for _, _, w, x, y in rows)


def test_medoids_equal_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    groups = {}
    for s, centres in (("p", 3), ("q", 2), ("r", 1), ("t", 2)):
        groups[s] = [(s, i, float(rng.integers(1, 9)), float(rng.normal(i % centres * 5, 1)), float(rng.normal(0, 1))) for i in range(18)]
    groups["u"] = [("u", 0, 1.0, 0.0, 0.0), ("u", 1, 3.0, 1.0, 0.0)]
    groups["v"] = [("v", i, 0.0 if i else None, float(i), 0.0) for i in range(4)]
    rows = [r for g in groups.values() for r in g] + [("p", 99, 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, POINTS).repartition(3)
    for k, block, starts in ((1, 512, 1), (2, 4, 6), (3, 512, 6), (2, 512, 1)):
        got = strata.medoids(df, ("a", "b"), k, block_rows=block, starts=starts).collect()
        assert len(got) == len(rows) - 1
        for s, g in groups.items():
            mine = [r for r in got if r.stratum == s]
            chosen = {r.m for r in mine}
            assert len(chosen) == min(k, len(g))
            best = min(cost(g, c) for c in combinations(range(len(g)), min(k, len(g))))
            assert all(cost(g, chosen - {m} | {o}) >= cost(g, chosen) - 1e-9 for m in chosen for o in range(len(g)) if len(g) > k)  # no exchange lowers it
            assert cost(g, chosen) <= best * 1.1 + 1e-9 and (starts == 1 < k or cost(g, chosen) == pytest.approx(best, rel=1e-9))
            total = sum(max(w or 0, 0) for _, _, w, _, _ in g)
            for m in chosen:
                share = sum(max(r[2] or 0, 0) for r, h in zip(g, sorted(mine, key=lambda r: r.id), strict=True) if h.m == m)
                assert all(r.share is None if total == 0 else r.share == pytest.approx(share / total) for r in mine if r.m == m)


def test_cost_never_rises(spark):
    """More rounds are never worse."""
    rng = np.random.default_rng(3)
    rows = [("s", i, float(rng.uniform(0.5, 2)), float(rng.uniform()), float(rng.uniform())) for i in range(60)]
    df = spark.createDataFrame(rows, POINTS)
    costs = [cost(rows, {r.m for r in strata.medoids(df, ("a", "b"), 4, rounds=n).collect()}) for n in (0, 1, 2, 20)]
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    assert strata.medoids(df.limit(0), ("a", "b"), 4).count() == 0


def test_medoids_meet_few_pairs(spark):
    """Many places, searched by cells: the end is one that no exchange lowers, and far fewer pairs are met than all with all."""
    rng = np.random.default_rng(5)
    rows = [("s", i, float(rng.uniform(0.5, 2)), float(rng.uniform()), float(rng.uniform())) for i in range(600)]
    rows += [("s", 600 + i, 1.0, *rows[i][3:]) for i in range(60)]  # copies of places
    df = spark.createDataFrame(rows, POINTS)
    xy, w = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(2)
    one = {r.m for r in strata.medoids(df, ("a", "b"), 1, block_rows=16).collect()}
    assert one == {int(np.argmin(w @ d))}
    two = sorted({r.m for r in strata.medoids(df, ("a", "b"), 2, block_rows=16).collect()})
    best = w @ np.minimum(d[:, two[0]], d[:, two[1]])
    assert len(two) == 2 and all((w @ np.minimum(d[:, [m]], d)).min() >= best * (1 - 1e-9) for m in two)
    open_ = df.select(F.struct("stratum", F.lit(1).alias("start")).alias("stratum"), "id", "a", "b")
    assert strata._cells(open_, ("a", "b"), 3, 16).select("cell").distinct().count() <= 64


def test_strata_without_a_kind_are_filled(spark):
    rows = [("x", True, 1, 2.0, 0.1, 0.2), ("x", True, 2, 6.0, 0.9, 0.2), ("y", True, 3, 1.0, 0.5, 0.5), ("y", False, 4, 1.0, 0.3, 0.3), ("y", False, 5, 3.0, 0.4, 0.9), ("y", False, 6, 1.0, 0.8, 0.9)]
    df = spark.createDataFrame(rows, "stratum string, urban boolean, id int, weight double, a double, b double")
    got = strata.integration_points(df, ("a", "b"), 2).collect()
    assert len(got) == 8 and all(r.a is not None and r.id is not None for r in got)
    by = {}
    for r in got:
        by.setdefault((r.stratum, r.urban), []).append(r.w)
    assert sorted(by[("x", True)]) == [0.25, 0.75] and by[("x", False)] == [0.0, 0.0] and sorted(by[("y", True)]) == [0.0, 1.0] and sum(by[("y", False)]) == pytest.approx(1)


def ring(poly, number, corners):
    return [(poly, number, *corners[i], *corners[(i + 1) % len(corners)]) for i in range(len(corners))]


EDGE = "poly int, ring int, x1 double, y1 double, x2 double, y2 double"


def test_fine_grid(spark):
    square = lambda s, x: ring(s, 0, [(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)])
    edges = spark.createDataFrame(square(1, 0.0) + square(2, 10.0) + square(3, 20.0), EDGE)
    pixels = []
    for s in (1, 2, 3):
        for i in range(16):
            east, north = (s - 1) * 10 + i % 4 * 2.5 + 1.25, i // 4 * 2.5 + 1.25
            urban = i == 5 if s == 1 else i < 8
            pixels.append((s * 100 + i, s, s * 10 + i % 2, urban, east, north, 0.0 if s == 3 and not urban else float(10 + i), not (s == 2 and i in (0, 1, 2))))
    pixels = [p for p in pixels if p[0] != 210]  # a hole: its points go to the nearest pixel of the stratum
    df = spark.createDataFrame(pixels, "pixel int, stratum int, subarea int, urban boolean, east double, north double, pop double, complete boolean")
    got = strata.fine_grid(edges, df, 2.5, 4.0, 12, 60).collect()
    n = {}
    for r in got:
        n[(r.stratum, r.urban)] = n.get((r.stratum, r.urban), 0) + 1
        p = next(p for p in pixels if p[0] == r.pixel)
        assert p[1] == r.stratum and p[3] == r.urban and p[6] > 0 and p[7] and (r.stratum - 1) * 10 <= r.x <= r.stratum * 10
        if r.stratum != 2:
            assert abs(r.x - p[4]) <= 1.25 and abs(r.y - p[5]) <= 1.25
    assert set(n) == {(1, True), (1, False), (2, True), (2, False), (3, True)} and all(12 <= k <= 60 for k in n.values())
    assert len({(r.stratum, r.urban, r.step) for r in got}) == 5 and len({r.step for r in got}) > 1
    for s, sub, u in {(r.stratum, r.subarea, r.urban) for r in got}:
        total = sum(p[6] for p in pixels if (p[1], p[2], p[3]) == (s, sub, u))
        assert sum(r.pop for r in got if (r.stratum, r.subarea, r.urban) == (s, sub, u)) == pytest.approx(total)
    with pytest.raises(ArithmeticError):
        strata.fine_grid(edges, df, 2.5, 4.0, 12, 60, rounds=1)


def area(df):
    return df.agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).first()[0] or 0.0


def shoelace(corners):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))) / 2


def test_intersections_add_up(spark):
    rng = np.random.default_rng(5)
    at = [(2 * np.pi * k / 17, rng.uniform(1.5, 6)) for k in range(17)]
    star = [(float(6 + r * np.cos(t)), float(6 + r * np.sin(t))) for t, r in at]
    hole = [(5.5, 5.5), (5.5, 6.4), (6.6, 6.1)]
    part = [(13.0, 1.0), (14.0, 1.0), (14.0, 3.0), (13.0, 3.0)]
    polygon = ring(1, 0, star) + ring(1, 1, hole) + ring(1, 2, part[::-1])
    whole = shoelace(star) - shoelace(hole) + shoelace(part)
    a = spark.createDataFrame(polygon, EDGE)
    tiles = spark.createDataFrame([e for k in range(16) for e in ring(k, 0, [(k % 4 * 4.0, k // 4 * 4.0), (k % 4 * 4.0 + 4, k // 4 * 4.0), (k % 4 * 4.0 + 4, k // 4 * 4.0 + 4), (k % 4 * 4.0, k // 4 * 4.0 + 4)])], EDGE)
    parts = {r.other: r.area for r in overlay.common_areas(a, tiles, 3.0).collect()}
    assert sum(parts.values()) == pytest.approx(whole) and all(v > 0 for v in parts.values()) and len(parts) >= 9
    for cell in (0.5, 50.0):
        assert {r.other: pytest.approx(r.area) for r in overlay.common_areas(a, tiles, cell).collect()} == parts
    turned = spark.createDataFrame([(p, r, c, d, a_, b) for p, r, a_, b, c, d in polygon], EDGE)
    assert area(overlay.intersection(a, turned, 3.0)) == pytest.approx(whole)  # the same polygon, its rings the other way round
    assert area(overlay.intersection(tiles.where("poly = 5"), a, 3.0)) == pytest.approx(parts[5])
    assert overlay.intersection(tiles.where("poly = 0"), tiles.where("poly IN (1, 4, 5, 15)"), 3.0).count() == 0  # neighbours share edges and corners only
    shifted = tiles.where("poly = 5").select("poly", "ring", (F.col("x1") + 2).alias("x1"), "y1", (F.col("x2") + 2).alias("x2"), "y2")
    both = overlay.intersection(tiles.where("poly = 5"), shifted, 3.0)  # stretches of edges in common
    assert area(both) == pytest.approx(8.0)
    assert overlay.intersection(a, tiles.limit(0), 3.0).count() == 0
