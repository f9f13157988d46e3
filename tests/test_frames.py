"""Ordered operators spread over stretches, projections at known points, and scores and frames against loops."""

import random
from math import erfc, lgamma

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.functions import projection, scalar
from fieldmosaic.operators import aggregate, clean, estimates, frame, integration, polygons, recode, scores, spatial, survey
from fieldmosaic.plans import catalog, registry
from fieldmosaic.sources import tables

SF = "/root/testdata/sf0.001"


def test_fill_down_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.choice([None, "", "", "a", "b", "c"])) for g in ("x", "y", None) for k in rng.sample(range(5000), 400)] + [("z", 1, "q"), ("z", 2, None), ("w", 5, "")]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    want, last = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        last[g] = v or last.get(g)
        want[(g, k)] = last[g]
    assert {(r.g, r.k): r.filled for r in clean.fill_down(df, ["g"], "k", "v").collect()} == want
    text = df.withColumn("k", F.lpad(F.col("k").cast("string"), 5, "0"))
    assert {(r.g, int(r.k)): r.filled for r in clean.fill_down(text, ["g"], "k", "v").collect()} == want


def test_numbered_and_custom_order(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.5, 2.5, float(k)])) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    got = {r.id: r.place for r in clean.numbered(df, [F.col("v").asc_nulls_last(), F.col("id")], "place").collect()}
    assert [got[k] for k, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))] == list(range(1, 501))
    assert clean.numbered(df.limit(0), [F.col("v"), F.col("id")], "place").count() == 0
    keys = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("z", 4)], "s string, ord int")
    held = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "b"), (5, None)], "id int, s string")
    assert [r.id for r in recode.in_order_of(held, keys, "s", F.col("id")).collect()] == [2, 4, 1]


def test_apportion_keeps_totals(spark):
    rng = random.Random(3)
    rows = [(g, k, 137 + g, rng.choice([0.0, 1.0, rng.random() * 50])) for g in range(4) for k in range(300)]
    got = recode.apportion(spark.createDataFrame(rows, "g int, id int, total int, share double"), ["g"], "id", "total", "share").collect()
    for g in range(4):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.id)
        s = sum(r.share for r in mine)
        exact = [round(r.total * r.share / s, 9) for r in mine]
        order = sorted(range(300), key=lambda i: (-(exact[i] - int(exact[i])), i))
        left = 137 + g - sum(int(e) for e in exact)
        assert [r.parts for r in mine] == [int(e) + (i in set(order[:left])) for i, e in enumerate(exact)]


def test_projection_at_known_points(spark):
    """A published example: 51.2 N, 7.5 E in zone 32 is 395201.31 m east and 5673135.24 m north."""
    utm = projection.Zone(6378.137, 298.257223563, 9.0, 0.0, 0.9996, 500.0, 0.0)
    e, n = projection.to_km(F.lit(7.5), F.lit(51.2), utm)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(395.2013104, abs=1e-5) and r.n == pytest.approx(5673.1352412, abs=1e-5)
    edges = spark.createDataFrame([(1, 3.0, 6.0, 4.0, 6.0), (1, 4.0, 6.0, 4.0, 9.0)], "poly int, x1 double, y1 double, x2 double, y2 double")
    back = projection.edges_to_km(projection.edges_to_km(edges), back=True).collect()
    assert all(tuple(a) == pytest.approx(tuple(b), abs=1e-9) for a, b in zip(sorted(back), sorted(edges.collect()), strict=True))
    box = projection.box_to_km(spark.createDataFrame([(1, 3.0, 6.0, 5.0, 8.0)], "k int, x0 double, x1 double, y0 double, y1 double"), "k").first()
    east, north = projection.to_km(F.lit(4.5), F.lit(5.0))
    middle = spark.range(1).select(north.alias("n")).first().n
    assert box.y0 == pytest.approx(middle, abs=0.01) and box.x0 < box.x1 and box.y1 - box.y0 > 330  # the lower side's lowest point is at the meridian


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.0, 10.0, 99.5, 1e4, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(lgamma(r.x), rel=1e-12, abs=1e-13) for r in got)
    c = spark.createDataFrame([(10, 3), (10, 0), (10, 10), (0, 0), (100_000, 50_000)], "n int, y int").select("n", "y", scalar.log_choose(F.col("n"), F.col("y")).alias("c")).collect()
    assert all(r.c == pytest.approx(lgamma(r.n + 1) - lgamma(r.y + 1) - lgamma(r.n - r.y + 1), abs=1e-8) for r in c)


def test_normal_cdf(spark):
    xs = [k / 7 for k in range(-260, 261)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.normal_cdf(F.col("x")).alias("c")).collect()
    assert all(r.c == pytest.approx(erfc(-r.x / 2**0.5) / 2, abs=1e-15, rel=1e-7) for r in got)
    assert spark.range(1).select(scalar.normal_cdf(F.lit(None).cast("double")).alias("c")).first().c is None


def test_codes_of_estimates_that_fail(spark):
    rows = [("a", s, c, int(c % 3 == 0), 1.0) for s in (0, 1) for c in range(6)] + [("b", 0, c, 0, 1.0) for c in range(6, 9)] + [("c", 1, c, 1, 2.0) for c in range(9, 12)]
    d = survey.direct_estimates(spark.createDataFrame(rows, "area string, s int, c int, y int, w double"), "area", "s", "c", F.col("y"), F.col("w"))
    areas = spark.createDataFrame([(x,) for x in "abcd"], "area string")
    got = {r.area: (r.converge, r.est, r.lower_80) for r in survey.estimates_with_intervals(d, (0.8,), areas).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 0, "b": 3, "c": 3, "d": 1}
    assert got["b"][1] == 0.0 and got["c"][1] == 1.0 and got["d"][1] is None and got["b"][2] is None and 0 < got["a"][2] < got["a"][1]


def test_folds_start_at_different_places(spark):
    df = spark.range(2300).select("id", (F.col("id") % 23).alias("s"))  # 100 rows a stratum
    folds = survey.stratified_folds(df, ["s"], F.col("id") / 2300, [F.col("id")], 8).groupBy("s", "fold").count().collect()
    big = {}
    for r in folds:
        assert r["count"] in (12, 13) and 1 <= r.fold <= 8
        big.setdefault(r.s, set()).update([r.fold] if r["count"] == 13 else [])
    assert all(len(b) == 4 for b in big.values()) and len({tuple(sorted(b)) for b in big.values()}) > 3


def test_bins_by_counts(spark):
    rng = np.random.default_rng(4)
    x = rng.exponential(5, 103)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(200, None)], "id int, d double")
    got = estimates.bin_by_counts(df, "d", 5).collect()
    s, per = np.sort(x), 21
    edges = [0.0] + [(s[k - 1] + s[k]) / 2 for k in range(per, 103, per)] + [s[-1] + 1e-6]
    for r in got:
        assert r.bin == np.searchsorted(edges[1:-1], r.d) + 1 and r.center == pytest.approx((edges[r.bin - 1] + edges[r.bin]) / 2)
    assert len(got) == 103
    assert estimates.bin_by_counts(df.limit(0), "d", 5).count() == 0


def test_score_tables_and_averages(spark):
    rows = [(m, f, bool(u), float(u + f), [float(x) for x in range(k, k + 5)], 1.0 + u) for k, (m, f, u) in enumerate((m, f, u) for m in "ab" for f in (1, 2) for u in (0, 1))] + [("a", 1, True, 3.0, [], 9.0)]
    df = spark.createDataFrame(rows, "model string, fold int, urban boolean, truth double, draws array<double>, w double")
    held = scores.scored(df, "draws", F.col("truth"), F.lit(0.2), (0.8,))
    got = {(r.model, r.fold, r.part): r for r in scores.score_table(held, ["model", "fold"], "urban", "w", (0.8,)).collect()}
    assert len(got) == 12
    for m in "ab":
        for f in (1, 2):
            mine = [(np.mean(d) - t, w, u) for mm, ff, u, t, d, w in rows if (mm, ff) == (m, f) and d]
            assert got[(m, f, "total")].bias == pytest.approx(sum(e * w for e, w, _ in mine) / sum(w for _, w, _ in mine))
            assert got[(m, f, "urban")].mse == pytest.approx(next(e * e for e, _, u in mine if u))
    folds = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 10.0), ("a", 3, None), ("b", 1, 4.0)], "k string, fold int, s double")
    r = {x.k: (x.s_mean, x.s_median) for x in estimates.over_folds(folds, ["k"], "fold", ("s",)).collect()}
    assert r == {"a": (6.0, 6.0), "b": (4.0, 4.0)}
    both = spark.createDataFrame([("a", "dhs", 1.0), ("a", "mics", 4.0), ("b", "dhs", 2.0), ("b", "mics", None)], "k string, survey string, s double")
    sizes = spark.createDataFrame([("dhs", 100.0), ("mics", 200.0)], "survey string, size double")
    assert {x.k: x.s for x in estimates.survey_average(both, sizes, ["k"], "survey", ("s",)).collect()} == {"a": 3.0, "b": 2.0}


def test_frames_and_averages(spark):
    df = spark.createDataFrame([(1, True, 10.0, 1.0), (1, False, 5.0, 3.0), (1, True, 2.0, None), (2, False, 1.0, 2.0)], "a int, u boolean, p double, x double")
    r = {x.a: x for x in frame.frame_of_clusters(df, "a", "u", "p").collect()}
    assert (r[1].ea_urb, r[1].hh_total, r[1].pop_urb, r[2].ea_urb, r[2].pop_urb, r[2].pop_total) == (2, 75, 12.0, 0, 0.0, 1.0)
    areas = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    assert {x.a: x.rate for x in aggregate.misclassified(df, areas, "a", F.col("u"), F.col("p") > 4).collect()} == {1: pytest.approx(2 / 3), 2: 0.0, 3: None}
    c = {(x.a, x.name): (x.fine, x.points) for x in aggregate.covariate_averages(df, df.where("u"), ["a"], "p", ("x", "p")).collect()}
    assert c[(1, "x")] == (pytest.approx(25 / 15), 1.0) and c[(2, "p")] == (1.0, None)


def test_sub_points_lie_in_their_sectors(spark):
    held = {(u, k): (r1, r2, a, wide, w) for u in (True, False) for _, k, r1, r2, a, wide, w in integration.sectors(u)}
    got = integration.sub_points(spark, 5, 3).collect()
    assert len(got) == 27 * 15
    for r in got:
        r1, r2, a, wide, w = held[(r.urban, r.k)]
        radius, turn = np.hypot(r.dx, r.dy), (np.arctan2(r.dy, r.dx) - a + np.pi) % (2 * np.pi) - np.pi
        assert r1 < radius < r2 and abs(turn) < wide / 2 + 1e-9 and r.w == pytest.approx(w / 15)
    for u in (True, False):
        assert sum(r.w for r in got if r.urban == u) == pytest.approx(1)


def test_weights_change_near_borders_only(spark):
    square = [(p, 0, *e) for p, x in ((0, 0.0), (1, 40.0)) for e in ((x, 0.0, x + 40, 0.0), (x + 40, 0.0, x + 40, 40.0), (x + 40, 40.0, x, 40.0), (x, 40.0, x, 0.0))]
    edges = spark.createDataFrame(square, "poly int, ring int, x1 double, y1 double, x2 double, y2 double")
    clusters = spark.createDataFrame([(1, True, 20.0, 20.0, 0), (2, True, 39.0, 20.0, 0), (3, False, 20.0, 20.0, 0), (4, False, 41.0, 20.0, 1), (5, True, 200.0, 200.0, 1)], "cluster int, urban boolean, east double, north double, poly int")
    got = {}
    for r in integration.admin_weights(clusters, edges, 10.0).collect():
        got.setdefault(r.cluster, {})[r.k] = (r.w, r.px)
    plain = {u: {k: w for _, k, _, _, _, _, w in integration.sectors(u)} for u in (True, False)}
    for c, u in ((1, True), (3, False), (5, True)):  # far from a border, or with no sub-point in its area
        assert {k: w for k, (w, _) in got[c].items()} == pytest.approx(plain[u])
    for c, u in ((2, True), (4, False)):
        assert sum(w for w, _ in got[c].values()) == pytest.approx(1) and {k: w for k, (w, _) in got[c].items()} != pytest.approx(plain[u])
    assert all(w == 0 for w, px in got[2].values() if px > 40.6) and got[2][0][0] > plain[True][0]


def test_likelihood_with_areas_and_totals(spark):
    pts = spark.createDataFrame([(1, "a", 0.5, 1.0, 2, 5), (1, "b", 0.5, 2.0, 2, 5), (2, "c", 1.0, 0.0, 0, 3), (3, "a", 1.0, None, 1, 3)], "obs int, area string, w double, x double, y int, n int")
    effects = spark.createDataFrame([("a", 0.3), ("b", -0.2)], "area string, effect double")
    held = integration.predictor(pts, -1.0, {"x": 0.5}, effects)
    got = {(r.obs, r.area): r.eta for r in held.collect()}
    assert got == {(1, "a"): pytest.approx(-0.2), (1, "b"): pytest.approx(-0.2), (2, "c"): -1.0, (3, "a"): None}
    each = integration.mixture_likelihood(held, "obs")
    p = 1 / (1 + np.exp(0.2))
    want = np.log(10 * p**2 * (1 - p) ** 3)
    assert {r.obs: r.loglik for r in each.collect()}[1] == pytest.approx(want)
    total = integration.total_likelihood(each.withColumn("all", F.lit(1)), ["all"]).first()
    assert total.n == 2 and total.loglik == pytest.approx(want + 3 * np.log(1 - 1 / (1 + np.e)))


def test_holes(spark):
    ring = lambda n, c: [(1, n, *c[i], *c[(i + 1) % 4]) for i in range(4)]
    edges = spark.createDataFrame(ring(0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]) + ring(1, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]), "poly int, ring int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.0, 4.0), (3, 10.0, 1.0)], "pid int, x double, y double")
    assert {r.pid for r in spatial.in_polygons(pts, edges, 2.0, holes=True).collect()} == {1}


def test_kept_tables_of_two_callers(spark, tmp_path):
    """While one caller makes the table another keeps its own: the first one stays, nothing is left beside it."""
    path = str(tmp_path / "kept")

    def slow():
        assert tables.cache_or_compute(spark, path, lambda: spark.range(5)).count() == 5
        return spark.range(3)

    assert tables.cache_or_compute(spark, path, slow).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["kept"]


def test_short_last_record_of_a_grid(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(np.arange(10, dtype="<i2").tobytes())
    with pytest.raises(Exception, match="EOF|end of|record"):
        tables.read_int16_grid(spark, str(tmp_path / "g.bin"), 4).collect()


def test_radii(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for p in range(30):
        n = int(rng.integers(3, 60))
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        r = rng.uniform(0.2, 1, n) if p % 3 else np.ones(n)  # every third one has all corners on a circle
        c = np.stack((5 * p + r * np.cos(t) * (1 + p % 4), r * np.sin(t)), axis=1)
        rows += [(p, 0, *map(float, c[i]), *map(float, c[(i + 1) % n])) for i in range(n)] + [(p, 1, 0.0, 0.0, 0.01, 0.0), (p, 1, 0.01, 0.0, 0.0, 0.01), (p, 1, 0.0, 0.01, 0.0, 0.0)]
        d = np.hypot(*(c[:, None] - c[None]).transpose(2, 0, 1))
        nxt = np.roll(c, -1, axis=0)
        cross = c[:, 0] * nxt[:, 1] - nxt[:, 0] * c[:, 1]
        if abs(cross.sum()) < 0.05:
            rows = [x for x in rows if x[0] != p]
            continue
        centre = ((c + nxt) * cross[:, None]).sum(0) / (3 * cross.sum())
        want[p] = (d.max() / 2, np.hypot(*(c - centre).T).mean())
    got = {r.poly: (r.radius, r.mean_radius) for r in polygons.radii(spark.createDataFrame(rows, "poly int, ring int, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert got.keys() == want.keys() and len(want) > 20 and all(got[p] == pytest.approx(want[p]) for p in want)


def test_strata_of_districts(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "z"), (4, "B", None), (5, "B", "twice"), (6, "C", "other")], "id int, area string, sub string")
    d = spark.createDataFrame([("x!", "A", "north"), ("y", "A", "elsewhere"), ("z", "B", "south"), ("twice", "B", "south"), ("twice", "B", "north"), ("x!", "B", "south")], "subarea string, state string, district string")
    names = spark.createDataFrame([("x!", "A", "x")], "old string, state string, new string")
    got = {r.id: r.stratum for r in recode.strata_of(df, "area", "sub", d, ("north", "south"), names).collect()}
    assert got == {1: "north", 2: "A", 3: "south", 4: "B", 5: "north", 6: "C"}


def test_sub_point_sums(spark):
    """27 rows of sums, so that clusters' sub-points needn't be made and grouped."""
    each = integration.sub_points(spark, 4, 3).collect()
    got = integration.sub_point_sums(spark, 4, 3).collect()
    assert len(got) == 27
    for r in got:
        mine = [x for x in each if (x.urban, x.k) == (r.urban, r.k)]
        d2 = [x.dx**2 + x.dy**2 for x in mine]
        assert r.n == 12 and (r.dx, r.dy, r.w) == pytest.approx((np.mean([x.dx for x in mine]), np.mean([x.dy for x in mine]), sum(x.w for x in mine)), abs=1e-12)
        assert (r.near, r.far) == pytest.approx((min(d2), max(d2)))


def test_all_sub_points_of_a_sector(spark):
    """The query sums up 10 by 10 sub-points of each sector, as the reference makes them, in code and SQL."""
    def sums(r1, r2, angle, width, w):
        at = [(r1 + (i + 0.5) * (r2 - r1) / 10, angle + ((j + 0.5) / 10 - 0.5) * width) for i in range(10) for j in range(10)]
        return 100, np.mean([r * np.cos(a) for r, a in at]), np.mean([r * np.sin(a) for r, a in at]), min(r for r, _ in at) ** 2, max(r for r, _ in at) ** 2, w

    want = {s[:2]: sums(*s[2:]) for u in (True, False) for s in integration.sectors(u)}
    g = {r.pixel: r for r in catalog.grid(spark, SF).collect()}
    got = registry.QUERIES["dhs_subpoints"](spark, SF).collect()
    assert len(got) == sum(11 if r.urban else 16 for r in g.values()) > 0
    for r in got:
        c = g[r.pixel]
        assert (r.n, r.px - c.east, r.py - c.north, r.near, r.far, r.w) == pytest.approx(want[c.urban, r.k], abs=1e-6)
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert con.execute(f"SELECT min(n), max(n), count(*) FROM ({registry.SQL['dhs_subpoints']}) q").fetchone() == (100, 100, len(got))


def test_clusters_in_one_place_are_weighed_once(spark, monkeypatch):
    """Copies of a place add no sub-points to look up; clusters without a polygon keep their rings' weights."""
    edges = spark.createDataFrame([(0, 0, *e) for e in ((0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 40.0), (40.0, 40.0, 0.0, 40.0), (0.0, 40.0, 0.0, 0.0))], "poly int, ring int, x1 double, y1 double, x2 double, y2 double")
    looked = []
    plain = integration.in_polygons
    monkeypatch.setattr(integration, "in_polygons", lambda points, *rest: looked.append(points.count()) or plain(points, *rest))
    rows = [(i, True, 39.0, 20.0, 0) for i in range(9)] + [(9, True, 39.0, 20.0, None)]
    got = {}
    for r in integration.admin_weights(spark.createDataFrame(rows, "cluster int, urban boolean, east double, north double, poly int"), edges, 10.0, 4, 4).collect():
        got.setdefault(r.cluster, {})[r.k] = r.w
    assert looked == [11 * 16] and len(got) == 10 and all(got[i] == got[0] for i in range(9))
    assert got[9] == pytest.approx({k: w for _, k, _, _, _, _, w in integration.sectors(True)}) and got[9] != pytest.approx(got[0])
