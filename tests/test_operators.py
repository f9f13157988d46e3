"""Operators on small tables with answers worked out by hand, and every query against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.functions import integrals, projection, scalar
from fieldmosaic.operators import aggregate, clean, estimates, integration, polygons, predict, recode, scores, spatial, survey
from fieldmosaic.plans import registry
from fieldmosaic.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")


def test_agg_area(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0, True), ("a", 15.0, 30.0, False), ("b", None, 0.0, True)], "area string, z double, n double, urban boolean")
    got = {r.area: r for r in aggregate.agg_area(df, "area", F.col("z"), F.col("n"), F.col("urban")).collect()}
    assert got["a"].p == pytest.approx(0.4) and got["a"].p_urb == pytest.approx(0.1) and got["b"].p is None


def test_scores(spark):
    df = spark.createDataFrame([([0.0, 1.0], 0.5), ([1.0, 2.0, 2.0, 4.0, 7.0], 1.2)], "d array<double>, t double")
    got = df.select(scores.crps_ensemble("d", F.col("t")).alias("c"), *[scores.quantile("d", p).alias(f"q{i}") for i, p in enumerate((0.1, 0.25, 0.9))]).collect()
    assert got[0].c == pytest.approx(0.25)
    assert list(got[1])[1:] == pytest.approx([1.4, 2.0, 5.8])
    one = spark.range(1).select(scores.crps_gauss(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("c"), scores.interval_score(F.lit(0.0), F.lit(1.0), F.lit(1.2), 0.8).alias("i")).first()
    assert one.c == pytest.approx(0.233695, abs=1e-6) and one.i == pytest.approx(3.0)


def test_expand_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, 3), (2, 0, 0)], "id int, y int, n int")
    assert [(r.id, r.hh, r.y_hh) for r in survey.expand_binary(df, "y", "n").orderBy("hh").collect()] == [(1, 1, 0), (1, 2, 0), (1, 3, 1)]
    ids = spark.createDataFrame([("x", k) for k in (1, 2, 3, 7, 9, 10)], "g string, k int")
    assert sorted((r["first"], r["last"]) for r in clean.gaps_islands(ids, ["g"], "k").collect()) == [(1, 3), (7, 7), (9, 10)]


def test_calibrate_and_rings(spark):
    df = spark.createDataFrame([("a", 0.0, 4.0), ("a", 0.0, 4.0), ("b", 3.0, None), ("c", 1.0, 8.0), ("c", 3.0, 8.0)], "r string, v double, t double")
    got = sorted((r.r, r.calibrated) for r in aggregate.calibrate(df, ["r"], "v", "t").collect())
    assert got == [("a", 2.0), ("a", 2.0), ("b", 3.0), ("c", 2.0), ("c", 6.0)]
    rows = integration.rings(spark).groupBy("urban").agg(F.count("*").alias("k"), F.sum("w").alias("w")).collect()
    assert {r.urban: r.k for r in rows} == {True: 11, False: 16} and all(r.w == pytest.approx(1.0) for r in rows)


def test_scalars(spark):
    r = spark.range(1).select(scalar.title_case(F.lit("wasagu/danko state")).alias("t"), scalar.expit(F.lit(40.0)).alias("e"), scalar.logit(F.lit(0.5)).alias("l")).first()
    assert (r.t, r.e, r.l) == ("Wasagu/Danko State", 1.0, 0.0)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(registry.SQL[name]).df())


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;share\nKano;0,25\nLagos;none\n")
    assert [tuple(r) for r in tables.read_csv2(spark, str(tmp_path / "a.csv"), "name string, share double").orderBy("name").collect()] == [("Kano", 0.25), ("Lagos", None)]
    np.arange(-6, 6, dtype="<i2").tofile(tmp_path / "g.bin")
    got = [tuple(r) for r in tables.read_int16_grid(spark, str(tmp_path / "g.bin"), 4).orderBy("r", "c").collect()]
    assert got == [(k // 4, k % 4, k - 6) for k in range(12)]
    made = []
    for _ in range(2):
        kept = tables.cache_or_compute(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(3))
        assert kept.count() == 3
    assert len(made) == 1


def test_running_sum_and_sample(spark):
    rows = [("a", k, (k * 7 % 10) / 10, float(k + 1)) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, id int, place double, size double")
    got = {r.id: r.running for r in estimates.running_sum(df, ["g"], F.col("place"), [F.col("id")], "size", buckets=3).collect()}
    total = 0.0
    for _, k, _, size in sorted(rows, key=lambda r: r[2]):
        total += size
        assert got[k] == pytest.approx(total)
    assert sum(r.times for r in estimates.pps_sample(df, ["g"], F.col("place"), [F.col("id")], "size", 4).collect()) == 4


def test_draws_with_gaps(spark):
    """Nulls inside, all null, no draws, ties with the truth at an endpoint, one draw."""
    rows = [(0, [0.0, None, 1.0], 0.5), (1, [None, None], 0.5), (2, [], 0.5), (3, [2.0] * 5 + [3.0] * 5, 2.0), (4, [1.0], 4.0), (5, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, d array<double>, t double")
    got = {r.id: r for r in scores.scored(df, "d", F.col("t"), F.lit(0.1), (0.8,)).collect()}
    assert got[0].crps == pytest.approx(0.25) and got[0].error == pytest.approx(0.0) and got[0].score80 == pytest.approx(0.8)
    assert all(got[k].crps is None and got[k].error is None and got[k].score80 is None for k in (1, 2, 5))
    # the lower endpoint is 2, at which half of the draws are; the tail of 0.1 lacks 0.1 beyond it
    assert got[3].cover80 == pytest.approx(0.8) and got[3].width80 == pytest.approx(1 - 0.1 * 0.2) and got[3].score80 == pytest.approx(0.98)
    assert got[4].score80 == pytest.approx(30.0) and got[4].cover80 == 0.0


def test_points_and_polygons(spark):
    shapes = [(1, 0, ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))), (2, 0, ((10, 0), (20, 0), (20, 10), (10, 10))), (3, 0, ((0, 10), (2, 10), (2, 12), (0, 12))), (3, 1, ((5, 10), (7, 10), (7, 12), (5, 12)))]
    edges = spark.createDataFrame([(p, r, *map(float, c[i]), *map(float, c[(i + 1) % len(c)])) for p, r, c in shapes for i in range(len(c))], "poly int, ring int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 15.0, 5.0), (4, 1.0, 11.0), (5, 6.0, 11.0), (6, 3.5, 11.0), (7, 30.0, 5.0), (8, 10.0, 5.0)], "pid int, x double, y double")
    got = {r.pid: r.poly for r in spatial.point_in_polygon(pts, edges, 1.5).collect()}
    assert [got[k] for k in range(1, 8)] == [1, None, 2, 3, 3, None, None] and got[8] in (2, None)
    near = {r.pid: (r.poly, r.dist) for r in spatial.polygon_or_nearest(pts, edges, 1.5).collect()}
    assert near[6] == (3, pytest.approx(1.5)) and near[7] == (2, pytest.approx(10.0)) and near[3] == (2, 0.0) and near[8][1] == pytest.approx(0.0)
    assert {r.poly: round(r.area, 6) for r in polygons.shapes(edges).collect()}[3] == 4.0


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 100, (80, 2)), np.concatenate((rng.uniform(0, 5, (40, 2)), rng.uniform(80, 81, (10, 2))))
    pts = spark.createDataFrame([(k, *map(float, x), k % 2) for k, x in enumerate(a)], "pid int, px double, py double, side int")
    grid = spark.createDataFrame([(k, *map(float, x), k % 2) for k, x in enumerate(b)], "gid int, gx double, gy double, side int")
    got = {r.pid: (r.gid, r.dist) for r in spatial.nearest(pts, grid, 1.0, by=("side",)).collect()}
    for k, x in enumerate(a):
        d = [(float(np.hypot(*(x - y))), j) for j, y in enumerate(b) if j % 2 == k % 2]
        assert got[k][0] == min(d)[1] and got[k][1] == pytest.approx(min(d)[0])
    none = spatial.nearest(pts.where("pid < 3"), grid.where("side = 9"), 1.0).collect()
    assert [r.gid for r in none] == [None] * 3


def test_neighbours_by_corner_and_edge(spark):
    squares = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (3, 3)}
    e = [(p, x + a, y + b, x + c, y + d) for p, (x, y) in squares.items() for a, b, c, d in ((0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0))]
    edges = spark.createDataFrame(e, "poly int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.src, r.dst) for r in polygons.neighbours(edges).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)}
    assert {(r.src, r.dst) for r in polygons.neighbours(edges, queen=False).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_integrals_and_projection(spark):
    r = spark.range(1).select(
        integrals.logit_normal_moment(F.lit(0.0), F.lit(2.0)).alias("a"), integrals.logit_normal_moment(F.lit(1.0), F.lit(0.0)).alias("b"), integrals.logit_normal_moment(F.lit(None).cast("double"), F.lit(1.0)).alias("c"),
        integrals.logit_normal_moment(F.lit(3.0), F.lit(10.0)).alias("d"), *[c.alias(n) for c, n in zip(projection.to_km(F.lit(4.5), F.lit(4.0)), ("e", "n"))],
    ).first()
    x = np.linspace(-12, 12, 200_001)
    want = float((1 / (1 + np.exp(-(3 + 10 * x))) * np.exp(-x * x / 2)).sum() * (x[1] - x[0]) / np.sqrt(2 * np.pi))
    assert r.a == pytest.approx(0.5) and r.b == pytest.approx(1 / (1 + np.exp(-1))) and r.c is None and r.d == pytest.approx(want, abs=1e-6)
    assert (r.e, r.n) == (pytest.approx(230.738), pytest.approx(0.0))


def test_prediction_pieces(spark):
    px = spark.createDataFrame([("a", 10.0, True, [0.2, 0.4]), ("a", 30.0, False, [0.6, None]), ("b", 0.0, True, [0.1, 0.1])], "area string, pop double, urban boolean, draws array<double>")
    got = {(r.area, r.draw): (r.p, r.p_urb, r.p_rur) for r in predict.predict_areas(px, "area", "pop", F.col("urban")).collect()}
    assert got["a", 0] == (pytest.approx(0.5), pytest.approx(0.2), pytest.approx(0.6)) and got["b", 0] == (None, None, None)
    d = predict.design(spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, x double, k double"), plain=("x", "k")).orderBy("id").collect()
    assert [r.x for r in d] == [pytest.approx(-0.5**0.5), pytest.approx(0.5**0.5)] and [r.k for r in d] == [0.0, 0.0]


def test_small_pieces(spark, tmp_path):
    long = "x" * 3000
    assert spark.range(1).select(scalar.title_case(F.lit(long)).alias("t")).first().t == "X" + long[1:]
    w = aggregate.weighted_moments(spark.createDataFrame([("a", 1e9 + 1, 2.0), ("a", 1e9 + 3, 2.0), ("b", None, 1.0)], "k string, x double, w double"), "k", F.col("x"), F.col("w"), "frequency").collect()
    assert [(r.k, r["mean"], r["var"]) for r in w] == [("a", 1e9 + 2, pytest.approx(4 / 3))]
    text = clean.gaps_text(spark.createDataFrame([("x", k) for k in (1, 2, 3, 7, 9, 10)], "g string, k int"), ["g"], "k").first().stretches
    assert text == "[1-3],7,[9-10]"
    j = recode.ragged_pair(spark.range(0, 12).withColumnRenamed("id", "job"), "job", [3, 0, 5]).orderBy("job").collect()
    assert [(r.i, r.j) for r in j] == [(None, None), (1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5), (None, None), (None, None), (None, None)]
    eta = spark.createDataFrame([(1, 500, 1000, 900.0, 1.0), (2, 1, 2, 0.0, 0.5), (2, 1, 2, 0.0, 0.5)], "o int, y int, n int, eta double, w double")
    ll = {r.o: r.loglik for r in integration.mixture_likelihood(eta, "o").collect()}
    assert ll[1] is not None and ll[1] < -4e5 and ll[2] == pytest.approx(np.log(0.5))
    tables.write_graph(spark.createDataFrame([(1, 2), (2, 2), (2, 3)], "src int, dst int"), str(tmp_path / "graph"))
    assert {(r.src, r.dst) for r in tables.read_graph(spark, str(tmp_path / "graph")).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    spark.createDataFrame([(1, 2)], "src int, dst int").write.parquet(str(tmp_path / "half"))
    with pytest.raises(ValueError):
        tables.read_graph(spark, str(tmp_path / "half"))
    tables.write_cells(spark.createDataFrame([("pop", 0, 0, 1.0), ("elev", 0, 1, None)], "layer string, r int, c int, v double"), str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).where("layer = 'pop'").count() == 1
    for fold in (1, 2):
        tables.write_results(spark.createDataFrame([("m", fold, 0.5)], "model string, fold int, score double"), str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_nearest_has_no_hot_cell(spark):
    """A far point asks for cells that hold all of 20,000 others, a third of them in one place; no key of the join has many rows, and none is lost."""
    rng = np.random.default_rng(7)
    xy = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 30, (20_000, 2)))]
    xy = [(k, 3.0, 4.0) if k % 3 == 0 else (k, x, y) for k, x, y in xy]
    others = spark.createDataFrame(xy, "gid int, gx double, gy double").repartition(4)
    points = [(0, 900.0, 700.0), (1, 3.0, 4.0), (2, -50.0, 15.0), (3, 15.0, 15.0)] + [(10 + k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 30, (200, 2)))]
    joined = []
    compared = spatial._compared
    try:
        spatial._compared = lambda asked, spread, keys: joined.append((compared(asked, spread, keys), keys)) or joined[-1][0]
        got = {r.pid: (r.gid, r.dist) for r in spatial.nearest(spark.createDataFrame(points, "pid int, px double, py double"), others, 1.0).collect()}
    finally:
        spatial._compared = compared
    at = np.array([p[1:] for p in xy])
    for pid, x, y in points:
        d = np.hypot(at[:, 0] - x, at[:, 1] - y)
        assert got[pid][1] == pytest.approx(d.min()) and d[got[pid][0]] == pytest.approx(d.min())
    df, keys = joined[0]
    largest = df.groupBy(*keys, "__s").agg(F.countDistinct("gid").alias("n")).agg(F.max("n")).first()[0]
    assert largest <= 2 * spatial.CELL_ROWS, largest


def test_dense_centres_are_not_met_by_all_points(spark):
    """Cells get smaller as centres get closer, and points between many centres don't meet them all."""
    rng = np.random.default_rng(8)
    centres = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (900, 2)))]
    centres += [(900, 30.0, 30.0), (901, *centres[0][1:]), (902, 34.0, 30.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 11, (60, 2)))] + [(60, 30.5, 30.5), (61, 32.0, 30.0)]
    p, g = spark.createDataFrame(points, "pid int, px double, py double"), spark.createDataFrame(centres, "gid int, gx double, gy double")
    assert spatial._finer(g.where("gid < 900"), 5.0) < 0.4 and spatial._finer(g.limit(0), 5.0) == 5.0
    assert spatial.crowded(p.where("px BETWEEN 2 AND 8 AND py BETWEEN 2 AND 8"), g.withColumn("n", F.lit(1)), 4.0).count() == sum(2 <= x <= 8 and 2 <= y <= 8 for _, x, y in points)
    got = {r.pid: r for r in spatial.cell_or_nearest(p, g, 4.0).collect()}
    for i, x, y in points:
        held = [c for c, u, v in centres if u - 2 < x <= u + 2 and v - 2 < y <= v + 2]
        best = held[0] if len(held) == 1 else min(centres, key=lambda c: ((c[1] - x) ** 2 + (c[2] - y) ** 2, c[0]))[0]
        assert (got[i].gid, got[i].exact) == (best, len(held) == 1)
    assert len(got) == len(points)


def test_moments_of_many_rows(spark):
    """Both moments in one pass agree with the rule for one row."""
    rows = [(m, s) for m in (-40.0, -2.0, 0.3, 800.0) for s in (0.0, 0.5, 1.5, 4.0)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(rows, "mu double, sigma double")
    mu, sigma = F.col("mu"), F.col("sigma")
    for r in df.select(integrals.logit_normal_moments(mu, sigma).alias("z"), integrals.logit_normal_moment(mu, sigma).alias("m"), integrals.logit_normal_variance(mu, sigma).alias("v")).collect():
        assert r.z is None if r.m is None else (r.z.m, r.z.v) == pytest.approx((r.m, r.v), abs=1e-12)


def test_inputs_are_joined_once(spark):
    """The result has a row for each pair of a stratum, so it isn't joined with itself."""
    plan = registry.QUERIES["make_inputs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # customers with nations, and points with clusters


def test_inputs_by_lists(spark):
    """Lists of clusters give each pair of a stratum once, however they are dealt; null clusters and repeated rows count, null strata don't."""
    c = [(i, i % 3, i % 2 == 0, i / 2) for i in range(40)] + [(7, 1, False, 3.5), (None, 0, True, None), (99, None, True, 1.0)]
    p = [(a, u, k, 0.1 * k) for a in range(4) for u in (True, False) for k in range(5)] + [(None, True, 0, 0.5)]
    clusters, points = spark.createDataFrame(c, "cluster long, area int, urban boolean, y double"), spark.createDataFrame(p, "area int, urban boolean, k int, w double")
    want = sorted(((a, u, k, w, i, y) for a, u, k, w in p for i, b, v, y in c if a is not None and (a, u) == (b, v)), key=repr)
    for size in (1, 3, 1000):
        got = integration.make_inputs(clusters, points, ["area", "urban"], size)
        assert got.columns == ["area", "urban", "k", "w", "cluster", "y"] and sorted(map(tuple, got.collect()), key=repr) == want
    bare = integration.make_inputs(clusters.select("area"), points.select("area", "k").where("area = 1 AND k = 2"), ["area"], 4)
    assert bare.columns == ["area", "k"] and bare.count() == 2 * sum(b == 1 for _, b, _, _ in c)
    for none in (clusters.limit(0), clusters.where("area = 9")):
        assert integration.make_inputs(none, points, ["area", "urban"]).isEmpty()


def test_inputs_are_rounded_before_they_are_paired(spark):
    """A point's numbers are rounded once, not for each cluster of its stratum, and lists of clusters are met by points, not clusters one by one."""
    plan = registry.QUERIES["make_inputs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pairs, _, rest = plan.partition("Join ")
    assert "round(" not in pairs and "inline(" in pairs and rest.count("round(") == 2
