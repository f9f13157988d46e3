"""Splines, random variates, empirical distributions and merged draws, on small tables with answers known otherwise."""

from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.functions import integrals, spline, variates
from fieldmosaic.operators import empirical, predict


def logit_normal(mu, sigma):
    z = np.linspace(-9, 9, 40_001)
    w = np.exp(-z * z / 2)
    return float((w / w.sum() / (1 + np.exp(-np.clip(mu + sigma * z, -700, 700)))).sum())


def test_spline_and_quadrature(spark):
    """Both within 1e-9 of a fine sum, from sharp to flat, far in the tails, and for customers' balances."""
    sigmas = (0.05, 0.4, 1.0, 1.25, 2.0, 3.7, 8.0, 20.0)
    rows = [(m / 7, s) for s in sigmas for m in range(-300, 301, 9)] + [(m, s) for s in (0.4, 8.0) for m in (-1000.0, -80.0, 80.0, 1000.0)]
    c = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(40).select((F.col("c_acctbal").cast("double") / 1000).alias("m"), F.lit(1.3).alias("s"))
    df = spark.createDataFrame(rows, "m double, s double").unionByName(c)
    for r in spline.spline_means(df, "m", "s", "p").withColumn("e", integrals.logit_normal_moment(F.col("m"), F.col("s"))).collect():
        want = logit_normal(r.m, r.s)
        assert r.p == pytest.approx(want, abs=1e-9) and r.e == pytest.approx(want, abs=1e-11)


def test_spline_is_monotone_and_defined(spark):
    df = spark.range(4001).select(((F.col("id") - 2000) / 100).alias("m"), F.lit(2.5).alias("s"))
    p = [r.p for r in spline.spline_means(df, "m", "s", "p").orderBy("m").collect()]
    assert all(a < b for a, b in zip(p, p[1:], strict=False))
    odd = spark.createDataFrame([(1, 0.5, 0.0), (2, None, 1.0), (3, 0.5, None), (4, 0.5, -1.0), (5, 0.0, 3.0), (6, 0.5, 1.0)], "id int, m double, s double")
    got = {r.id: r.p for r in spline.spline_means(odd, "m", "s", "p").collect()}
    assert got[1] == pytest.approx(1 / (1 + np.exp(-0.5))) and got[2] is None and got[3] is None and got[4] is None and got[5] == pytest.approx(0.5)
    assert spline.spline_means(odd.limit(0), "m", "s", "p").count() == 0


def test_spline_joined_by_sigma_when_large(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") / 50).alias("m"), (F.col("id") % 5 / 2.0).alias("s"))
    small = {r.m: r.p for r in spline.spline_means(df, "m", "s", "p").collect()}
    monkeypatch.setattr(spline, "BROADCAST_BYTES", 0)
    assert {r.m: r.p for r in spline.spline_means(df, "m", "s", "p").collect()} == small


def test_grid_prediction_by_spline_and_exact(spark, monkeypatch):
    pixels = spark.createDataFrame([(k, k % 3, k / 10) for k in range(40)], "pixel int, area int, x double")
    effects = spark.createDataFrame([(0, [0.1, 0.2, 0.3]), (1, [-0.3, 0.0, 0.3])], "area int, effect array<double>")
    params = spark.createDataFrame([([-1.0, 0.0, 0.5], [0.3, -0.2, 0.1], [0.0, 0.7, 2.2], [0.5, 0.25, 0.0])], "alpha array<double>, beta_x array<double>, sigma array<double>, survey array<double>")
    by = lambda **k: {r.pixel: r.draws for r in predict.predict_grid(pixels, effects, params, "area", ("x",), **k).collect()}
    a, b, shifted = by(), by(exact=True), by(offset="survey")
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in range(40))
    assert a[2][1] == pytest.approx(logit_normal(0.0 - 0.2 * 0.2, 0.7), abs=1e-9)  # an area without an effect
    assert shifted[4][0] == pytest.approx(logit_normal(-1.0 - 0.3 + 0.3 * 0.4 + 0.5, 0.0), abs=1e-9)
    monkeypatch.setattr(spline, "BROADCAST_BYTES", 100)
    assert predict.draw_splines(params) is None and by() == b


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.77, 0.9251, 0.99999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", variates.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.5,), (None,)], "p double").select(variates.normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in odd] == [float("-inf"), float("inf"), None, None, None]


def test_variates_belong_to_keys(spark):
    df = spark.range(20_000).withColumn("g", F.col("id") % 7)
    u = lambda d: {r.id: r.u for r in d.withColumn("u", variates.uniform("s", F.col("id"), F.col("g"))).collect()}
    one = u(df)
    assert one == u(df.repartition(13)) == u(df.orderBy(F.desc("id")).coalesce(1))
    x = np.array([one[k] for k in range(20_000)])
    assert x.min() > 0 and x.max() < 1 and len(set(one.values())) == 20_000
    assert abs(np.histogram(x, 20, (0, 1))[0] - 1000).max() < 150 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.03
    z = np.array([r.z for r in df.select(variates.normal("s", F.col("id")).alias("z")).collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z > 1.645).mean() - 0.05) < 0.006
    other = df.select(variates.uniform("t", F.col("id")).alias("u"), variates.uniform("s", F.col("id")).alias("v"), variates.uniform("s", F.lit(None)).alias("w")).first()
    assert other.u != other.v and 0 < other.w < 1


def test_binomial(spark):
    from math import comb

    n, p = 9, 0.3
    cdf = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    us = [1e-9, *[float(c) + d for c in cdf[:-1] for d in (-1e-9, 1e-9)], 1 - 1e-12]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", variates.binomial_quantile(F.col("u"), F.lit(n), F.lit(p)).alias("y")).collect()
    assert all(r.y == int(np.searchsorted(cdf, r.u)) for r in got)
    ends = spark.range(1).select(*[variates.binomial_quantile(F.lit(u), F.lit(k), F.lit(q)).alias(f"c{i}") for i, (u, k, q) in enumerate([(0.5, 7, 0.0), (0.5, 7, 1.0), (0.5, 0, 0.4), (0.5, -1, 0.4), (0.5, 5, 1.5), (None, 5, 0.5)])]).first()
    assert tuple(ends) == (0, 7, 0, None, None, None)
    big = [r.y for r in spark.range(300).select(variates.binomial(F.lit(5000), F.lit(0.4), "big", F.col("id")).alias("y")).collect()]
    assert abs(np.mean(big) - 2000) < 8 and 25 < np.std(big) < 45


def test_samples_respect_weights(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 5, 6), ("a", 1, 2), ("a", 9, 1), ("b", 4, 3), ("c", 1, 0), ("a", None, 5)], "g string, v int, w int")
    table = empirical.ranges(df, ["g"], "v", "w").cache()
    assert sorted((r.g, r.v, round(r.mass, 6), round(r.hi, 6)) for r in table.collect()) == [("a", 1, 0.3, 0.3), ("a", 5, 0.6, 0.9), ("a", 9, 0.1, 1.0), ("b", 4, 1.0, 1.0)]
    rows = spark.range(6000).select("id", F.when(F.col("id") % 6 == 0, "b").when(F.col("id") % 6 == 1, "c").otherwise("a").alias("g")).withColumn("u", variates.uniform("x", F.col("id")))
    got = empirical.sample(table, ["g"], "v", rows, ["id"], "u").join(rows, "id").collect()
    assert len(got) == 5000 and {r.v for r in got if r.g == "b"} == {4}
    share = Counter(r.v for r in got if r.g == "a")
    assert set(share) == {1, 5, 9} and abs(share[1] / 4000 - 0.3) < 0.03 and abs(share[9] / 4000 - 0.1) < 0.02
    assert all((r.v == 1) == (r.u <= 0.3) for r in got if r.g == "a" and abs(r.u - 0.3) > 1e-9)
    ends = spark.createDataFrame([(k, "a", u) for k, u in enumerate((1e-16, 0.3 - 1e-15, 0.9, 1 - 1e-16, 1.0))], "id int, g string, u double")
    assert {r.id: r.v for r in empirical.sample(table, ["g"], "v", ends, ["id"], "u").collect()} == {0: 1, 1: 1, 2: 5, 3: 9, 4: 9}
    x = spark.createDataFrame([("a", 5), ("a", 2), ("d", 5)], "g string, v int")
    assert sorted(round(r.mass, 6) for r in empirical.mass(table, ["g"], "v", x).collect()) == [0.0, 0.0, 0.6]


def test_composed_samples(spark):
    two = empirical.ranges(spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "one int, v int, w int"), ["one"], "v", "w")
    none = empirical.ranges(spark.createDataFrame([(1, 0, 3), (1, 10, 1)], "one int, v int, w int"), ["one"], "v", "w")
    rows = spark.range(800).withColumn("one", F.lit(1))
    got = [r.total for r in empirical.sample_composed([(two, ["one"], "v"), (none, ["one"], "v")], rows, ["id"], "s").collect()]
    assert len(got) == 800 and {x % 10 for x in got} == {0} and max(got) <= 30 and abs(np.mean(got) - 6.25) < 0.6


def test_batches_merge_in_any_split(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3), float(x)) for k, x in enumerate(rng.normal(0.4, 0.2, 3000))] + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "k int, x double").repartition(6).cache()
    results = []
    for n in (1, 3, 7):
        for b in range(n):
            part = df.where(F.pmod(F.hash("x"), F.lit(n)) == b)
            for _ in range(1 + (b == 0)):  # a batch that runs again
                empirical.store_batch(part, f"{tmp_path}/{n}", str(b), ["k"], "x", 0.001)
        results.append({r.k: tuple(r) for r in empirical.stored(spark, f"{tmp_path}/{n}", ["k"], 0.001, (0.0, 0.1, 0.5, 1.0)).collect()})
    assert results[0] == results[1] == results[2] and sum(r[1] for r in results[0].values()) == 3000
    for k in range(3):
        x = np.array([v for g, v in rows if g == k and v is not None and v == v])
        assert results[0][k][2] == pytest.approx(x.mean(), abs=1e-12)
        assert results[0][k][3:] == pytest.approx(np.quantile(x, (0, 0.1, 0.5, 1), method="inverted_cdf"), abs=0.0011)
