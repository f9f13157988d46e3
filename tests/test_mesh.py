"""Sparse solvers, finite elements, projections and Hellinger distances against dense algebra and closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmosaic.operators import estimates, mesh, polygons, sparse


def laplacian(links, n):
    q = np.zeros((n, n))
    for a, b in links:
        q[a, a] += 1
        q[a, b] -= 1
    return q


def table(spark, links):
    return polygons.precision(spark.createDataFrame(links, "src int, dst int"))


def test_marginal_variances_of_a_path_and_a_lattice(spark):
    n = 12
    path = [(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    got = {r.i: r.var for r in sparse.marginal_variances(table(spark, path)).collect()}
    for i in range(n):  # closed form: the mean resistance to the others, less half the mean over all pairs
        resist = sum(abs(i - j) for j in range(n)) / n
        everywhere = sum(abs(a - b) for a in range(n) for b in range(n)) / (2 * n * n)
        assert got[i] == pytest.approx(resist - everywhere, rel=1e-8)
    grid = [(a, b) for a in range(20) for b in range(20) if abs(a // 5 - b // 5) + abs(a % 5 - b % 5) == 1]
    q = {(r.i, r.j): r.q for r in polygons.precision(spark.createDataFrame(grid, "src int, dst int"), scaled=True).collect()}
    dense = np.array([[q.get((a, b), 0.0) for b in range(20)] for a in range(20)])
    v = np.diag(np.linalg.pinv(dense))
    assert np.exp(np.log(v).mean()) == pytest.approx(1.0, abs=1e-8) and np.abs(dense.sum(1)).max() < 1e-9


def test_components_scale_on_their_own(spark):
    links = [(0, 1), (1, 0), (1, 2), (2, 1), (5, 6), (6, 5)]
    q = table(spark, links).unionByName(spark.createDataFrame([(9, 9, 1)], "i int, j int, q long"))
    assert {r.i: r.part for r in sparse.components(q).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 9: 9}
    v = {r.i: r.var for r in sparse.marginal_variances(q).collect()}
    assert v[5] == pytest.approx(0.25) and v[9] is None and v[1] == pytest.approx(np.linalg.pinv(laplacian(links[:4], 3))[1, 1])
    s = {(r.i, r.j): r.q for r in sparse.scaled(q).collect()}
    assert s[(5, 6)] == pytest.approx(-0.25) and s[(9, 9)] == 1.0


def test_long_chain_of_components(spark):
    links = [(i, i + 1) for i in range(120)] + [(i + 1, i) for i in range(120)]
    assert {r.part for r in sparse.components(table(spark, links)).collect()} == {0}


def test_conjugate_gradient(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 9))
    a = a @ a.T + np.eye(9)
    q = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(9) for j in range(9)], "i int, j int, q double")
    b = rng.normal(size=(9, 3))
    b[:, 2] = 0
    x = sparse.conjugate_gradient(q, spark.createDataFrame([(k, i, float(b[i, k])) for k in range(3) for i in range(9)], "k int, i int, b double"))
    got = np.zeros((9, 3))
    for r in x.collect():
        got[r.i, r.k] = r.x
    assert got == pytest.approx(np.linalg.solve(a, b), abs=1e-6)
    with pytest.raises(ArithmeticError):
        sparse.conjugate_gradient(q, spark.createDataFrame([(0, i, 1.0 + i) for i in range(9)], "k int, i int, b double"), rounds=1)


@pytest.fixture(scope="module")
def square(spark):
    """A unit square of 6 x 6 nodes, its inner ones moved, in 50 triangles."""
    rng = np.random.default_rng(2)
    nodes = [(6 * r + c, c / 5 + (rng.uniform(-0.05, 0.05) if 0 < c < 5 else 0), r / 5 + (rng.uniform(-0.05, 0.05) if 0 < r < 5 else 0)) for r in range(6) for c in range(6)]
    tri = [t for r in range(5) for c in range(5) for k in [6 * r + c] for t in ((2 * k, k, k + 1, k + 6), (2 * k + 1, k + 1, k + 7, k + 6))]
    odd = [(1000, 0, 1, 2), (1001, 0, 1, 99)]  # flat, and with a node that isn't there
    return spark.createDataFrame(nodes, "node int, x double, y double"), spark.createDataFrame(tri + odd, "tri int, a int, b int, c int"), nodes


def dense(df, n):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r.i, r.j] += r.q
    return m


def test_finite_elements(square):
    nodes, tri, xy = square
    mass, stiffness = (dense(m, 36) for m in mesh.finite_elements(nodes, tri))
    assert mass.sum() == pytest.approx(1.0) and np.abs(stiffness.sum(1)).max() < 1e-12 and stiffness == pytest.approx(stiffness.T)
    x, y = (np.array([n[k] for n in xy]) for k in (1, 2))
    f = 2 * x - 3 * y  # a linear field's energy is its squared slope times the area
    assert f @ stiffness @ f == pytest.approx(13.0)
    q = dense(mesh.precision(*mesh.finite_elements(nodes, tri), 0.4, -0.3), 36)
    k2 = np.exp(0.8)
    assert q == pytest.approx(np.exp(-0.6) * (k2 * k2 * mass + 2 * k2 * stiffness + stiffness @ np.diag(1 / np.diag(mass)) @ stiffness))
    assert np.linalg.eigvalsh(q).min() > 0


@pytest.mark.parametrize("cell", [0.01, 0.2, 30.0])
def test_projection(spark, square, cell):
    nodes, tri, xy = square
    rng = np.random.default_rng(3)
    pts = [(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(0, 1, (200, 2)))] + [(500, 0.0, 0.0), (501, 1.0, 0.37), (502, xy[14][1], xy[14][2]), (600, 1.2, 0.5), (601, -0.001, 0.5)]
    got = mesh.project(spark.createDataFrame(pts, "pid int, x double, y double"), nodes, tri, cell).collect()
    weights = {}
    for r in got:
        weights.setdefault(r.pid, {})[r.node] = r.w
    assert set(weights) == set(range(200)) | {500, 501, 502}
    at = {n: (x, y) for n, x, y in xy}
    for pid, x, y in pts[:-2]:
        w = weights[pid]
        assert len(w) == 3 and sum(w.values()) == pytest.approx(1) and min(w.values()) > -1e-8
        assert sum(v * at[n][0] for n, v in w.items()) == pytest.approx(x) and sum(v * at[n][1] for n, v in w.items()) == pytest.approx(y)
    assert max(weights[502].values()) == pytest.approx(1)
    assert mesh.project(spark.createDataFrame([], "pid int, x double, y double"), nodes, tri, cell).count() == 0


def test_matern_prior(spark):
    got = spark.range(1).select(mesh.matern_prior_log_density(F.lit(0.2), F.lit(-0.5), 3.0, 0.5, 1.0, 0.05).alias("d")).first().d
    rho, sigma = 8**0.5 / np.exp(-0.5), 1 / np.sqrt(4 * np.pi * np.exp(0.4) * np.exp(-1.0))
    assert got == pytest.approx(-2 * np.log(rho) + np.log(0.5) * 3 / rho + np.log(0.05) * sigma - 0.2 + 1.0)


def test_hellinger(spark):
    rng = np.random.default_rng(4)
    rows = [("a", True, float(x)) for x in rng.normal(0, 1, 3000)] + [("a", False, float(x)) for x in rng.normal(1, 2, 2000)]
    rows += [("b", bool(k % 2), float(x)) for k, x in enumerate(rng.gamma(2, 1, 800))] + [("c", True, 1.0), ("c", True, 2.0), ("c", False, None)] + [("d", bool(k % 2), 5.0 * (k % 2) + k % 7 / 100) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, s boolean, x double")
    normal = {r.g: r.distance for r in estimates.hellinger_normal(df, "g", "x", F.col("s")).collect()}
    closed = np.sqrt(1 - np.sqrt(2 * 1 * 2 / 5) * np.exp(-1 / 20))
    assert normal["a"] == pytest.approx(closed, abs=0.02) and normal["c"] is None and normal["d"] == pytest.approx(1.0, abs=1e-6)
    kernel = {r.g: r.distance for r in estimates.hellinger_kernel(df, "g", "x", F.col("s")).collect()}
    assert kernel["c"] is None and kernel["d"] == pytest.approx(1.0, abs=1e-3)
    for g in "ab":
        sides = [np.array([x for h, t, x in rows if h == g and t == s]) for s in (True, False)]
        at = np.linspace(-15, 20, 7001)
        band = [0.9 * len(x) ** -0.2 * min(x.std(ddof=1), np.subtract(*np.quantile(x, (0.75, 0.25))) / 1.34) for x in sides]
        d = [np.exp(-((at[:, None] - x) ** 2) / (2 * h * h)).sum(1) / (len(x) * h * np.sqrt(2 * np.pi)) for x, h in zip(sides, band, strict=True)]
        assert kernel[g] == pytest.approx(np.sqrt(1 - np.sqrt(d[0] * d[1]).sum() * (at[1] - at[0])), abs=0.003)
    q = spark.createDataFrame([(0.0,), (0.5,), (0.8,), (1.0,)], "q double").select("q", estimates.bernoulli_at(estimates.hellinger_bernoulli(F.col("q"))).alias("r"), estimates.hellinger_bernoulli(F.col("q")).alias("h")).collect()
    assert all(r.r == pytest.approx(max(r.q, 1 - r.q), abs=1e-7) for r in q) and q[0].h == pytest.approx(0.541196, abs=1e-6)


def test_stiffness_is_summed_in_all_tasks(spark, square):
    nodes, tri = square[:2]
    assert mesh.finite_elements(nodes, tri)[1].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
