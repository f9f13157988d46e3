"""Queries over random variates, empirical distributions, meshes, medoids and refined grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.functions import variates
from fieldmosaic.operators import empirical, estimates, integration, mesh, overlay, polygons, strata
from fieldmosaic.plans.catalog import GRID, URBAN, _from, draws, grid, query, rounded
from fieldmosaic.plans.estimation import AROUND, CELLS, LINKS, squares
from fieldmosaic.plans.engines import binomial_sql, normal_sql, uniform_sql


@query(f"SELECT pixel, round({normal_sql('u')}, 9) z, round({normal_sql('v')}, 9) tail FROM (SELECT pixel, {uniform_sql('pixels', 'pixel', 'area')} u, pow({uniform_sql('pixels', 'pixel')}, 8) v FROM ({GRID}) g) x")
def normal_draws(spark, sf_dir):
    g, k = grid(spark, sf_dir), F.col("pixel")
    return g.select("pixel", F.round(variates.normal("pixels", k, F.col("area")), 9).alias("z"), F.round(variates.normal_quantile(F.pow(variates.uniform("pixels", k), F.lit(8))), 9).alias("tail"))


@query(f"""WITH g AS (SELECT pixel, k draw, 1 + pixel % 25 n, 0.01 + 0.97 * prev p FROM ({GRID}) x CROSS JOIN range(0, 4) t(k)), u AS (SELECT *, {uniform_sql('noise', 'pixel', 'draw')} u FROM g),
c AS (SELECT pixel, draw, n, u, sum({binomial_sql('k', 'n', 'p')}) OVER (PARTITION BY pixel, draw ORDER BY k) c FROM u CROSS JOIN range(0, 26) t(k) WHERE k <= n)
SELECT pixel, CAST(draw AS INTEGER) draw, round(least(max(n), sum(CASE WHEN c < u THEN 1 ELSE 0 END)) / CAST(max(n) AS DOUBLE), 6) rate FROM c GROUP BY 1, 2""")
def binom_noise(spark, sf_dir):
    g = grid(spark, sf_dir).select("pixel", (1 + F.col("pixel") % 25).alias("n"), (0.01 + 0.97 * F.col("prev")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("draw"))
    return g.select("pixel", "draw", F.round(variates.binomial(F.col("n"), F.col("p"), "noise", F.col("pixel"), F.col("draw")) / F.col("n"), 6).alias("rate"))


WEIGHED = "SELECT c_nationkey AS area, CAST(floor(CAST(c_acctbal AS DOUBLE) / 100) AS BIGINT) AS v, c_custkey % 5 AS w FROM customer"
STEPS = f"h AS (SELECT area, v, sum(w) w FROM ({WEIGHED}) x WHERE w > 0 GROUP BY 1, 2), s AS (SELECT area, v, w, sum(w) OVER (PARTITION BY area ORDER BY v) c, sum(w) OVER (PARTITION BY area) t FROM h)"


def weighed(spark, sf_dir):
    return empirical.ranges(_from(spark, sf_dir, WEIGHED), ["area"], "v", "w")


@query(f"WITH {STEPS}, r AS (SELECT c_custkey, c_nationkey area, {uniform_sql('sample', 'c_custkey')} u FROM customer) SELECT c_custkey, min(v) v FROM r JOIN s ON r.area = s.area AND c >= u * t GROUP BY 1")
def sample_ecdf(spark, sf_dir):
    rows = _from(spark, sf_dir, "SELECT c_custkey, c_nationkey AS area FROM customer").withColumn("u", variates.uniform("sample", F.col("c_custkey")))
    return empirical.sample(weighed(spark, sf_dir), ["area"], "v", rows, ["c_custkey"], "u")


@query(f"WITH {STEPS} SELECT s_suppkey, round(coalesce(w / t, 0), 9) mass FROM (SELECT s_suppkey, s_nationkey, CAST(floor(CAST(s_acctbal AS DOUBLE) / 100) AS BIGINT) v FROM supplier) x LEFT JOIN s ON s.area = x.s_nationkey AND s.v = x.v")
def ecdf_mass(spark, sf_dir):
    rows = _from(spark, sf_dir, "SELECT s_suppkey, s_nationkey AS area, CAST(floor(CAST(s_acctbal AS DOUBLE) / 100) AS BIGINT) AS v FROM supplier")
    return empirical.mass(weighed(spark, sf_dir), ["area"], "v", rows).select("s_suppkey", F.round("mass", 9).alias("mass"))


LINES = "SELECT l_linenumber AS n, count(*) AS w FROM lineitem GROUP BY l_linenumber"
PARTS = "SELECT p_size % 4 AS n, count(*) AS w FROM part GROUP BY p_size % 4"


@query(f"""WITH a AS (SELECT n, sum(w) OVER (ORDER BY n) c, sum(w) OVER () t FROM ({LINES}) x), b AS (SELECT n, sum(w) OVER (ORDER BY n) c, sum(w) OVER () t FROM ({PARTS}) y),
r AS (SELECT s_suppkey, {uniform_sql('households-0', 's_suppkey', '1')} u FROM supplier), f AS (SELECT s_suppkey, min(n) n FROM r JOIN a ON c >= u * t GROUP BY 1), e AS (SELECT s_suppkey, k FROM f CROSS JOIN range(1, 50) q(k) WHERE k <= n),
m AS (SELECT s_suppkey, k, {uniform_sql('households-1', 's_suppkey', 'k')} u FROM e), g AS (SELECT s_suppkey, k, min(n) n FROM m JOIN b ON c >= u * t GROUP BY 1, 2) SELECT s_suppkey, CAST(sum(n) AS BIGINT) total FROM g GROUP BY 1""")
def sample_composed(spark, sf_dir):
    tables = [(empirical.ranges(_from(spark, sf_dir, sql).withColumn("one", F.lit(1)), ["one"], "n", "w"), ["one"], "n") for sql in (LINES, PARTS)]
    return empirical.sample_composed(tables, _from(spark, sf_dir, "SELECT s_suppkey, 1 AS one FROM supplier"), ["s_suppkey"], "households")


WIDTH = 0.001


@query(f"""WITH x AS (SELECT label, unnest(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) v FROM embeddings WHERE embedding IS NOT NULL), b AS (SELECT label, floor(v / {WIDTH}) bin, count(*) n, sum(v) s FROM x GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY bin) up, sum(n) OVER (PARTITION BY label) t FROM b), q AS (SELECT *, unnest([0.1, 0.5, 0.9]) p FROM c)
SELECT label, CAST(max(t) AS BIGINT) n, round(sum(CASE WHEN p = 0.5 THEN s END) / max(t), 6) mean, {', '.join(f"round(max(CASE WHEN p = {p} AND up >= t * p AND up - n < t * p THEN (bin + (t * p - up + n) / n) * {WIDTH} END), 6) q{k + 1}" for k, p in enumerate((0.1, 0.5, 0.9)))} FROM q GROUP BY label""")
def merged_draws(spark, sf_dir):
    d = draws(spark, sf_dir)
    batches = [d.select("label", F.explode(F.slice("draws", at, 20)).alias("x")) for at in (1, 21, 41, 61)]
    parts = [empirical.partials(b, ["label"], "x", WIDTH) for b in batches]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return rounded(empirical.merged(both, ["label"], WIDTH, (0.1, 0.5, 0.9)), "label", "n")


#: Customers as nodes of a mesh, forty in a row, and two triangles to the right of and above each.
NODES = "SELECT c_custkey AS node, c_custkey % 40 + ((c_custkey * 7919) % 101) / CAST(330 AS DOUBLE) AS x, floor(c_custkey / CAST(40 AS DOUBLE)) + ((c_custkey * 6007) % 103) / CAST(330 AS DOUBLE) AS y FROM customer"
TRIANGLES = "SELECT 2 * c_custkey AS tri, c_custkey AS a, c_custkey + 1 AS b, c_custkey + 40 AS c FROM customer WHERE c_custkey % 40 < 39 UNION ALL SELECT 2 * c_custkey + 1, c_custkey + 1, c_custkey + 41, c_custkey + 40 FROM customer WHERE c_custkey % 40 < 39"
CORNERS = f"no AS ({NODES}), t AS ({TRIANGLES}), g AS (SELECT tri, a, b, c, p.x ax, p.y ay, q.x bx, q.y \"by\", r.x cx, r.y cy, (q.x - p.x) * (r.y - p.y) - (r.x - p.x) * (q.y - p.y) k FROM t JOIN no p ON p.node = a JOIN no q ON q.node = b JOIN no r ON r.node = c)"
FEM = f"""{CORNERS}, l AS (SELECT tri, a AS n, cx - bx ex, cy - "by" ey, abs(k) k FROM g UNION ALL SELECT tri, b, ax - cx, ay - cy, abs(k) FROM g UNION ALL SELECT tri, c, bx - ax, "by" - ay, abs(k) FROM g),
m AS (SELECT n, sum(k) / 6 m FROM l GROUP BY n), s AS (SELECT u.n i, v.n j, sum((u.ex * v.ex + u.ey * v.ey) / (2 * u.k)) s FROM l u JOIN l v ON u.tri = v.tri GROUP BY 1, 2)"""


def elements(spark, sf_dir):
    return mesh.finite_elements(_from(spark, sf_dir, NODES), _from(spark, sf_dir, TRIANGLES))


@query(f"WITH {FEM} SELECT i, j, round(s, 6) stiffness, round(CASE WHEN i = j THEN m ELSE 0 END, 6) mass FROM s JOIN m ON m.n = i")
def finite_elements(spark, sf_dir):
    mass, stiffness = elements(spark, sf_dir)
    both = stiffness.withColumnRenamed("q", "stiffness").join(mass.withColumnRenamed("q", "mass"), ["i", "j"], "left")
    return both.select("i", "j", F.round("stiffness", 6).alias("stiffness"), F.round(F.coalesce("mass", F.lit(0.0)), 6).alias("mass"))


@query(f"WITH {FEM}, z AS (SELECT u.i, v.j, sum(u.s * v.s / m) q FROM s u JOIN m ON m.n = u.j JOIN s v ON v.i = u.j GROUP BY 1, 2) SELECT z.i, z.j, round(exp(0.6) * (exp(-0.8) * CASE WHEN z.i = z.j THEN m ELSE 0 END + 2 * exp(-0.4) * coalesce(s, 0) + z.q), 4) q FROM z JOIN m ON m.n = z.i LEFT JOIN s ON s.i = z.i AND s.j = z.j")
def spde_q(spark, sf_dir):
    return mesh.precision(*elements(spark, sf_dir), -0.2, 0.3).select("i", "j", F.round("q", 4).alias("q"))


#: Integration points around clusters, drawn to the mesh.
ON_MESH = f"{AROUND}, w AS (SELECT pixel * 100 + k pid, 5 + px * 0.25 x, 1 + py * 0.02 y, w FROM q)"


@query(f"""WITH {ON_MESH}, {CORNERS}, h AS (SELECT pid, w, tri, a, b, c, ((bx - x) * (cy - y) - (cx - x) * ("by" - y)) / k wa, ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / k wb FROM w JOIN g ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, "by", cy) AND greatest(ay, "by", cy)),
z AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tri) r FROM h WHERE wa >= -1e-9 AND wb >= -1e-9 AND 1 - wa - wb >= -1e-9), f AS (SELECT pid, unnest([a, b, c]) node, unnest([wa, wb, 1 - wa - wb]) v, w FROM z WHERE r = 1) SELECT pid, node, round(v * w, 7) w FROM f""")
def jitter_data_spde(spark, sf_dir):
    q = integration.around(grid(spark, sf_dir).select("pixel", "urban", "east", "north"), integration.rings(spark))
    p = q.select((F.col("pixel") * 100 + F.col("k")).alias("pid"), (5 + F.col("px") * 0.25).alias("x"), (1 + F.col("py") * 0.02).alias("y"), F.col("w").alias("share"))
    a = mesh.project(p, _from(spark, sf_dir, NODES), _from(spark, sf_dir, TRIANGLES), 1.0)
    return a.join(p.select("pid", "share"), "pid").select("pid", "node", F.round(F.col("w") * F.col("share"), 7).alias("w"))


@query(f"""WITH RECURSIVE {LINKS}, n AS (SELECT list(poly ORDER BY poly) ids FROM c), e AS (SELECT list(v ORDER BY i) a FROM (SELECT x.poly i, list(CASE WHEN x.poly = y.poly THEN d.n WHEN greatest(abs(x.cx - y.cx), abs(x.cy - y.cy)) = 1 THEN -1 ELSE 0 END + 1 / CAST(25 AS DOUBLE) ORDER BY y.poly) v FROM c x CROSS JOIN c y JOIN (SELECT src, count(*) n FROM l GROUP BY 1) d ON d.src = x.poly GROUP BY x.poly) r),
s AS (SELECT 1 AS k, a FROM e UNION ALL SELECT k + 1, list_transform(a, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = k AND j = k THEN 1 / a[k][k] WHEN i = k THEN v / a[k][k] WHEN j = k THEN -v / a[k][k] ELSE v - r[k] * a[k][j] / a[k][k] END)) FROM s WHERE k <= 25),
f AS (SELECT exp(list_avg(list_transform(a, lambda r, i: ln(r[i] - 1 / CAST(25 AS DOUBLE))))) f FROM s WHERE k = 26) SELECT src i, src j, round(count(*) * max(f), 6) q FROM l CROSS JOIN f GROUP BY src UNION ALL SELECT src, dst, round(-f, 6) FROM l CROSS JOIN f""")
def besag_q_scaled(spark, sf_dir):
    return polygons.precision(polygons.neighbours(squares(spark, sf_dir)), scaled=True).select("i", "j", F.round("q", 6).alias("q"))


@query(f"SELECT region, round(sqrt(1 - sqrt(2 * sqrt(v * u) / (v + u)) * exp(-pow(m - n, 2) / (4 * (v + u)))), 6) distance FROM (SELECT region, avg(CASE WHEN urban THEN pop END) m, avg(CASE WHEN NOT urban THEN pop END) n, var_samp(CASE WHEN urban THEN pop END) v, var_samp(CASE WHEN NOT urban THEN pop END) u FROM ({GRID}) g GROUP BY region) s")
def hellinger_normal(spark, sf_dir):
    return rounded(estimates.hellinger_normal(grid(spark, sf_dir), "region", "pop", F.col("urban")), "region")


@query(f"""WITH g AS (SELECT region, urban, pop FROM ({GRID}) x), b AS (SELECT region, urban, count(*) n, 0.9 * pow(count(*), -0.2) * least(stddev_samp(pop), (quantile_cont(pop, 0.75) - quantile_cont(pop, 0.25)) / 1.34) h FROM g GROUP BY 1, 2), w AS (SELECT region, min(h) / 8 w FROM b GROUP BY 1),
c AS (SELECT g.region, g.urban, floor(pop / w + 0.5) bin, count(*) c, max(h) h, max(n) n, max(w) w FROM g JOIN b ON g.region = b.region AND g.urban = b.urban JOIN w ON w.region = g.region GROUP BY 1, 2, 3),
d AS (SELECT region, bin + o AS spot, max(w) w, sum(CASE WHEN urban THEN c * exp(-pow(o * w / h, 2) / 2) / (n * h) END) d1, sum(CASE WHEN NOT urban THEN c * exp(-pow(o * w / h, 2) / 2) / (n * h) END) d0 FROM c CROSS JOIN range(-400, 401) r(o) WHERE abs(o) <= ceil(5 * h / w) GROUP BY 1, 2)
SELECT region, round(sqrt(1 - least(1, sum(sqrt(d0 * d1) * w) / sqrt(2 * pi()))), 6) distance FROM d GROUP BY region""")
def hellinger_kernel(spark, sf_dir):
    return rounded(estimates.hellinger_kernel(grid(spark, sf_dir), "region", "pop", F.col("urban")), "region")


@query(f"SELECT pixel, round(sqrt(greatest(0, 1 - sqrt((1 - prev) / 2) - sqrt(prev / 2))), 6) h, round(greatest(prev, 1 - prev), 4) q FROM ({GRID}) g")
def hellinger_bernoulli(spark, sf_dir):
    h = estimates.hellinger_bernoulli(F.col("prev"))
    return grid(spark, sf_dir).select("pixel", F.round(h, 6).alias("h"), F.round(estimates.bernoulli_at(h), 4).alias("q"))


MEDOID_POINTS = f"SELECT area AS stratum, urban, pixel AS id, pop AS weight, east / 50 AS a, prev AS b FROM ({GRID}) g WHERE area < 12"


def _exchanges_sql(rounds: int) -> str:
    """From each stratum's best medoid and the best one beside it, the best pair that shares one of them, and so on."""
    out = ["s0 AS (SELECT c.stratum, c.urban, m, k, cost FROM c JOIN f ON c.stratum = f.stratum AND c.urban = f.urban AND f.o IN (m, k) QUALIFY row_number() OVER (PARTITION BY c.stratum, c.urban ORDER BY cost, m, k) = 1)"]
    for r in range(rounds):
        out.append(f"s{r + 1} AS (SELECT c.stratum, c.urban, c.m, c.k, c.cost FROM c JOIN s{r} s ON c.stratum = s.stratum AND c.urban = s.urban AND (c.m IN (s.m, s.k) OR c.k IN (s.m, s.k)) QUALIFY row_number() OVER (PARTITION BY c.stratum, c.urban ORDER BY c.cost, c.m, c.k) = 1)")
    return ", ".join(out)


@query(f"""WITH p AS ({MEDOID_POINTS}), d AS (SELECT x.stratum, x.urban, x.id, y.id o, x.weight w, pow(x.a - y.a, 2) + pow(x.b - y.b, 2) d FROM p x JOIN p y ON x.stratum = y.stratum AND x.urban = y.urban),
c AS (SELECT u.stratum, u.urban, u.o m, v.o k, sum(u.w * least(u.d, v.d)) cost FROM d u JOIN d v ON u.stratum = v.stratum AND u.urban = v.urban AND u.id = v.id AND u.o < v.o GROUP BY 1, 2, 3, 4),
f AS (SELECT stratum, urban, o FROM d GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY stratum, urban ORDER BY sum(w * d), o) = 1), {_exchanges_sql(10)}
SELECT f.stratum, f.urban, round(coalesce(cost, 0), 4) cost, coalesce(m, f.o) low, coalesce(k, f.o) high FROM f LEFT JOIN s10 s ON s.stratum = f.stratum AND s.urban = f.urban""")
def mics_kmedoids(spark, sf_dir):
    p = _from(spark, sf_dir, MEDOID_POINTS)
    both = p.withColumn("stratum", F.struct("stratum", "urban"))
    m = strata.medoids(both, ("a", "b"), 2)
    far = both.select(F.col("stratum").alias("s"), F.col("id").alias("m"), F.col("a").alias("ma"), F.col("b").alias("mb"))
    held = m.join(both.select("stratum", "id", "a", "b"), ["stratum", "id"]).join(far, (F.col("s") == F.col("stratum")) & (far["m"] == m["m"]))
    d = (F.col("a") - F.col("ma")) ** 2 + (F.col("b") - F.col("mb")) ** 2
    return held.groupBy("stratum").agg(F.sum(F.col("weight") * d).alias("cost"), F.min(m["m"]).alias("low"), F.max(m["m"]).alias("high")).select("stratum.stratum", "stratum.urban", F.round("cost", 4).alias("cost"), "low", "high")


#: Each nation's square in cells of 2.5 by 2.5, those that have customers; one in eleven lacks a covariate.
CELL = f"SELECT c_nationkey * 16 + c_custkey % 16 AS pixel, c_nationkey AS stratum, c_nationkey * 4 + c_custkey % 4 AS subarea, 2 * sum(CASE WHEN {URBAN} THEN 1 ELSE 0 END) > count(*) AS urban, (c_nationkey % 5) * 10 + (c_custkey % 4) * 2.5 + 1.25 AS east, floor(c_nationkey / CAST(5 AS DOUBLE)) * 10 + floor(c_custkey % 16 / CAST(4 AS DOUBLE)) * 2.5 + 1.25 AS north, sum(CAST(c_acctbal AS DOUBLE) + 1000) AS pop, (c_nationkey + c_custkey % 16 * 7) % 11 <> 0 AS complete FROM customer GROUP BY c_nationkey, c_custkey % 16, c_custkey % 4"
LEAST, MOST, START = 9, 40, 3.0


def _refined_sql(rounds: int) -> str:
    """The rounds of steps one after the other: a lattice, its points' pixels in their stratum, and the next steps."""
    out = [f"c AS ({CELLS}), px AS (SELECT pixel, stratum, subarea, urban, CAST(east AS DOUBLE) east, north, pop, complete FROM ({CELL}) q), s0 AS (SELECT DISTINCT stratum, urban, CAST({START} AS DOUBLE) step, true AS \"open\" FROM px WHERE pop > 0 AND complete)"]
    for r in range(rounds):
        seen = f'SELECT s.stratum, s.urban, s.step, s."open", i * s.step x, j * s.step y, cx * 10 + i * s.step ax, cy * 10 + j * s.step ay, i, j FROM s{r} s JOIN c ON c.poly = s.stratum CROSS JOIN range(0, 60) a(i) CROSS JOIN range(0, 60) b(j) WHERE i * s.step < 10 AND j * s.step < 10'
        cell = "abs(l.ax - px.east) < 1.25 OR l.ax = px.east + 1.25"
        out.append(f"l{r} AS ({seen}), w{r} AS (SELECT l.stratum, l.urban, l.i, l.j, px.pixel, row_number() OVER (PARTITION BY l.stratum, l.urban, l.i, l.j ORDER BY CASE WHEN ({cell}) AND (abs(l.ay - px.north) < 1.25 OR l.ay = px.north + 1.25) THEN 0 ELSE 1 END, pow(l.ax - px.east, 2) + pow(l.ay - px.north, 2), px.pixel) k FROM l{r} l JOIN px ON px.stratum = l.stratum)")
        out.append(f"g{r} AS (SELECT w.stratum, w.urban, w.i, w.j, px.pixel, px.subarea, px.pop FROM w{r} w JOIN px ON px.pixel = w.pixel WHERE k = 1 AND px.urban = w.urban AND px.complete AND px.pop > 0), n{r} AS (SELECT s.stratum, s.urban, count(g.i) n FROM s{r} s LEFT JOIN g{r} g ON s.stratum = g.stratum AND s.urban = g.urban GROUP BY 1, 2)")
        out.append(f's{r + 1} AS (SELECT s.stratum, s.urban, CASE WHEN n < {LEAST} THEN step / 2 WHEN n > {MOST} THEN step * 1.1 ELSE step END step, n < {LEAST} OR n > {MOST} AS "open" FROM s{r} s JOIN n{r} n ON s.stratum = n.stratum AND s.urban = n.urban)')
    return ", ".join(out)


#: Rounds after which all strata are within the bounds.
REFINED = 9


@query(f"""WITH {_refined_sql(REFINED)}, t AS (SELECT stratum, subarea, urban, sum(pop) t FROM px GROUP BY 1, 2, 3), h AS (SELECT stratum, urban, subarea, sum(pop) s FROM g{REFINED - 1} GROUP BY 1, 2, 3)
SELECT g.stratum, g.urban, CAST(count(*) AS BIGINT) n, round(max(s.step), 6) step, round(sum(g.pop * t.t / h.s), 3) pop, CAST(sum(g.pixel) AS BIGINT) pixels FROM g{REFINED - 1} g JOIN s{REFINED} s ON s.stratum = g.stratum AND s.urban = g.urban JOIN t ON t.stratum = g.stratum AND t.urban = g.urban AND t.subarea = g.subarea JOIN h ON h.stratum = g.stratum AND h.urban = g.urban AND h.subarea = g.subarea GROUP BY 1, 2""")
def mics_fine_grid(spark, sf_dir):
    pixels = _from(spark, sf_dir, CELL).withColumn("east", F.col("east").cast("double"))
    edges = squares(spark, sf_dir).select("poly", F.lit(0).alias("ring"), "x1", "y1", "x2", "y2")
    fine = strata.fine_grid(edges, pixels, 2.5, START, LEAST, MOST)
    return fine.groupBy("stratum", "urban").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("step"), 6).alias("step"), F.round(F.sum("pop"), 3).alias("pop"), F.sum("pixel").alias("pixels"))


@query(f"""WITH p AS ({MEDOID_POINTS}), d AS (SELECT x.stratum, x.urban, y.id o, sum(x.weight * (pow(x.a - y.a, 2) + pow(x.b - y.b, 2))) cost FROM p x JOIN p y ON x.stratum = y.stratum AND x.urban = y.urban GROUP BY 1, 2, 3),
m AS (SELECT stratum, urban, o FROM d WHERE urban OR stratum <> 3 QUALIFY row_number() OVER (PARTITION BY stratum, urban ORDER BY cost, o) = 1), f AS (SELECT stratum, unnest([true, false]) urban FROM (SELECT DISTINCT stratum FROM p) q), l AS (SELECT stratum, min(o) o FROM m GROUP BY 1)
SELECT f.stratum, f.urban, coalesce(m.o, l.o) id, CASE WHEN m.o IS NULL THEN 0.0 ELSE 1.0 END w FROM f LEFT JOIN m ON f.stratum = m.stratum AND f.urban = m.urban JOIN l ON l.stratum = f.stratum""")
def mics_points(spark, sf_dir):
    p = _from(spark, sf_dir, MEDOID_POINTS).where("urban OR stratum <> 3")  # one stratum without rural points
    return strata.integration_points(p, ("a", "b"), 1).select("stratum", "urban", "id", "w")


#: Each region's rectangle, which lies across nations' squares.
BORDER = "SELECT r_regionkey AS poly, 3.3 + r_regionkey * 7 AS x, 5.1 + r_regionkey * 3 AS y, 31.0 AS w, 18.0 - r_regionkey AS h FROM region"


@query(f"WITH c AS ({CELLS}), b AS ({BORDER}), o AS (SELECT c.poly, b.poly AS other, least(cx * 10 + 10, x + w) - greatest(cx * 10, x) dx, least(cy * 10 + 10, y + h) - greatest(cy * 10, y) dy FROM c CROSS JOIN b) SELECT poly, other, round(CAST(dx * dy AS DOUBLE), 6) area FROM o WHERE dx > 0 AND dy > 0")
def polygon_intersect(spark, sf_dir):
    b = _from(spark, sf_dir, BORDER).select("poly", *[F.col(c).cast("double") for c in "xywh"])
    at = lambda x, y: ((F.col("x") + x * F.col("w")), (F.col("y") + y * F.col("h")))
    ends = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    rows = [F.struct(*[c.alias(n) for n, c in zip(overlay.ENDS, (*at(*e[:2]), *at(*e[2:])), strict=True)]) for e in ends]
    border = b.select("poly", F.inline(F.array(*rows)))
    return overlay.common_areas(squares(spark, sf_dir).drop("parent"), border, 10.0).select("poly", "other", F.round("area", 6).alias("area"))
