"""Queries over the given tables, each with SQL that another engine can check it with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.functions import scalar
from fieldmosaic.operators import aggregate, clean, frame, integration, scores, spatial, survey
from fieldmosaic.plans.engines import uniform_sql

QUERIES: dict = {}
SQL: dict = {}

URBAN = "c_mktsegment IN ('BUILDING', 'AUTOMOBILE')"
#: Clusters as grid points: customers with an area, a population and coordinates.
GRID = f"""SELECT c_custkey AS pixel, n_nationkey AS area, n_regionkey AS region, {URBAN} AS urban, CAST(c_acctbal AS DOUBLE) + 1000 AS pop,
  ((c_custkey * 37) % 1000) / CAST(10 AS DOUBLE) AS east, ((c_custkey * 91) % 1000) / CAST(10 AS DOUBLE) AS north,
  ((c_custkey * 7919) % 101) / CAST(101 AS DOUBLE) AS prev FROM customer JOIN nation ON c_nationkey = n_nationkey"""
PEOPLE = f"""SELECT c_nationkey AS area, {URBAN} AS urban, c_custkey AS cluster, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(l_quantity AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
DRAWS = "SELECT vec_id, label, embedding, CAST(label AS DOUBLE) / 10 AS truth FROM embeddings WHERE embedding IS NOT NULL"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TABLES = ("customer", "nation", "region", "lineitem", "orders", "embeddings", "events", "part", "supplier")
NAMED_TABLES = re.compile(rf"\b(FROM|JOIN)(\s+)({'|'.join(TABLES)})\b(?!\s*\.)", re.IGNORECASE)


def _from(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the given tables, which are read where their names follow FROM or JOIN."""
    return spark.sql(NAMED_TABLES.sub(lambda m: f"{m[1]}{m[2]}parquet.`{sf_dir}/{m[3].lower()}.parquet`", sql))


def grid(spark, sf_dir):
    return _from(spark, sf_dir, GRID)


def people(spark, sf_dir):
    return _from(spark, sf_dir, PEOPLE)


def draws(spark, sf_dir):
    return _from(spark, sf_dir, DRAWS).withColumn("draws", F.transform("embedding", lambda x: x.cast("double")))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[c if c in keep else F.round(F.col(c), 6).alias(c) for c in df.columns])


AREAS = """SELECT area, sum(pop * prev) z, sum(pop) n, sum(CASE WHEN urban THEN pop * prev ELSE 0 END) zu, sum(CASE WHEN urban THEN pop ELSE 0 END) nu,
  sum(CASE WHEN urban THEN 0 ELSE pop * prev END) zr, sum(CASE WHEN urban THEN 0 ELSE pop END) nr FROM g GROUP BY area"""


@query(f"WITH g AS ({GRID}), a AS ({AREAS}) SELECT area, round(z, 3) z, round(n, 3) n, round(z / nullif(n, 0), 6) p, round(zu / nullif(nu, 0), 6) p_urb, round(zr / nullif(nr, 0), 6) p_rur FROM a")
def agg_area(spark, sf_dir):
    a = aggregate.agg_area(grid(spark, sf_dir), "area", F.col("pop") * F.col("prev"), F.col("pop"), F.col("urban"))
    return a.select("area", F.round("z", 3).alias("z"), F.round("n", 3).alias("n"), *[F.round(c, 6).alias(c) for c in ("p", "p_urb", "p_rur")])


@query(f"WITH g AS ({GRID}) SELECT region, round(sum(pop * prev), 3) z, round(sum(pop), 3) n, round(sum(pop * prev) / sum(pop), 6) p FROM g GROUP BY region")
def agg_area_to_area(spark, sf_dir):
    g = grid(spark, sf_dir)
    a = aggregate.agg_area(g, "area", F.col("pop") * F.col("prev"), F.col("pop"), F.col("urban"))
    mapping = _from(spark, sf_dir, "SELECT n_nationkey AS area, n_regionkey AS region FROM nation")
    return aggregate.roll_up(a, mapping, "area", "region").select("region", F.round("z", 3).alias("z"), F.round("n", 3).alias("n"), F.round("p", 6).alias("p"))


@query(f"WITH g AS ({GRID}), k AS (SELECT n_nationkey area FROM nation), u AS (SELECT true urban UNION ALL SELECT false) SELECT k.area, u.urban, CAST(count(g.pixel) AS BIGINT) n FROM k CROSS JOIN u LEFT JOIN g ON g.area = k.area AND g.urban = u.urban AND g.region <> 2 GROUP BY 1, 2")
def count_by_strata_complete(spark, sf_dir):
    return aggregate.count_complete(grid(spark, sf_dir).where("region <> 2"), "area", "urban", _from(spark, sf_dir, "SELECT n_nationkey AS area FROM nation"))


@query(f"SELECT cluster, min(area) area, bool_or(urban) urban, CAST(sum(y) AS BIGINT) y, CAST(count(*) AS BIGINT) n, sum(w) w FROM ({PEOPLE}) p GROUP BY cluster")
def cluster_agg(spark, sf_dir):
    return people(spark, sf_dir).groupBy("cluster").agg(F.min("area").alias("area"), F.bool_or("urban").alias("urban"), F.sum("y").cast("long").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(f"WITH g AS ({GRID}) SELECT area, CAST(sum(CASE WHEN urban THEN 1 ELSE 0 END) AS BIGINT) ea_urb, CAST(sum(CASE WHEN urban THEN 0 ELSE 1 END) AS BIGINT) ea_rur, CAST(count(*) AS BIGINT) ea_total, CAST(sum(CASE WHEN urban THEN 25 ELSE 0 END) AS BIGINT) hh_urb, CAST(sum(CASE WHEN urban THEN 0 ELSE 25 END) AS BIGINT) hh_rur, CAST(count(*) * 25 AS BIGINT) hh_total, round(sum(CASE WHEN urban THEN pop ELSE 0 END), 3) pop_urb, round(sum(CASE WHEN urban THEN 0 ELSE pop END), 3) pop_rur, round(sum(pop), 3) pop_total FROM g GROUP BY area")
def frame_from_survey(spark, sf_dir):
    f = frame.frame_of_clusters(grid(spark, sf_dir), "area", "urban", "pop")
    return f.select(*[F.round(c, 3).alias(c) if c.startswith("pop") else c for c in f.columns])


@query(f"WITH g AS ({GRID}), t AS (SELECT s_nationkey area, CAST(count(*) * 1000 AS DOUBLE) target FROM supplier GROUP BY 1) SELECT g.pixel, round(CASE WHEN t.target IS NULL THEN g.pop WHEN sum(g.pop) OVER w = 0 THEN t.target / count(*) OVER w ELSE g.pop * t.target / sum(g.pop) OVER w END, 6) calibrated FROM g LEFT JOIN t ON g.area = t.area WINDOW w AS (PARTITION BY g.area)")
def calibrate(spark, sf_dir):
    totals = _from(spark, sf_dir, "SELECT s_nationkey AS area, CAST(count(*) * 1000 AS DOUBLE) AS target FROM supplier GROUP BY s_nationkey")
    done = aggregate.calibrate(grid(spark, sf_dir).join(totals, "area", "left"), ["area"], "pop", "target")
    return done.select("pixel", F.round("calibrated", 6).alias("calibrated"))


@query(f"WITH g AS ({GRID}), c AS (SELECT area, pop, sum(pop) OVER (PARTITION BY area ORDER BY pop RANGE UNBOUNDED PRECEDING) c, sum(pop) OVER (PARTITION BY area) t FROM g) SELECT area, CASE WHEN area IN (3, 7) THEN CAST('-Infinity' AS DOUBLE) ELSE min(CASE WHEN c >= t * 0.6 THEN pop END) END threshold FROM c GROUP BY area")
def urban_threshold(spark, sf_dir):
    return aggregate.threshold_by_share(grid(spark, sf_dir).withColumn("share", F.lit(0.4)), "area", "pop", "share", (3, 7))


@query(f"WITH s AS (SELECT cluster, sum(w) v1, sum(w * w) v2, sum(w * y) s1, sum(w * y * y) s2 FROM ({PEOPLE}) p GROUP BY cluster) SELECT cluster, round(s1 / v1, 6) mean, round((s2 - s1 * s1 / v1) / nullif(v1 - v2 / v1, 0), 6) var FROM s")
def weighted_mean_var(spark, sf_dir):
    return rounded(aggregate.weighted_moments(people(spark, sf_dir), "cluster", F.col("y"), F.col("w")), "cluster")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf_dir):
    right = _from(spark, sf_dir, "SELECT r_regionkey AS n_regionkey, r_name, r_regionkey AS ord FROM region")
    return clean.first_match_join(_from(spark, sf_dir, "SELECT n_name, n_regionkey FROM nation"), right, "n_regionkey", "ord").select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT c_custkey FROM customer").join(_from(spark, sf_dir, "SELECT o_custkey AS c_custkey FROM orders"), "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT c_custkey FROM customer").join(_from(spark, sf_dir, "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F'"), "c_custkey", "left_anti")


FILL = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment ELSE '' END AS seg FROM customer"


@query(f"WITH f AS ({FILL}), k AS (SELECT *, count(nullif(seg, '')) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) i FROM f) SELECT c_custkey, max(nullif(seg, '')) OVER (PARTITION BY c_nationkey, i) filled FROM k")
def fill_down(spark, sf_dir):
    return clean.fill_down(_from(spark, sf_dir, FILL), ["c_nationkey"], "c_custkey", "seg").select("c_custkey", "filled")


NAMES = "SELECT p_partkey, p_name, CAST(p_size AS STRING) AS state FROM part"


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ',' || CAST(p_size AS VARCHAR) ELSE p_name END unique_name FROM part")
def dedupe_names(spark, sf_dir):
    return clean.dedupe_names(_from(spark, sf_dir, NAMES), "p_name", "state").select("p_partkey", "unique_name")


@query("WITH p AS (SELECT c_custkey, CAST((c_custkey * 37) % 1000 AS DOUBLE) / 10 AS pct FROM customer) SELECT c_custkey, CASE WHEN pct < 0.3 THEN 0.0::DOUBLE WHEN pct > 99.7 THEN 100.0::DOUBLE ELSE pct END pct FROM p")
def threshold_pct(spark, sf_dir):
    p = _from(spark, sf_dir, "SELECT c_custkey, CAST((c_custkey * 37) % 1000 AS DOUBLE) / 10 AS pct FROM customer")
    return p.select("c_custkey", clean.threshold_pct(F.col("pct")).alias("pct"))


@query("WITH d AS (SELECT DISTINCT o_custkey, o_orderkey k FROM orders), g AS (SELECT *, k - row_number() OVER (PARTITION BY o_custkey ORDER BY k) g FROM d) SELECT o_custkey, min(k) first, max(k) last, CAST(count(*) AS BIGINT) n FROM g GROUP BY o_custkey, g")
def gaps_islands(spark, sf_dir):
    return clean.gaps_islands(_from(spark, sf_dir, "SELECT o_custkey, o_orderkey AS k FROM orders"), ["o_custkey"], "k")


@query("SELECT n_nationkey, array_to_string(list_transform(regexp_extract_all(lower(n_name || '-' || n_name || '/x y'), '[^ /\\-]+|[ /\\-]'), lambda x: upper(x[1]) || x[2:]), '') titled FROM nation")
def title_case(spark, sf_dir):
    n = _from(spark, sf_dir, "SELECT n_nationkey, concat(n_name, '-', n_name, '/x y') AS s FROM nation")
    return n.select("n_nationkey", scalar.title_case(F.col("s")).alias("titled"))


POINTS = "SELECT s_suppkey AS pid, s_nationkey AS area, ((s_suppkey * 53) % 997) / CAST(10 AS DOUBLE) AS x, ((s_suppkey * 71) % 991) / CAST(10 AS DOUBLE) AS y FROM supplier"


D2 = "(x - east) * (x - east) + (y - north) * (y - north)"


@query(f"""WITH p AS ({POINTS}), g AS ({GRID}), m AS (SELECT pid, min(pixel) pixel, count(*) n, min({D2}) d2 FROM p JOIN g ON east - 2.5 < x AND x <= east + 2.5 AND north - 2.5 < y AND y <= north + 2.5 GROUP BY pid),
d AS (SELECT pid, pixel, {D2} d2, row_number() OVER (PARTITION BY pid ORDER BY {D2}, pixel) k FROM p CROSS JOIN g) SELECT d.pid, CASE WHEN m.n = 1 THEN m.pixel ELSE d.pixel END pixel, coalesce(m.n = 1, FALSE) exact, sqrt(CASE WHEN m.n = 1 THEN m.d2 ELSE d.d2 END) > 1.5 far FROM d LEFT JOIN m ON d.pid = m.pid WHERE k = 1""")
def cell_range_join(spark, sf_dir):
    p = _from(spark, sf_dir, POINTS).select("pid", F.col("x").alias("px"), F.col("y").alias("py"))
    g = grid(spark, sf_dir).select("pixel", F.col("east").alias("gx"), F.col("north").alias("gy"))
    return spatial.cell_or_nearest(p, g, 5.0, "pid", "pixel", 1.5).select("pid", "pixel", "exact", "far")


@query(f"WITH p AS ({POINTS}), g AS ({GRID}), d AS (SELECT pid, pixel, {D2} d2, row_number() OVER (PARTITION BY pid ORDER BY {D2}, pixel) k FROM p JOIN g ON p.area = g.area) SELECT p.pid, pixel, round(sqrt(d2), 6) dist FROM p LEFT JOIN d ON p.pid = d.pid AND k = 1")
def nearest_join(spark, sf_dir):
    p = _from(spark, sf_dir, POINTS).select("pid", "area", F.col("x").alias("px"), F.col("y").alias("py"))
    g = grid(spark, sf_dir).select("pixel", "area", F.col("east").alias("gx"), F.col("north").alias("gy"))
    return spatial.nearest(p, g, 5.0, "pid", "pixel", ("area",)).withColumn("dist", F.round("dist", 6))


@query(f"WITH p AS ({POINTS}), g AS ({GRID}) SELECT pid, round(ln(sqrt(min({D2})) + 1), 6) log_dist FROM p CROSS JOIN g GROUP BY pid")
def nn_distance(spark, sf_dir):
    p = _from(spark, sf_dir, POINTS).select("pid", F.col("x").alias("px"), F.col("y").alias("py"))
    g = grid(spark, sf_dir).select("pixel", F.col("east").alias("gx"), F.col("north").alias("gy"))
    return spatial.nearest(p, g, 5.0, "pid", "pixel").select("pid", F.round(F.log(F.col("dist") + 1), 6).alias("log_dist"))


@query(f"WITH p AS ({POINTS}), b(poly, a, c, b, d) AS (VALUES (1, 10, 10, 50, 60), (2, 40, 40, 90, 95)), m AS (SELECT pid, min(poly) poly, CAST(count(*) AS BIGINT) n FROM p JOIN b ON x >= a AND x < b.b AND y >= c AND y < d GROUP BY pid) SELECT p.pid, m.poly, coalesce(m.n, 0) n_poly FROM p LEFT JOIN m ON p.pid = m.pid")
def pip_join(spark, sf_dir):
    boxes = [(1, 10.0, 10.0, 50.0, 60.0), (2, 40.0, 40.0, 90.0, 95.0)]
    edges = [(k, *e) for k, a, c, b, d in boxes for e in ((a, c, b, c), (b, c, b, d), (b, d, a, d), (a, d, a, c))]
    return spatial.point_in_polygon(_from(spark, sf_dir, POINTS).select("pid", "x", "y"), spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double"), 20.0)


@query("SELECT c_custkey, h hh, CASE WHEN h > 5 - c_custkey % 6 THEN 1 ELSE 0 END y_hh FROM customer, range(1, 6) t(h)")
def expand_binary(spark, sf_dir):
    c = _from(spark, sf_dir, "SELECT c_custkey, CAST(c_custkey % 6 AS INT) AS y, 5 AS n FROM customer")
    return survey.expand_binary(c, "y", "n").select("c_custkey", F.col("hh").cast("long").alias("hh"), "y_hh")


@query(f"""WITH p AS ({PEOPLE}), c AS (SELECT area, urban, cluster, sum(w * y) wy, sum(w) w FROM p GROUP BY 1, 2, 3), e AS (SELECT area, sum(wy) / sum(w) est, sum(w) sw FROM c GROUP BY area),
nh AS (SELECT urban, count(DISTINCT cluster) nh FROM p GROUP BY urban), z AS (SELECT c.area, c.urban, (wy - est * w) / (sw * est * (1 - est)) z FROM c JOIN e ON c.area = e.area),
h AS (SELECT area, urban, sum(z) sz, sum(z * z) szz FROM z GROUP BY 1, 2), v AS (SELECT area, sum(CASE WHEN nh > 1 THEN nh / (nh - 1) * (szz - sz * sz / nh) ELSE szz END) v FROM h JOIN nh ON h.urban = nh.urban GROUP BY area)
SELECT e.area, round(est, 6) est, round(ln(est / (1 - est)), 6) logit_est, round(v, 6) logit_var FROM e JOIN v ON e.area = v.area""")
def direct_est(spark, sf_dir):
    return rounded(survey.direct_estimates(people(spark, sf_dir), "area", "urban", "cluster", F.col("y"), F.col("w")), "area")


HASHED = "(c_custkey * 1103515245 + 12345) % 2147483648"


@query(f"SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey, {URBAN} ORDER BY {HASHED}, c_custkey) - 1 + floor(10 * {uniform_sql('folds', 'c_nationkey', f'CAST({URBAN} AS VARCHAR)')})) % 10 + 1 AS INTEGER) fold FROM customer")
def strat_kfold(spark, sf_dir):
    c = _from(spark, sf_dir, f"SELECT c_custkey, c_nationkey, {URBAN} AS urban, {HASHED} AS h FROM customer")
    return survey.stratified_folds(c, ["c_nationkey", "urban"], F.col("h") / 2147483648, [F.col("c_custkey")], 10).select("c_custkey", F.col("fold").cast("int").alias("fold"))


@query(f"WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {HASHED}, c_custkey) k, count(*) OVER (PARTITION BY c_nationkey) n FROM customer) SELECT c_custkey, round(n / least(n, 5), 6) weight FROM r WHERE k <= 5")
def srs_sample(spark, sf_dir):
    c = _from(spark, sf_dir, f"SELECT c_custkey, c_nationkey, {HASHED} AS h FROM customer")
    return survey.srs_sample(c, ["c_nationkey"], [F.col("h"), F.col("c_custkey")], 5).select("c_custkey", F.round("weight", 6).alias("weight"))


D_SQL = "WITH d AS (SELECT vec_id, label, CAST(label AS DOUBLE) / 10 truth, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) d FROM embeddings WHERE embedding IS NOT NULL)"


@query(D_SQL + ", e AS (SELECT vec_id, truth, unnest(d) x FROM d), s AS (SELECT a.vec_id, avg(abs(a.x - b.x)) g FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1), t AS (SELECT vec_id, avg(abs(x - truth)) g FROM e GROUP BY 1) SELECT t.vec_id, round(t.g - s.g / 2, 6) crps FROM t JOIN s ON t.vec_id = s.vec_id")
def crps_ensemble(spark, sf_dir):
    return draws(spark, sf_dir).select("vec_id", F.round(scores.crps_ensemble("draws", F.col("truth")), 6).alias("crps"))


@query(D_SQL + ", e AS (SELECT label, list_avg(d) - truth e, vec_id % 4 w FROM d) SELECT label, round(sum(w * e) / sum(w), 6) bias, round(sum(w * e * e) / sum(w), 6) mse, round(sum(w * e * e) / sum(w) - pow(sum(w * e) / sum(w), 2), 6) var, round(sqrt(sum(w * e * e) / sum(w)), 6) rmse FROM e GROUP BY label")
def mse(spark, sf_dir):
    e = draws(spark, sf_dir).select("label", (F.col("vec_id") % 4).alias("w"), (scores.mean("draws") - F.col("truth")).alias("error"))
    return rounded(scores.weighted_errors(e, ["label"], "w"), "label")


@query(D_SQL + """, e AS (SELECT vec_id, label % 5 y, unnest(d) * 40 eta, 1 / CAST(len(d) AS DOUBLE) w FROM d), t AS (SELECT vec_id, ln(w) - (greatest(-eta, 0) + ln(1 + exp(-abs(eta)))) * y - (greatest(eta, 0) + ln(1 + exp(-abs(eta)))) * (9 - y)
  + ln([1, 9, 36, 84, 126][y + 1]) t FROM e), m AS (SELECT vec_id, max(t) m FROM t GROUP BY 1) SELECT t.vec_id, round(max(m) + ln(sum(exp(t - m))), 5) loglik FROM t JOIN m ON t.vec_id = m.vec_id GROUP BY t.vec_id""")
def mix_loglik(spark, sf_dir):
    e = draws(spark, sf_dir).select("vec_id", (F.col("label") % 5).alias("y"), F.lit(9).alias("n"), (F.lit(1.0) / F.size("draws")).alias("w"), F.explode("draws").alias("x")).withColumn("eta", F.col("x") * 40)
    return integration.mixture_likelihood(e, "vec_id").select("vec_id", F.round("loglik", 5).alias("loglik"))


@query(f"WITH g AS ({GRID}) SELECT pixel, round(1 / (1 + exp(-(prev * 4 - 2))), 6) expit, round(1 / (1 + exp(-((prev * 4 - 2) / sqrt(1 + pow(16 * sqrt(3) / (15 * pi()), 2) * 0.25)))), 6) lnm FROM g")
def logit_normal(spark, sf_dir):
    x = F.col("prev") * 4 - 2
    return grid(spark, sf_dir).select("pixel", F.round(scalar.expit(x), 6).alias("expit"), F.round(scalar.logit_normal_mean(x, F.lit(0.5)), 6).alias("lnm"))
