"""Queries over draws of parameters, scores of predictions, and design-based estimates made from them."""

from __future__ import annotations

from math import exp
from statistics import NormalDist

from pyspark.sql import functions as F

from fieldmosaic.functions import integrals, projection, scalar, spline
from fieldmosaic.operators import estimates, predict, scores, survey
from fieldmosaic.plans.catalog import GRID, HASHED, PEOPLE, URBAN, D_SQL, _from, draws, grid, people, query, rounded
from fieldmosaic.plans.engines import binomial_sql, normal_cdf_sql, normal_sql, uniform_sql

#: Draws of parameters: twelve of each.
N = 12
PARAMS = f"SELECT CAST(k AS INTEGER) AS draw, -1.0 + ((k * 7) % 11) / CAST(10 AS DOUBLE) AS alpha, ((k * 5) % 7 - 3) / CAST(10 AS DOUBLE) AS beta, 0.2 + ((k * 3) % 5) / CAST(10 AS DOUBLE) AS sigma FROM range(0, {N}) t(k)"
EFFECTS = f"SELECT n_nationkey AS area, CAST(k AS INTEGER) AS draw, ((n_nationkey * 31 + k * 17) % 23 - 11) / CAST(20 AS DOUBLE) AS w FROM nation CROSS JOIN range(0, {N}) t(k)"
#: A finer rule than the library's, of 129 nodes.
NODES = f"SELECT CAST(i AS DOUBLE) AS i, exp(-i * i / CAST(128 AS DOUBLE)) / {sum(exp(-i * i / 128) for i in range(-64, 65))!r} AS q FROM range(-64, 65) t(i)"
PIXELS = f"SELECT pixel, area, urban, pop, east / 100 - 0.5 AS x FROM ({GRID}) g"
RISK = f"""pr AS ({PARAMS}), ef AS ({EFFECTS}), no AS ({NODES}), px AS ({PIXELS}),
r AS (SELECT px.pixel, px.area, px.urban, px.pop, pr.draw, sum(q / (1 + exp(-(alpha + w + beta * x + sigma * i / 8)))) p FROM px JOIN ef ON px.area = ef.area JOIN pr ON pr.draw = ef.draw CROSS JOIN no GROUP BY 1, 2, 3, 4, 5)"""


def params(spark):
    held = spark.sql(PARAMS).agg(F.array_sort(F.collect_list(F.struct("draw", "alpha", "beta", "sigma"))).alias("v"))
    return held.select(F.col("v.alpha").alias("alpha"), F.col("v.beta").alias("beta_x"), F.col("v.sigma").alias("sigma"))


def risks(spark, sf_dir):
    effects = predict.area_effects(_from(spark, sf_dir, EFFECTS), "area", "draw", "w")
    return predict.predict_grid(_from(spark, sf_dir, PIXELS), effects, params(spark), "area", ("x",))


@query(f"WITH {RISK} SELECT pixel, round(avg(p), 6) mean, round(quantile_cont(p, 0.1), 6) q1, round(quantile_cont(p, 0.9), 6) q2 FROM r GROUP BY pixel")
def pred_grid(spark, sf_dir):
    return rounded(predict.summarised(risks(spark, sf_dir).select("pixel", "draws"), "draws", (0.1, 0.9)), "pixel")


@query(f"WITH {RISK} SELECT area, draw, round(sum(pop * p) / sum(pop), 6) p, round(sum(CASE WHEN urban THEN pop * p END) / sum(CASE WHEN urban THEN pop END), 6) p_urb, round(sum(CASE WHEN NOT urban THEN pop * p END) / sum(CASE WHEN NOT urban THEN pop END), 6) p_rur FROM r GROUP BY 1, 2")
def predict_area(spark, sf_dir):
    return rounded(predict.predict_areas(risks(spark, sf_dir), "area", "pop", F.col("urban")), "area", "draw")


@query(f"WITH {RISK} SELECT area, round(avg(p), 6) mean, round(quantile_cont(p, 0.1), 6) q1, round(quantile_cont(p, 0.9), 6) q2 FROM (SELECT area, draw, sum(pop * p) / sum(pop) p FROM r WHERE area % 5 = 2 GROUP BY 1, 2) s GROUP BY area")
def pred_stratum(spark, sf_dir):
    some = risks(spark, sf_dir).where("area % 5 = 2")
    a = predict.predict_areas(some, "area", "pop", F.col("urban")).groupBy("area").agg(F.array_sort(F.collect_list("p")).alias("draws"))
    return rounded(predict.summarised(a, "draws", (0.1, 0.9)), "area")


CLUSTERS = "SELECT CAST(c_custkey % 50 AS BIGINT) AS cluster, 5 + c_custkey % 50 % 30 AS size, (c_custkey % 7 + 1) / CAST(8 AS DOUBLE) AS w, (c_custkey % 13 - 6) / CAST(4 AS DOUBLE) AS e FROM customer"
NOISE = f"""WITH pr AS ({PARAMS}), g AS ({CLUSTERS}), k AS (SELECT DISTINCT cluster, draw, sigma FROM g CROSS JOIN pr), u AS (SELECT *, {uniform_sql("sites-nugget", "cluster", "draw")} u FROM k), z AS (SELECT cluster, draw, sigma * {normal_sql("u")} z FROM u),
p AS (SELECT g.cluster, pr.draw, max(size) n, sum(w / (1 + exp(-(e + alpha + z)))) / sum(w) p FROM g CROSS JOIN pr JOIN z ON z.cluster = g.cluster AND z.draw = pr.draw GROUP BY 1, 2)"""


def noisy_clusters(spark, sf_dir, size=None):
    pts = _from(spark, sf_dir, CLUSTERS).join(F.broadcast(params(spark)))  # one row of draws
    return predict.predict_clusters(pts.withColumn("eta", F.transform("alpha", lambda a: a + F.col("e"))), "cluster", "w", "eta", "sigma", "sites", size)


@query(f"{NOISE} SELECT cluster, draw, round(p, 6) p FROM p")
def pred_cluster(spark, sf_dir):
    return rounded(noisy_clusters(spark, sf_dir), "cluster", "draw")


@query(f"{NOISE}, v AS (SELECT *, {uniform_sql('sites-binomial', 'cluster', 'draw')} u FROM p), c AS (SELECT cluster, draw, n, u, k, sum({binomial_sql('k', 'n', 'p')}) OVER (PARTITION BY cluster, draw ORDER BY k) c FROM v CROSS JOIN range(0, 36) t(k) WHERE k <= n) SELECT cluster, draw, CAST(least(max(n), sum(CASE WHEN c < u THEN 1 ELSE 0 END)) AS INTEGER) y, round(least(max(n), sum(CASE WHEN c < u THEN 1 ELSE 0 END)) / CAST(max(n) AS DOUBLE), 6) rate FROM c GROUP BY 1, 2")
def pred_cluster_binomial(spark, sf_dir):
    return noisy_clusters(spark, sf_dir, "size").select("cluster", "draw", "y", F.round("rate", 6).alias("rate"))


#: Draws of a fit's parameters as a table: three components of each vector.
FITTED = "SELECT vec_id % 3 AS model, vec_id % 5 AS fold, CAST(embedding[{}] AS DOUBLE) AS alpha, CAST(embedding[{}] AS DOUBLE) * 2 AS beta, exp(CAST(embedding[{}] AS DOUBLE)) AS sigma FROM embeddings WHERE embedding IS NOT NULL"


@query(f"WITH p AS ({FITTED.format(1, 2, 3)}), l AS (SELECT 'alpha' AS name, alpha AS x FROM p UNION ALL SELECT 'beta', beta FROM p UNION ALL SELECT 'sigma', sigma FROM p) SELECT name, round(avg(x), 6) mean, round(quantile_cont(x, 0.025), 6) q1, round(quantile_cont(x, 0.5), 6) q2, round(quantile_cont(x, 0.975), 6) q3 FROM l GROUP BY name")
def param_summary(spark, sf_dir):
    return rounded(predict.summarise_parameters(_from(spark, sf_dir, FITTED.format(0, 1, 2)), ("alpha", "beta", "sigma")), "name")


@query(f"WITH f AS (SELECT model, fold, avg(alpha) alpha, avg(beta) beta, avg(sigma) sigma FROM ({FITTED.format(1, 2, 3)}) p GROUP BY 1, 2) SELECT model, round(avg(alpha), 6) alpha, round(avg(beta), 6) beta, round(avg(sigma), 6) sigma FROM f GROUP BY 1")
def param_avg(spark, sf_dir):
    names = ["alpha", "beta", "sigma"]
    folds = predict.average_parameters(_from(spark, sf_dir, FITTED.format(0, 1, 2)), ["model", "fold"], names)
    return rounded(predict.average_parameters(folds, ["model"], names), "model")


@query(f"WITH e AS ({EFFECTS}), t AS (SELECT draw, sum(w * 2) s FROM e GROUP BY draw) SELECT area, e.draw, round(w - s / 25 * 0.5, 6) w FROM e JOIN t ON e.draw = t.draw")
def sum_to_zero(spark, sf_dir):
    e = _from(spark, sf_dir, EFFECTS).withColumn("structured", F.col("w") * 2)
    return predict.centred(e, "draw", "w", F.lit(1 / 25), F.lit(0.5)).select("area", "draw", F.round("w", 6).alias("w"))


@query(f"WITH g AS (SELECT pixel, ln(1 + pop) p, sqrt(east) e, north n FROM ({GRID}) x), m AS (SELECT avg(p) mp, stddev_samp(p) sp, avg(e) me, stddev_samp(e) se, avg(n) mn, stddev_samp(n) sn FROM g) SELECT pixel, round((p - mp) / sp, 6) pop, round((e - me) / se, 6) east, round((n - mn) / sn, 6) north FROM g CROSS JOIN m")
def design_mat(spark, sf_dir):
    return rounded(predict.design(grid(spark, sf_dir).select("pixel", "pop", "east", "north"), ("pop",), ("east",), ("north",)), "pixel")


@query(f"WITH no AS ({NODES}) SELECT pixel, round(sum(q / (1 + exp(-(prev * 4 - 2 + (pixel % 5) * 0.5 * i / 8)))), 6) m, round(sum(q * pow(1 / (1 + exp(-(prev * 4 - 2 + (pixel % 5) * 0.5 * i / 8))), 2)) - pow(sum(q / (1 + exp(-(prev * 4 - 2 + (pixel % 5) * 0.5 * i / 8)))), 2), 6) v FROM ({GRID}) g CROSS JOIN no GROUP BY pixel")
def logit_normal_exact(spark, sf_dir):
    mu, sigma = F.col("prev") * 4 - 2, (F.col("pixel") % 5) * 0.5
    held = grid(spark, sf_dir).select("pixel", integrals.logit_normal_moments(mu, sigma).alias("z"))
    return held.select("pixel", F.round("z.m", 6).alias("m"), F.round("z.v", 6).alias("v"))


@query(f"WITH no AS ({NODES}) SELECT pixel, round(sum(q / (1 + exp(-(east / 8 - 6 + ((pixel % 4) * 0.7) * i / 8)))), 8) p FROM ({GRID}) g CROSS JOIN no GROUP BY pixel")
def logit_normal_spline(spark, sf_dir):
    g = grid(spark, sf_dir).select("pixel", (F.col("east") / 8 - 6).alias("mu"), (F.col("pixel") % 4 * 0.7).cast("double").alias("sigma"))
    return spline.spline_means(g, "mu", "sigma", "p").select("pixel", F.round("p", 8).alias("p"))


@query(D_SQL + f", no AS ({NODES}), e AS (SELECT vec_id, unnest(d[1:4]) m, unnest([0.1, 0.5, 1.0, 2.0]) s, unnest([1, 2, 3, 4]) k FROM d), g AS (SELECT vec_id, k, sum(q / (1 + exp(-(m + s * i / 8)))) p FROM e CROSS JOIN no GROUP BY 1, 2) SELECT vec_id, round(sum(p * k), 6) total FROM g GROUP BY vec_id")
def logit_normal_grouped(spark, sf_dir):
    sigmas = F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0, 2.0)])
    p = integrals.logit_normal_means(F.slice("draws", 1, 4), sigmas)
    return draws(spark, sf_dir).select("vec_id", F.round(F.aggregate(F.transform(p, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"SELECT pixel, round(1 / (1 + exp(-x)), 9) expit2, round(CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END, 6) logit, CASE WHEN p <= 0 THEN -1 WHEN p >= 1 THEN 1 ELSE 0 END bound FROM (SELECT pixel, (east - 50) * 3 x, prev * 1.1 - 0.05 p FROM ({GRID}) g) v")
def logit_forms(spark, sf_dir):
    held = grid(spark, sf_dir).select("pixel", ((F.col("east") - 50) * 3).alias("x"), scalar.logit(F.col("prev") * 1.1 - 0.05).alias("l"))
    return held.select("pixel", F.round(scalar.expit2(F.col("x")), 9).alias("expit2"), F.round(F.when(F.abs("l") < float("inf"), F.col("l")), 6).alias("logit"), F.when(F.abs("l") < float("inf"), 0).otherwise(F.signum("l").cast("int")).alias("bound"))


RATE = integrals.pc_precision_rate(1.0, 0.1)


@query(f"SELECT pixel, round(ln({RATE!r}) - ln(2) - 1.5 * t - {RATE!r} / sqrt(exp(t)), 6) prec, round({RATE!r} / (2 * sqrt(v)) * exp(-{RATE!r} * sqrt(v)), 6) var_d, round(1 - exp(-{RATE!r} * sqrt(v)), 6) var_p, round(pow(ln(1 - u) / {RATE!r}, 2), 6) var_q FROM (SELECT pixel, east / 15 - 3 t, north / 20 + 0.05 v, prev * 0.99 u FROM ({GRID}) r) x")
def pc_prec(spark, sf_dir):
    t, v, u = F.col("east") / 15 - 3, F.col("north") / 20 + 0.05, F.col("prev") * 0.99
    return rounded(grid(spark, sf_dir).select("pixel", integrals.pc_precision_log_density(t, RATE).alias("prec"), integrals.pc_variance_density(v, RATE).alias("var_d"), integrals.pc_variance_cdf(v, RATE).alias("var_p"), integrals.pc_variance_quantile(u, RATE).alias("var_q")), "pixel")


SCALES = [0.3, 0.6, 1.0, 1.7, 2.5]


@query(f"""WITH p AS (SELECT pixel, 0.02 + prev * 0.97 phi FROM ({GRID}) g), s AS (SELECT unnest({SCALES}) - 1 g), d AS (SELECT pixel, sqrt(phi * sum(g) - sum(ln(1 + phi * g))) d, (sum(g) - sum(g / (1 + phi * g))) / 2 slope FROM p CROSS JOIN s GROUP BY pixel, phi)
SELECT pixel, round(d, 6) distance, round(ln(2) - 2 * d + ln(abs(slope)) - ln(d), 6) density FROM d""")
def pc_phi(spark, sf_dir):
    phi = 0.02 + F.col("prev") * 0.97
    return rounded(grid(spark, sf_dir).select("pixel", integrals.mixing_distance(phi, SCALES).alias("distance"), integrals.mixing_log_density(phi, SCALES, 2.0).alias("density")), "pixel")


@query(f"SELECT pixel, round(exp(-2 * d * 0.07), 6) nu_half, round((1 + sqrt(12) * d * 0.07) * exp(-sqrt(12) * d * 0.07), 6) nu_three_halves FROM (SELECT pixel, sqrt(pow(east - 50, 2) + pow(north - 50, 2)) d FROM ({GRID}) g) x")
def matern(spark, sf_dir):
    d = F.hypot(F.col("east") - 50, F.col("north") - 50)
    return rounded(grid(spark, sf_dir).select("pixel", integrals.matern(d, F.lit(0.07), 0.5).alias("nu_half"), integrals.matern(d, F.lit(0.07), 1.5).alias("nu_three_halves")), "pixel")


@query(f"SELECT pixel, round(3 + east / 20, 6) lon, round(4 + north / 12, 6) lat FROM ({GRID}) g")
def projection_round_trip(spark, sf_dir):
    g = grid(spark, sf_dir).select("pixel", *[c.alias(n) for c, n in zip(projection.to_km(3 + F.col("east") / 20, 4 + F.col("north") / 12), ("e", "n"), strict=True)])
    lon, lat = projection.to_degrees(F.col("e"), F.col("n"))
    return g.select("pixel", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


#: The projection's series in SQL, for the library's own zone.
ZONE = projection.Zone()
E_OF = 2 * ZONE.n**0.5 / (1 + ZONE.n)


def _km_sql(lon: str, lat: str, src: str) -> str:
    north = " + ".join(f"{a!r} * sin(2 * {j} * xi) * cosh(2 * {j} * eta)" for j, a in enumerate(ZONE.forward(), 1))
    east = " + ".join(f"{a!r} * cos(2 * {j} * xi) * sinh(2 * {j} * eta)" for j, a in enumerate(ZONE.forward(), 1))
    k = ZONE.scale * ZONE.unit
    return f"(SELECT *, {ZONE.east_km!r} + {k!r} * (eta + {east}) x, {ZONE.north_km!r} + {k!r} * (xi + {north}) y FROM (SELECT *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta FROM (SELECT *, sinh(atanh(sin(radians({lat}))) - {E_OF!r} * atanh({E_OF!r} * sin(radians({lat})))) t, radians({lon} - {ZONE.meridian!r}) lam FROM {src}) a) b)"


ORIGIN = _km_sql("lon", "lat", f"(SELECT {ZONE.meridian!r} lon, {ZONE.parallel!r} lat) o")


@query(f"WITH g AS (SELECT area, 3 + east / 20 lon, 4 + north / 12 lat FROM ({GRID}) g), b AS (SELECT area, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 FROM g GROUP BY area), s AS (SELECT area, unnest([x0 + k / 19.0 * (x1 - x0), x0 + k / 19.0 * (x1 - x0), x0, x1]) lon, unnest([y0, y1, y0 + k / 19.0 * (y1 - y0), y0 + k / 19.0 * (y1 - y0)]) lat FROM b CROSS JOIN range(0, 20) r(k)), p AS {_km_sql('lon', 'lat', 's')}, o AS {ORIGIN} SELECT area, round(min(p.x), 5) x0, round(max(p.x), 5) x1, round(min(p.y) - max(o.y), 5) y0, round(max(p.y) - max(o.y), 5) y1 FROM p CROSS JOIN o GROUP BY area")
def projected_boxes(spark, sf_dir):
    g = _from(spark, sf_dir, f"SELECT area, 3 + east / 20 AS lon, 4 + north / 12 AS lat FROM ({GRID}) g")
    boxes = g.groupBy("area").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    got = projection.box_to_km(boxes, "area", points=20)
    return got.select("area", *[F.round(c, 5).alias(c) for c in ("x0", "x1", "y0", "y1")])


WHOLE = "WITH d AS (SELECT vec_id, label, label - 5 AS truth, list_transform(embedding, lambda x: CAST(floor(x * 20) AS DOUBLE)) d FROM embeddings WHERE embedding IS NOT NULL)"
LEVELS = (0.5, 0.8)


def _interval_sql(level: float) -> str:
    t, n = (1 - level) / 2, round(100 * level)
    share = lambda c: f"len(list_filter(d, lambda x: {c})) / CAST(len(d) AS DOUBLE)"
    rej = lambda end, beyond: f"CASE WHEN truth = {end} THEN CASE WHEN {share(f'x = {end}')} > 0 THEN greatest(0, least(1, ({t!r} - {share(f'x {beyond} {end}')}) / ({share(f'x = {end}')}))) ELSE 0.5 END ELSE 0 END"
    return f"""q{n} AS (SELECT *, list_aggregate(d, 'quantile_cont', {t!r}) lo, list_aggregate(d, 'quantile_cont', {1 - t!r}) hi FROM d), r{n} AS (SELECT *, {rej('lo', '<')} rl, {rej('hi', '>')} rh FROM q{n}),
m{n} AS (SELECT vec_id, label, truth, lo, hi, lo + 0.25 * rl a, hi - 0.25 * rh b, rl + rh rr FROM r{n}), s{n} AS (SELECT vec_id, label, b - a width, b - a + {2 / (1 - level)!r} * CASE WHEN truth < lo THEN a - truth WHEN truth > hi THEN truth - b ELSE 0 END score, CASE WHEN truth BETWEEN lo AND hi THEN 1 - least(1, rr) ELSE 0 END cover FROM m{n})"""


def whole_draws(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT vec_id, label, label - 5 AS truth, embedding FROM embeddings WHERE embedding IS NOT NULL").withColumn("draws", F.transform("embedding", lambda x: F.floor(x.cast("double") * 20).cast("double")))


@query(WHOLE.replace("x * 20", "CAST(x AS DOUBLE) * 20") + ", " + ", ".join(_interval_sql(x) for x in LEVELS) + " SELECT a.vec_id, round(a.score, 6) score50, round(a.cover, 6) cover50, round(a.width, 6) width50, round(b.score, 6) score80, round(b.cover, 6) cover80, round(b.width, 6) width80 FROM s50 a JOIN s80 b ON a.vec_id = b.vec_id")
def interval_score(spark, sf_dir):
    s = scores.scored(whole_draws(spark, sf_dir), "draws", F.col("truth"), F.lit(0.25), LEVELS)
    return rounded(s.select("vec_id", *[f"{n}{x}" for x in (50, 80) for n in ("score", "cover", "width")]), "vec_id")


CRPS = "list_avg(list_transform(d, lambda x: abs(x - truth))) - list_sum(list_transform(list_sort(d), lambda x, i: x * (2 * i - len(d) - 1))) / (len(d) * len(d))"
SCORED = WHOLE.replace("x * 20", "CAST(x AS DOUBLE) * 20") + f", {', '.join(_interval_sql(x) for x in LEVELS)}, cr AS (SELECT vec_id, list_avg(d) - truth e, {CRPS} crps FROM d), " + """e AS (SELECT d.vec_id, d.label, cr.e, cr.crps, a.score score50, a.cover cover50, a.width width50, b.score score80, b.cover cover80, b.width width80, d.vec_id % 3 + 1 w, d.vec_id % 2 AS model, d.vec_id % 5 AS fold, d.vec_id % 7 < 3 AS urban, (d.vec_id * 7919 % 1009) / CAST(10 AS DOUBLE) AS dist FROM d JOIN cr ON cr.vec_id = d.vec_id JOIN s50 a ON a.vec_id = d.vec_id JOIN s80 b ON b.vec_id = d.vec_id)"""
COLUMNS = ("crps", "score50", "cover50", "width50", "score80", "cover80", "width80")
AVERAGED = "round(sum(w * e) / sum(w), 6) bias, round(sum(w * e * e) / sum(w), 6) mse, round(sum(w * e * e) / sum(w) - pow(sum(w * e) / sum(w), 2), 6) var, round(sqrt(sum(w * e * e) / sum(w)), 6) rmse, " + ", ".join(f"round(sum(w * {c}) / sum(w), 6) {c}" for c in COLUMNS)


def all_scored(spark, sf_dir):
    v = F.col("vec_id")
    extra = {"w": v % 3 + 1, "model": v % 2, "fold": v % 5, "urban": v % 7 < 3, "dist": v * 7919 % 1009 / F.lit(10.0)}
    return scores.scored(whole_draws(spark, sf_dir).withColumns(extra), "draws", F.col("truth"), F.lit(0.25), LEVELS)


@query(f"{SCORED} SELECT label, {AVERAGED} FROM e GROUP BY label")
def get_scores(spark, sf_dir):
    return rounded(scores.average_scores(all_scored(spark, sf_dir), ["label"], "w", LEVELS), "label")


@query(f"{SCORED} SELECT model, fold, 'total' AS part, {AVERAGED} FROM e GROUP BY 1, 2 UNION ALL SELECT model, fold, CASE WHEN urban THEN 'urban' ELSE 'rural' END, {AVERAGED} FROM e GROUP BY 1, 2, 3")
def score_validation(spark, sf_dir):
    return rounded(scores.score_table(all_scored(spark, sf_dir), ["model", "fold"], "urban", "w", LEVELS), "model", "fold", "part")


@query(f"""{SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY dist) k, count(*) OVER () n FROM e), p AS (SELECT CAST(max(ceil(n / 6.0)) AS BIGINT) per, max(n) n, max(dist) top FROM o), g AS (SELECT list_concat([0.0], list_concat(list((x.dist + y.dist) / 2 ORDER BY x.k), [max(top) + 0.000001])) b FROM o x JOIN o y ON y.k = x.k + 1 CROSS JOIN p WHERE x.k % per = 0),
h AS (SELECT e.*, least(len(b) - 1, 1 + len(list_filter(b[2:len(b) - 1], lambda z: dist > z))) bin, b FROM e CROSS JOIN g) SELECT CAST(bin AS INTEGER) bin, round(max((b[bin] + b[bin + 1]) / 2), 6) center, CAST(count(*) AS BIGINT) n, {AVERAGED} FROM h GROUP BY bin""")
def scores_by_distance(spark, sf_dir):
    held = estimates.bin_by_counts(all_scored(spark, sf_dir), "dist", 6)
    counts = held.groupBy("bin").agg(F.first("center").alias("center"), F.count(F.lit(1)).alias("n"))
    return rounded(scores.average_scores(held, ["bin"], "w", LEVELS).join(counts, "bin"), "bin", "n")


@query(f"{SCORED} SELECT label, CAST(count(*) AS BIGINT) n, round(sum(w * cover50) / sum(w), 6) cover50, round(sum(w * cover80) / sum(w), 6) cover80 FROM e GROUP BY label")
def coverage(spark, sf_dir):
    s = all_scored(spark, sf_dir)
    over = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return rounded(s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[over(c).alias(c) for c in ("cover50", "cover80")]), "label", "n")


@query(f"""{SCORED}, f AS (SELECT label, vec_id % 2 survey, fold, CAST(count(*) AS DOUBLE) n, avg(e) bias, avg(CASE WHEN fold <> 3 OR label % 2 = 0 THEN crps END) crps FROM e GROUP BY 1, 2, 3), s AS (SELECT label, survey, sum(n * bias) / sum(n) bias, sum(n * crps) / sum(CASE WHEN crps IS NOT NULL THEN n END) crps FROM f GROUP BY 1, 2),
z AS (SELECT vec_id % 2 survey, CAST(sum(w) AS DOUBLE) size FROM e GROUP BY 1) SELECT label, round(sum(size * bias) / sum(size), 6) bias, round(sum(size * crps) / sum(size), 6) crps FROM s JOIN z ON s.survey = z.survey GROUP BY label""")
def weighted_fold_avg(spark, sf_dir):
    e = all_scored(spark, sf_dir).withColumn("survey", F.col("vec_id") % 2)
    kept = F.when((F.col("fold") != 3) | (F.col("label") % 2 == 0), F.col("crps"))
    f = e.groupBy("label", "survey", "fold").agg(F.avg("error").alias("bias"), F.avg(kept).alias("crps"), F.count(F.lit(1)).cast("double").alias("n"))
    within = estimates.fold_average(f, ["label", "survey"], "n", ("bias", "crps"))
    sizes = e.groupBy("survey").agg(F.sum("w").cast("double").alias("size"))
    return rounded(estimates.survey_average(within, sizes, ["label"], "survey", ("bias", "crps")), "label")


@query(f"{SCORED}, f AS (SELECT label, fold, avg(crps) crps, avg(width80) width80 FROM e GROUP BY 1, 2) SELECT label, round(avg(crps), 6) crps_mean, round(median(crps), 6) crps_median, round(avg(width80), 6) width80_mean, round(median(width80), 6) width80_median FROM f GROUP BY label")
def col_medians(spark, sf_dir):
    return rounded(estimates.over_folds(all_scored(spark, sf_dir), ["label"], "fold", ("crps", "width80")), "label")


@query(D_SQL + ", s AS (SELECT CAST(label % 4 AS BIGINT) bin, label % 2 t, CAST(count(*) AS BIGINT) n, avg(d[1]) a FROM d GROUP BY 1, 2 UNION ALL SELECT CAST(label % 3 AS BIGINT), 2, CAST(count(*) AS BIGINT), avg(d[2]) FROM d GROUP BY 1) SELECT bin, CAST(sum(n) AS BIGINT) n, round(sum(n * a) / sum(n), 6) a FROM s GROUP BY bin")
def avg_binned(spark, sf_dir):
    d = draws(spark, sf_dir)
    table = lambda bin_, at: d.groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("draws")[at]).alias("a"))
    parts = [d.where(F.col("label") % 2 == r).groupBy((F.col("label") % 4).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("draws")[0]).alias("a")) for r in (0, 1)]
    return rounded(scores.merge_binned([*parts, table(F.col("label") % 3, 1)], "bin", "n", ["a"]), "bin", "n")


TRUTHS = f"e AS (SELECT vec_id, label, truth, unnest(d[1:8]) x, unnest(range(0, 8)) k FROM d), u AS (SELECT *, {uniform_sql('left out', 'vec_id', 'k')} u FROM e), f AS (SELECT vec_id, label, x - 1 / (1 + exp(-(truth - 0.5 + 0.3 * {normal_sql('u')}))) e FROM u)"


@query(f"""{D_SQL}, {TRUTHS}, o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e) i FROM f), s AS (SELECT vec_id, label, avg(e) m, avg(abs(e)) - sum(e * (2 * i - 9)) / 64 crps, quantile_cont(e, 0.1) lo, quantile_cont(e, 0.9) hi FROM o GROUP BY 1, 2)
SELECT label, round(avg(m), 6) bias, round(avg(m * m), 6) mse, round(avg(m * m) - avg(m) * avg(m), 6) var, round(sqrt(avg(m * m)), 6) rmse, round(avg(crps), 6) crps, round(avg(hi - lo + 10 * greatest(lo, 0) + 10 * greatest(-hi, 0)), 6) score80, round(avg(CASE WHEN lo <= 0 AND hi >= 0 THEN 1.0 ELSE 0.0 END), 6) cover80, round(avg(hi - lo), 6) width80 FROM s GROUP BY label""")
def score_vs_direct(spark, sf_dir):
    d = draws(spark, sf_dir).select("vec_id", "label", F.slice("draws", 1, 8).alias("draws"), (F.col("truth") - 0.5).alias("m"), F.lit(0.3).alias("s"), F.lit(1.0).alias("w"))
    return rounded(scores.average_scores(scores.against_direct(d, "draws", "m", "s", "left out", "vec_id"), ["label"], "w", (0.8,)), "label")


@query(f"""WITH g AS (SELECT pixel, (prev - 0.5) / sqrt(0.04 + prev / 10) z, sqrt(0.04 + prev / 10) sd FROM ({GRID}) x), c AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) f, {normal_cdf_sql('z')} c, {normal_cdf_sql('(z * 4)')} far FROM g)
SELECT pixel, round(c, 9) "cdf", round(f, 6) pdf, round(far, 9) far, round(sd * (z * (2 * c - 1) + 2 * f - 1 / sqrt(pi())), 6) crps FROM c""")
def crps_gauss(spark, sf_dir):
    var = 0.04 + F.col("prev") / 10
    z = (F.col("prev") - 0.5) / F.sqrt(var)
    return grid(spark, sf_dir).select("pixel", F.round(scalar.normal_cdf(z), 9).alias("cdf"), F.round(scalar.normal_cdf(z * 4), 9).alias("far"), F.round(scalar.normal_pdf(z), 6).alias("pdf"), F.round(scores.crps_gauss(F.col("prev"), F.lit(0.5), var), 6).alias("crps"))


DIRECT = f"""p AS ({PEOPLE}), c AS (SELECT area, urban, cluster, sum(w * y) wy, sum(w) w FROM p GROUP BY 1, 2, 3), e AS (SELECT area, sum(wy) / sum(w) est, sum(w) sw FROM c GROUP BY area),
nh AS (SELECT urban, count(DISTINCT cluster) nh FROM p GROUP BY urban), z AS (SELECT c.area, c.urban, (wy - est * w) / (sw * est * (1 - est)) z FROM c JOIN e ON c.area = e.area),
h AS (SELECT area, urban, sum(z) sz, sum(z * z) szz FROM z GROUP BY 1, 2), v AS (SELECT area, sum(nh / (nh - 1) * (szz - sz * sz / nh)) v FROM h JOIN nh ON h.urban = nh.urban GROUP BY area),
de AS (SELECT e.area, ln(est / (1 - est)) m, sqrt(v) s FROM e JOIN v ON e.area = v.area)"""


def direct(spark, sf_dir):
    return survey.direct_estimates(people(spark, sf_dir), "area", "urban", "cluster", F.col("y"), F.col("w"))


#: One area without people, and two where all answers are alike.
EDGE_PEOPLE = f"SELECT area, urban, cluster, CASE WHEN area = 4 THEN 0 WHEN area = 9 THEN 1 ELSE y END AS y, w FROM ({PEOPLE}) x WHERE area <> 13"


@query(f"WITH {DIRECT.replace(PEOPLE, EDGE_PEOPLE)}, no AS ({NODES}), k AS (SELECT area, CASE WHEN est > 0 AND est < 1 AND s > 0 THEN m END m, CASE WHEN est > 0 AND est < 1 AND s > 0 THEN s END s, est FROM (SELECT e.area, est, CASE WHEN est > 0 AND est < 1 THEN ln(est / (1 - est)) END m, sqrt(v) s FROM e LEFT JOIN v ON e.area = v.area) z), f AS (SELECT n_nationkey area, m, s, est FROM nation LEFT JOIN k ON k.area = n_nationkey) SELECT area, round(CASE WHEN m IS NULL THEN max(est) ELSE sum(q / (1 + exp(-(m + s * i / 8)))) END, 6) est, round(sum(q * pow(1 / (1 + exp(-(m + s * i / 8))), 2)) - pow(sum(q / (1 + exp(-(m + s * i / 8)))), 2), 6) var, round(1 / (1 + exp(-(m - {NormalDist().inv_cdf(0.95)!r} * s))), 6) lower_90, round(1 / (1 + exp(-(m + {NormalDist().inv_cdf(0.95)!r} * s))), 6) upper_90, CASE WHEN m IS NOT NULL THEN 0 WHEN max(est) IN (0, 1) THEN 3 ELSE 1 END converge FROM f CROSS JOIN no GROUP BY area, m, s")
def get_est(spark, sf_dir):
    p = _from(spark, sf_dir, EDGE_PEOPLE)
    d = survey.direct_estimates(p, "area", "urban", "cluster", F.col("y"), F.col("w"))
    got = survey.estimates_with_intervals(d, (0.9,), _from(spark, sf_dir, "SELECT n_nationkey AS area FROM nation"))
    return rounded(got.drop("logit_est", "logit_var"), "area", "converge")


@query(f"WITH {DIRECT}, no AS ({NODES}), b AS (SELECT area, m, pow(s, 2) v, 0 c FROM de UNION ALL SELECT area, m / 2, 0.02 + area / CAST(1000 AS DOUBLE), 1 FROM de WHERE area % 2 = 0), k AS (SELECT area, sum(m / v) / sum(1 / v) m, 1 / sum(1 / v) v, max(c) c FROM b GROUP BY area) SELECT area, round(m, 6) logit_est, round(v, 6) logit_var, c converge, round(sum(q / (1 + exp(-(m + sqrt(v) * i / 8)))), 6) est, round(sum(q * pow(1 / (1 + exp(-(m + sqrt(v) * i / 8))), 2)) - pow(sum(q / (1 + exp(-(m + sqrt(v) * i / 8)))), 2), 6) var, round(1 / (1 + exp(-(m - {NormalDist().inv_cdf(0.9)!r} * sqrt(v)))), 6) lower_80, round(1 / (1 + exp(-(m + {NormalDist().inv_cdf(0.9)!r} * sqrt(v)))), 6) upper_80 FROM k CROSS JOIN no GROUP BY area, m, v, c")
def combine_surveys(spark, sf_dir):
    a = direct(spark, sf_dir).withColumn("converge", F.lit(0))
    b = a.where("area % 2 = 0").select("area", (F.col("logit_est") / 2).alias("logit_est"), (0.02 + F.col("area") / 1000.0).alias("logit_var"), F.lit(1).alias("converge"))
    return rounded(survey.combine_logits([a, b], "area", (0.8,)), "area", "converge")


@query(f"""WITH p AS ({PEOPLE}), c AS (SELECT area, urban, cluster, sum(w * y) wy, sum(w) w FROM p GROUP BY 1, 2, 3), e AS (SELECT area, urban, sum(wy) / sum(w) est, sum(w) sw FROM c GROUP BY 1, 2),
nh AS (SELECT urban, count(DISTINCT cluster) nh FROM p GROUP BY urban), z AS (SELECT c.area, c.urban, (wy - est * w) / (sw * est * (1 - est)) z FROM c JOIN e ON c.area = e.area AND c.urban = e.urban WHERE est > 0 AND est < 1),
h AS (SELECT area, urban, sum(z) sz, sum(z * z) szz FROM z GROUP BY 1, 2), x AS (SELECT e.area, e.urban, ln(est / (1 - est)) m, nh / (nh - 1) * (szz - sz * sz / nh) v FROM e JOIN h ON e.area = h.area AND e.urban = h.urban JOIN nh ON nh.urban = e.urban)
SELECT u.area, round(u.m - r.m, 6) contrast, round(u.v + r.v, 6) var FROM x u JOIN x r ON u.area = r.area WHERE u.urban AND NOT r.urban""")
def contrast(spark, sf_dir):
    p = people(spark, sf_dir).withColumn("domain", F.struct("area", "urban"))
    d = survey.direct_estimates(p, "domain", "urban", "cluster", F.col("y"), F.col("w")).select("domain.area", "domain.urban", "logit_est", "logit_var")
    return rounded(survey.contrast(d, "area", "urban").where("contrast IS NOT NULL"), "area")


@query(f"WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483648, o_orderkey) k, count(*) OVER (PARTITION BY o_custkey) n FROM orders) SELECT o_orderkey, round(4 / (least(1, 3 / CAST(n AS DOUBLE)) * 0.25), 6) weight FROM r WHERE k <= 3")
def sampling_weight(spark, sf_dir):
    o = _from(spark, sf_dir, "SELECT o_orderkey, o_custkey, (o_orderkey * 1103515245 + 12345) % 2147483648 AS h FROM orders")
    some = survey.household_sample(o, "o_custkey", [F.col("h"), F.col("o_orderkey")], 3)
    return some.select("o_orderkey", F.round(survey.sampling_weight(F.lit(4), F.col("p_hh"), F.lit(0.25)), 6).alias("weight"))


@query(f"SELECT c_custkey, {HASHED} % 20 + 1 = 13 held_out FROM customer")
def fold_split_cluster(spark, sf_dir):
    c = _from(spark, sf_dir, f"SELECT c_custkey, {HASHED} % 20 + 1 - 10 AS fold FROM customer")
    return survey.fold_split(c, "fold", 13, 10).select("c_custkey", "held_out")


@query(f"SELECT c_custkey, c_nationkey = 3 AND {HASHED} % 10 + 1 > 5 held_out FROM customer")
def fold_split_areal(spark, sf_dir):
    c = _from(spark, sf_dir, f"SELECT c_custkey, c_nationkey, {HASHED} % 10 + 1 AS fold FROM customer")
    return survey.fold_split_areal(c, "c_nationkey", 3, "fold", 5).select("c_custkey", "held_out")
