"""Queries that clean survey rows, join them and build population frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import ratio
from fieldmosaic.operators import aggregate, clean, frame, recode, survey
from fieldmosaic.plans.catalog import GRID, PEOPLE, URBAN, _from, grid, people, query, rounded

AGES = "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END AS age FROM customer"


@query(f"SELECT * FROM ({AGES}) a WHERE age BETWEEN 20 AND 29")
def age_filter(spark, sf_dir):
    return _from(spark, sf_dir, AGES).where(F.col("age").between(20, 29))


LEVELS = "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 5 END AS level, c_custkey % 13 AS grade FROM customer"


@query(f"SELECT c_custkey, CASE WHEN grade = 12 THEN false WHEN level = 2 AND grade >= 6 THEN true WHEN level >= 3 THEN true ELSE false END secondary FROM ({LEVELS}) a")
def edu_flag(spark, sf_dir):
    level, grade = F.col("level"), F.col("grade")
    return _from(spark, sf_dir, LEVELS).select("c_custkey", recode.last_rule([(level >= 3, True), ((level == 2) & (grade >= 6), True), (grade == 12, False)], False).alias("secondary"))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 1 WHEN p_size IN (10, 20, 30) THEN 2 ELSE 9 END AS klass FROM part")
def recode_codes(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT p_partkey, p_size FROM part").select("p_partkey", recode.recode(F.col("p_size"), {1: (1, 2, 3), 2: (10, 20, 30)}).alias("klass"))


@query(f"SELECT c_custkey, coalesce(level >= 4, true) completed FROM ({LEVELS}) a")
def completed_flag(spark, sf_dir):
    return _from(spark, sf_dir, LEVELS).select("c_custkey", F.coalesce(F.col("level") >= 4, F.lit(True)).alias("completed"))


PLACED = "SELECT c_custkey, c_custkey % 9 AS lon, CASE WHEN c_custkey % 6 = 0 THEN 9999 ELSE c_custkey % 100 END AS alt FROM customer"


@query(f"SELECT c_custkey, lon, nullif(alt, 9999) alt FROM ({PLACED}) p WHERE lon <> 0")
def missing_geo(spark, sf_dir):
    return _from(spark, sf_dir, PLACED).where("lon <> 0").withColumn("alt", F.nullif(F.col("alt"), F.lit(9999)))


NAMED = f"SELECT c_custkey, n_name, {URBAN} AS urban FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT c_custkey, urban OR ends_with(n_name, '_1') urban FROM ({NAMED}) n")
def force_urban(spark, sf_dir):
    return _from(spark, sf_dir, NAMED).select("c_custkey", (F.col("urban") | F.col("n_name").endswith("_1")).alias("urban"))


@query("SELECT n_nationkey, regexp_replace(n_name, '[AEIOU]+', '-', 'g') plain FROM nation")
def regex_replace(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT n_nationkey, n_name FROM nation").select("n_nationkey", F.regexp_replace("n_name", "[AEIOU]+", "-").alias("plain"))


@query("SELECT n_nationkey, CASE WHEN n_name = 'NATION_7' AND r_name = 'ASIA' THEN 'Seven' WHEN n_name = 'NATION_8' AND r_name = 'ASIA' THEN 'Wrong' WHEN n_name = 'NATION_8' THEN 'Eight' WHEN n_name = 'NATION_4' THEN 'Four' ELSE n_name END fixed FROM nation JOIN region ON n_regionkey = r_regionkey")
def name_fix(spark, sf_dir):
    n = _from(spark, sf_dir, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    names = spark.createDataFrame([("NATION_7", "ASIA", "Seven"), ("NATION_7", None, "None"), ("NATION_8", "ASIA", "Wrong"), ("NATION_8", None, "Eight"), ("NATION_4", None, "Four")], "old string, state string, new string")
    return recode.rename_by_table(n, names, "n_name", "r_name").select("n_nationkey", "fixed")


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'a')")
def split_totals(spark, sf_dir):
    return recode.split_totals(_from(spark, sf_dir, "SELECT p_partkey, p_name FROM part"), "p_name", "a")[1].select("p_partkey")


@query(f"SELECT concat_ws('.', n_name, CAST(urban AS VARCHAR)) stratum, CAST(count(*) AS BIGINT) n FROM ({NAMED}) n GROUP BY 1")
def interaction_key(spark, sf_dir):
    return _from(spark, sf_dir, NAMED).groupBy(F.concat_ws(".", "n_name", F.col("urban").cast("string")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CAST(round_even(c_custkey / CAST(4 AS DOUBLE), 1) AS DOUBLE) r FROM customer")
def round_cols(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT c_custkey FROM customer").select("c_custkey", F.bround(F.col("c_custkey") / F.lit(4.0), 1).alias("r"))


@query(f"WITH g AS ({GRID}) SELECT pixel, round_even(pop * pow(1 + CAST(area % 5 AS DOUBLE) / 100, 11), 0) pop FROM g")
def growth_project(spark, sf_dir):
    return grid(spark, sf_dir).select("pixel", recode.grow(F.col("pop"), (F.col("area") % 5).cast("double"), 11).alias("pop"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND (l_linenumber % 2) = (o_custkey % 2)")
def join_inner_hh(spark, sf_dir):
    a = _from(spark, sf_dir, "SELECT l_orderkey, l_linenumber, l_orderkey AS clust, l_linenumber % 2 AS hh FROM lineitem")
    return a.join(_from(spark, sf_dir, "SELECT o_custkey, o_orderkey AS clust, o_custkey % 2 AS hh FROM orders"), ["clust", "hh"]).drop("clust", "hh")


@query("WITH c AS (SELECT c_nationkey k, CAST(count(*) AS BIGINT) n FROM customer WHERE c_nationkey < 15 GROUP BY 1), s AS (SELECT s_nationkey k, CAST(count(*) AS BIGINT) m FROM supplier WHERE s_nationkey > 9 GROUP BY 1) SELECT coalesce(c.k, s.k) k, n, m FROM c FULL JOIN s ON c.k = s.k")
def join_full_outer(spark, sf_dir):
    c = _from(spark, sf_dir, "SELECT c_nationkey AS k FROM customer").where("k < 15").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    s = _from(spark, sf_dir, "SELECT s_nationkey AS k FROM supplier").where("k > 9").groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    return c.join(s, "k", "full_outer")


@query(f"WITH g AS ({GRID}), s AS (SELECT s_suppkey, ((s_suppkey * 37) % 1000) / CAST(10 AS DOUBLE) x, ((s_suppkey * 91) % 1000) / CAST(10 AS DOUBLE) y FROM supplier) SELECT s_suppkey, pixel FROM s JOIN g ON round(x, 6) = round(east, 6) AND round(y, 6) = round(north, 6)")
def join_on_coords(spark, sf_dir):
    s = _from(spark, sf_dir, "SELECT s_suppkey, ((s_suppkey * 37) % 1000) / CAST(10 AS DOUBLE) AS x, ((s_suppkey * 91) % 1000) / CAST(10 AS DOUBLE) AS y FROM supplier")
    key = lambda df, x, y: df.withColumn("__x", F.round(x, 6)).withColumn("__y", F.round(y, 6))
    return key(s, "x", "y").join(key(grid(spark, sf_dir), "east", "north"), ["__x", "__y"]).select("s_suppkey", "pixel")


@query("SELECT a.n_nationkey AS row_a, b.n_nationkey AS row_b FROM nation a JOIN nation b ON a.n_name = b.n_name AND a.n_regionkey = b.n_regionkey")
def row_match_join(spark, sf_dir):
    a = _from(spark, sf_dir, "SELECT n_nationkey AS row_a, n_name, n_regionkey FROM nation")
    b = a.withColumnRenamed("row_a", "row_b")
    return a.join(b, ["n_name", "n_regionkey"]).select("row_a", "row_b")


#: Districts of some nations' suppliers, a nation being spelt otherwise there.
DISTRICTS = "SELECT concat(CASE WHEN n_nationkey = 7 THEN 'Seventh' ELSE n_name END, '/', CAST(k AS VARCHAR(3))) AS subarea, r_name AS state, concat(r_name, ' ', CAST(n_nationkey % 3 AS VARCHAR(3)), CAST(k AS VARCHAR(3))) AS district FROM nation JOIN region ON n_regionkey = r_regionkey {cross} range(0, 3) t(k)"
SITES = "SELECT c_custkey, r_name AS area, concat(n_name, '/', CAST(c_custkey % 4 AS VARCHAR(3))) AS subarea FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
WANTED = ("ASIA 00", "ASIA 11", "ASIA 12", "AFRICA 20", "AFRICA 01")


@query(f"WITH d AS (SELECT CASE WHEN state = 'ASIA' AND starts_with(subarea, 'Seventh') THEN replace(subarea, 'Seventh', 'NATION_7') ELSE subarea END subarea, district FROM ({DISTRICTS.format(cross='CROSS JOIN')}) x), w AS (SELECT subarea, min(district) district FROM d WHERE district IN {WANTED!r} GROUP BY 1) SELECT c_custkey, coalesce(district, area) stratum FROM ({SITES}) s LEFT JOIN w ON w.subarea = s.subarea")
def strata_lookup(spark, sf_dir):
    names = spark.createDataFrame([(f"Seventh/{k}", "ASIA", f"NATION_7/{k}") for k in range(3)], "old string, state string, new string")
    each = _from(spark, sf_dir, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey").withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    spelt = F.when(F.col("n_nationkey") == 7, "Seventh").otherwise(F.col("n_name"))
    districts = each.select(F.concat(spelt, F.lit("/"), "k").alias("subarea"), F.col("r_name").alias("state"), F.concat("r_name", F.lit(" "), F.col("n_nationkey") % 3, "k").alias("district"))
    return recode.strata_of(_from(spark, sf_dir, SITES), "area", "subarea", districts, WANTED, names).select("c_custkey", "stratum")


@query("SELECT n_nationkey, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN n_name ELSE r_name END stratum FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy_map(spark, sf_dir):
    n = _from(spark, sf_dir, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    return n.select("n_nationkey", F.when(F.col("r_name").isin("ASIA", "AFRICA"), F.col("n_name")).otherwise(F.col("r_name")).alias("stratum"))


@query("SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) l_quantity, round(avg(CAST(l_discount AS DOUBLE)), 6) l_discount, min(l_returnflag) l_returnflag FROM lineitem GROUP BY l_orderkey")
def mixed_agg(spark, sf_dir):
    df = _from(spark, sf_dir, "SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, l_returnflag FROM lineitem")
    return aggregate.mixed(df, "l_orderkey", sums=("l_quantity",)).withColumn("l_discount", F.round("l_discount", 6))


@query(f"WITH g AS ({GRID}) SELECT region, urban, round(avg(prev), 6) p FROM g GROUP BY 1, 2")
def agg_area_normalized(spark, sf_dir):
    return rounded(grid(spark, sf_dir).groupBy("region", "urban").agg(F.avg("prev").alias("p")), "region", "urban")


@query(f"WITH g AS (SELECT region, prev, CASE WHEN region = 1 THEN 0 ELSE pop END pop FROM ({GRID}) x) SELECT region, round(CASE WHEN sum(pop) = 0 THEN avg(prev) ELSE sum(pop * prev) / sum(pop) END, 6) p FROM g GROUP BY region")
def agg_area_zero_pop(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("pop", F.when(F.col("region") == 1, F.lit(0.0)).otherwise(F.col("pop")))
    return rounded(g.groupBy("region").agg(F.coalesce(ratio(F.sum(F.col("pop") * F.col("prev")), F.sum("pop")), F.avg("prev")).alias("p")), "region")


@query(f"WITH g AS ({GRID}) SELECT area, urban, round(sum(prev * pop) / nullif(sum(pop), 0), 6) p FROM g GROUP BY 1, 2")
def agg_pixel_density(spark, sf_dir):
    return rounded(grid(spark, sf_dir).groupBy("area", "urban").agg(ratio(F.sum(F.col("prev") * F.col("pop")), F.sum("pop")).alias("p")), "area", "urban")


@query(f"WITH e AS (SELECT cluster, CAST(count(*) AS BIGINT) n, CAST(sum(y) AS BIGINT) z FROM ({PEOPLE}) p GROUP BY 1) SELECT pixel, coalesce(n, 0) n, z, round(z / CAST(n AS DOUBLE), 6) p FROM ({GRID}) g LEFT JOIN e ON pixel = cluster")
def ea_to_pixel(spark, sf_dir):
    e = people(spark, sf_dir).groupBy(F.col("cluster").alias("pixel")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("z"))
    return grid(spark, sf_dir).select("pixel").join(e, "pixel", "left").select("pixel", F.coalesce("n", F.lit(0)).alias("n"), "z", F.round(F.col("z") / F.col("n"), 6).alias("p"))


@query(f"WITH g AS ({GRID}) SELECT pixel, round(sum(pop) OVER w / count(*) OVER w, 6) per_ea FROM g WINDOW w AS (PARTITION BY area, urban)")
def expected_per_ea(spark, sf_dir):
    return frame.expected_per_ea(grid(spark, sf_dir), ["area", "urban"], "pop").select("pixel", F.round("per_ea", 6).alias("per_ea"))


@query(f"WITH g AS ({GRID}) SELECT CAST(ceil(east / 25) AS BIGINT) i, CAST(ceil(north / 25) AS BIGINT) j, round(avg(pop), 6) mean FROM g GROUP BY 1, 2")
def numint_grid(spark, sf_dir):
    return rounded(frame.block_means(grid(spark, sf_dir), "east", "north", "pop", 25.0), "i", "j")


@query(f"WITH g AS ({GRID}), t AS (SELECT s_nationkey area, true urban, CAST(count(*) * 1000 AS DOUBLE) target FROM supplier GROUP BY 1) SELECT pixel, round(CASE WHEN target IS NULL OR sum(pop) OVER w = 0 THEN 0 ELSE pop * target / sum(pop) OVER w END, 6) adjusted FROM g LEFT JOIN t ON g.area = t.area AND g.urban = t.urban WINDOW w AS (PARTITION BY g.area, g.urban)")
def adjust_grid(spark, sf_dir):
    targets = _from(spark, sf_dir, "SELECT s_nationkey AS area, true AS urban, CAST(count(*) * 1000 AS DOUBLE) AS target FROM supplier GROUP BY s_nationkey")
    return frame.adjust_grid(grid(spark, sf_dir), targets, ["area", "urban"], "pop").select("pixel", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH f AS (SELECT area, CAST(sum(CASE WHEN urban THEN 25 ELSE 0 END) AS DOUBLE) * 2.5::DOUBLE pop_urb, CAST(sum(CASE WHEN urban THEN 0 ELSE 25 END) AS DOUBLE) * 3.5::DOUBLE pop_rur FROM ({GRID}) g GROUP BY area) SELECT area, pop_urb, pop_rur, round(100 * pop_urb / (pop_urb + pop_rur), 6) pct_urb, round(100 * (pop_urb + pop_rur) / sum(pop_urb + pop_rur) OVER (), 6) pct_total FROM f")
def frame_target_pop(spark, sf_dir):
    hh = grid(spark, sf_dir).groupBy("area").agg(F.sum(F.when(F.col("urban"), 25).otherwise(0)).alias("hh_urb"), F.sum(F.when(F.col("urban"), 0).otherwise(25)).alias("hh_rur"))
    return rounded(frame.target_population(hh, "area", 2.5, 3.5), "area")


@query(f"WITH g AS (SELECT area, pixel, pop FROM ({GRID}) x), e AS (SELECT *, round(100 * pop / sum(pop) OVER (PARTITION BY area), 9) e FROM g), f AS (SELECT *, floor(e) f FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY e - f DESC, pixel) k, 100 - sum(f) OVER (PARTITION BY area) left_over FROM f) SELECT pixel, CAST(f + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) parts FROM k")
def apportion_rounded(spark, sf_dir):
    g = grid(spark, sf_dir).select("area", "pixel", "pop", F.lit(100).alias("total"))
    return recode.apportion(g, ["area"], "pixel", "total", "pop").select("pixel", "parts")


@query(f"WITH g AS ({GRID}) SELECT n_nationkey area, round(avg(CASE WHEN pixel IS NULL THEN NULL WHEN urban <> (pop > 5000) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) rate FROM nation LEFT JOIN g ON area = n_nationkey AND region <> 2 GROUP BY 1")
def misclass_rate(spark, sf_dir):
    areas = _from(spark, sf_dir, "SELECT n_nationkey AS area FROM nation")
    return rounded(aggregate.misclassified(grid(spark, sf_dir).where("region <> 2"), areas, "area", F.col("urban"), F.col("pop") > 5000), "area")


@query(f"WITH g AS ({GRID}), c AS (SELECT east, count(*) n FROM g GROUP BY 1), t AS (SELECT east FROM c ORDER BY n DESC, east LIMIT 1), d AS (SELECT DISTINCT north FROM g JOIN t ON g.east = t.east), s AS (SELECT north - lag(north) OVER (ORDER BY north) gap FROM d) SELECT round(min(gap), 6) resolution FROM s")
def grid_resolution(spark, sf_dir):
    return frame.resolution(grid(spark, sf_dir)).select(F.round("resolution", 6).alias("resolution"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY o.ord, c_custkey) AS INTEGER) place FROM customer JOIN (VALUES ('MACHINERY', 1), ('BUILDING', 2), ('HOUSEHOLD', 4)) o(seg, ord) ON c_mktsegment = o.seg")
def custom_order(spark, sf_dir):
    keys = spark.createDataFrame([("MACHINERY", 1), ("BUILDING", 2), ("MACHINERY", 3), ("HOUSEHOLD", 4), ("NONE", 5)], "c_mktsegment string, ord int")
    held = recode.in_order_of(_from(spark, sf_dir, "SELECT c_custkey, c_mktsegment FROM customer"), keys, "c_mktsegment", F.col("c_custkey"))
    return clean.numbered(held, [F.col("ord"), F.col("c_custkey")], "place").select("c_custkey", "place")


@query("SELECT c_custkey k, c_mktsegment seg, CAST(NULL AS VARCHAR) name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_missing(spark, sf_dir):
    a = _from(spark, sf_dir, "SELECT c_custkey AS k, c_mktsegment AS seg FROM customer")
    return a.unionByName(_from(spark, sf_dir, "SELECT s_suppkey AS k, s_name AS name FROM supplier"), allowMissingColumns=True)


@query("SELECT n_nationkey, CAST(c AS INTEGER) copy FROM nation, range(1, 4) t(c) WHERE n_name IN ('NATION_4', 'NATION_9') UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_name NOT IN ('NATION_4', 'NATION_9')")
def replicate_rows(spark, sf_dir):
    times = F.when(F.col("n_name").isin("NATION_4", "NATION_9"), 3).otherwise(1)
    return _from(spark, sf_dir, "SELECT n_nationkey, n_name FROM nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


@query(f"WITH g AS ({GRID}) SELECT pixel, pop FROM g ORDER BY pop DESC, pixel LIMIT 50")
def topk_inspect(spark, sf_dir):
    return grid(spark, sf_dir).select("pixel", "pop").orderBy(F.col("pop").desc(), "pixel").limit(50)


@query(f"WITH g AS ({GRID}) SELECT pixel, round((ln(1 + pop) - avg(ln(1 + pop)) OVER w) / stddev_samp(ln(1 + pop)) OVER w, 6) z FROM g WINDOW w AS (PARTITION BY area)")
def zscore_by_area(spark, sf_dir):
    g = grid(spark, sf_dir).select("pixel", "area", F.log1p("pop").alias("x"))
    moments = g.groupBy("area").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    return g.join(moments, "area").select("pixel", F.round(ratio(F.col("x") - F.col("m"), F.col("s")), 6).alias("z"))


@query("SELECT p_partkey, p_partkey // 20 + 1 i, p_partkey % 20 + 1 j FROM part")
def job_index_decode(spark, sf_dir):
    i, j = recode.job_pair(F.col("p_partkey") + 1, 20)
    return _from(spark, sf_dir, "SELECT p_partkey FROM part").select("p_partkey", i.alias("i"), j.alias("j"))


@query(f"SELECT pixel, round(area_km, 3) weight, CAST(k AS INTEGER) hh FROM (SELECT pixel, pop / 6 area_km FROM ({GRID}) g WHERE pixel % 6 = 5) s CROSS JOIN range(1, 7) t(k)")
def expand_weighted(spark, sf_dir):
    g = grid(spark, sf_dir).where("pixel % 6 = 5").select("pixel", "pop", F.lit(2).alias("y"), F.lit(6).alias("n"))
    return survey.expand_binary(g, "y", "n", "pop").select("pixel", F.round("pop", 3).alias("weight"), "hh")
