"""Queries over polygons, rasters, samples and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmosaic.operators import aggregate, estimates, integration, polygons, raster
from fieldmosaic.plans.catalog import D_SQL, GRID, HASHED, POINTS, URBAN, _from, draws, grid, people, query, rounded

#: Each nation is a square of a 5 x 5 board; a region is their union.
CELLS = "SELECT n_nationkey AS poly, n_regionkey AS parent, n_nationkey % 5 AS cx, CAST(floor(n_nationkey / CAST(5 AS DOUBLE)) AS BIGINT) AS cy FROM nation"
LINKS = f"c AS ({CELLS}), l AS (SELECT a.poly src, b.poly dst, a.parent = b.parent inner_link, a.parent FROM c a JOIN c b ON greatest(abs(a.cx - b.cx), abs(a.cy - b.cy)) = 1), r AS (SELECT a.poly src, b.poly dst, a.parent = b.parent inner_link, a.parent FROM c a JOIN c b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1)"
CORNERS = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))


def squares(spark, sf_dir):
    at = lambda c, d, name: ((F.col(c) + d) * 10.0).alias(name)
    edges = F.array(*[F.struct(at("cx", a, "x1"), at("cy", b, "y1"), at("cx", c, "x2"), at("cy", d, "y2")) for a, b, c, d in CORNERS])
    return _from(spark, sf_dir, CELLS).select("poly", "parent", F.inline(edges))


@query(f"WITH {LINKS} SELECT src, dst FROM l")
def polygon_neighbours(spark, sf_dir):
    return polygons.neighbours(squares(spark, sf_dir))


@query(f"WITH {LINKS}, k AS (SELECT parent, count(*) n FROM r WHERE inner_link GROUP BY 1), s AS (SELECT parent, 4 * count(*) n FROM c GROUP BY 1) SELECT s.parent, CAST(s.n - coalesce(k.n, 0) AS BIGINT) edges FROM s LEFT JOIN k ON s.parent = k.parent")
def polygon_union(spark, sf_dir):
    return polygons.outline(squares(spark, sf_dir), "parent").groupBy("parent").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {LINKS} SELECT src i, src j, CAST(count(*) AS BIGINT) q FROM l GROUP BY src UNION ALL SELECT src, dst, -1 FROM l")
def besag_q(spark, sf_dir):
    return polygons.precision(polygons.neighbours(squares(spark, sf_dir)))


@query("SELECT c_nationkey poly, round(ln(100 / CAST(count(*) AS DOUBLE)), 6) log_area FROM customer GROUP BY 1")
def area_per_obs(spark, sf_dir):
    n = _from(spark, sf_dir, "SELECT c_nationkey AS poly FROM customer").groupBy("poly").agg(F.count(F.lit(1)).alias("n"))
    return polygons.areas(squares(spark, sf_dir)).join(n, "poly").select("poly", F.round(F.log(F.col("area") / F.col("n")), 6).alias("log_area"))


RASTER = "SELECT CAST(floor(id / CAST(101 AS DOUBLE)) AS BIGINT) AS r, id % 101 AS c, CAST((id * 7919) % 127 AS DOUBLE) AS v FROM range(0, 10201) t(id)"


@query(f"SELECT CAST(floor(floor(north) / 7) AS BIGINT) r, CAST(floor(floor(east) / 7) AS BIGINT) c, round(sum(pop), 4) v FROM ({GRID}) g GROUP BY 1, 2")
def raster_aggregate(spark, sf_dir):
    cells = grid(spark, sf_dir).groupBy(F.floor("north").alias("r"), F.floor("east").alias("c")).agg(F.sum("pop").alias("v"))
    return raster.block_sum(cells, 7).select("r", "c", F.round("v", 4).alias("v"))


@query(f"""WITH p AS (SELECT *, CAST(floor(x) AS BIGINT) i, CAST(floor(y) AS BIGINT) j, x - floor(x) u, y - floor(y) w FROM ({POINTS}) s), g AS ({RASTER})
SELECT pid, round((1 - u) * (1 - w) * a.v + u * (1 - w) * b.v + (1 - u) * w * d.v + u * w * e.v, 6) AS "value" FROM p JOIN g a ON a.r = j AND a.c = i JOIN g b ON b.r = j AND b.c = i + 1 JOIN g d ON d.r = j + 1 AND d.c = i JOIN g e ON e.r = j + 1 AND e.c = i + 1""")
def bilinear_extract(spark, sf_dir):
    return rounded(raster.bilinear(_from(spark, sf_dir, POINTS), spark.sql(RASTER), "pid", "x", "y"), "pid")


OFFSETS = ", ".join(f"({str(u).lower()}, {k}, {dx!r}::DOUBLE, {dy!r}::DOUBLE, {w!r}::DOUBLE)" for city in (True, False) for u, k, dx, dy, w in integration.ring_points(city))
AROUND = f"o(urban, k, dx, dy, w) AS (VALUES {OFFSETS}), q AS (SELECT pixel, o.k, east + dx px, north + dy py, o.w, floor(east / 25) = floor((east + dx) / 25) AND floor(north / 25) = floor((north + dy) / 25) inside FROM ({GRID}) g JOIN o ON g.urban = o.urban)"


@query(f"""WITH g AS ({GRID}), l AS (SELECT region, urban, pop w, pixel, unnest(['east', 'prev']) AS name, unnest([east, prev]) x FROM g) SELECT region, urban, name, round(sum(w * x) / sum(w), 6) fine, round(sum(CASE WHEN pixel % 9 = 0 AND region <> 4 THEN w * x END) / sum(CASE WHEN pixel % 9 = 0 AND region <> 4 THEN w END), 6) points FROM l GROUP BY 1, 2, 3""")
def weighted_cov_avgs(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(aggregate.covariate_averages(g, g.where("pixel % 9 = 0 AND region <> 4"), ["region", "urban"], "pop", ("east", "prev")), "region", "urban", "name")


@query(f"WITH g AS (SELECT pixel, abs(east - 50) + abs(north - 50) dist FROM ({GRID}) x), e AS (SELECT quantile_cont(dist, [0.2, 0.4, 0.6, 0.8]) e FROM g) SELECT pixel, CAST(1 + len(list_filter(e, lambda x: dist > x)) AS INTEGER) bin FROM g CROSS JOIN e")
def quantile_bins(spark, sf_dir):
    g = grid(spark, sf_dir).select("pixel", (F.abs(F.col("east") - 50) + F.abs(F.col("north") - 50)).alias("dist"))
    return estimates.bin_by_quantiles(g, "dist", 5).select("pixel", "bin")


PLACED = f"SELECT g.pixel, g.area, g.pop, ((g.pixel * 1103515245 + 12345) % 2147483648) / CAST(2147483648 AS DOUBLE) AS place FROM ({GRID}) g"


@query(f"""WITH r AS (SELECT *, sum(pop) OVER (PARTITION BY area ORDER BY place, pixel ROWS UNBOUNDED PRECEDING) c, sum(pop) OVER (PARTITION BY area) / 4 step FROM ({PLACED}) p WHERE pop > 0),
t AS (SELECT pixel, area, step / pop weight, CAST(floor(round(c / step + 0.5, 6)) - floor(round((c - pop) / step + 0.5, 6)) AS BIGINT) times FROM r) SELECT pixel, area, times, round(weight, 6) weight FROM t WHERE times > 0""")
def pps_sample(spark, sf_dir):
    g = _from(spark, sf_dir, PLACED).where("pop > 0")
    return estimates.pps_sample(g, ["area"], F.col("place"), [F.col("pixel")], "pop", 4).select("pixel", "area", "times", F.round("weight", 6).alias("weight"))


@query(f"""WITH v AS (SELECT region, pop, count(CASE WHEN urban THEN 1 END) f, count(CASE WHEN NOT urban THEN 1 END) g FROM ({GRID}) x GROUP BY 1, 2),
c AS (SELECT region, lead(pop) OVER w - pop gap, abs(sum(f) OVER w / CAST(sum(f) OVER a AS DOUBLE) - sum(g) OVER w / CAST(sum(g) OVER a AS DOUBLE)) d FROM v WINDOW w AS (PARTITION BY region ORDER BY pop), a AS (PARTITION BY region)) SELECT region, round(coalesce(sum(gap * d), 0), 4) distance FROM c GROUP BY region""")
def wasserstein(spark, sf_dir):
    return estimates.wasserstein(grid(spark, sf_dir), "region", "pop", F.col("urban")).select("region", F.round("distance", 4).alias("distance"))


@query(f"SELECT c_nationkey area, quantile_disc(CAST(c_acctbal AS DOUBLE), 0.4) q FROM customer GROUP BY 1")
def ecdf_quantile(spark, sf_dir):
    return _from(spark, sf_dir, "SELECT c_nationkey AS area, percentile_disc(0.4) WITHIN GROUP (ORDER BY CAST(c_acctbal AS DOUBLE)) AS q FROM customer GROUP BY c_nationkey")
