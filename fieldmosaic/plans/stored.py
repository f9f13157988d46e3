"""Queries that write given tables in the library's formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldmosaic.operators import polygons
from fieldmosaic.operators.sparse import shared_folder
from fieldmosaic.plans.catalog import GRID, _from, draws, grid, query, rounded
from fieldmosaic.plans.estimation import LINKS, squares
from fieldmosaic.sources import tables


def place(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, round(CAST(c_acctbal AS DOUBLE), 6) balance, CASE WHEN c_custkey % 10 <> 3 THEN round(CAST(c_acctbal AS DOUBLE) / 1000, 6) END thousands FROM customer")
def csv_read(spark, sf_dir):
    c = _from(spark, sf_dir, "SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS b FROM customer")
    comma = lambda x: F.replace(F.format_string("%.6f", x), F.lit("."), F.lit(","))
    odd = F.when(F.col("c_custkey") % 10 == 3, "1.234,5").otherwise(comma(F.col("b") / 1000))  # not a number, as it has a separator of thousands
    path = place(spark, "csv")
    c.select("c_custkey", "c_name", comma(F.col("b")).alias("balance"), odd.alias("thousands")).write.csv(path, sep=";", header=True)
    return rounded(tables.read_csv2(spark, path, "c_custkey long, c_name string, balance double, thousands double"), "c_custkey", "c_name")


@query(f"WITH {LINKS} SELECT src, dst FROM l")
def graph_read(spark, sf_dir):
    path = place(spark, "graph")
    n = polygons.neighbours(squares(spark, sf_dir))
    tables.write_graph(n.where("src < dst").unionByName(n.where("src % 3 = 0")), path)  # half of the links, some both ways round
    return tables.read_graph(spark, path).select("src", "dst")


@query(f"SELECT layer, r, c, round(sum(v), 4) v FROM (SELECT unnest(['people', 'places']) AS layer, CAST(floor(north / 10) AS BIGINT) r, CAST(floor(east / 10) AS BIGINT) c, unnest([pop, 1.0]) v FROM ({GRID}) g) x WHERE layer = 'people' OR r < 5 GROUP BY 1, 2, 3")
def raster_layers(spark, sf_dir):
    cells = grid(spark, sf_dir).select(F.floor(F.col("north") / 10).alias("r"), F.floor(F.col("east") / 10).alias("c"), F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), v.alias("v")) for n, v in (("people", F.col("pop")), ("places", F.lit(1.0)))])))
    path = place(spark, "layers")
    tables.write_cells(cells.groupBy("layer", "r", "c").agg(F.sum("v").alias("v")), path)
    return spark.read.parquet(path).where("layer = 'people' OR r < 5").select("layer", "r", "c", F.round("v", 4).alias("v"))


@query("SELECT vec_id % 2 AS model, label AS fold, CAST(count(*) AS BIGINT) n, round(avg(CAST(embedding[1] AS DOUBLE) + CASE WHEN vec_id % 2 = 1 AND label = 3 THEN 10 ELSE 0 END), 6) score FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2")
def results_stored(spark, sf_dir):
    d = draws(spark, sf_dir).select((F.col("vec_id") % 2).alias("model"), F.col("label").alias("fold"), F.col("draws")[0].alias("x"))
    r = d.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("score"))
    path = place(spark, "results")
    tables.write_results(r, path)
    tables.write_results(r.where("model = 1 AND fold = 3").withColumn("score", F.col("score") + 10), path)  # one fold again: the others stay
    return spark.read.parquet(path).select(F.col("model").cast("long").alias("model"), "fold", "n", F.round("score", 6).alias("score"))


@query(f"SELECT area, round(sum(pop), 3) pop FROM ({GRID}) g GROUP BY area")
def cached_areas(spark, sf_dir):
    path, made = place(spark, "cached"), []

    def make():
        made.append(1)
        return grid(spark, sf_dir).groupBy("area").agg(F.round(F.sum("pop"), 3).alias("pop"))

    tables.cache_or_compute(spark, path, make)
    again = tables.cache_or_compute(spark, path, make)
    if len(made) != 1:
        raise AssertionError("a kept table was made again")
    return again
