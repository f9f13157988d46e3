"""Cleaning, ordering and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmosaic.operators.sparse import settled


def fill_down(df: DataFrame, part: list[str], order: str, value: str) -> DataFrame:
    """Adds `filled`: the last value up to a row, in the order, that is neither null nor empty.

    Where the order is a number, a part's range is cut in 64 stretches: each stretch's last value is found first and carried to the next ones, then
    rows are filled within stretches, so that a large part is spread over many tasks. Rows without an order come first, in one stretch.
    """
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = F.nullif(F.col(value), F.lit(""))
    if not isinstance(df.schema[order].dataType, T.NumericType):
        return df.withColumn("filled", last(held, Window.partitionBy(*part).orderBy(order)))
    ends = df.groupBy(*part).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    same = [F.col(f"d.{p}").eqNullSafe(F.col(f"e.{p}")) for p in part]  # null parts are parts too
    width = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    at = F.coalesce(F.least(F.lit(63), F.floor(64 * (F.col(order) - F.col("__lo")) / width)), F.when(F.col(order).isNull(), -1).otherwise(0)).cast("int")
    cut = df.alias("d").join(ends.alias("e"), same).select("d.*", "__lo", "__hi").withColumn("__s", at).drop("__lo", "__hi")
    ended = cut.withColumn("__v", held).where("__v IS NOT NULL").groupBy(*part, "__s").agg(F.max_by("__v", F.struct(F.col(order).isNotNull(), order)).alias("__v"))
    every = cut.select(*part, "__s").distinct().alias("d").join(ended.alias("e"), [*same, F.col("d.__s") == F.col("e.__s")], "left").select("d.*", "e.__v")
    before = every.withColumn("__before", F.last("__v", ignorenulls=True).over(Window.partitionBy(*part).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))).drop("__v")
    joined = cut.alias("d").join(before.alias("e"), [*same, F.col("d.__s") == F.col("e.__s")]).select("d.*", "e.__before")
    return joined.withColumn("filled", F.coalesce(last(held, Window.partitionBy(*part, "__s").orderBy(order)), "__before")).drop("__s", "__before")


def dedupe_names(df: DataFrame, name: str, state: str) -> DataFrame:
    """Appends the state to names that occur in more than one row."""
    many = df.groupBy(name).agg((F.count(F.lit(1)) > 1).alias("__many"))
    return df.join(many, name).withColumn("unique_name", F.when(F.col("__many"), F.concat_ws(",", name, state)).otherwise(F.col(name))).drop("__many")


def threshold_pct(pct: Column, low: float = 0.3, high: float = 99.7) -> Column:
    return F.when(pct < low, F.lit(0.0)).when(pct > high, F.lit(100.0)).otherwise(pct)


def first_match_join(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """A left join with the first row of each key on the right."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), order).alias("__r"))
    return left.join(first, key, "left").select(*left.columns, "__r.*")


def gaps_islands(df: DataFrame, part: list[str], x: str) -> DataFrame:
    """Runs of consecutive integers: first, last, and how many."""
    held = df.select(*part, x).distinct()
    held = held.withColumn("__g", F.col(x) - F.row_number().over(Window.partitionBy(*part).orderBy(x)))
    return held.groupBy(*part, "__g").agg(F.min(x).alias("first"), F.max(x).alias("last"), F.count(F.lit(1)).alias("n")).drop("__g")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that agree in all columns that both have; a null agrees with nothing."""
    return left.join(right, [c for c in left.columns if c in right.columns])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their places in an order, from 1. Ranges of the order go to tasks of their own, where rows are numbered; then each range is shifted by the counts of those before it."""
    held = settled(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id()))
    counts = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each task
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return held.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + place).cast("int")).drop("__p", "__before")


def gaps_text(df: DataFrame, part: list[str], key: str) -> DataFrame:
    """Stretches of consecutive numbers as text, such as [1-3],7,[9-10], one row for each part."""
    runs = gaps_islands(df, part, key)
    text = F.when(F.col("first") < F.col("last"), F.concat(F.lit("["), F.col("first"), F.lit("-"), F.col("last"), F.lit("]"))).otherwise(F.col("first").cast("string"))
    held = runs.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("at"), text.alias("t")))).alias("s"))
    return held.select(*part, F.array_join(F.col("s.t"), ",").alias("stretches"))


def draw_columns(draws: str, places: list[int]) -> list[Column]:
    """Columns of some draws, by place from 0."""
    return [F.get(draws, p) for p in places]
