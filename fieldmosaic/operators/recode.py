"""Recoding of survey answers, names and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmosaic.functions.scalar import ratio


def last_rule(rules: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the last rule that holds; a rule that is null doesn't hold."""
    out = F.lit(other)
    for holds, value in rules:
        out = F.when(holds, F.lit(value)).otherwise(out)
    return out


def recode(code: Column, groups: dict[int, tuple], other: int = 9) -> Column:
    """The class whose codes hold the code; nulls and unlisted codes are `other`."""
    return last_rule([(code.isin(*codes), k) for k, codes in groups.items()], other)


def rename_by_table(df: DataFrame, names: DataFrame, name: str, state: str) -> DataFrame:
    """Adds `fixed`: the new name listed for the name in its state, else the one listed for any state, else the name.

    names: old, state (null: any), new; one row for each old name and state.
    """
    here = names.where("state IS NOT NULL").select(F.col("old").alias(name), F.col("state").alias(state), F.col("new").alias("__here"))
    anywhere = names.where("state IS NULL").select(F.col("old").alias(name), F.col("new").alias("__any"))
    held = df.join(here, [name, state], "left").join(anywhere, name, "left")
    return held.withColumn("fixed", F.coalesce("__here", "__any", name)).drop("__here", "__any")


def strata_of(df: DataFrame, area: str, subarea: str, districts: DataFrame, wanted: tuple[str, ...], renamed: DataFrame | None = None) -> DataFrame:
    """Adds `stratum`: the district of a row's subarea, if it is one of those wanted, else the row's area.

    districts: subarea, state, district. renamed (old, state, new) is applied to the districts' subareas first, as in rename_by_table, where two tables spell
    names differently. A subarea that is listed twice has the smallest of its wanted districts; one that isn't listed, or null, has its area.
    """
    listed = districts if renamed is None else rename_by_table(districts, renamed, "subarea", "state").withColumn("subarea", F.col("fixed")).drop("fixed")
    held = listed.where(F.col("district").isin(*wanted)).groupBy(F.col("subarea").alias(subarea)).agg(F.min("district").alias("__district"))
    return df.join(held, subarea, "left").withColumn("stratum", F.coalesce("__district", area)).drop("__district")


def split_totals(df: DataFrame, name: str, mark: str = "Total") -> tuple[DataFrame, DataFrame]:
    """Rows whose name holds the mark, and all others, those without name included."""
    total = F.coalesce(F.col(name).contains(mark), F.lit(False))
    return df.where(total), df.where(~total)


def grow(total: Column, percent: Column, years: int) -> Column:
    """A total after yearly growth, rounded half to even."""
    return F.bround(total * F.pow(1 + percent / 100, F.lit(years)))


def apportion(df: DataFrame, part: list[str], row_id: str, total: str, share: str) -> DataFrame:
    """Adds `parts`: whole numbers in proportion to the shares that sum to each group's total; units left over go to the largest remainders, ties to smaller ids. Remainders are ranked in buckets, after the buckets' counts, so a large group is spread over many tasks."""
    held = df.join(df.groupBy(*part).agg(F.sum(share).alias("__s")), part)
    exact = F.coalesce(ratio(F.col(total) * F.col(share), F.col("__s")), F.lit(0.0))
    held = held.withColumn("__e", F.round(exact, 9)).withColumn("__f", F.floor("__e"))
    left = held.groupBy(*part).agg((F.max(total) - F.sum("__f")).alias("__left"))
    rest = F.col("__e") - F.col("__f")
    held = held.withColumn("__k", F.floor((1 - rest) * 64))
    counts = held.groupBy(*part, "__k").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*part, "__k", (F.sum("__n").over(Window.partitionBy(*part).orderBy("__k")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*part, "__k").orderBy(rest.desc(), row_id))
    held = held.join(left, part).join(before, [*part, "__k"]).withColumn("parts", (F.col("__f") + F.when(place <= F.col("__left"), 1).otherwise(0)).cast("long"))
    return held.drop("__s", "__e", "__f", "__left", "__k", "__before")


def in_order_of(df: DataFrame, keys: DataFrame, key: str, *then: Column) -> DataFrame:
    """Rows in the order of a list of keys (key, ord), and within a key in the order of `then`; rows with other keys go. A key that is listed twice counts where it comes first."""
    return df.join(keys.groupBy(key).agg(F.min("ord").alias("ord")), key).orderBy("ord", *then)


def job_pair(job: Column, most: int) -> tuple[Column, Column]:
    """Job number (from 1) to the pair i, j with j in 1..most."""
    return (F.floor((job - 1) / F.lit(most)) + 1).cast("long"), ((job - 1) % most + 1).cast("long")


def job_number(i: Column, j: Column, most: int) -> Column:
    """The pair i, j (j in 1..most) to its job number, from 1."""
    return ((i - 1) * most + j).cast("long")


def ragged_pair(jobs: DataFrame, job: str, most: list[int]) -> DataFrame:
    """Adds i and j of job numbers where the i-th group has most[i - 1] jobs; other numbers have none."""
    ends = [sum(most[:k]) for k in range(len(most) + 1)]
    held = F.array(*[F.lit(e) for e in ends[1:]])
    i = F.size(F.filter(held, lambda e: e < F.col(job))) + 1
    start = F.get(F.array(*[F.lit(e) for e in ends]), i - 1)
    ok = (F.col(job) >= 1) & (F.col(job) <= ends[-1])
    return jobs.withColumn("i", F.when(ok, i).cast("long")).withColumn("j", F.when(ok, F.col(job) - start).cast("long"))
