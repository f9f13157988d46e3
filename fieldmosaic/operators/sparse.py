"""Sparse matrices as tables (i, j, q): products, components, and a solver in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders of local sessions without spark.checkpoint.dir.
LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local session without one has a folder of its own, a cluster's must name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or LOCAL.get(sc.applicationId)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="fieldmosaic-")
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that rounds don't grow its plan, nothing is computed twice, and no later step depends on executors that may be lost. Its size is known from then on, so small tables are broadcast."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, q) of a matrix product, joined on the inner index."""
    right = b.select(F.col("i").alias("m"), "j", F.col("q").alias("r"))
    return a.select("i", F.col("j").alias("m"), "q").join(right, "m").groupBy("i", "j").agg(F.sum(F.col("q") * F.col("r")).alias("q"))


def components(q: DataFrame) -> DataFrame:
    """(i, part): the smallest index that each index reaches by entries off the diagonal. A round halves the way to go, as indices also follow what they point at."""
    links = q.where("i <> j AND q <> 0").select("i", "j")
    state = settled(q.select("i").distinct().withColumn("part", F.col("i")))
    while True:
        near = links.join(state.select(F.col("i").alias("j"), "part"), "j").groupBy("i").agg(F.min("part").alias("near"))
        held = state.join(near, "i", "left").select("i", "part", F.least("part", "near").alias("least"))
        ahead = held.select(F.col("i").alias("least"), F.col("least").alias("next"))
        new = settled(held.join(ahead, "least", "left").select("i", F.least("least", "next").alias("new"), "part"))
        state = new.select("i", F.col("new").alias("part"))
        if new.where("new <> part").isEmpty():
            return state


def conjugate_gradient(q: DataFrame, b: DataFrame, tolerance: float = 1e-9, rounds: int = 10_000, intrinsic: bool = False) -> DataFrame:
    """(k, i, x) with Q x = b for each k of b (k, i, b): all right-hand sides at once, scaled by Q's diagonal, a round being one join with q and sums by k.

    q is symmetric and positive semi-definite with a positive diagonal; where it is singular, b must be in its range, and x has any part along what it
    takes to 0. `intrinsic`: rows of q sum to 0 over the indices of each k, and residuals are held to that sum, which rounding
    would leave. A k rests when its residual is below tolerance times its b; ends when all do, and raises after `rounds`.
    """
    scale = q.where("i = j").select("i", F.col("q").alias("d"))
    w = Window.partitionBy("k")
    start = b.join(scale, "i").withColumn("z", F.col("b") / F.col("d"))
    state = settled(start.select("k", "i", "d", F.lit(0.0).alias("x"), F.col("b").cast("double").alias("r"), F.col("z").alias("p"), F.sum(F.col("b") * F.col("z")).over(w).alias("rz")).withColumn("first", F.col("rz")))
    for _ in range(rounds):
        if state.where(F.col("rz") > tolerance**2 * F.col("first")).isEmpty():
            return state.select("k", "i", "x")
        ap = state.where("p <> 0").select("k", F.col("i").alias("j"), "p").join(q, "j").groupBy("k", "i").agg(F.sum(F.col("q") * F.col("p")).alias("ap"))
        held = state.join(ap, ["k", "i"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
        held = held.withColumn("curve", F.sum(F.col("p") * F.col("ap")).over(w)).withColumn("step", F.when((F.col("rz") > tolerance**2 * F.col("first")) & (F.col("curve") > 0), F.col("rz") / F.col("curve")).otherwise(0.0))
        held = held.withColumn("x", F.col("x") + F.col("step") * F.col("p")).withColumn("r", F.col("r") - F.col("step") * F.col("ap"))
        if intrinsic:
            held = held.withColumn("r", F.col("r") - F.avg("r").over(w))
        held = held.withColumn("new", F.sum(F.col("r") * F.col("r") / F.col("d")).over(w))
        turn = F.when(F.col("rz") > 0, F.col("new") / F.col("rz")).otherwise(0.0)
        state = settled(held.select("k", "i", "d", "x", "r", (F.col("r") / F.col("d") + turn * F.col("p")).alias("p"), F.col("new").alias("rz"), "first"))
    raise ArithmeticError(f"no solution after {rounds} rounds")


def marginal_variances(q: DataFrame) -> DataFrame:
    """(i, part, n, var): the diagonal of the generalised inverse of an intrinsic precision, whose rows sum to 0, with values that sum to 0 over each component of n indices; null for a component of one."""
    q = settled(q.where("q <> 0").select("i", "j", "q"))  # every round reads it
    parts = components(q)
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    held = parts.join(sizes, "part").where("n > 1")
    unit = held.select(F.col("i").alias("k"), "part", "n").join(held.select("i", "part"), "part").select("k", "i", (F.when(F.col("k") == F.col("i"), 1.0).otherwise(0.0) - 1 / F.col("n")).alias("b"))
    x = conjugate_gradient(q, unit, intrinsic=True)
    var = x.groupBy("k").agg((F.max(F.when(F.col("k") == F.col("i"), F.col("x"))) - F.avg("x")).alias("var"))
    return parts.join(sizes, "part").join(var.withColumnRenamed("k", "i"), "i", "left").select("i", "part", "n", "var")


def scaled(q: DataFrame) -> DataFrame:
    """q with each component scaled so that the geometric mean of its marginal variances is 1; an index without links stays as it is."""
    v = settled(marginal_variances(q))
    factor = v.groupBy("part").agg(F.exp(F.avg(F.log("var"))).alias("f"))
    return q.join(v.join(factor, "part").select("i", "f"), "i").select("i", "j", (F.col("q") * F.coalesce("f", F.lit(1.0))).alias("q"))
