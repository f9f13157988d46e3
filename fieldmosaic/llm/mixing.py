"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Weights of the sources in code point order, repeating; nulls come last.
WEIGHTS = (5.0, 2.0, 1.0)


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds rank, weight and target to a table with a row for each source: source, rows_, source_size.

    Targets share `share` times all words by weight; none exceeds `most` times its source's
    size, and what is cut off is shared again by weight. That is a water level: sources fill up in
    the order of cap / weight, and the level is that of the first which isn't full (filling one raises the level for the rest, so it is the highest).
    The table has one row for each source, so its windows need no partitioning.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("goal", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("caps_before", F.sum("cap").over(full) - F.col("cap"))
    s = s.withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(full) + F.col("weight"))
    s = s.withColumn("level", (F.col("goal") - F.col("caps_before")) / F.col("weight_from"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return s.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).select("source", "rows_", "source_size", "rank", "weight", "target")


def _hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` blocks are good ones: the inverse of the distribution at u.

    Probabilities are built from the mode outwards by their ratios, so nothing underflows before
    it is too small to matter; one pass sums them, one finds the place of u.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - bad)
    high = F.least(good, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (good + 1) / (good + bad + 2)).cast("long")))
    up = lambda k: (good - k) * (drawn - k) / F.greatest((k + 1) * (bad - drawn + k + 1), F.lit(1).cast("long"))  # noqa: E731  P(k + 1) / P(k)
    down = lambda k: k * (bad - drawn + k) / F.greatest((good - k + 1) * (drawn - k + 1), F.lit(1).cast("long"))  # noqa: E731  P(k - 1) / P(k)
    empty = F.array().cast("array<bigint>")
    above = F.when(mode < high, F.sequence(mode, high - 1)).otherwise(empty)
    below = F.when(mode > low, F.sequence(mode, low + 1, F.lit(-1).cast("long"))).otherwise(empty)
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    grow = lambda ratio: lambda acc, k: F.struct((acc["p"] * ratio(k)).alias("p"), (acc["sum"] + acc["p"] * ratio(k)).alias("sum"))
    over, under = F.aggregate(above, begin, grow(up))["sum"], F.aggregate(below, begin, grow(down))["sum"]
    point = u * (1.0 + over + under)
    # below the mode: walk down from it; above: walk up
    seek = lambda ratio, by: lambda acc, k: F.when(acc["left"] < 0, acc).otherwise(F.struct((acc["p"] * ratio(k)).alias("p"), (acc["left"] - acc["p"] * ratio(k)).alias("left"), (acc["at"] + by).alias("at")))
    start = lambda left: F.struct(F.lit(1.0).alias("p"), left.alias("left"), mode.alias("at"))
    found = F.when(point < 1.0, mode).when(point < 1.0 + over, F.aggregate(above, start(point - 1.0), seek(up, 1))["at"]).otherwise(F.aggregate(below, start(point - 1.0 - over), seek(down, -1))["at"])
    return F.greatest(low, F.least(high, found))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Splits quotas (one row: q, an array of block counts by source rank) among shards: rows shard, q.

    At each node of a binary tree the left side gets half the blocks (one less for odd counts); how many
    of each source is multivariate hypergeometric, drawn source by source from what is left. So the
    leaves hold what dealing all blocks in random order would give, no block is listed,
    and leaf totals differ by at most one block per level.
    """
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = quotas.select(F.lit(0).alias("node"), "q", F.lit(shards).alias("width"))
    while shards > 1:
        half = F.floor(total * F.floor(F.col("width") / 2) / F.col("width")).cast("long")

        def draw(acc, x):
            n = _hypergeometric(x, acc["rest"] - x, acc["room"], unit(F.lit(seed), F.col("node"), F.col("width"), F.size(acc["left"])))
            return F.struct((acc["rest"] - x).alias("rest"), (acc["room"] - n).alias("room"), F.concat(acc["left"], F.array(n)).alias("left"))

        begin = F.struct(total.alias("rest"), half.alias("room"), F.array().cast("array<bigint>").alias("left"))
        nodes = nodes.withColumn("lq", F.when(F.col("width") > 1, F.aggregate("q", begin, draw)["left"]))
        few = F.floor(F.col("width") / 2).cast("int")
        both = F.array(F.struct(F.col("node").alias("node"), F.col("lq").alias("q"), few.alias("width")), F.struct((F.col("node") + few).alias("node"), F.zip_with("q", "lq", lambda a, b: a - b).alias("q"), (F.col("width") - few).cast("int").alias("width")))
        nodes = nodes.select(F.explode(F.when(F.col("width") > 1, both).otherwise(F.array(F.struct("node", "q", "width")))).alias("x")).select("x.*")
        shards = -(-shards // 2)
    return nodes.select(F.col("node").alias("shard"), "q")


def mix_sources(df: DataFrame, id_cols: list[str], size: str = "size", source: str = "source", shards: int = 16, blocks: int = 2048, seed: int = 7, rows_per_bucket: int = 2_000, **targets) -> DataFrame:
    """Adds source_size, target, taken, and parts: what of the row goes where, an array of (shard, from, words, place).

    Each source's rows are put in a hashed order, in which a row covers a range of words. A target
    of t words takes floor(t / source size) whole passes and, of a last pass, the rest;
    the row in which the last pass ends gives only its first words, so taken words are the rounded target. No row
    is taken more than `most` times. The passes are cut into blocks of equal word counts (about `blocks` in all); the
    splitting tree gives each shard an exact number of blocks of each source, in disjoint
    ranges of the hashed order; `place` orders a shard locally.

    The hashed order is kept in buckets, of about rows_per_bucket rows of one source each, whose word counts
    are summed before; no task sorts a whole source. Null ids, equal rows and empty texts have their places in the
    order; rows without words (null or empty texts) take none. A very long text is one row. An empty table gives an empty
    result. Columns named source_size, target, taken or parts are replaced; others, whatever their names, stay.
    Sources are a short list: their targets are shared by windows over one row for each, and their quotas stand in one row.
    """
    kept = df.select(F.struct(*df.columns).alias("__row"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"), F.xxhash64(F.lit(seed), *id_cols).alias("__h"), F.struct(*id_cols).alias("__id"), F.col(source).alias("__of"))
    per = kept.groupBy(F.col("__of").alias("source")).agg(F.count(F.lit(1)).alias("rows_"), F.sum("__size").alias("source_size"))
    per = source_targets(per, **targets)
    per = per.withColumn("want", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("block", F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("want").over(Window.partitionBy()) / F.lit(blocks)).cast("long")))
    per = per.withColumn("n_blocks", F.ceil(F.col("want") / F.col("block")).cast("long")).withColumn("buckets", F.ceil(F.col("rows_") / F.lit(rows_per_bucket)).cast("long"))
    per = cut(per, "targets")
    quotas = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n_blocks"))), lambda x: x["n_blocks"]).alias("q"))
    leaves = split_quotas(quotas, shards, seed)
    ends = leaves.select("shard", F.posexplode("q").alias("rank", "n")).withColumn("end", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")))
    ends = ends.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    per = cut(per.join(ends, "rank").withColumnRenamed("source", "__source"), "sources")  # a row for each source

    held = kept.join(per, F.col("__of").eqNullSafe(F.col("__source"))).withColumn("__bucket", F.floor(unit(F.lit(0), "__h") * F.col("buckets")).cast("long"))
    sums = held.groupBy("rank", "__bucket").agg(F.sum("__size").alias("__words"))
    sums = sums.withColumn("__before", F.sum("__words").over(Window.partitionBy("rank").orderBy("__bucket")) - F.col("__words")).drop("__words")
    held = held.join(sums, ["rank", "__bucket"])
    inside = Window.partitionBy("rank", "__bucket").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))

    last = F.col("want") - F.col("passes") * F.col("source_size")  # words of the last pass
    extra = F.greatest(F.lit(0).cast("long"), F.least("__size", last - F.col("__from")))
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("passes")),
        lambda k: F.struct(F.floor((k * F.col("source_size") + F.col("__from")) / F.col("block")).cast("long").alias("b"), F.when(k < F.col("passes"), F.col("__size")).otherwise(extra).alias("words"), k.alias("k")),
    )
    shard = lambda b: F.least(F.lit(shards - 1), F.size(F.filter("ends", lambda e: e <= b)))
    parts = F.transform(F.filter(pieces, lambda p: p["words"] > 0), lambda p: F.struct(shard(p["b"]).cast("int").alias("shard"), p["words"].alias("words"), unit(F.lit(seed + 1), F.col("__h"), p["k"]).alias("place")))
    taken = (F.col("passes") * F.col("__size") + extra).alias("taken")
    return held.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in ("source_size", "target", "taken", "parts")], "source_size", "target", taken, parts.alias("parts"))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document. Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: see mix_sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    mixed = mix_sources(docs, ["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("parts", lambda p: p["shard"]).alias("shards"))
