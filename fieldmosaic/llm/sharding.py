"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_unsigned, mix, table

ROUNDS = 6


def _domain(n: int) -> tuple[int, int]:
    """Sides a and b of the smallest near-square domain that holds n numbers."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round_value(half: np.ndarray, k: int, key: int, size: int) -> np.ndarray:
    return (mix(half.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xBF58476D1CE4E5B9) % 2**64)) % np.uint64(size)).astype(np.int64)


def permute(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: alternate halves are shifted by hashes of the other half; values past n walk on along their cycle."""
    a, b = _domain(n)
    out = rows.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] % a, out[todo] // a
        for k in range(ROUNDS):
            if k % 2:
                right = (right + _round_value(left, k, key, b)) % b
            else:
                left = (left + _round_value(right, k, key, a)) % a
        out[todo] = left + a * right
        todo = todo[out[todo] >= n]
    return out


def invert(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """The row number at each place of the permutation."""
    a, b = _domain(n)
    out = places.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] % a, out[todo] // a
        for k in reversed(range(ROUNDS)):
            if k % 2:
                right = (right - _round_value(left, k, key, b)) % b
            else:
                left = (left - _round_value(right, k, key, a)) % a
        out[todo] = left + a * right
        todo = todo[out[todo] >= n]
    return out


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", rows_per_bucket: int = 50_000) -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 that follow from the rows' content alone, and n.

    Rows are bucketed by a hash of `order`, numbered within buckets, and shifted by the running
    total of the bucket counts, so that no task sorts more than a bucket. Equal rows tie: any
    order among them gives the same result. The table of counts has n / rows_per_bucket rows.
    """
    n = df.count()
    buckets = max(16, -(-n // rows_per_bucket))
    held = df.withColumn("__h", F.xxhash64(*order)).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    counts = held.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *order)) - 1
    return held.join(before, "__b").withColumn(name, F.col("__before") + place).drop("__h", "__b", "__before"), n


def feistel_shards(df: DataFrame, order: list[Column], n_shards: int = 16, key: int = 20240229) -> DataFrame:
    """Adds shard and slot: place = permuted row number, shard = place mod n_shards, slot = place div n_shards.

    Shard sizes differ by one row at most and slots have no gaps. An empty table gives an empty
    result; null ids, empty and very long texts, ties and equal rows are numbered like any other row. Columns named shard or
    slot are replaced; others, whatever their names, stay: a row travels as one column.
    """
    packed = df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("held"), *[c.alias(f"o{k}") for k, c in enumerate(order)])
    numbered, n = number_rows(packed, [F.col(f"o{k}") for k in range(len(order))], "__row")

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, key))

    return (
        numbered.withColumn("__place", place("__row"))
        .select(*[F.col("held")[c].alias(c) for c in df.columns if c not in ("shard", "slot")], F.pmod("__place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("__place") / F.lit(n_shards)).cast("long").alias("slot"))
    )


def op4_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by law `rows`. A null text counts as no bytes; the rest of odd input: see feistel_shards."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        crc32_unsigned().alias("text_crc32"),
    )
    done = feistel_shards(docs, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
