"""URL rules and lists: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Odd 31-bit multipliers, one for each of a block's eight 32-bit words; products of 31-bit numbers don't overflow a long.
SALTS = tuple((0x9E3779B97F4A7C15 * (2 * i + 1) >> 20) & 0x7FFFFFFF | 1 for i in range(8))
LOW = 0x7FFFFFFF
#: Rules of the query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class BlockedBloom:
    """Blocks of 256 bits; a key sets one bit in each of the eight words of one block.

    The listed keys are combined on the executors (bit_or by block); only the blocks come to the
    driver. Their number is fixed by the count of keys and max_bytes, so the size that is sent to
    every executor is at most max_bytes whatever the list; beyond it the filter only gets denser
    and passes more rows to the exact join.
    """

    def __init__(self, keys: DataFrame, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> None:
        n = keys.count()
        self.blocks = int(min(max(1, -(-n * bits_per_key // 256)), max_bytes // 32))
        low = F.col("h").bitwiseAND(F.lit(LOW))
        word = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(LOW)), 26).cast("int")) for s in SALTS]
        block = F.pmod(F.shiftrightunsigned("h", 32), F.lit(self.blocks))
        rows = keys.groupBy(block.alias("b")).agg(*[F.bit_or(w).alias(f"w{i}") for i, w in enumerate(word)]).toArrow()  # 72 bytes for each block
        self.words = np.zeros((self.blocks, 8), np.uint64)
        for i in range(8):
            self.words[rows.column("b").to_numpy(), i] = rows.column(f"w{i}").to_numpy().view(np.uint64)

    def flagged(self, df: DataFrame, hashes: Column, name: str = "__maybe") -> DataFrame:
        """Adds whether one of an array of hashes may be among the keys."""
        sent = df.sparkSession.sparkContext.broadcast((self.words, self.blocks))
        schema = df.schema.add(name, "boolean")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = BlockedBloom.__new__(BlockedBloom)
            mine.words, mine.blocks = sent.value
            for b in batches:
                lists = b.column("__hashes")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                hits = np.bincount(np.repeat(np.arange(len(size)), size), mine.might_have(lists.flatten().to_numpy()), len(size))
                yield pa.record_batch([*b.columns[:-1], pa.array(hits > 0)], names=schema.names)

        return df.select("*", hashes.alias("__hashes")).mapInArrow(run, schema)

    def column(self, h: Column) -> Column:
        """Whether a hash may be among the keys, as a column."""
        sent = SparkSession.getActiveSession().sparkContext.broadcast((self.words, self.blocks))

        @F.pandas_udf("boolean")
        def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mine = BlockedBloom.__new__(BlockedBloom)
            mine.words, mine.blocks = sent.value
            for x in batches:
                yield pd.Series(mine.might_have(x.to_numpy()))

        return possible(h)

    def might_have(self, h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64).view(np.uint64)
        block = self.words[((h >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)]
        low = h & np.uint64(LOW)
        ok = np.ones(len(h), bool)
        for i, s in enumerate(SALTS):
            bit = ((low * np.uint64(s)) & np.uint64(LOW)) >> np.uint64(26)
            ok &= (block[:, i] >> bit) & np.uint64(1) == 1
        return ok


def _listed(rules: DataFrame) -> DataFrame:
    listed = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).where("rule_host IS NOT NULL AND rule_path IS NOT NULL")
    return listed.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))


def _possible_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The rule keys that a url could have: suffixes of its host with as many labels as some rule, with prefixes of its path as long as some rule's."""
    held = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    some = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    suffixes = some([F.when(held >= c, F.substring_index(host, ".", -c)) for c in labels])
    prefixes = some([F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("rule_host"), p.alias("rule_path")))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", salts: int = 16) -> DataFrame:
    """Adds host, path, rule and verdict; columns of these names that pages has are replaced.

    rules has verdict, host, path; a rule fits its host and all subdomains when the url's path starts with the rule's.
    The longest rule wins (host and path together, then the host); of equal rules the smaller verdict. The Bloom filter passes urls of which a
    possible key may be listed, and these alone are joined with the rules exactly; urls that many rows have are
    dealt to `salts` tasks, row by row. Null and empty urls and urls without :// have empty host and path, no rule, and the verdict
    `otherwise`: no list names them. Work on a url grows with its length times the rules' numbers of labels and lengths
    of paths. Repeated rows stay. Empty pages give an empty result, and without rules nothing is blocked.
    """
    listed = _listed(rules)
    labels = [r[0] for r in listed.select(F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."), F.lit(""))) + 1).distinct().collect()]  # at most the labels of the longest host
    lengths = [r[0] for r in listed.select(F.length("rule_path")).distinct().collect()]  # at most the longest path
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    held = pages.select(*rest, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    names = [F.col(c) for c in rest if c not in ("host", "path", "rule", "verdict")] + [F.col("__host").alias("host"), F.col("__path").alias("path")]
    if not labels:
        return held.select(*names, F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    bloom = BlockedBloom(listed.select(F.xxhash64("rule_host", "rule_path").alias("h")))
    keys = _possible_keys(F.col("__host"), F.col("__path"), sorted(labels), sorted(lengths))
    hashed = bloom.flagged(held, F.transform(keys, lambda k: F.xxhash64(k["rule_host"], k["rule_path"])))
    maybe = hashed.where("__maybe").drop("__maybe")
    weight = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    won = (
        maybe.select("__host", "__path", F.explode(keys).alias("k")).select("__host", "__path", "k.rule_host", "k.rule_path").distinct()
        .join(listed, ["rule_host", "rule_path"])
        .groupBy("__host", "__path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), weight).alias("__won"))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    met = maybe.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(won, ["__host", "__path", "__salt"], "left")
    met = met.select(*names, F.col("__won.rule").alias("rule"), F.coalesce("__won.verdict", F.lit(otherwise)).alias("verdict"))
    return met.unionByName(hashed.where("NOT __maybe").select(*names, F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict by RULES. Nulls, empty and very long urls, ties, repeated rows, empty tables and clashing names: see filter_urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH rules(v, h, p) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
u AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.page_id, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h) + length(r.p) DESC, length(r.h) DESC) AS k
  FROM u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""
