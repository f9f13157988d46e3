"""Columns whose names clash with those that operators add or use, and helpers that several of them share."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from fieldmosaic.llm import language_id, sharding, toxicity, url_filter
from fieldmosaic.llm.common import whole_keys


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.range(100).select("id", *[F.lit(k).alias(c) for k, c in enumerate(("__h", "__b", "__n", "__before", "__row", "__place", "held", "o0", "shard", "a.b"))])
    got = sharding.feistel_shards(df, [F.col("id")], 7)
    assert got.columns == ["id", "__h", "__b", "__n", "__before", "__row", "__place", "held", "o0", "a.b", "shard", "slot"]
    assert {tuple(r)[1:10] for r in got.collect()} == {(0, 1, 2, 3, 4, 5, 6, 7, 9)}
    plain = sharding.feistel_shards(df.select("id"), [F.col("id")], 7)
    assert sorted(map(tuple, plain.collect())) == sorted((r.id, r.shard, r.slot) for r in got.collect())


def test_scores_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "some words", "t", 0.5), (2, None, "t", 0.5)], "doc_id long, text string, toxic string, p_toxic double")
    got = toxicity.score(docs, None, ("doc_id", "toxic", "p_toxic", "text"))
    assert got.columns == ["doc_id", "text", "p_junk", "p_toxic", "junk", "toxic"] and not got.where("toxic OR p_toxic > 0").count() and got.count() == 2
    named = docs.select("doc_id", "text", F.col("toxic").alias("lang_pred"), F.col("p_toxic").alias("score"))
    assert language_id.identify(named, None, ("doc_id", "lang_pred", "score")).columns == ["doc_id", "lang_pred", "score"]


def test_url_filter_with_a_map(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://net/es/x").alias("url"), F.create_map(F.lit("a"), F.col("id") % 2).alias("m"))
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    got = url_filter.filter_urls(pages, rules)
    assert got.count() == 40 and {r.verdict for r in got.collect()} == {"block"}


def test_training_windows_are_bounded_in_length(spark):
    docs = spark.createDataFrame([(k, chr(97 + k % 26) * (90_000 + k), "de") for k in range(60)], "doc_id long, text string, lang string")
    held = language_id.training_windows(docs, 10, 128)
    assert held and max(len(t) for t, _ in held) <= 64 * 128


def test_whole_keys():
    """Tables of sorted batches hold whole keys, about as many bytes as asked for, and all rows in order."""
    rng = random.Random(3)
    keys = sorted(rng.choices(range(-20, 20), k=500) + [7] * 300)
    batches, at = [], 0
    while at < len(keys):
        n = rng.randint(0, 9)
        batches.append(pa.record_batch({"k": pa.array(keys[at : at + n], pa.int64()), "v": pa.array(range(at, min(at + n, len(keys))), pa.int64())}))
        at += n
    for most in (1, 400, 3000, 10**9):
        got = list(whole_keys(iter(batches), "k", most))
        assert [v for t in got for v in t.column("v").to_pylist()] == list(range(len(keys)))
        ends = [(t.column("k")[0].as_py(), t.column("k")[-1].as_py()) for t in got]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False)) and (len(got) == 1) == (most == 10**9)
    assert list(whole_keys(iter([]), "k")) == [] and list(whole_keys(iter([batches[0].slice(0, 0)]), "k")) == []
