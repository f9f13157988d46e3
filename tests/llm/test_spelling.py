"""Spelling variants against loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from fieldmosaic.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, path string, core string"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, spoil=31, least=7):
    out = Counter()
    for doc_id, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{r}".encode())
            if h % spoil == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            out[r] += len(r) >= least
    return {w: n for w, n in out.items() if n >= 2}


def brute(words, factor=10):
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in near.items() if o}
    form = {w: o if words[o] >= factor * words[w] else None for w, o in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if form.get(w) else None) for w, n in words.items())


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcéßA", k=rng.randint(5, 9))) for _ in range(40)]
    long = "ab" * 700
    rows = [(None, "aaaaaaa aaaaaaab"), (1, None), (2, ""), (3, "12 ... !"), (4, "aaaaaaa " * 300), (4, "aaaaaaa " * 3), (5, f"{long} {long} {long}c {long}c {long[:400]}x{long[400:]} " * 2)]
    for k in range(6, 150):
        words = []
        for w in rng.choices(base, weights=[1 / (i + 1) for i in range(40)], k=60):
            at, x = rng.randrange(len(w)), rng.random()
            words.append(w if x < 0.8 else w[:at] + w[at + 1 :] if x < 0.87 else w[:at] + rng.choice("abcé") + w[at + (x < 0.93) :])
        rows.append((k, rng.choice([" ", "-", "\t", "×"]).join(words)))  # U+00D7 is in the pattern, so it joins words
    return rows + [(7, rows[8][1]), (7, rows[8][1])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)


def test_equals_loops(spark):
    want = brute(counted(texts()))
    assert len(want) > 100 and sum(r[1] is not None for r in want) > 30 and max(r[4] for r in want) > 5
    vocab = spelling.vocabulary(frame(spark, texts()), spoil=31)
    assert got(spelling.variants(vocab)) == want


def test_hot_parts_are_parted_again(spark):
    """Thousands of words with one beginning and one end meet in small parts only, and no pair is lost."""
    rng = random.Random(2)
    words = {"prefixes" + "".join(rng.choices("abc", k=6)) + "suffixes": k % 7 + 1 for k in range(900)} | {"a": 1, "": 2, "b": 3, "ab": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((w, o) for w in words for o in words if one_apart(w, o))
    assert len(want) > 300
    for most in (20_000, 100, 25):
        assert sorted((r.word, r.other) for r in spelling.near_pairs(df, most).collect()) == want


def test_chains_ties_and_factor(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 9999, "zzzzzzy": 5, "zzzzzzx": 50, "zzzzzzw": 50}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r[0]: r for r in got(spelling.variants(df))}
    assert list(found.values()) == brute(words)
    assert found["aaaaaaa"][2] == "aaaabbb" and found["zzzzzzy"][1] == "zzzzzzw"
    assert got(spelling.variants(df, factor=2)) == brute(words, 2)


def test_trie_pairs():
    rng = random.Random(1)
    for _ in range(200):
        group, cores = [], []
        for k in range(rng.randint(1, 4)):
            some = sorted({"".join(rng.choices("abé"[: rng.randint(1, 3)], k=rng.randint(0, 6))) for _ in range(rng.randint(1, 40))})
            cores, group = cores + some, group + [k] * len(some)
        v, u = spelling.trie_pairs(cores, np.array(group))
        pairs = sorted(tuple(sorted(p)) for p in zip(v.tolist(), u.tolist(), strict=True))
        assert pairs == [(i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if group[i] == group[j] and one_apart(cores[i], cores[j])]


def test_no_rows(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []), spoil=31)).count() == 0
    assert spelling.variants(spelling.vocabulary(frame(spark, [(1, None), (None, ""), (2, "a b c")]))).count() == 0


def test_batches_keep_parts_whole(spark, monkeypatch):
    """Parts that cross the batches Spark hands over are still one trie."""
    words = {f"common{a}{b}": 1 for a in "abcdefghij" for b in "abcdefghij"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert spelling.near_pairs(df).count() == 100 * 18
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(c.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.OP12_SQL})").fetchall(), key=lambda r: r[0].encode())
    have = spelling.op12_trie_variants(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in have.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0].encode()) == want
    assert have.where(F.col("form").isNotNull()).count() > 0
