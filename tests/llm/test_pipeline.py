"""The pipeline's stages against plain loops, on a table with nulls, empty and very long texts, ties, repeated rows and repeated ids; and every query on empty and odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldmosaic.llm import queries

from .test_llm import removed, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocab, k=n))
    base, passage = make(80), make(70)
    out = [(0, None), (1, ""), (2, "  \n"), (None, base), (3, base), (3, base), (3, base + " and a word more"), (4, make(30)), (4, "quite another text under one id"), (None, None), (5, make(9000))]
    for k in range(10, 60):
        w = base.split() if k % 3 == 0 else make(rng.randint(5, 120)).split()
        w[rng.randrange(len(w))] = "changed"
        out.append((k, " ".join(w) + (" " + passage if k % 5 == 0 else "")))
    out += [(k, " ".join(rng.choices(["vile", "rotten", "stupid", "scum", "hate"], k=30))) for k in range(60, 75)]
    out += [(80, None), (81, passage), (81, passage)]
    return [(i, t, "en" if k % 2 else None, (None, "a", "b", "c")[k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if i % 7 == 0 else 1, int(i >= 60)) for i in range(10, 75)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def held(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=str)


def test_toxicity_drops_toxic_rows_only(spark, docs, sf):
    got = held(cp.toxicity(spark, docs, sf))
    assert got == sorted((r for r in rows() if r[0] is None or not 60 <= r[0] < 75), key=str)


def test_near_duplicates_by_plain_loops(spark, docs, sf):
    all_rows = rows()
    sets = [shingles(r[1], 5) for r in all_rows]
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and root[i] > root[j] and 100 * len(a & b) >= 80 * len(a | b):
                    root[i], changed = root[j], True
    got = held(cp.near_duplicates(spark, docs, sf))
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(all_rows[k])
    empty = [all_rows[k] for k, s in enumerate(sets) if not s]
    left = list(got)
    for r in empty:
        left.remove(r)
    for r, members in groups.items():
        if sets[r]:
            found = [x for x in left if x in members]
            least = min((m[0] is not None, m[0] or 0) for m in members)
            assert len(found) == 1 and (found[0][0] is not None, found[0][0] or 0) == least
            left.remove(found[0])
    assert not left


def test_repeated_passages_by_plain_loops(spark, sf):
    some = [r for r in rows() if r[0] is not None]
    some = [(k, *r[1:]) for k, r in enumerate(some)]
    got = {r.doc_id: r.text for r in cp.repeated_passages(spark, spark.createDataFrame(some, DOCS), sf).collect()}
    want = removed([(r[0], r[1]) for r in some])
    for k, t, *_ in some:
        n, gone, *_ = want[k]
        if gone == n and n:
            assert k not in got
        elif k in got:
            assert len(got[k].encode()) == n - gone
        else:
            assert gone and n - gone < 100


def test_mixture_and_packing_keep_counts(spark, docs, sf):
    mixed = cp.mixture(spark, docs, sf)
    got, times = held(mixed), {}
    for r in got:
        times[r] = times.get(r, 0) + 1
    copies = {r: rows().count(r) for r in rows()}
    assert all(n <= 2 * copies[r] and len((r[1] or "").split()) for r, n in times.items())
    words = lambda some: sum(len((r[1] or "").split()) for r in some)
    longest = max(len((r[1] or "").split()) for r in rows())
    assert abs(words(got) - 1.5 * words(rows())) <= 4 * longest
    pieces = cp.packing(spark, mixed, sf).collect()
    from tokenizers import Tokenizer

    from fieldmosaic.llm import packing

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in got)


def test_run_goes_through_all_stages(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns[0] == "doc_id" and got.count() > 0


ODD = {
    "documents": (DOCS + ", shard int, slot int, verdict string, media binary, taken long, rank int, score double, __h string", [(1, None), (2, ""), (2, ""), (None, "a b c d e"), (None, None), (3, "x" * 300_000), (4, "one two three four five six"), (4, "one two three four five six")]),
    "embeddings": ("vec_id long, embedding array<float>, rank int, score long, v int, row string, label int", [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (None, [1.0]), (2, [None, 1.0]), (3, [3e38]), (100, []), (4, [1.0, 2.0])]),
    "pages": ("page_id long, url string, html string, host string, rule string, verdict string", [(1, None), (2, ""), (3, "http://"), (3, "http://"), (None, "http://net/es/x"), (5, "://net/fr/" + "y" * 300_000)]),
    "labels": ("doc_id long, quality int, toxic int", [(1, None, 1), (2, 0, 1), (2, 1, 0), (None, 1, 1)]),
}


def _tables(spark, d, empty):
    for name, (schema, data) in ODD.items():
        width = schema.count(",") + 1
        full = [] if empty else [tuple(r) + (None,) * (width - len(r)) for r in data]
        df = spark.createDataFrame(full, schema)
        df.write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("nothing"), True)


TABLE = {"op7_maxscore_topk": "embeddings", "op10_url_filter": "pages", "op13_dictionary_warc": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_odd_tables(spark, odd, nothing, name):
    got = queries.QUERIES[name](spark, odd).collect()
    data = ODD[TABLE.get(name, "documents")][1]
    if name == "op7_maxscore_topk":
        most, near = 2**63 - 1, 256**2 + 512**2
        mine = [(50, 1, 3, most), (50, 2, 4, near), (50, 3, 50, near), (50, 4, None, 256**2), (50, 5, 100, 0)]
        other = [(100, n + 1, v, 0) for n, v in enumerate((3, 4, 50, 50, None))]
        assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == sorted(mine + mine + other, key=str)
    elif name in ("op11_voronoi_hard_negatives", "op12_trie_variants"):  # no labels, no word twice that is long enough; odd input: their own tests
        assert got == []
    elif name == "op13_dictionary_warc":
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(((r[0], 0, "response", None) for r in data), key=str)
    elif name == "op6_bm25_packing":
        assert {r.doc_id for r in got} == {r[0] for r in data} and sum(r.offset == 0 for r in got) >= 1
    else:
        assert len(got) == len(data)
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_op4_digests(spark, sf):
    got = queries.QUERIES["op4_feistel_sharding"](spark, sf).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op9_targets_by_a_loop(spark, sf):
    got = queries.QUERIES["op9_mixing"](spark, sf).collect()
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
        open_ -= full or set(open_)
    source = {}
    for r in rows():
        source.setdefault((r[0], len((r[1] or "").split())), set()).add(r[3])
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}
    assert abs(sum(r.taken for r in got) - goal) <= len(order) and all(0 <= r.taken <= 2 * r["size"] for r in got)


def test_out_of_fold_probabilities_dont_see_their_row():
    from fieldmosaic.llm import toxicity

    rng = np.random.default_rng(0)
    n, row = 60, np.repeat(np.arange(60), 3)
    bucket = np.concatenate([[k, 1000 + k % 5, 2000 + k % 7] for k in range(60)])
    labels = np.stack([rng.random(n) < 0.5, rng.random(n) < 0.5], 1)
    seen = []
    fit = toxicity.Linear.fit
    toxicity.Linear.fit = lambda self, n, row, bucket, dense, y, **k: seen.append(dense.copy()) or fit(self, n, row, bucket, dense, y, **k)
    try:
        toxicity.fit_chain(n, row, bucket, np.zeros((n, 1)), labels)
        before = seen[-1][:, 1]
        other = labels.copy()
        other[0, 0] = not other[0, 0]
        toxicity.fit_chain(n, row, bucket, np.zeros((n, 1)), other)
    finally:
        toxicity.Linear.fit = fit
    after = seen[-1][:, 1]
    fold = np.arange(n) % 3
    assert np.allclose(before[fold == 0], after[fold == 0]) and not np.allclose(before[fold != 0], after[fold != 0])


def test_toxicity_on_labels_kept_out(spark):
    from fieldmosaic.llm import toxicity

    d = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    chain = toxicity.train(all_docs, labels.where(~out))
    got = toxicity.score(all_docs, chain).join(labels.where(out).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    hits = sum(r.toxic and r.y == 1 for r in got)
    assert len(got) > 20 and hits >= 0.6 * sum(r.y == 1 for r in got) and sum(r.toxic for r in got) - hits <= 0.1 * len(got)
