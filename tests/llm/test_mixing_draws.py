"""The splitting tree's draws against the exact distribution, and the pipeline's mixture and packing stages row by row."""

from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldmosaic.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("good,bad,drawn", [(7, 5, 4), (3, 40, 20), (30, 2, 15), (1, 1, 1), (12, 0, 5), (0, 9, 4), (25, 25, 25)])
def test_hypergeometric_draws(spark, good, bad, drawn):
    """Over evenly spread numbers the shares of all outcomes are the distribution's."""
    n = 4000
    u = (F.col("id") + 0.5) / n
    lit = lambda x: F.lit(x).cast("long")
    got = Counter(r.k for r in spark.range(n).select(mixing._hypergeometric(lit(good), lit(bad), lit(drawn), u).alias("k")).collect())
    for k in range(max(0, drawn - bad), min(good, drawn) + 1):
        assert got.pop(k, 0) / n == pytest.approx(comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn), abs=2 / n)
    assert not got


def test_quotas_are_split_exactly(spark):
    quotas = [37, 0, 5, 400, 1]
    df = spark.createDataFrame([(quotas,)], "q array<long>")
    first = []
    for seed in range(6):
        leaves = {r.shard: list(r.q) for r in mixing.split_quotas(df, 16, seed).collect()}
        assert sorted(leaves) == list(range(16)) and [sum(q) for q in zip(*leaves.values(), strict=True)] == quotas
        totals = [sum(q) for q in leaves.values()]
        assert max(totals) - min(totals) <= 4 and min(min(q) for q in leaves.values()) >= 0  # one block for each level
        first.append(tuple(map(tuple, (leaves[k] for k in range(16)))))
        assert {r.shard: list(r.q) for r in mixing.split_quotas(df, 16, seed).collect()} == leaves
    assert len(set(first)) > 1


def level(sizes):
    """Targets of sources in order, by weights 5, 2, 1 repeating, 150 % of all words in all, at most twice a source's own."""
    weights, out, left = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))], [0.0] * len(sizes), 1.5 * sum(sizes)
    free = set(range(len(sizes)))
    while free and left > 1e-9:
        share = left / sum(weights[k] for k in free)
        full = {k for k in free if weights[k] * share >= 2 * sizes[k] - out[k] - 1e-12}
        if not full:
            for k in free:
                out[k] += weights[k] * share
            break
        for k in full:
            left -= 2 * sizes[k] - out[k]
            out[k] = 2.0 * sizes[k]
        free -= full
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, " ".join(["w"] * (k % 23 + 1)), "de", "abcd"[min(3, k % 7)], 5) for k in range(400)] + [(500, None, None, "a", None), (501, "", None, None, 0), (502, "one two", None, None, 7), (502, "one two", None, None, 7), (503, "long " * 900, "en", "b", 4500)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_mixture_stage_by_loops(spark, docs):
    size = lambda t: len((t or "").split())
    held = docs.collect()
    of = sorted({r.source for r in held}, key=lambda s: (s is None, s or ""))
    totals = [sum(size(r.text) for r in held if r.source == s) for s in of]
    got = [tuple(r) for r in cp.mixture(spark, docs, "").collect()]
    have = Counter(map(tuple, held))
    assert set(got) <= set(have) and all(n <= 2 * have[r] and size(r[1]) for r, n in Counter(got).items())
    for s, target, total in zip(of, level(totals), totals, strict=True):
        words = sum(size(r[1]) for r in got if r[3] == s)
        longest = max(size(r.text) for r in held if r.source == s)
        assert abs(words - target) <= longest / 2 + 1 and words <= 2 * total, s
        times = Counter(got)
        passes = int(round(target) // total)
        assert all(passes * have[r] <= times[r] <= (passes + 1) * have[r] for r in have if r[3] == s and size(r[1]))  # every row as often as the others, or once more
    assert Counter(map(tuple, cp.mixture(spark, docs.repartition(7), "").collect())) == Counter(got)


def test_packing_stage_row_by_row(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = cp.packing(spark, docs, "").collect()
    windows, parts = {}, {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        parts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for w in windows.values():  # gapless from 0, and no longer than a window
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:i]) for i in range(len(w))] and sum(n for _, n in w) <= 2048
    full = sum(sum(n for _, n in w) == 2048 for w in windows.values())
    assert full >= len(windows) - len(windows) ** 0.5 - 2
    for key, found in parts.items():  # each document's ids once, as often as the document is there
        cover = Counter(i for s, n in found for i in range(s, s + n))
        assert cover == Counter({i: want[key] for i in range(key[1])})
    assert set(parts) == set(want)
