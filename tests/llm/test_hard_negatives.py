"""Hard negatives against a loop over all pairs in whole numbers."""

import math
import random

import numpy as np
import pytest

from fieldmosaic.llm import common
from fieldmosaic.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, row string, cell string, query string, group string"


def brute(rows, low=80, high=100, k=5):
    """Rows (vec_id, label, whole vector, anchor) in, the operator's rows out; scores are cut to 64 bits."""
    clip = lambda x: max(common.LEAST, min(common.MOST, x))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(a, b, strict=False)))
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]
    out = []
    for i, (anchor, label, v, is_anchor) in enumerate(rows):
        if not is_anchor:
            continue
        scored = [(dot(v, w), vec_id, other) for j, (vec_id, other, w, _) in enumerate(rows) if j != i]
        for score, positive, _ in first([s for s in scored if s[2] == label]):
            fits = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score]
            out += [(anchor, positive, rank + 1, s[1], score, s[0]) for rank, s in enumerate(first(fits))]
    return sorted(out, key=str)


def taken(rows):
    """The contract's reading of a table's rows."""
    out = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        out.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v], vec_id is not None and vec_id % 100 == 0))
    return out


def embeddings(seed=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, rng.randrange(4), [x + rng.gauss(0, 0.3) for x in middle[rng.randrange(4)]]) for k in range(900)]
    same = [0.5] * 6
    rows += [(k, k % 3, same) for k in range(900, 1200)]  # a quarter of all rows are copies: ties everywhere
    rows += [(100, 1, rows[0][2]), (100, 1, rows[0][2]), (None, 1, same), (None, None, same), (1300, 2, None), (1301, 2, [1.0, None]), (1302, 2, [float("nan")] * 6), (1303, 2, [float("inf")] * 6)]
    return rows + [(1400, 1, []), (1500, 2, [1.0]), (1600, 1, [2.0] * 9), (1700, 3, [-1.0] * 6), (1800, 77, [0.1] * 6)]


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)


def test_equals_a_loop(spark):
    rows = embeddings()
    want = brute(taken(rows))
    assert len(want) > 200
    df = hn.contract_rows(frame(spark, rows))
    assert got(hn.hard_negatives(df)) == want
    assert got(hn.hard_negatives(df, pivots=3, group_anchors=2, slice_rows=100)) == want


def test_large_components_are_exact(spark):
    """Sums beyond 2**53 stay exact; beyond 64 bits the nearest long counts."""
    rng = random.Random(1)
    rows = [(k, k % 2, [2.0**rng.randrange(10, 26) + rng.randrange(100) for _ in range(4)]) for k in range(150)]
    rows += [(200 + k, k % 2, [3e38, 1.0, 1.0, -3e37 * k]) for k in range(4)] + [(300, 0, [-3e38] * 4)]
    assert got(hn.hard_negatives(hn.contract_rows(frame(spark, rows)))) == brute(taken(rows))


def test_other_bounds_and_no_rows(spark):
    rows = embeddings(9)[:400]
    df = hn.contract_rows(frame(spark, rows))
    assert got(hn.hard_negatives(df, positives=2, negatives=3, low=50, high=90)) == [x for x in _bounded(taken(rows))]
    assert hn.hard_negatives(df.limit(0)).count() == 0
    assert hn.hard_negatives(df.where("NOT anchor OR anchor IS NULL")).count() == 0


def _bounded(rows):
    clip = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (anchor, label, v, is_anchor) in enumerate(rows):
        if is_anchor:
            scored = sorted(((-clip(v, w), vec_id, other) for j, (vec_id, other, w, _) in enumerate(rows) if j != i))
            for score, positive, _ in [s for s in scored if s[2] == label][:2]:
                fits = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 90 * -score][:3]
                out += [(anchor, positive, rank + 1, s[1], -score, -s[0]) for rank, s in enumerate(fits)]
    return sorted(out, key=str)


def test_second_round_skips_far_rows(spark):
    """Where vectors lie in tight, distant groups, most of them aren't sent to other groups' anchors."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 50, (20, 8))
    rows = [(k, int(k // 20 % 2), [float(x) for x in middle[k % 20] / np.linalg.norm(middle[k % 20]) * 100 + rng.normal(0, 0.05, 8)]) for k in range(2000)]
    df = hn.contract_rows(frame(spark, rows))
    sent = []
    join = hn._join
    try:
        hn._join = lambda queries, held, links, *a: (sent.append(held.join(links, ["cell", "label"] if a[1] else ["cell"]).where("far BETWEEN near AND away").count()), join(queries, held, links, *a))[1]
        assert got(hn.hard_negatives(df, pivots=20, group_anchors=5)) == brute(taken(rows))
    finally:
        hn._join = join
    assert len(sent) == 4 and sent[1] < 2000, sent


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = c.execute(hn.OP11_SQL).df()
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(hn.op11_voronoi_hard_negatives(spark, "/root/testdata/sf0.001")) == sorted((tuple(int(x) for x in r) for r in want[cols].itertuples(index=False)), key=str)
