"""Hard negatives by an exact nearest-neighbour join over Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LEAST, MOST, cut, floored, partitions_for, products, table, utf8

#: Bytes that all pivots may take together; they go to every task.
PIVOT_BYTES = 4 << 20
FOUND = "query long, anchor_id long, row long, vec_id long, score long"


class Space:
    """Vectors with one more component, sqrt(M**2 - |x|**2), which is 0 for a query: the distance to a query then falls as the inner product grows."""

    def __init__(self, pivots: np.ndarray, longest: float) -> None:
        self.longest = longest
        self.pivots = np.concatenate((pivots, self.lift(pivots)[:, None]), axis=1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))

    def nearest(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot and the distance to it."""
        last = np.zeros(len(x)) if query else self.lift(x)
        full = np.concatenate((x, last[:, None]), axis=1)
        square = (full * full).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (full @ self.pivots.T)
        cell = square.argmin(1)
        return cell, np.sqrt(np.maximum(square[np.arange(len(x)), cell], 0))

    def between(self) -> np.ndarray:
        square = (self.pivots * self.pivots).sum(1)
        return np.sqrt(np.maximum(square[:, None] + square - 2 * (self.pivots @ self.pivots.T), 0))


def _padded(lists: pa.ListArray, dims: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(lists), dims))
    rows = np.repeat(np.arange(len(lists)), sizes)
    m[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return m


def _assigned(space: Space, dims: int):
    """Each vector's cell and its distance to the pivot; anchors have a cell as queries too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _padded(b.column("v"), dims)
            cell, far = space.nearest(v, False)
            own, reach = space.nearest(v, True)
            packed = pa.array([x.tobytes() for x in v], pa.binary())
            cols = [b.column(c) for c in ("row", "vec_id", "label", "anchor")]
            yield pa.record_batch([*cols, packed, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(own.astype(np.int32)), pa.array(reach), pa.array((v * v).sum(1))], names=["row", "vec_id", "label", "anchor", "v", "cell", "far", "own_cell", "own_far", "square"])

    return run


class Best:
    """The k best rows so far of each query of one group, of the rows that have come."""

    def __init__(self, k: int, same: bool, dims: int) -> None:
        self.k, self.same, self.dims = k, same, dims
        self.parts: list[dict] = []
        self.ready = False

    def add_queries(self, c: dict) -> None:
        self.parts.append(c)

    def _begin(self) -> None:
        self.q = {n: np.concatenate([p[n] for p in self.parts]) for n in ("query", "anchor_id", "row", "label", "low", "high", "v")}
        _, first, self.inverse = np.unique(self.q["row"], return_index=True, return_inverse=True)
        self.vectors = self.q["v"][first]  # an anchor's vector counts once, whatever its number of queries
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(5))  # query's place, row, id, id is null, score
        self.floor = self.q["low"].copy()
        self.ready, self.parts = True, []

    def add_rows(self, c: dict, step: int = 1024) -> None:
        if not self.ready:
            self._begin()
        q, k = self.q, self.k
        for at in range(0, len(c["row"]), step):
            row, label, ids, null = (c[n][at : at + step] for n in ("row", "label", "vec_id", "null"))
            score = products(self.vectors, c["v"][at : at + step])[self.inverse]
            fits = (score >= self.floor[:, None]) & (score <= q["high"][:, None]) & (q["row"][:, None] != row)
            fits &= (q["label"][:, None] == label) if self.same else (q["label"][:, None] != label)
            i, j = np.nonzero(fits)
            if not len(i):
                continue
            new = (i, row[j], ids[j], null[j], score[i, j])
            place, row_, ids_, null_, score_ = (np.concatenate(x) for x in zip(self.kept, new, strict=True))
            order = np.lexsort((row_, ids_, null_, -np.maximum(score_, -MOST), place))
            sorted_place = place[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_place, sorted_place)
            keep = order[rank < k]
            self.kept = tuple(x[keep] for x in (place, row_, ids_, null_, score_))
            kth = order[rank == k - 1]
            self.floor[place[kth]] = np.maximum(self.floor[place[kth]], score_[kth])

    def out(self) -> pa.RecordBatch | None:
        if not self.ready or not len(self.kept[0]):
            return None
        place, row, ids, null, score = self.kept
        return pa.record_batch([pa.array(self.q["query"][place]), pa.array(self.q["anchor_id"][place]), pa.array(row), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score)], names=["query", "anchor_id", "row", "vec_id", "score"])


def _local(k: int, same: bool, dims: int):
    """The join of one slice of a group at a time: its queries come first, then the rows sent to it."""

    def columns(b: pa.RecordBatch) -> dict:
        data, _ = utf8(b.column("v"))
        ids = b.column("vec_id")
        whole = {n: b.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("query", "row", "label", "low", "high")}
        ids_, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        return whole | {"vec_id": ids_, "anchor_id": ids_, "null": null, "v": np.frombuffer(data.tobytes(), np.float64).reshape(-1, dims)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for b in batches:
            c = columns(b)
            group, slice_, kind = (b.column(n).to_numpy(zero_copy_only=False) for n in ("group", "slice", "kind"))
            turns = np.flatnonzero((np.diff(group) != 0) | (np.diff(slice_) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *turns], [*turns, b.num_rows], strict=True):
                if i == j:
                    continue
                if (group[i], slice_[i]) != now:
                    if best and (done := best.out()):
                        yield done
                    now, best = (group[i], slice_[i]), Best(k, same, dims)
                part = {n: x[i:j] for n, x in c.items()}
                if kind[i] == 0:
                    best.add_queries(part)
                elif best.parts or best.ready:
                    best.add_rows(part)
        if best and (done := best.out()):
            yield done

    return run


def _join(queries: DataFrame, rows: DataFrame, links: DataFrame, k: int, same: bool, dims: int, slice_rows: int) -> DataFrame:
    """The k best of the rows that links (group, cell, low and high distance; label too where only equal labels meet) send to each query's group.

    Rows of a group are dealt into slices of about slice_rows, so no task has more than one slice's; its queries go to each.
    """
    on = ["cell", "label"] if same else ["cell"]
    sent = lambda *cols: rows.select("row", "cell", "label", "far", *cols).join(links, on).where("far BETWEEN near AND away")
    load = cut(sent().groupBy("group").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices")), "load")
    asked = queries.join(load, "group").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("group", "slice", F.lit(0).alias("kind"), "query", "row", "vec_id", "label", "low", "high", "v")
    nothing = F.lit(None).cast("long")
    held = sent("vec_id", "v").join(load, "group").select("group", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), nothing.alias("query"), "row", "vec_id", "label", nothing.alias("low"), nothing.alias("high"), "v")
    met = asked.unionByName(held).repartition(partitions_for(rows), "group", "slice").sortWithinPartitions("group", "slice", "kind")
    return met.mapInArrow(_local(k, same, dims), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _searched(queries: DataFrame, rows: DataFrame, gaps: DataFrame, k: int, same: bool, dims: int, longest: float, slice_rows: int, name: str) -> DataFrame:
    """Each query's k best rows with a score from low to high, in two rounds.

    The first asks the rows of the group's own cells; its k-th best score bounds how far off a better row can be. By the
    triangle inequality over the pivots, the second sends a cell's rows only to groups that they might serve.
    """
    by = ["group", "label"] if same else ["group"]
    wide, slack = F.lit(float("inf")), 1e-6 * longest
    mine = queries.select("group", F.col("own_cell").alias("cell"), *by[1:]).distinct()
    near = cut(_join(queries, rows, mine.withColumn("near", -wide).withColumn("away", wide), k, same, dims, slice_rows), f"{name}-near")
    kth = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    at_most = lambda s: F.sqrt(F.greatest(F.col("square") + longest**2 - 2 * s.cast("double"), F.lit(0.0)))
    # a score near the ends of 64 bits may stand for one beyond, so it bounds nothing
    reached = F.greatest(F.coalesce("kth", F.lit(LEAST)), "low")
    bounds = (
        queries.join(kth, "query", "left").withColumn("reach", F.when(reached > -(2**62), at_most(reached)).otherwise(wide))
        .withColumn("inner", F.when(F.col("high") < 2**62, at_most(F.col("high"))).otherwise(0.0))
        .groupBy(*by, F.col("own_cell").alias("i")).agg(F.max("own_far").alias("own"), F.max("reach").alias("reach"), F.min("inner").alias("inner"))
    )
    low = F.greatest(F.col("gap") - F.col("own") - F.col("reach"), F.col("inner") - F.col("own") - F.col("gap")) - slack
    links = bounds.join(gaps, "i").groupBy(*by, "cell").agg(F.min(low).alias("near"), F.max(F.col("gap") + F.col("own") + F.col("reach") + slack).alias("away"))
    links = cut(links.join(mine, [*by, "cell"], "left_anti"), f"{name}-links")
    return _first(near.unionByName(_join(queries, rows, links, k, same, dims, slice_rows)), k)


def _groups(sizes: dict[int, int], gaps: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, number of groups): large cells are split, small ones next to each other share a group. There are as many cells as pivots at most."""
    out, group, held, left, at = [], 0, 0, dict(sizes), None
    while left:
        cell = min(left) if at is None else min(left, key=lambda c: (gaps[at, c], c))
        n, at = left.pop(cell), cell
        if held and held + n > most:
            group, held = group + 1, 0
        parts = max(1, -(-n // most))
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = 64, group_anchors: int = 256, slice_rows: int = 32768) -> DataFrame:
    """Each anchor's best rows of its own label, and for each of them the best rows of other labels that score from low to high percent of it.

    rows has vec_id, label (whole numbers), v (array<double> of integral values, no nulls) and anchor (boolean); other
    columns, whatever their names, aren't read. The result: anchor_id, positive_id, positive_score, rank, negative_id, negative_score.

    Pivots are the vectors with the smallest hashes. Vectors get one more component, so that a larger inner product is a smaller
    distance, and go to the cell of their nearest pivot; so do anchors, in groups of about group_anchors. A first round in a
    group's own cells bounds the distance of what is still to be found, and a second sends each other cell's rows to the
    groups that they might serve. Bounds only save work: every row that could be among the best is compared exactly.

    Rows are told apart by a key of their own: repeated ids and repeated vectors are rows like others, and each anchor row
    has its own result. Ties go to the smaller vec_id; null ids come last. Shorter vectors are filled with zeros, empty ones
    are all zeros. A score beyond 64 bits counts as the nearest long. A positive that scores below 0 has no negatives. Rows with a null
    label or vector take no part; no rows or no anchors give an empty result.
    """
    held = cut(rows.where("label IS NOT NULL AND v IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "v", F.coalesce("anchor", F.lit(False)).alias("anchor")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    dims, longest = held.agg(F.max(F.size("v")), F.max(square)).first()
    dims, longest = max(1, dims or 0), float(np.sqrt(longest or 0.0)) * (1 + 1e-12)
    most = max(1, min(pivots, PIVOT_BYTES // (8 * dims)))
    chosen = [r.v for r in held.select("v").orderBy(F.xxhash64("v")).limit(most).collect()] or [[]]
    space = Space(np.array([v + [0.0] * (dims - len(v)) for v in chosen], float).reshape(len(chosen), dims), longest)
    spark, between = rows.sparkSession, space.between()
    assigned = cut(held.mapInArrow(_assigned(space, dims), "row long, vec_id long, label long, anchor boolean, v binary, cell int, far double, own_cell int, own_far double, square double"), "cells")
    gaps = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(chosen)) for j in range(len(chosen))], "i int, cell int, gap double")
    sizes = {r.own_cell: r["count"] for r in assigned.where("anchor").groupBy("own_cell").count().collect()}
    dealt = spark.createDataFrame(_groups(sizes, between, group_anchors), "own_cell int, first int, parts int")
    group = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    anchors = assigned.where("anchor").join(F.broadcast(dealt), "own_cell").select(group.alias("group"), "row", "vec_id", "label", "v", "own_cell", "own_far", "square")
    asked = anchors.withColumns({"query": F.col("row"), "low": F.lit(LEAST), "high": F.lit(MOST)})
    found = _searched(asked, assigned, gaps, positives, True, dims, longest, slice_rows, "positives")
    pairs = cut(found.select(F.col("query").alias("row"), F.col("rank").alias("pos_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent, up: F.expr(f"CAST((CAST(positive_score AS DECIMAL(38, 0)) * {percent} + {up}) div 100 AS BIGINT)")
    windows = pairs.where("positive_score >= 0").withColumns({"low": share(low, 99), "high": share(high, 0), "query": F.col("row") * positives + F.col("pos_rank") - 1})
    again = cut(anchors.join(windows, "row"), "windows")
    worse = _searched(again.drop("pos_rank", "positive_id", "positive_score"), assigned, gaps, negatives, False, dims, longest, slice_rows, "negatives")
    named = again.select("query", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return worse.select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def contract_rows(emb: DataFrame) -> DataFrame:
    """vec_id, label, v = floor(256 * x) and anchor of the rows that take part: no null label, no null vector, no null or non-finite component. Every seventh label is a wrong one."""
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    wrong = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return emb.where(good).select("vec_id", wrong.alias("label"), floored("embedding").alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"))


def op11_voronoi_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector of `embeddings`; handling as in hard_negatives, a null vec_id is no anchor."""
    return hard_negatives(contract_rows(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
    row_number() OVER () AS k FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, c.k AS ck, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.k <> c.k WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id NULLS LAST, ck) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ak, p.ck ORDER BY s.score DESC, s.vec_id NULLS LAST, s.ck) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.ak = s.ak AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
