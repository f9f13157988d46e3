"""Exact top-k inner products by MaxScore over postings of vector components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, floored, partitions_for, products, table

BLOCK = "keys binary, dims int, comps binary"
#: What a null id is sorted as: behind all others.
LAST = 2**63 - 1
#: Vectors with a component this large are in shards of their own, so that they alone are multiplied as whole numbers of any size.
WIDE = 2.0**20


def _packer(per_block: int):
    """Rows (row, vec_id, v, wide) into blocks of at most per_block vectors, wide ones apart; shorter vectors are filled up with zeros, which add nothing to a product. keys: row, id and whether the id is null, for each vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for wide in (False, True):
                b = whole.filter(pc.equal(whole.column("wide"), wide))
                for k in range(0, b.num_rows, per_block):
                    part = b.slice(k, per_block)
                    lists = part.column("v")
                    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    dims = int(sizes.max(initial=0))
                    m = np.zeros((part.num_rows, dims))
                    rows = np.repeat(np.arange(part.num_rows), sizes)
                    m[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
                    ids = part.column("vec_id")
                    keys = np.stack([part.column("row").to_numpy(zero_copy_only=False), ids.fill_null(LAST).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
                    yield pa.record_batch({"keys": pa.array([keys.tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()), "comps": pa.array([m.tobytes()], pa.binary())})

    return pack


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id, null ids last, then smaller row."""
    held = np.arange(len(scores))
    if len(scores) > 4 * k:
        held = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    row, ids, null = keys[:, held]
    return held[np.lexsort((row, ids, null, -np.maximum(scores[held], -LAST)))[:k]]


class Shard:
    """One block of vectors as postings. A dimension has two lists, of its positive and its negative components, each with the largest first; zeros have no posting."""

    def __init__(self, keys: np.ndarray, comps: np.ndarray) -> None:
        self.keys, self.comps = keys, comps
        order = np.argsort(comps, axis=0, kind="stable").astype(np.int32)  # ascending: negative ones, zeros, positive ones
        self.order, self.values = np.ascontiguousarray(order.T), np.ascontiguousarray(np.take_along_axis(comps, order, 0).T)
        self.below, self.above = (comps < 0).sum(0), (comps > 0).sum(0)
        self.low, self.high = (comps.min(0), comps.max(0)) if len(comps) else (comps.sum(0), comps.sum(0))
        self.peak = float(np.abs(comps).max(initial=0))
        self.by_dim = np.ascontiguousarray(comps.T)
        self.stored = int((self.below + self.above).sum())
        self.read = 0

    def _gains(self, d: int, weight: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the list of dimension d that adds to a score, largest first, down to what adds `least` at least."""
        n = len(self.comps)
        if weight > 0:
            at, v = self.order[d, n - self.above[d] :], self.values[d, n - self.above[d] :]
            k = int(np.searchsorted(v, -(-least // weight)))
            return at[k:], v[k:] * weight
        at, v = self.order[d, : self.below[d]], self.values[d, : self.below[d]]
        k = int(np.searchsorted(v, -least // -weight, side="right"))
        return at[:k], v[:k] * weight

    def top(self, row: int, q: np.ndarray, k: int, least: int | None = None, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """MaxScore: places and scores of the k best vectors but the query's own row, without those that score under `least`, the k-th best score known from other shards.

        A list's bound is the most that it can add. Lists are taken by bound, the largest first; those that together can't
        lift a vector to the k-th best score aren't essential. Essential postings are traversed, the last list only as
        far as needed, and give the candidates; the other lists, and those that only take away, are probed for
        candidates that are still competitive.
        """
        own = self.keys[0] == row
        if float(np.abs(q).max(initial=0)) * self.peak * max(1, len(q)) >= 2.0**53:  # sums may not be exact as doubles: all are made of whole numbers
            sums = products(q[None], self.comps)[0]
            live = np.flatnonzero(~own & (sums >= (-LAST - 1 if least is None else least)))
            won = _best(self.keys[:, live], sums[live], k)
            return live[won], sums[live][won]
        bound = np.maximum(np.maximum(q * self.low, q * self.high), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))  # what lists from here on add at most
        if int((~own).sum()) >= k:  # a first k-th best score: of the vectors first in the lists with the largest bounds
            some = [self._gains(int(d), int(q[d]), 1)[0] for d in order[:4] if bound[d] > 0]
            some = [x[:: -1 if q[d] > 0 else 1][: 4 * k] for x, d in zip(some, order[:4], strict=False)]
            first = np.unique(np.concatenate(some)) if some else np.arange(min(len(own), 4 * k))
            first = first[~own[first]]
            if len(first) >= k:
                kth = int(np.sort(self.comps[first] @ q)[-k])
                least = kth if least is None else max(least, kth)
        seen, read = np.zeros(len(self.comps), bool), 0
        if least is None or least <= 0:  # a vector without any gain could win: all are candidates
            seen[:] = True
            essential = 0
        else:
            essential = int(np.argmax(rest < least))  # lists from here on don't reach the k-th best score
            for i, d in enumerate(order[:essential]):
                at, gain = self._gains(int(d), int(q[d]), max(1, least - int(rest[i + 1])))
                # shorter than the whole list only where no later list makes up for what is left out
                seen[at] = True
                read += len(at)
        self.read += read
        live = np.flatnonzero(seen & ~own)
        by = self.by_dim
        sums, at = np.zeros(len(live)), 0
        least = -(2**62) if least is None else least
        while at < len(order) and len(live):
            some = order[at : at + step]
            sums = sums + q[some] @ (by[some] if len(live) == len(self.comps) else by[np.ix_(some, live)])
            self.read += len(live) * len(some)
            at += step
            keep = sums + rest[min(at, len(order))] >= least
            live, sums = live[keep], sums[keep]
        sums = sums.astype(np.int64)
        won = _best(self.keys[:, live], sums, k)
        return live[won], sums[won]


def _search(k: int):
    """Query blocks against a part's shards, which come first; each query's k-th best score so far goes from shard to shard."""

    def read(row: dict) -> tuple[np.ndarray, np.ndarray]:
        keys = np.frombuffer(row["keys"], np.int64).reshape(3, -1)
        return keys, np.frombuffer(row["comps"], np.float64).reshape(keys.shape[1], row["dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shards = None, []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("part", "kind", "keys", "dims", "comps")}
                if row["part"] != now:
                    now, shards = row["part"], []
                keys, m = read(row)
                if row["kind"] == 0:
                    shards.append(Shard(keys, m))
                    continue
                asked, found, scores = [], [], []
                for own, q in zip(keys.T, m, strict=True):
                    held, score = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
                    for s in shards:
                        wide = s.comps.shape[1]
                        one = q[:wide] if len(q) >= wide else np.pad(q, (0, wide - len(q)))  # what one side lacks is zero
                        at, more = s.top(int(own[0]), one, k, int(score.min()) if len(score) == k else None)
                        held, score = np.concatenate((held, s.keys[:, at]), axis=1), np.concatenate((score, more))
                        best = _best(held, score, k)
                        held, score = held[:, best], score[best]
                    asked.append(np.repeat(own[:, None], len(score), axis=1))
                    found.append(held)
                    scores.append(score)
                if asked:
                    q, v = np.concatenate(asked, axis=1), np.concatenate(found, axis=1)
                    ids = lambda x: pa.array(x[1], pa.int64(), mask=x[2].astype(bool))
                    yield pa.record_batch([pa.array(q[0]), ids(q), pa.array(v[0]), ids(v), pa.array(np.concatenate(scores).astype(np.int64))], names=["query", "query_id", "row", "vec_id", "score"])

    return run


def maxscore_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, query_rows: int = 256, shards_per_part: int = 16) -> DataFrame:
    """The k best vectors of each query: query_id, rank, vec_id, score.

    Both inputs have row (a key of the row's own), vec_id and v (array<double> of whole values); other columns aren't read. Vectors are packed in shards, which keep their
    place in a part; blocks of queries go to each part once, and each part gives the k best of each query, which
    are merged by query. A row isn't a candidate of itself; rows with repeated or null ids are queries and candidates like
    others, each with a result of its own. Ties go to the smaller id, null ids last, then to the smaller row. Vectors of other lengths are filled
    with zeros. Scores are exact; one beyond 64 bits counts as the nearest long. Empty tables give an empty result.

    On dense vectors every list is long, and a bound only ends the work on single candidates: on the given embeddings
    about as many postings are read as are stored. Lists are skipped where components are few or uneven.
    """
    wide = F.exists("v", lambda x: F.abs(x) >= WIDE).alias("wide")
    blocks = lambda df, rows: df.select("row", F.col("vec_id").cast("long").alias("vec_id"), "v", wide).mapInArrow(_packer(rows), BLOCK)
    shards = cut(blocks(vectors, shard_rows), "vectors")
    parts = max(1, -(-shards.count() // shards_per_part))
    q = cut(blocks(queries.coalesce(max(1, partitions_for(queries))), query_rows), "queries")
    held = shards.withColumn("part", F.pmod(F.xxhash64("keys"), F.lit(parts)).cast("int")).withColumn("kind", F.lit(0))
    sent = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(1))
    met = held.unionByName(sent).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = met.mapInArrow(_search(k), "query long, query_id long, row long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def scaled(emb: DataFrame) -> DataFrame:
    """row, vec_id and v = floor(256 * x) of every whole vector; null vectors and those with null or non-finite components are left out. Written once, as a row's key must not change between the two sides of a search."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cut(emb.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", floored("embedding").alias("v")), "scaled")


def op7_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every fiftieth of `embeddings`; a null id is no query. The rest of odd input: see maxscore_topk."""
    vectors = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return maxscore_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS k, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.k AS query, q.vec_id AS query_id, c.k, c.vec_id, CAST(least(greatest(list_dot_product(q.v, c.v), -9223372036854775808), 9223372036854774784) AS BIGINT) AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, k) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
