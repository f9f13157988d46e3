"""Packing by lexical retrieval: a sharded BM25 index gives each seed document's unused neighbours, which fill its window.

Counts, document frequencies and the mean length are those of all documents. Documents are placed in shards by shared
terms: a weighted minimum of term hashes, by BM25 weight, that two documents have in common the more often the more
weight they share. Retrieval doesn't leave a shard.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, partitions_for, table, trim, trimmed

WINDOW, END = 2048, 1
K1, B = 1.2, 0.75
#: Terms of more than one in so many documents of a shard have a weight for each document instead of postings.
COMMON = 16
#: Documents of a shard up to which all seeds' scores for common terms are held.
MOST_AT_ONCE = 4096
#: Groups of second terms of a frequent first term; places are then at most vocabulary * GROUPS.
GROUPS = 16
#: Fixed value: the vocabulary's mark that a text may hold, and its id.
MARK, MARK_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a public vocabulary file; its ids are those of the same vocabulary's JSON file, its mark's included."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={MARK: MARK_ID})


class Stats:
    """Number of documents, mean length and the document frequency of each term, over the whole corpus."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.n, self.mean, self.df = n, max(mean, 1), df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self._race: np.ndarray | None = None

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Stats:
        df = np.zeros(int(max(d.max() for d in docs)) + 1 if docs else 0, np.int64)
        for d in docs:
            df[np.unique(d)] += 1
        return cls(len(docs), sum(map(len, docs)) / max(len(docs), 1), df)

    def weight(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def weights(self, docs: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's terms in order and their weights, document by document, and where each document begins. Tokens are counted for one document at a time, so only its distinct terms are held."""
        terms, weights = [np.zeros(0, np.uint16)], [np.zeros(0, kind)]
        for d in docs:
            term, tf = np.unique(d, return_counts=True)
            terms.append(term)
            weights.append(self.weight(term, tf, np.int64(len(d))).astype(kind))
        return np.concatenate(terms), np.concatenate(weights), np.cumsum([len(t) for t in terms])

    def race(self) -> np.ndarray:
        """Two exponential times for each term, from its hash."""
        if self._race is None:
            term = np.arange(len(self.df), dtype=np.uint64) * np.uint64(2)
            self._race = -np.log(((mix(term + np.arange(1, 3, dtype=np.uint64)[:, None]) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        return self._race

    def places(self, docs: list[np.ndarray]) -> np.ndarray:
        """Two terms of each document (which has one at least), each the first in a race in which a term's chance is its weight; terms that no other document has run only alone."""
        size = np.array([len(d) for d in docs], np.int64)
        held = np.concatenate(docs).astype(np.int64) | np.repeat(np.arange(len(docs)) << 16, size)
        held.sort()
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        tf, held = np.diff(np.append(first, len(held))), held[first]
        term, doc = held & 0xFFFF, held >> 16
        weight = self.weight(term, tf, size[doc])
        weight = np.where(self.df[term] > 1, weight, weight * 1e-9)
        start = np.searchsorted(doc, np.arange(len(docs)))
        out = []
        for race in self.race():
            time = race[term] / weight
            best = np.flatnonzero(time == np.minimum.reduceat(time, start)[doc])
            out.append(term[best[np.searchsorted(doc[best], np.arange(len(docs)))]])
        return np.stack(out)


class Index:
    """An inverted index of one shard: the documents and BM25 weights of each rare term, and of each common term a weight for every document, as postings would hold most documents anyway."""

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None) -> None:
        stats = stats or Stats.of(docs)
        n = len(docs)
        term, weights, self.first = stats.weights(docs, np.float32)
        count = np.bincount(term)
        self.terms = np.flatnonzero(count)
        df, slot = count[self.terms], np.zeros(len(count), np.int32)
        slot[self.terms] = np.arange(len(self.terms))
        self.by_doc = slot[term]  # each document's terms
        found = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        self.idf = stats.idf[self.terms]
        common = df * COMMON > n
        self.place = np.where(common, np.cumsum(common) - 1, -1)  # rows of the dense part
        self.dense = np.zeros((int(common.sum()), n), np.float32)
        k = common[self.by_doc]
        self.dense[self.place[self.by_doc[k]], found[k]] = weights[k]
        k = np.flatnonzero(~k)
        k = k[np.argsort(term[k], kind="stable")]
        self.docs, self.weights = found[k], weights[k]
        self.df = np.where(common, 0, df)
        self.begin = np.cumsum(self.df) - self.df
        self.n, self._all = n, None

    def _dense_scores(self, seed: int, own: np.ndarray) -> np.ndarray:
        """What common terms add: one product for all seeds of an ordinary shard, one for each seed of a very large one."""
        if self.n > MOST_AT_ONCE:
            return self.dense[self.place[own[self.place[own] >= 0]]].sum(0)
        if self._all is None:
            held = np.zeros((self.n, len(self.dense)), np.float32)
            for row, i, j in zip(held, self.first[:-1], self.first[1:], strict=True):
                at = self.place[self.by_doc[i:j]]
                row[at[at >= 0]] = 1
            self._all = held @ self.dense
        return self._all[seed]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all of the seed's terms; 0 without a shared term."""
        own = self.by_doc[self.first[seed] : self.first[seed + 1]]
        dense = self._dense_scores(seed, own)
        own = own[self.df[own] > 1]
        size = self.df[own]
        at = np.arange(size.sum()) + np.repeat(self.begin[own] - np.cumsum(size) + size, size)
        return dense + np.bincount(self.docs[at], self.weights[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, the best BM25 score over all its terms first, ties in order."""
        score = self.scores(seed)
        which = np.flatnonzero(unused & (score > 0))
        return which[np.argsort(-score[which], kind="stable")]


def fill_windows(docs: list[np.ndarray], window: int = WINDOW, stats: Stats | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once. Only the last window can be short.

    A seed fills its window; its neighbours follow, the best first, and the one that doesn't fit
    is cut there, its rest beginning the next window as seed. Without a neighbour the first unused document follows.
    """
    index, unused = Index(docs, stats), np.ones(len(docs), bool)
    out, sequence, room, first = [], 0, window, 0
    queue: list[int] = []
    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            doc = queue.pop()
        else:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return out
            doc = first
        unused[doc] = False
        start, size = 0, len(docs[doc])
        seeds = room == window
        while start < size:
            length = min(room, size - start)
            out.append((doc, start, length, sequence, window - room))
            start, room = start + length, room - length
            if not room:
                sequence, room, seeds = sequence + 1, window, start < size
        if seeds or not queue:
            queue = index.neighbours(doc, unused)[::-1].tolist()


def _tokens(path: str):
    """Token ids of 16 bits, as the vocabulary has fewer than 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if enc.n_vocab > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        for b in batches:
            tokens = [np.append(enc.encode_to_numpy(t.as_py() or "", allowed_special="all", disallowed_special=()), np.uint32(END)).astype("<u2").tobytes() for t in b.column("__text")]
            yield pa.record_batch([b.column("__id"), b.column("__salt"), pa.array(tokens, pa.binary())], names=["__id", "__salt", "__tokens"])

    return run


def _ids(t) -> np.ndarray:
    return np.frombuffer(t.as_buffer(), "<u2")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents (term -1), tokens (term -2) and documents of each term."""
    encoder.cache_clear()  # a worker that has made tokens needs it no more
    df, rows, total = np.zeros(1 << 16, np.int64), 0, 0
    for b in batches:
        for t in b.column("__tokens"):
            ids = _ids(t)
            rows, total = rows + 1, total + len(ids)
            df[np.unique(ids)] += 1
    some = np.flatnonzero(df)
    yield pa.record_batch({"term": pa.array(np.concatenate(([-1, -2], some))), "c": pa.array(np.concatenate(([rows, total], df[some])))})


def corpus_stats(tokens: DataFrame) -> tuple[Stats, int]:
    """The corpus's statistics and its number of tokens."""
    got = tokens.select("__tokens").mapInArrow(trimmed(_term_counts), "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()  # a row for each term of the vocabulary
    term, c = (got.column(x).to_numpy() for x in ("term", "c"))
    n, total = int(c[term == -1].sum()), int(c[term == -2].sum())
    df = np.zeros(max(int(term.max(initial=0)) + 1, END + 1), np.int64)
    df[term[term >= 0]] = c[term >= 0]
    return Stats(n, total / max(n, 1), df), total


def _place_rows(sent):
    """The place of each document, term * GROUPS + group of the second term, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"place": pa.array(_places(sent.value, b.column("__tokens"))), "size": pa.array([t.as_buffer().size // 2 for t in b.column("__tokens")], pa.int64())})

    return run


def _places(stats: Stats, tokens: pa.Array) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(tokens), 256):
        x, y = stats.places([_ids(t) for t in tokens[k : k + 256]])
        out.append(x * GROUPS + (mix(y.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64))
    return np.concatenate(out)


def shard_map(tokens: DataFrame, sent, per: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """By place, the first shard and the number of shards, and how many shards there are. A shard has about `per` documents or `most` tokens.

    Places with one first term stand together, a second term counts where one shard can't hold the first, and only
    places that one shard can't hold either are dealt to several. There are at most vocabulary * GROUPS places.
    """
    places = tokens.select("__tokens").mapInArrow(trimmed(_place_rows(sent)), "place long, size long").groupBy("place").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("t")).toArrow()
    place = places.column("place").to_numpy()
    load = np.maximum(places.column("c").to_numpy() / per, places.column("t").to_numpy() / most)
    order = np.argsort(place)
    place, load = place[order], load[order]
    first, count = np.zeros(int(place.max(initial=0)) + 1, np.int64), np.ones(int(place.max(initial=0)) + 1, np.int64)
    shard, room = -1, 0.0
    term = place // GROUPS
    start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(place) else place
    for i, j in zip(start, np.append(start[1:], len(place)), strict=False):  # no places, no rounds
        cells = [(place[i:j], load[i:j].sum())] if load[i:j].sum() <= 1 else [(place[k : k + 1], load[k]) for k in range(i, j)]
        for at, size in cells:
            if size > 1:
                n = int(np.ceil(size))
                first[at], count[at], shard, room = shard + 1, n, shard + n, 0.0
            else:
                if size > room:
                    shard, room = shard + 1, 1.0
                first[at], room = shard, room - size
    return first, count, max(shard + 1, 1)


def _sharded(sent, where):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = where.value
        for b in batches:
            at = _places(sent.value, b.column("__tokens"))
            shards = first[at] + b.column("__salt").to_numpy() % count[at]
            yield pa.record_batch([b.column("__id"), b.column("__tokens"), pa.array(shards)], names=["__id", "__tokens", "__shard"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str | None = None, docs_per_shard: int = 2000, tokens_per_shard: int = 1 << 21, window: int = WINDOW) -> DataFrame:
    """Packs all documents, whole, into windows of tokens: one row for each piece.

    Documents are placed by shared terms in shards of about docs_per_shard documents or tokens_per_shard tokens at most; each
    shard has its own index with the corpus's statistics, and its last window may be short. A task holds one shard at a time.

    A null text counts as empty: its only token is the end mark. Equal rows are documents of their own, null ids come first.
    A very long text is cut into as many windows as it needs. Ties in score go by id, then tokens. An empty table gives an empty result. Other columns, whatever their names, are
    not read.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kinds = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([*docs.select(id_col).schema.fields, *kinds])
    names = [f.name for f in schema.fields]
    id_type = schema.fields[0].dataType.simpleString()
    held = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).withColumn("__salt", F.xxhash64("__id", F.crc32(F.coalesce("__text", F.lit("")).cast("binary"))))
    tokens = cut(held.mapInArrow(trimmed(_tokens(path)), f"__id {id_type}, __salt long, __tokens binary"), "tokens")
    context = docs.sparkSession.sparkContext
    stats, total = corpus_stats(tokens)
    sent = context.broadcast(stats)
    first, count, shards = shard_map(tokens, sent, docs_per_shard, tokens_per_shard)
    where = context.broadcast((first, count))

    def packed(shard: int, ids: list, tokens: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, 0 if ids[k] is None else ids[k], len(tokens[k]), tokens[k].tobytes()))
        ids, tokens = [ids[k] for k in order], [tokens[k] for k in order]
        rows = fill_windows(tokens, window, stats=sent.value)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        crc = [zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, length, strict=True)]
        sizes = np.array([len(t) for t in tokens], np.int64)
        return pa.record_batch([pa.array([ids[d] for d in doc], kind), *[pa.array(c, pa.int64()) for c in (start, length, crc, sizes[doc], sequence + (shard << 32), offset)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        now, ids, tokens, kind = None, [], [], None
        for b in batches:  # sorted by shard
            kind = b.column("__id").type
            for shard, i, t in zip(b.column("__shard").to_pylist(), b.column("__id").to_pylist(), b.column("__tokens"), strict=True):
                if shard != now:
                    if ids:
                        yield packed(now, ids, tokens, kind)
                    now, ids, tokens = shard, [], []
                    trim()
                ids.append(i)
                tokens.append(np.frombuffer(t.as_py(), "<u2"))
        if ids:
            yield packed(now, ids, tokens, kind)

    placed = tokens.mapInArrow(trimmed(_sharded(sent, where)), f"__id {id_type}, __tokens binary, __shard long")
    tasks = min(shards, max(partitions_for(docs), total * 2 >> 28))  # a quarter of a gigabyte of tokens for each at most, on average
    return placed.repartition(tasks, "__shard").sortWithinPartitions("__shard").mapInArrow(trimmed(run), schema)


def op6_bm25_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents` in windows of 2048 tokens; null and empty texts are one mark, and the rest of odd input: see pack."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
