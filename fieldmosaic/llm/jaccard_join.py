"""Exact Jaccard self-join of word n-gram sets with signature trees, and the components of its links.

1. Documents with the same set are one class: sets are told apart by 128 bits of hashes and the size. A pass gives
   each class a bitmap (signature) of its shingles, and finds which shingles are frequent.
2. Two sets that link share one of their first size - ceil(threshold * size) + 1 shingles in any order that
   is the same for all; here frequent shingles come last. Classes meet in the buckets of these shingles; buckets
   of shingles known to be very frequent are dealt to several tasks.
3. In each bucket every class is compared with the one after it in a hashed order: few comparisons for any class, which
   join most copies.
4. Then the classes of each bucket that aren't in one component yet are put in a signature tree: nodes hold
   the OR of their bitmaps and the range of sizes, and pairs of nodes are followed down only while the largest
   possible overlap can still reach the threshold. Pairs from 3 and 4 are checked on the whole sets.
5. Where a tree would give more than a few pairs for each class, or a bucket is very large, no pairs leave the task. The
   bucket's sets are dealt to tiles, each pair of tiles is a row of its own, in which all overlaps are counted
   exactly, and only links that join two components (fewer than there are sets) leave it.
6. Links lie within components. To count them, each component's sets are dealt to tiles in the same way; only sums for
   each class leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, partitions_for, spans, table, trimmed, utf8
from .components import components
from .shingles import shingle_sets
from .url_filter import BlockedBloom

#: Words of 64 bits of the shortest signatures and how often they may double; slots of the counts of frequent shingles.
SIG, LEVELS, COUNTERS = 16, 7, 1 << 21
#: A shingle's slot: the highest bits of its hash.
SLOT_SHIFT = 64 - 21
ORDERS, LEAF, FAN = 4, 16, 8
#: Shingles in more documents than this (and than slots hold on average) come last in the order.
FREQUENT = 50
#: Rows of a bucket beyond which it is dealt to several tasks; pairs for each class beyond which its sets are compared in tiles.
SPREAD, PAIRS = 2048, 4
#: Classes and shingles of a tile, on average; shingles multiplied at once.
TILE, TILE_SHINGLES, WIDE = 1024, 1 << 17, 4096
#: Tiles that a task holds at once.
BLOCK = 4
PREFIX = "token long, salt int, salts int, k1 long, k2 long, n int, pos int"


def class_keys(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent keys for each set that don't depend on order; -1 for empty sets."""
    size = np.diff(at)
    out = []
    for seed in (77, 1_000_003):
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(seed)), dtype=np.uint64)))
            key = mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)) >> np.uint64(1)
        out.append(np.where(size > 0, key.astype(np.int64), -1))
    return out[0], out[1]


def _level(n: np.ndarray) -> np.ndarray:
    """Signatures double in length until they have a bit for each shingle, at most LEVELS times."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / (SIG * 64))), 0, LEVELS).astype(np.int64)


def signatures(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps with a bit for the hash of each shingle, back to back, and the places where they begin and end, in words of 64 bits."""
    size = np.diff(at)
    bits = SIG * 64 << _level(size)
    begin = np.cumsum(bits) - bits
    out = np.zeros(int(bits.sum()), bool)
    row = np.repeat(np.arange(len(size)), size)
    out[begin[row] + (mix(value + np.uint64(991)) % bits[row].astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.int64), np.append(begin, bits.sum()) // 64


class Bitmaps:
    """Signatures of rows, folded to shorter ones where two of different lengths are compared."""

    def __init__(self, lists: pa.Array) -> None:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        self.words = lists.flatten().to_numpy().view(np.uint64)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin, self.level = np.cumsum(size) - size, np.log2(np.maximum(size, 1) / SIG).astype(np.int64)

    def at(self, rows: np.ndarray, level: int) -> np.ndarray:
        """One row of SIG << level words for each of rows, all of which have this level or a higher one."""
        wide = SIG << level
        out = np.zeros((len(rows), wide), np.uint64)
        for high in np.unique(self.level[rows]):
            k = np.flatnonzero(self.level[rows] == high)
            for part in range(1 << (high - level)):
                out[k] |= self.words[self.begin[rows[k]][:, None] + part * wide + np.arange(wide)]
        return out

    def could_link(self, other: Bitmaps, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int, most: int = 1 << 18) -> np.ndarray:
        """Whether rows a of this and b of the other, of sizes n and m, can link."""
        out, level = np.zeros(len(a), bool), np.minimum(self.level[a], other.level[b])
        for x in np.unique(level):
            k = np.flatnonzero(level == x)
            step = max(1, most // (SIG << x))
            for i in range(0, len(k), step):
                p = k[i : i + step]
                out[p] = could_link(self.at(a[p], x), other.at(b[p], x), n[p], m[p], num, den)
        return out


def _needed(a, b, num: int, den: int):
    """The least overlap of linked sets with sizes a and b: ceil(num * (a + b) / (den + num))."""
    return -((-num * (a + b)) // (den + num))


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(SLOT_SHIFT)).astype(np.int64)


def could_link(s: np.ndarray, t: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets with these bitmaps and sizes can link: a bit that only one has is a shingle that only one has."""
    return np.minimum(n - np.bitwise_count(s & ~t).sum(1), m - np.bitwise_count(t & ~s).sum(1)) >= _needed(n, m, num, den)


def _pass_one(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, rows, total = np.zeros(COUNTERS, np.int32), 0, 0
        names = ["id", "h", "n", "k1", "k2", "sig", "slot", "hits"]
        for b in batches:
            data, at = utf8(b.column("__text"))
            for i, j in spans(at):
                value, where = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                slot, c = np.unique(_slot(value), return_counts=True)
                counter[slot] += c.astype(np.int32)
                rows, total = rows + j - i, total + len(value)
                sig, place = signatures(value, where)
                yield pa.record_batch(
                    [b.column("__id").slice(i, j - i), b.column("__h").slice(i, j - i), pa.array(np.diff(where)), *map(pa.array, class_keys(value, where)), pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(sig)), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64())],
                    names=names,
                )
        often = np.flatnonzero(counter >= max(4, rows // 4000))
        if rows:  # slot -1 stands for all shingles
            slot, hits = np.append(often, -1), np.append(counter[often].astype(np.int64), total)
            k = len(slot)
            yield pa.record_batch([pa.nulls(k, b.column("__id").type), pa.nulls(k, b.column("__h").type), *[pa.nulls(k, pa.int64())] * 3, pa.nulls(k, pa.list_(pa.int64())), pa.array(slot), pa.array(hits)], names=names)

    return run


def _prefix_rows(width: int, num: int, den: int, heavy_sent):
    """A row for each shingle of each class's prefix. Shingles whose slot counts more than SPREAD are dealt to `salts` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hits = heavy_sent.value
        heavy, seen = np.zeros(COUNTERS, bool), set()  # a pair of keys for each class of this task
        heavy[slots] = True
        for b in batches:
            data, at = utf8(b.column("__text"))
            for i, j in spans(at):
                value, where = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                (k1, k2), size = class_keys(value, where), np.diff(where)
                new = np.zeros(len(k1), bool)
                for r, pair in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if pair[0] >= 0 and pair not in seen:
                        seen.add(pair)
                        new[r] = True
                row = np.repeat(np.arange(j - i), size)
                keep = new[row]
                value, row = value[keep], row[keep]
                often = heavy[_slot(value)]
                # values ascend within a row; the rare ones come first
                rare, before = np.cumsum(~often), np.searchsorted(row, np.arange(j - i + 1))
                rare = np.concatenate(([0], rare))
                here, all_rare = np.arange(len(row)) - before[row], rare[before[1:]] - rare[before[:-1]]
                lower = rare[:-1] - rare[before[row]]  # rare ones before this place
                pos = np.where(often, all_rare[row] + here - lower, lower)
                k = pos <= size[row] + (-num * size[row]) // den
                value, row, pos, often = value[k], row[k], pos[k], often[k]
                salts = np.ones(len(row), np.int32)
                salts[often] = -(-hits[np.searchsorted(slots, _slot(value[often]))] // SPREAD)
                with np.errstate(over="ignore"):
                    salt = (mix(k1[row].astype(np.uint64) + value) % salts.astype(np.uint64)).astype(np.int32)
                yield pa.record_batch({"token": pa.array(value.view(np.int64)), "salt": pa.array(salt), "salts": pa.array(salts), "k1": pa.array(k1[row]), "k2": pa.array(k2[row]), "n": pa.array(size[row].astype(np.int32)), "pos": pa.array(pos.astype(np.int32))})

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with two classes or more, each with the class that follows it in the bucket's hashed order. Rows come sorted by token and salt; a part of a spread bucket stays even if it has one class."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, salt, salts, k1, k2, n, pos = (t.column(c).to_numpy() for c in ("token", "salt", "salts", "k1", "k2", "n", "pos"))
        with np.errstate(over="ignore"):
            lot = mix(k1.astype(np.uint64) * np.uint64(2 * ORDERS) + (token.astype(np.uint64) % np.uint64(ORDERS)))
        order = np.lexsort((k2, k1, lot, salt, token))
        token, salt, salts, k1, k2, n, pos = (x[order] for x in (token, salt, salts, k1, k2, n, pos))
        part = np.concatenate(([False], (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])))
        again = part & np.concatenate(([False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])))
        token, salts, k1, k2, n, pos, part = (x[~again] for x in (token, salts, k1, k2, n, pos, part))
        start = np.flatnonzero(~part)
        size = np.diff([*start, len(token)])
        last = start + size - 1
        follows = np.minimum(np.arange(len(token)) + 1, len(token) - 1)
        follows[last] = np.where(size > 2, start, last)  # a ring
        keep = (np.repeat(size, size) > 1) | (salts > 1)
        yield pa.record_batch({"token": pa.array(token[keep]), "salts": pa.array(salts[keep]), "k1": pa.array(k1[keep]), "k2": pa.array(k2[keep]), "n": pa.array(n[keep]), "pos": pa.array(pos[keep]), "next1": pa.array(k1[follows][keep]), "next2": pa.array(k2[follows][keep]), "next_n": pa.array(n[follows][keep])})

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows > 1 << 16:  # whole buckets only: what may go on stays
            t = pa.Table.from_batches(held).combine_chunks()
            token, salt = t.column("token").to_numpy(), t.column("salt").to_numpy()
            end = int(np.flatnonzero((token != token[-1]) | (salt != salt[-1])).max(initial=-1)) + 1
            if end:
                yield from done(t.slice(0, end))
            held, rows = t.slice(end).to_batches(), t.num_rows - end
    if held:
        yield from done(pa.Table.from_batches(held))


class SignatureTree:
    """Items sorted by size in leaves of LEAF, FAN nodes under each parent. Nodes hold ORed bitmaps, size ranges, the most shingles that share bits, and the label if it is one."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, label: np.ndarray) -> None:
        slack = n - np.bitwise_count(sig).sum(1)
        self.levels = [(sig, n, n, slack, label, label)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            s, lo, hi, sl, la, lb = self.levels[-1]
            cuts = np.arange(0, len(lo), width)
            self.levels.append((np.bitwise_or.reduceat(s, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(sl, cuts), np.minimum.reduceat(la, cuts), np.maximum.reduceat(lb, cuts)))
            width = FAN

    def pairs(self, num: int, den: int, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item pairs (a < b) with different labels whose possible overlap reaches the threshold.

        Node pairs wait unopened on the stack and are opened about `most` children at a time, so that it holds a few such pieces for each level.
        """
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            fan = LEAF if level == 1 else FAN
            step = max(1, most // fan**2)
            if level and len(a) > step:
                stack.append((level, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            s, lo, hi, slack, la, lb = self.levels[level]
            ok = ~((la[a] == lb[a]) & (la[b] == lb[b]) & (la[a] == la[b]))
            ok &= (hi[a] * den >= num * lo[b]) & (hi[b] * den >= num * lo[a])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level:
                room = np.bitwise_count(s[a] & s[b]).sum(1) + np.minimum(slack[a], slack[b])
                ok = np.minimum(room, np.minimum(hi[a], hi[b])) >= _needed(lo[a], lo[b], num, den)
                a, b, below = a[ok], b[ok], len(self.levels[level - 1][1])
                x, y = np.broadcast_arrays(a[:, None, None] * fan + np.arange(fan)[:, None], b[:, None, None] * fan + np.arange(fan))
                x, y = x.ravel(), y.ravel()
                keep = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
                stack.append((level - 1, x[keep], y[keep]))
            else:
                ok = could_link(s[a], s[b], lo[a], lo[b], num, den)
                yield a[ok], b[ok]


def _small_pairs(start: np.ndarray, end: np.ndarray, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each of the small buckets [start, end), about `most` at a time."""
    row = np.concatenate([np.arange(i, j) for i, j in zip(start, end, strict=True)]) if len(start) else start
    after = np.repeat(end, end - start) - row - 1
    total = np.cumsum(after)
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most)))
        c = after[i:j]
        a = np.repeat(row[i:j], c)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        i = j


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Tables of rows sorted by token, the places [start, end) of whole buckets in them that have two labels or more, and their columns of numbers."""
    held: list[pa.RecordBatch] = []
    for last, b in _with_last(batches):
        held.append(b)
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            held = []
            continue
        cols = {c: t.column(c).to_numpy().astype(np.int64) for c in ("token", "key", "n", "pos", "label")}
        token, label = cols["token"], cols["label"]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        end = np.append(start[1:], len(token))
        held = t.slice(int(start[-1])).to_batches()
        if not last:
            start, end = start[:-1], end[:-1]
        if len(start):
            whole = int(end[-1])
            mixed = np.minimum.reduceat(label[:whole], start) < np.maximum.reduceat(label[:whole], start)
            yield t, start[mixed], end[mixed], cols


def _may_meet(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows a and b of one bucket with different labels whose sizes allow a link, if theirs is the first shingle that both have in their prefixes: all before it are in one of them only."""
    n, pos, label = c["n"], c["pos"], c["label"]
    ok = (label[a] != label[b]) & (n[a] * den >= num * n[b]) & (n[b] * den >= num * n[a])
    need = _needed(n[a], n[b], num, den)
    return ok & (pos[a] + need <= n[a]) & (pos[b] + need <= n[b])


def _partnered(num: int, den: int):
    """The rows that another one of their bucket may link with, by sizes and places; buckets over a leaf stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end, c in _buckets(batches):
            keep = np.zeros(t.num_rows, bool)
            small = end - start <= LEAF
            for i, j in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
                keep[i:j] = True
            for a, b in _small_pairs(start[small], end[small]):
                ok = _may_meet(c, a, b, num, den)
                keep[a[ok]] = keep[b[ok]] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return run


def _tree_pairs(num: int, den: int):
    """Pairs of classes of a task's buckets that may link; for a bucket with more than PAIRS for each class only its token, with a null pair. Rows come sorted by token.

    A bucket that fits a leaf is one; the leaves of a batch are gone through together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end, c in _buckets(batches):
            key, n = c["key"], c["n"]
            bits = Bitmaps(t.column("sig"))
            sig = bits.at(np.arange(t.num_rows), 0)
            found, dense = [], []

            def checked(a: np.ndarray, b: np.ndarray, c=c, bits=bits, key=key, n=n) -> tuple[np.ndarray, np.ndarray]:
                ok = _may_meet(c, a, b, num, den)
                a, b = a[ok], b[ok]
                ok = bits.could_link(bits, a, b, n[a], n[b], num, den)
                return np.minimum(key[a[ok]], key[b[ok]]), np.maximum(key[a[ok]], key[b[ok]])

            small = end - start <= LEAF
            for a, b in _small_pairs(start[small], end[small]):
                found.append(checked(a, b))
            for i, j in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
                at, many, own = i + np.lexsort((key[i:j], n[i:j])), 0, []
                for a, b in SignatureTree(sig[at], n[at], c["label"][at]).pairs(num, den):
                    own.append(checked(at[a], at[b]))
                    many += len(own[-1][0])
                    if many > PAIRS * (j - i):
                        break
                if many > PAIRS * (j - i):
                    dense.append(int(c["token"][i]))
                else:
                    found += own
            if dense:
                yield pa.record_batch({"dense": pa.array(dense, pa.int64()), "a": pa.nulls(len(dense), pa.int64()), "b": pa.nulls(len(dense), pa.int64())})
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch({"dense": pa.nulls(len(a), pa.int64()), "a": pa.array(a), "b": pa.array(b)})

    return run


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches, each with whether it is the last."""
    before = None
    for b in batches:
        if before is not None:
            yield False, before
        before = b
    if before is not None:
        yield True, before


def _linkable(num: int, den: int):
    """Of pairs with sizes and signatures, the keys of those that could link, the smaller key first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "n_x", "n_y"))
            k = np.flatnonzero((n * den >= num * m) & (m * den >= num * n))
            k = k[Bitmaps(b.column("sig_x")).could_link(Bitmaps(b.column("sig_y")), k, k, n[k], m[k], num, den)]
            yield pa.record_batch({"a": pa.array(np.minimum(x[k], y[k])), "b": pa.array(np.maximum(x[k], y[k]))})

    return run


def _sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts, back to back, and the places where they begin and end; about a megabyte of text at a time."""
    data, at = utf8(texts)
    parts, ends = [], [np.zeros(1, np.int64)]
    for i, j in spans(at):
        value, where = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
        parts.append(value)
        ends.append(where[1:] + ends[-1][-1])
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(ends)


def _exact(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, at_x), (y, at_y) = (_sets_of(b.column(c), width) for c in ("text_a", "text_b"))
            ok = []
            for i in range(b.num_rows):
                p, q = x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                ok.append(both * den >= num * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def overlaps(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """How many shingles each set of x shares with each of y."""
    out = np.zeros((len(at_x) - 1, len(at_y) - 1), np.int64)
    common = np.intersect1d(x, y)
    side = []
    for value, at in ((x, at_x), (y, at_y)):
        row, slot = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.searchsorted(common, value)
        ok = slot < len(common)
        ok[ok] = common[slot[ok]] == value[ok]
        order = np.argsort(slot[ok], kind="stable")
        side.append((row[ok][order], slot[ok][order], len(at) - 1))
    for k in range(0, len(common), WIDE):
        m = []
        for row, slot, n in side:
            i, j = np.searchsorted(slot, (k, k + WIDE))
            dense = np.zeros((n, min(WIDE, len(common) - k)), np.float32)
            dense[row[i:j], slot[i:j] - k] = 1
            m.append(dense)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile, with the texts of its classes, from rows sorted by root and tile."""
    now, keys, labels, texts = None, [], [], []

    def row() -> pa.RecordBatch:
        packed = [pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (keys, labels)]
        return pa.record_batch([pa.array([now[0]], pa.int64()), *[pa.array([x], pa.int32()) for x in now[1:]], *packed, pa.array([texts], pa.list_(pa.string()))], names=["root", "tile", "tiles", "alone", "keys", "labels", "texts"])

    for b in batches:
        for root, tile, tiles, alone, key, label, held in zip(*(b.column(c).to_pylist() for c in ("root", "tile", "tiles", "alone", "key", "label", "text")), strict=True):
            if now != (root, tile, tiles, alone):
                if keys:
                    yield row()
                now, keys, labels, texts = (root, tile, tiles, alone), [], [], []
            keys.append(key)
            labels.append(label)
            texts.append(held)
    if keys:
        yield row()


def joining(ok: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links ok (row, column), as pairs of labels, only those that a spanning forest of the labels needs."""
    name, code = np.unique(np.concatenate((left, right)), return_inverse=True)
    i, j = np.nonzero(ok & (left[:, None] != right))
    near = np.zeros((len(name), len(name)), bool)
    near[code[: len(left)][i], code[len(left) :][j]] = True
    near |= near.T
    seen, a, b = np.zeros(len(name), bool), [], []
    for first in np.flatnonzero(near.any(1)):
        stack = [] if seen[first] else [first]
        seen[first] = True
        while stack:
            u = stack.pop()
            new = np.flatnonzero(near[u] & ~seen)
            seen[new] = True
            stack.extend(new.tolist())
            a.append(np.full(len(new), name[u]))
            b.append(name[new])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tile_pairs(width: int, num: int, den: int):
    """The pairs of tiles of each block in a task, with the links between their sets. A block (root, block) is held: its own tiles, BLOCK at most, and compared with those that follow, one at a time, in the order of their numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                root, block, tile, alone = (b.column(c)[i].as_py() for c in ("root", "block", "tile", "alone"))
                if now != (root, block):
                    now, held = (root, block), []
                key, label = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("keys", "labels"))
                value, at = _sets_of(b.column("texts")[i].values, width)
                here = (key, label, np.diff(at), value, at)
                own = tile // BLOCK == block
                if tile >= alone:  # else it and all before it are tiles that aren't compared with each other
                    for other, same in [(x, False) for x in held] + [(here, True)] * own:
                        both = overlaps(value, at, other[3], other[4])
                        ok = both * den >= num * (here[2][:, None] + other[2] - both)
                        if same:
                            np.fill_diagonal(ok, False)
                        yield ok, here, other, same
                if own:
                    held.append(here)

    return each


def _tile_links(width: int, num: int, den: int):
    """Links of each class in the pairs of tiles of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for ok, here, other, same in _tile_pairs(width, num, den)(batches):
            for keys, links in ((here[0], ok.sum(1)), (other[0], ok.sum(0)))[: 2 - same]:
                for k, c in zip(keys.tolist(), links.tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
            if len(total) > 1 << 16:
                yield pa.record_batch({"key": pa.array(list(total), pa.int64()), "links": pa.array(list(total.values()), pa.int64())})
                total = {}
        yield pa.record_batch({"key": pa.array(list(total), pa.int64()), "links": pa.array(list(total.values()), pa.int64())})

    return run


def _tile_joins(width: int, num: int, den: int):
    """Links of a task's pairs of tiles that join two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ok, here, other, _ in _tile_pairs(width, num, den)(batches):
            a, b = joining(ok, here[1], other[1])
            if len(a):
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return run


def _one_tile(run):
    """run over roots that are one tile each, without another shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.record_batch([b.column(c) for c in ("root", "tile", "tile", "alone", "keys", "labels", "texts")], names=["root", "block", "tile", "alone", "keys", "labels", "texts"]) for b in _tiles(batches))

    return go


def _in_tiles(rows: DataFrame, docs: DataFrame, classes: DataFrame, parts: int, run, out: str, name: str) -> DataFrame:
    """run over all pairs of tiles of each root of rows (root, tile, tiles, alone, key, label); tiles under `alone` aren't compared with each other.

    A tile's texts go to its own block of BLOCK tiles and to the blocks before it, not to each pair: once for a root of up to BLOCK tiles.
    """
    where = rows.select("root", "tile", "tiles", "alone", "key", "label")
    texts = _texts(rows.select("key").distinct(), docs, classes).join(where, "key").select("root", "tile", "tiles", "alone", "key", "label", "text")
    few = texts.where("tiles = 1 AND alone = 0").repartition(parts, "root").sortWithinPartitions("root").mapInArrow(_one_tile(run), out)
    made = texts.where("tiles > 1").repartition(parts, "root", "tile").sortWithinPartitions("root", "tile").mapInArrow(_tiles, "root long, tile int, tiles int, alone int, keys binary, labels binary, texts array<string>")
    mine = F.floor(F.col("tile") / BLOCK).cast("int")
    sent = cut(made, name).withColumn("block", F.explode(F.sequence(F.lit(0), mine))).where((F.col("block") == mine) | (F.col("tile") >= F.col("alone")))
    sent = sent.select("root", "block", "tile", "alone", "keys", "labels", "texts").repartition(parts, "root", "block").sortWithinPartitions("root", "block", "tile")
    return few.unionByName(sent.mapInArrow(run, out))


def _tile_count(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / F.lit(TILE)), F.ceil(shingles / F.lit(TILE_SHINGLES))).cast("int")


def _spread_join(rows: DataFrame, small: DataFrame, on: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join with a table of one row for each `on`, in which the rows of one `on` are dealt to several tasks."""
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(dealt, [on, "__salt"], how).drop("__salt")


def _link_counts(root: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int, parts: int) -> DataFrame:
    """(key, class_links) of every class in root (node, root): all pairs of each component, tile by tile."""
    held = cut(root.select(F.col("node").alias("key"), "root").join(classes.select("key", "n"), "key"), "linked-classes")
    tiles = held.groupBy("root").agg(_tile_count(F.count(F.lit(1)), F.sum("n")).alias("tiles"))
    where = _spread_join(held, tiles, "root").select("key", F.col("key").alias("label"), "root", "tiles", F.lit(0).alias("alone"), F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile"))
    counted = _in_tiles(where, docs, classes, parts, _tile_links(width, num, den), "key long, links long", "tiles")
    return cut(counted.groupBy("key").agg(F.sum("links").alias("class_links")), "link-counts")


def _dense_links(rest: DataFrame, tokens: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int, parts: int) -> DataFrame:
    """Links (a, b) of labels in the buckets named, tile by tile. The label with most classes of a bucket has tiles of its own, which aren't compared with each other."""
    rows = cut(_spread_join(rest, tokens, "token", "left_semi").select(F.col("token").alias("root"), "key", "label", "n"), "dense")
    by = rows.groupBy("root", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    most = F.max_by(F.struct("label", "c", "n"), F.struct("c", "label"))
    by = by.groupBy("root").agg(most.alias("m"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    by = by.select("root", F.col("m.label").alias("main"), _tile_count(F.col("m.c"), F.col("m.n")).alias("alone"), _tile_count(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("rest"))
    h = F.xxhash64("key")
    tile = F.when(F.col("label") == F.col("main"), F.pmod(h, F.col("alone"))).otherwise(F.col("alone") + F.pmod(h, F.greatest("rest", F.lit(1))))
    where = _spread_join(rows, by, "root").select("key", "label", "root", (F.col("alone") + F.col("rest")).alias("tiles"), "alone", tile.cast("int").alias("tile"))
    return cut(_in_tiles(where, docs, classes, parts, _tile_joins(width, num, den), "a long, b long", "dense-tiles"), "dense-links")


def _texts(keys: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, text) of the classes named: one text of each, from which its set is made where it is needed, as texts are smaller than sets."""
    wanted = cut(keys.join(classes.select("key", F.col("__rep").alias("__h")), "key"), "wanted")
    bloom = BlockedBloom(wanted.select(F.col("__h.a").alias("h")), bits_per_key=12)
    found = docs.where(bloom.column(F.col("__h.a"))).join(wanted, "__h").select("key", F.col("__text").alias("text"))
    return cut(found.dropDuplicates(["key"]), "class-texts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of class keys whose sets link."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, classes)
    first = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_exact(width, num, den)), "a long, b long"), "linked")


def _sent_slots(slots: DataFrame):
    """Frequent slots and their counts, at most COUNTERS of them, as two sorted arrays."""
    t = slots.toArrow().sort_by("slot")
    return slots.sparkSession.sparkContext.broadcast((t.column("slot").to_numpy().astype(np.int32), np.minimum(t.column("h").to_numpy(), 2**31 - 1).astype(np.int32)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100, count_links: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, class_links (links of its class with other classes).

    Without count_links only components are sought, and there is no class_links: pairs already in one component
    are never compared. Counting compares all classes of a component, which grows with the square of their number.

    Sets link when den * intersection >= num * union. component_id is the smallest id that links reach.
    Null and empty texts and texts without words have no shingles, no links and their own id. Equal sets (repeated rows,
    ties) are one class; rows with null ids take part, and a component of null ids only has a null id. Shingles are held
    as 64-bit hashes, sets are equal when 126 bits of hashes and their sizes are. Very long texts are single rows of
    their own, of which a task holds one at a time. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    parts = partitions_for(docs)
    held = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).withColumn("__h", F.struct(F.xxhash64("__id", "__text").alias("a"), F.hash("__text").alias("b")))
    id_type = held.schema["__id"].dataType.simpleString()
    one = cut(held.mapInArrow(trimmed(_pass_one(width)), f"id {id_type}, h struct<a:bigint,b:int>, n long, k1 long, k2 long, sig array<long>, slot long, hits long"), "sets-seen")
    counts = cut(one.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("hits").alias("h")), "slots")
    total = counts.where("slot < 0").agg(F.max("h")).first()[0] or 0
    often = counts.where((F.col("slot") >= 0) & (F.col("h") > FREQUENT + 2 * total // COUNTERS))
    first = held.select("__text").mapInArrow(trimmed(_prefix_rows(width, num, den, _sent_slots(often))), PREFIX)
    hot = first.groupBy("token").agg(F.count(F.lit(1)).alias("h")).where(F.col("h") > FREQUENT).select(F.shiftrightunsigned("token", SLOT_SHIFT).alias("slot"), "h")
    sent = _sent_slots(cut(often.unionByName(hot).groupBy("slot").agg(F.max("h").alias("h")), "frequent"))
    members = one.where("slot IS NULL").select(F.col("id").alias("__id"), "n", "k1", "k2")
    classes = one.where("k1 >= 0").groupBy("k1", "k2", "n").agg(F.min("h").alias("__rep"), F.min("id").alias("__least"), F.any_value("sig").alias("sig"))
    classes = cut(classes.withColumn("n", F.col("n").cast("int")).withColumn("key", F.monotonically_increasing_id()), "classes")
    rows = held.select("__text").mapInArrow(trimmed(_prefix_rows(width, num, den, sent)), PREFIX)
    shared = rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt").mapInArrow(trimmed(_shared_rows), "token long, salts int, k1 long, k2 long, n int, pos int, next1 long, next2 long, next_n int")
    shared = cut(shared, "shared")

    side = lambda s, x, y: classes.select(F.col("k1").alias(x), F.col("k2").alias(y), F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    close = F.least("n", "next_n") * den >= F.greatest("n", "next_n") * num
    near = shared.where("(k1, k2) <> (next1, next2)").where(close).select("k1", "k2", "next1", "next2").distinct()
    near = near.join(side("x", "k1", "k2"), ["k1", "k2"]).join(side("y", "next1", "next2"), ["next1", "next2"])
    near = near.select("x", "y", "n_x", "n_y", "sig_x", "sig_y")
    near = cut(near.mapInArrow(trimmed(_linkable(num, den)), "a long, b long").distinct(), "near")
    links = _verified(near, held, classes, width, num, den)
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = classes.select("k1", "k2", "key").join(label.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left").withColumn("label", F.coalesce("label", "key"))
    rest = cut(shared.select("token", "salts", "k1", "k2", "n", "pos").join(named, ["k1", "k2"]).select("token", "salts", "key", "n", "pos", "label"), "labelled")
    mixed = cut(rest.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("salts").alias("salts")).where("x <> y").select("token", "salts"), "mixed")
    some = rest.where("salts = 1").join(mixed.where("salts = 1").select("token"), "token", "left_semi").select("token", "key", "n", "pos", "label")
    some = some.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(trimmed(_partnered(num, den)), "token long, key long, n int, pos int, label long").join(classes.select("key", "sig"), "key")
    found = some.select("token", "key", "n", "pos", "label", "sig").repartition(parts, "token").sortWithinPartitions("token").mapInArrow(trimmed(_tree_pairs(num, den)), "dense long, a long, b long")
    found = cut(found, "tree-pairs")
    more = cut(found.where("dense IS NULL").select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "tree-only")
    links = links.unionByName(_verified(more, held, classes, width, num, den))
    dense = mixed.where("salts > 1").select("token").unionByName(found.where("dense IS NOT NULL").select(F.col("dense").alias("token")))
    links = links.unionByName(_dense_links(rest, dense, held, classes, width, num, den, parts))
    root = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    grouped = classes.join(root.withColumnRenamed("node", "key"), "key", "left").select("key", "k1", "k2", "__least", F.coalesce("root", "key").alias("root"))
    least = grouped.groupBy("root").agg(F.min("__least").alias("component_id"))
    per_class = _spread_join(grouped, least, "root").drop("root", "__least")
    out = [F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("k1") < 0, F.col("__id")).otherwise(F.col("component_id")).alias("component_id")]
    if count_links:
        per_class = per_class.join(_link_counts(root, held, classes, width, num, den, parts), "key", "left")
        out.append(F.coalesce("class_links", F.lit(0)).alias("class_links"))
    return members.join(per_class, ["k1", "k2"], "left").select(*out)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The component of each of all `documents`, with its number of shingles; odd input: see jaccard_components."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
