"""Removal of every byte covered by a string of `length` bytes that also starts earlier in the corpus.

1. Each window of `length` bytes is led by the smallest hash among its `gram`-byte strings, its anchor. Neighbouring
   windows with the same anchor are a run. Equal windows have equal anchors at the same place, so only
   runs of the same anchor string can hold equal windows.
2. Runs with the same bytes are collapsed first, in each task and then by anchor: all but the
   earliest are repeats as a whole. What remains of an anchor with several different runs is sorted.
3. Those suffixes, cut at `length` bytes, are deep-shallow sorted: a multikey quicksort, by words of eight bytes, to a
   shallow depth; the groups with longer common prefixes go to blind tries, which branch on the first
   byte in which members differ and skip what they share. Members of one leaf are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, partitions_for, range_hashes, sequence_hashes, spans, table, trimmed, utf8, whole_keys
from .url_filter import BlockedBloom

LENGTH, GRAM, SHALLOW = 100, 32, 32
RUN = "route long, anchor long, body long, rid long, start long, size int, lead int"


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first byte, bytes, place of the anchor, and hashes of the anchor and of the run."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    place = np.arange(len(data) - gram + 1)
    h = range_hashes(data, place, place + gram)
    value, who = (h >> np.uint64(32)).astype(np.uint32), place.astype(np.int32)
    have, want = 1, length - gram + 1
    while have < want:
        step = min(have, want - have)
        left = value[:-step] <= value[step:]
        value, who = np.where(left, value[:-step], value[step:]), np.where(left, who[:-step], who[step:])
        have += step
    row = np.searchsorted(at, np.arange(len(who)), side="right") - 1
    p = np.flatnonzero(np.arange(len(who)) + length <= at[row + 1])
    if not len(p):
        return none
    who, row = who[p].astype(np.int64), row[p]
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    begin, end, lead = p[first], p[last] + length, who[first]
    return row[first], begin - at[row[first]], end - begin, lead - begin, h[lead].view(np.int64), sequence_hashes(h, begin, end - gram + 1).view(np.int64)


def merged(rid: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, joined."""
    if not len(rid):
        return rid, start, size
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], (start + size)[order]
    owner = np.cumsum(np.concatenate(([0], rid[1:] != rid[:-1])))
    far = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(end + owner * far) - owner * far
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return rid[first], start[first], reach[np.append(first[1:], len(rid)) - 1] - start[first]


def _repeat_flags(anchor: np.ndarray, body: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(anchor), bool)
    out[1:] = (anchor[1:] == anchor[:-1]) & (body[1:] == body[:-1]) & (size[1:] == size[:-1])
    return out


def _batch(route, anchor, body, rid, start, size, lead) -> pa.RecordBatch:
    i64 = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.record_batch({"route": i64(route), "anchor": i64(anchor), "body": i64(body), "rid": i64(rid), "start": i64(start), "size": pa.array(np.asarray(size, np.int32)), "lead": pa.array(np.asarray(lead, np.int32))})


def _span_batch(rid, start, size) -> pa.RecordBatch:
    """Removed spans travel with lead -1, dealt evenly."""
    rid, start, size = merged(rid, start, size)
    zero = np.zeros(len(rid), np.int64)
    return _batch(mix(rid.astype(np.uint64) * np.uint64(1 << 20) + start.astype(np.uint64)).view(np.int64), zero, zero, rid, start, size, zero - 1)


def _find_runs(length: int, gram: int, most: int = 100_000):
    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rid, start, size, lead, anchor, body = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, rid, size, body, anchor))
        rid, start, size, lead, anchor, body = (x[order] for x in (rid, start, size, lead, anchor, body))
        again = _repeat_flags(anchor, body, size)
        if again.any():
            yield _span_batch(rid[again], start[again], size[again])
        k = ~again
        for i in range(0, int(k.sum()), 1 << 16):
            some = np.flatnonzero(k)[i : i + (1 << 16)]
            yield _batch(anchor[some], anchor[some], body[some], rid[some], start[some], size[some], lead[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            rids = b.column("rid").to_numpy(zero_copy_only=False)
            data, at = utf8(b.column("text"))
            for i, j in spans(at):
                row, start, size, lead, anchor, body = runs(data[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                held.append((rids[i:j][row], start, size, lead, anchor, body))
                n += len(row)
                if n >= most:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapses equal runs of a task's anchors, some whole anchors at a time; keeps the earliest runs of anchors that have different ones (lead >= 0), and removed spans. Rows come sorted by anchor."""
    spans_: list[pa.RecordBatch] = []

    def runs_of() -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = b.column("lead").to_numpy(zero_copy_only=False) < 0
            if done.any():
                spans_.append(_span_batch(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[done] for c in ("rid", "start", "size"))))
            yield b.filter(pa.array(~done))

    for t in whole_keys(runs_of(), "anchor"):
        yield from spans_
        spans_.clear()
        yield from _resolve_some(t)
    yield from spans_


def _resolve_some(t: pa.Table) -> Iterator[pa.RecordBatch]:
    anchor, body, rid, start, size, lead = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "body", "rid", "start", "size", "lead"))
    order = np.lexsort((start, rid, size, body, anchor))
    again = _repeat_flags(anchor[order], body[order], size[order])
    if again.any():
        yield _span_batch(*(x[order[again]] for x in (rid, start, size)))
    order = order[~again]
    a = anchor[order]
    same = a[1:] == a[:-1]
    shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    for i in range(0, len(shared), 1 << 16):
        s = shared[i : i + (1 << 16)]
        yield _batch(anchor[s], anchor[s], body[s], rid[s], start[s], size[s], lead[s])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted runs."""
    for b in batches:
        out = ([], [], [], [], [])
        for text, wanted, rid in zip(b.column("text"), b.column("wanted"), b.column("rid").to_pylist(), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8).tobytes() if text.is_valid else b""
            w = wanted.values
            for anchor, start, size, lead in zip(w.field("anchor").to_pylist(), w.field("start").to_pylist(), w.field("size").to_pylist(), w.field("lead").to_pylist(), strict=True):
                for x, v in zip(out, (anchor, rid, start, lead, raw[start : start + size]), strict=True):
                    x.append(v)
        if out[0]:
            yield pa.record_batch({n: pa.array(x, k) for n, x, k in zip(("anchor", "rid", "start", "lead", "bytes"), out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def _dense(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: 0 for the first group, 1 for the next, and so on."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _in_groups(group: np.ndarray) -> np.ndarray:
    """Which items of sorted groups aren't alone."""
    same = group[1:] == group[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(group) else np.zeros(0, bool)


def deep_shallow_sort(text: np.ndarray, suffix: np.ndarray, bucket: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that equal another one of their bucket in the first `length` bytes, and their groups.

    text needs eight spare bytes at its end. Buckets are sorted first; suffixes left alone are in place and drop out.
    """
    word = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    order = np.argsort(bucket, kind="stable")
    item, group = order, _dense(bucket[order]) if len(order) else order
    for depth in range(0, min(shallow, length - 7), 8):  # shallow: a word decides, equal ones go a word deeper
        keep = _in_groups(group)
        item, group = item[keep], group[keep]
        w = word[suffix[item] + depth].astype(np.uint64)
        order = np.lexsort((w, group))
        item, group, w = item[order], group[order], w[order]
        group = _dense(group, w)
    keep = _in_groups(group)
    item, group = item[keep], group[keep]
    done_items, done_groups, base = [], [], 0
    skip = [d for d in range(shallow, length - 8, 8)] + [length - 8] if length >= 8 else [0]
    while len(item):  # deep: one level of all blind tries at a time
        new = np.concatenate(([True], group[1:] != group[:-1]))
        first = np.flatnonzero(new)
        leader = suffix[item[first]][np.cumsum(new) - 1]
        here = suffix[item]
        lcp = np.full(len(item), length, np.int64)
        open_ = np.arange(len(item))
        for d in skip:
            x = word[here[open_] + d].astype(np.uint64) ^ word[leader[open_] + d].astype(np.uint64)
            hit = x != 0
            at = open_[hit]
            # the first byte that differs: from the highest set bit of the difference
            lcp[at] = d + (63 - np.floor(np.log2(x[hit].astype(np.float64))).astype(np.int64).clip(0, 63)) // 8
            lcp[at] = _first_difference(text, here[at], leader[at], lcp[at], d)
            open_ = open_[~hit]
            if not len(open_):
                break
        node = np.minimum.reduceat(lcp, first)
        leaf = (node >= length)[np.cumsum(new) - 1]
        if leaf.any():
            done_items.append(item[leaf])
            g = _dense(group[leaf])
            done_groups.append(g + base)
            base += int(g[-1]) + 1
        rest = ~leaf
        branch = text[here[rest] + node[np.cumsum(new) - 1][rest]]
        item, group = item[rest], group[rest]
        order = np.lexsort((branch, group))
        item, group, branch = item[order], group[order], branch[order]
        group = _dense(group, branch) if len(item) else group
        keep = _in_groups(group)
        item, group = item[keep], group[keep]
    if not done_items:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_items), np.concatenate(done_groups)


def _first_difference(text: np.ndarray, a: np.ndarray, b: np.ndarray, guess: np.ndarray, depth: int) -> np.ndarray:
    """guess comes from a rounded logarithm, so it can be one byte early or late; look at the bytes."""
    guess = np.maximum(guess - 1, depth)
    for _ in range(2):
        guess = np.where(text[a + guess] == text[b + guess], guess + 1, guess)
    return guess


def _sort_anchors(length: int, most: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, "anchor"):
            yield from some(t.combine_chunks())

    def some(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, rid, start, lead = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "rid", "start", "lead"))
        data, at = utf8(t.column("bytes"))
        text = np.concatenate((data, np.zeros(8, np.uint8)))
        windows = np.diff(at) - length + 1
        order = np.argsort(anchor, kind="stable")
        total = np.cumsum(windows[order])
        i = 0
        while i < len(order):  # whole anchors, about `most` windows at a time
            j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
            j = min(len(order), max(j, i + 1))
            j = int(np.searchsorted(anchor[order], anchor[order[j - 1]], side="right"))
            rows = order[i:j]
            n = windows[rows]
            owner = np.repeat(rows, n)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            # the anchor's place in the window separates windows that can't be equal
            bucket = _dense(anchor[rows])[np.repeat(np.arange(len(rows)), n)] * (length + 1) + (lead[owner] - shift)
            item, group = deep_shallow_sort(text, at[owner] + shift, bucket, length)
            if len(item):
                r, s = rid[owner[item]], start[owner[item]] + shift[item]
                o = np.lexsort((s, r, group))
                later = np.concatenate(([False], group[o][1:] == group[o][:-1]))
                r, s, z = merged(r[o][later], s[o][later], np.full(int(later.sum()), length))
                yield pa.record_batch({"rid": pa.array(r), "start": pa.array(s), "size": pa.array(z.astype(np.int32))})
            i = j

    return run


def _with_ids(docs: DataFrame, id_col: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """rid, id, text, and other columns in one struct. The id itself orders the documents if it is an integer and no two rows share it; otherwise rows are numbered by id (nulls first) and text."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("__none"), *[F.col(c) for c in keep]).alias("keep"))
    if held.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n = held.agg(F.count(F.lit(1)), F.count("id")).first()
        if n[0] == n[1] == held.select("id").distinct().count():
            return held.select(F.col("id").cast("long").alias("rid"), "id", "text", "keep")
    return _ranked(held)


def _ranked(held: DataFrame) -> DataFrame:
    """Numbers that follow the order of (id, text): rows are dealt by ranges of ids, so ties with one id stand together."""
    parts = partitions_for(held)
    return cut(held.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text").withColumn("rid", F.monotonically_increasing_id()), "sorted")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans (rid, start, size) that cover all bytes of repeated windows; docs has rid and text. Spans can overlap."""
    parts = partitions_for(docs)
    found = docs.select("rid", "text").where(F.octet_length("text") >= length).mapInArrow(trimmed(_find_runs(length, gram)), RUN)
    held = cut(found.repartition(parts, "route").sortWithinPartitions("anchor").mapInArrow(trimmed(_resolve), RUN), "runs")
    whole = held.where("lead < 0").select("rid", "start", "size")
    wanted = held.where("lead >= 0").groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "size", "lead")).alias("wanted"))
    bloom = BlockedBloom(held.where("lead >= 0").select("rid").distinct().select(F.xxhash64("rid").alias("h")), bits_per_key=12)
    texts = docs.select("rid", "text").where(bloom.column(F.xxhash64("rid"))).join(wanted, "rid")
    pieces = texts.select("rid", "text", "wanted").mapInArrow(trimmed(_cut_out), "anchor long, rid long, start long, lead int, bytes binary")
    part = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(_sort_anchors(length)), "rid long, start long, size int")
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, the columns `keep`, and with_text also kept.

    kept is the text that remains; characters of which a removed span took only some bytes are left out of it (not of the digest).

    Windows never cross documents; the earliest occurrence (smaller id, then smaller start) stays.
    Null texts count as empty: nothing is removed. Texts under `length` bytes stay whole, and very long ones are sorted like others. Equal rows are
    documents of their own; of equal ids any order counts. An empty table gives an empty result. Columns of `keep` mustn't have the names of the new ones.
    """
    held = _with_ids(docs, id_col, text, keep)
    per_doc = cut(repeated_spans(held, length).groupBy("rid").agg(F.collect_list(F.struct("start", "size")).alias("gone")), "spans")
    bloom = BlockedBloom(per_doc.select(F.xxhash64("rid").alias("h")), bits_per_key=12)
    flagged = held.withColumn("__flag", bloom.column(F.xxhash64("rid")))
    touched = flagged.where("__flag").drop("__flag").join(per_doc, "rid", "left").select("id", "text", "keep", "gone")
    rest = flagged.where("NOT __flag").select("id", "text", "keep", F.lit(None).cast("array<struct<start:bigint,size:int>>").alias("gone"))
    schema = held.select(F.col("id").alias(id_col), "keep").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept", "string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, g in zip(b.column("text"), b.column("gone"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                removed = n = 0
                if g.is_valid and len(g.values):
                    start, size = g.values.field("start").to_numpy(), g.values.field("size").to_numpy().astype(np.int64)
                    _, start, size = merged(np.zeros(len(start), np.int64), start, size)
                    parts, at, n = [], 0, len(start)
                    for s, z in zip(start.tolist(), size.tolist(), strict=True):
                        parts.append(raw[at:s])
                        at = s + z
                    whole = len(raw)
                    raw = b"".join([*parts, raw[at:]])
                    removed = whole - len(raw)
                rows.append((len(raw) + removed, removed, n, sha256(raw).hexdigest(), raw.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column("id"), b.column("keep"), *[pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[: 5 if with_text else 4]]], names=[f.name for f in schema.fields])

    done = touched.unionByName(rest).mapInArrow(finish, schema)
    return done.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *[F.col("keep")[c].alias(c) for c in keep], *["kept"] * with_text)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What repeats of 100 bytes take out of each of all `documents`; odd input: see remove_repeats."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
