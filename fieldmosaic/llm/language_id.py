"""Language labels of words by a linear-chain conditional random field, and of documents from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, mix, range_hashes, spans, table, utf8, word_hashes, words

BUCKETS = 1 << 17
#: Words in a chain; longer texts are several chains.
CHAIN = 32


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of words as (word, bucket, value): the word itself, affixes of one to four bytes, byte trigrams with word ends, and the lexicon's label of the word or that it has none."""
    n, size = len(begin), end - begin
    at, bucket, value = [np.arange(n)], [mix(range_hashes(data, begin, end)) % np.uint64(BUCKETS)], [np.ones(n)]
    for k in (1, 2, 3, 4):
        some = np.flatnonzero(size >= k)
        for kind, (b, e) in enumerate(((begin[some], begin[some] + k), (end[some] - k, end[some]))):
            at.append(some)
            bucket.append(mix(range_hashes(data, b, e) + np.uint64(7919 * (2 * k + kind))) % np.uint64(BUCKETS))
            value.append(np.ones(len(some)))
    if lexicon is not None:
        at.append(np.arange(n))
        bucket.append(mix((lexicon.look_up(word_hashes(data, begin, end)) + 1).astype(np.uint64) + np.uint64(15485863)) % np.uint64(BUCKETS))
        value.append(np.ones(n))
    held = np.concatenate(([32], data, [32])).astype(np.uint64)
    word = np.repeat(np.arange(n), size)
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(word))  # of each byte of a word
    left = np.where(place == begin[word], 32, held[place])
    right = np.where(place + 1 == end[word], 32, held[np.minimum(place + 2, len(held) - 1)])
    at.append(word)
    bucket.append(mix((left << np.uint64(16) | held[place + 1] << np.uint64(8) | right) + np.uint64(104729)) % np.uint64(BUCKETS))
    value.append(1 / np.sqrt(size[word]))
    return np.concatenate(at), np.concatenate(bucket).astype(np.int64), np.concatenate(value).astype(np.float32)


class Lexicon:
    """Words that most training documents which have them share a label: sorted hashes, and each one's label."""

    def __init__(self, documents: list[tuple[list[bytes], int]], least: int = 3, share: float = 0.9) -> None:
        """From (words, label) of training documents: words of at least `least` documents, a share of which has one label."""
        words_ = [np.array(sorted(set(ws)), object) for ws, _ in documents]
        flat, label = np.concatenate([*words_, np.zeros(0, object)]), np.repeat(np.array([k for _, k in documents], np.int64), [len(w) for w in words_])
        begin, end, data = _packed(flat.tolist())
        h = word_hashes(data, begin, end)
        pair, count = np.unique(np.stack([h.view(np.int64), label], 1), axis=0, return_counts=True)
        key, first = np.unique(pair[:, 0], return_index=True)
        total, best = (np.add.reduceat(count, first), np.maximum.reduceat(count, first)) if len(key) else (count, count)
        owner = np.repeat(np.arange(len(key)), np.diff(np.append(first, len(pair))))
        top = np.flatnonzero(count == best[owner])
        top = top[np.concatenate(([True], owner[top][1:] != owner[top][:-1]))] if len(top) else top
        keep = (total >= least) & (best >= share * total)
        self.keys, self.labels = key[keep], pair[top, 1][keep]

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The label of each word hash, -1 for words that aren't listed."""
        if not len(self.keys):
            return np.full(len(h), -1)
        x = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[at] == x, self.labels[at], -1)


def _packed(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in ws], np.int64)
    end = np.cumsum(size + 1) - 1
    return end - size, end, np.frombuffer(b" ".join(ws), np.uint8)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For words in order with their rows: chain, place in the chain, and the number of chains."""
    if not len(row):
        return row, row, 0
    first = np.concatenate(([True], row[1:] != row[:-1]))
    start = np.flatnonzero(first)
    place = np.arange(len(row)) - np.repeat(start, np.diff([*start, len(row)]))
    new = first | (place % CHAIN == 0)
    return np.cumsum(new) - 1, place % CHAIN, int(new.sum())


def forward_backward(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels (chain, place, label) and the expected moves (label, label) over all chains."""
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    a, first = np.exp(move - move.max()), np.exp(begin - begin.max())
    alpha = np.empty((t, n, k), emit.dtype)
    x = first * e[:, 0]
    alpha[0] = x / x.sum(1, keepdims=True)
    for i in range(1, t):
        x = (alpha[i - 1] @ a) * e[:, i]
        x /= x.sum(1, keepdims=True)
        alpha[i] = np.where(mask[:, i, None], x, alpha[i - 1])
    post, moves, beta = np.empty_like(emit), np.zeros((k, k)), np.ones((n, k), emit.dtype)
    for i in range(t - 1, -1, -1):
        x = alpha[i] * beta
        post[:, i] = x / x.sum(1, keepdims=True)
        if i:
            live = mask[:, i, None]
            y = e[:, i] * beta
            pair = alpha[i - 1][:, :, None] * a * y[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moves += (pair * live[:, :, None]).sum(0)
            back = y @ a.T
            beta = np.where(live, back / back.sum(1, keepdims=True), beta)
    return post, moves


class Field:
    """Weights: buckets x labels, moves between labels, and first labels; and the lexicon that features look words up in."""

    def __init__(self, labels: list[str], lexicon: Lexicon | None = None) -> None:
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.move = np.zeros((len(labels), len(labels)), np.float32)
        self.begin = np.zeros(len(labels), np.float32)

    def emissions(self, n: int, at: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, self.weights[bucket, k] * value, minlength=n) for k in range(len(self.labels))], 1).astype(np.float32)

    def fit(self, sequences: list[tuple[list[bytes], list[int]]], rounds: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Steepest ascent of the conditional likelihood with per-weight rates (Adagrad)."""
        known: dict[bytes, int] = {}
        n, k = len(sequences), len(self.labels)
        word, label = np.zeros((n, CHAIN), np.int64), np.zeros((n, CHAIN), np.int64)
        mask = np.zeros((n, CHAIN), bool)
        for i, (ws, ls) in enumerate(sequences):
            word[i, : len(ws)] = [known.setdefault(w, len(known)) for w in ws]
            label[i, : len(ws)], mask[i, : len(ws)] = ls, True
        data = np.frombuffer(b" ".join(known), np.uint8)
        end = np.cumsum([len(w) + 1 for w in known]) - 1
        begin = end - [len(w) for w in known]
        at, bucket, value = word_features(data, begin, end, self.lexicon)
        truth = np.eye(k)[label] * mask[:, :, None]
        real = np.zeros((k, k))
        np.add.at(real, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1)
        sums = [np.full(x.shape, 1e-8) for x in (self.weights, self.move, self.begin)]
        for _ in range(rounds):
            emit = self.emissions(len(known), at, bucket, value)[word]
            post, moves = forward_backward(emit, mask, self.move, self.begin)
            off = ((truth - post * mask[:, :, None]) / n).reshape(-1, k)
            per_word = np.stack([np.bincount(word.ravel(), off[:, j], minlength=len(known)) for j in range(k)], 1)
            grad = np.stack([np.bincount(bucket, per_word[at, j] * value, minlength=BUCKETS) for j in range(k)], 1) - decay * self.weights
            for x, g, s in zip((self.weights, self.move, self.begin), (grad, (real - moves) / n, off.reshape(n, CHAIN, k)[:, 0].sum(0)), sums, strict=True):
                s += g * g
                x += (rate * g / np.sqrt(s)).astype(np.float32)
        return self

    def label(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of rows (begin, end, row) and the posteriors of their labels."""
        begin, end, row = words(data, at)
        if not len(begin):
            return begin, end, row, np.zeros((0, len(self.labels)), np.float32)
        data = lower_ascii(data)
        _, one, same = np.unique(range_hashes(data, begin, end), return_index=True, return_inverse=True)
        emit = self.emissions(len(one), *word_features(data, begin[one], end[one], self.lexicon))
        chain, place, n = chains(row)
        padded, mask = np.zeros((n, CHAIN, len(self.labels)), np.float32), np.zeros((n, CHAIN), bool)
        padded[chain, place], mask[chain, place] = emit[same], True
        return begin, end, row, forward_backward(padded, mask, self.move, self.begin)[0][chain, place]


def is_held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _windows(labelled: DataFrame, size: int, cutoff: int) -> DataFrame:
    """(h, lang, text): the windows of `size` words of whole texts whose hash is under the cutoff. Equal windows of one language have one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            langs = b.column("lang").to_pylist()
            data, at = utf8(b.column("text"))
            for i, j in spans(at):
                part = data[at[i] : at[j]]
                begin, end, row = words(part, at[i : j + 1] - at[i])
                place = np.arange(len(row)) - np.searchsorted(row, row)
                first = np.flatnonzero(place % size == 0)
                last = np.append(first[1:], len(row)) - 1
                raw = part.tobytes()
                for x, y, r in zip(begin[first].tolist(), end[last].tolist(), row[first].tolist(), strict=True):
                    h = xxhash.xxh3_64_intdigest(raw[x:y]) >> 1
                    if h < cutoff:
                        for c, v in zip(out, (h, langs[i + r], raw[x:y].decode("utf-8", "replace")), strict=True):
                            c.append(v)
            yield pa.record_batch({"h": pa.array(out[0], pa.int64()), "lang": pa.array(out[1], pa.string()), "text": pa.array(out[2], pa.string())})

    return labelled.select("lang", "text").mapInArrow(run, "h long, lang string, text string")


def training_windows(docs: DataFrame, most: int, size: int) -> list[tuple[str, str]]:
    """At most `most` different windows of `size` words, in a hashed order, out of all windows of all labelled documents that aren't held out.

    Only hashes under a cutoff, a few times `most` of them whatever the table's size, are put in order, so what comes to the driver stays the same.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    held = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    share = (4 * most + 400) / max(1, held[0] / (8 * size) + held[1] / 2)  # about how many windows there are
    rows = _windows(known, size, int(min(1.0, share) * (2**63 - 1))).groupBy("h", "lang").agg(F.min("text").alias("text"))
    # a window's words may be of any length: in the sample, its first 64 characters a word
    held = rows.orderBy("h", "lang").limit(most).select("lang", F.substring("text", 1, 64 * size).alias("text"))
    return [(r.text, r.lang) for r in held.collect()]


def train(docs: DataFrame, max_windows: int = 3000, size: int = 4 * CHAIN, seed: int = 5) -> Field | None:
    """A field, and its lexicon, from a bounded sample: max_windows windows of `size` words.

    Chains are made of one document's words or, half of them, of words of two
    documents, so that moves between languages are learned too. None if no row has a label.
    """
    rows = training_windows(docs, max_windows, size)
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    documents = [(lower_ascii(np.frombuffer(text.encode(), np.uint8)).tobytes().split(), labels.index(lang)) for text, lang in rows]
    pieces = [(ws[i : i + CHAIN], label) for ws, label in documents for i in range(0, len(ws), CHAIN)]
    other = rng.permutation(len(pieces))
    sequences = []
    for i, (ws, label) in enumerate(pieces):
        if i % 2:
            more, also = pieces[other[i]]
            at = int(rng.integers(1, CHAIN))
            a, b = ws[:at], more[: CHAIN - at]
            sequences.append((a + b, [label] * len(a) + [also] * len(b)))
        else:
            sequences.append((ws, [label] * len(ws)))
    return Field(labels, Lexicon(documents)).fit([s for s in sequences if s[0]])


def _stretches(row: np.ndarray, label: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring words of one label: n + 1 places where rows begin and end, labels, and numbers of words."""
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])))) if len(row) else np.zeros(0, np.int64)
    return np.searchsorted(row[first], np.arange(n + 1)), label[first], np.diff(np.append(first, len(row)))


def identify(docs: DataFrame, model: Field | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", stretches: bool = False) -> DataFrame:
    """Columns of `keep`, lang_pred, score, and with `stretches` also stretches: the labels of the text's words, as (lang, words) for each run of words of one label.

    A document has the language with the largest sum of its words' posteriors; score is that sum's share. Texts that are
    null, empty or without a letter, and all texts if there is no model, are `und` with score 0; null texts have no stretches.
    A very long text is labelled in one piece, chain by chain. Ties go to the label first in order; equal texts get equal
    results, repeated rows stay, and an empty table gives an empty result. A column of `keep` with the name of a new one is replaced by it."""
    keep = tuple(c for c in keep if c not in ("lang_pred", "score") and not (stretches and c == "stretches"))
    runs = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("stretches", runs)] * stretches)
    names = [f.name for f in schema.fields]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            letters = b.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            data, at = utf8(b.column("__text"))
            for i, j in spans(at):
                part = data[at[i] : at[j]]
                score, pick = np.zeros(j - i), np.full(j - i, -1)
                begin, end, row, post = field.label(part, at[i : j + 1] - at[i]) if field else (*(np.zeros(0, np.int64),) * 3, np.zeros((0, 1)))
                solid = np.concatenate(([0], np.cumsum((part >= 128) | ((part | 32) >= 97) & ((part | 32) <= 122))))
                votes = solid[end] > solid[begin]
                sums = np.stack([np.bincount(row[votes], post[votes, k], minlength=j - i) for k in range(post.shape[1])], 1)
                total = sums.sum(1)
                ok = (total > 0) & letters[i:j]
                pick[:] = np.where(ok, sums.argmax(1), -1)
                score[:] = np.where(ok, sums.max(1) / np.maximum(total, 1e-12), 0)
                labels = np.array([*(field.labels if field else ()), "und"], object)
                cols = [pa.array(labels[pick], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())]
                if stretches:
                    where, label, n = _stretches(row, np.where(votes, post.argmax(1), -1), j - i)
                    items = pa.StructArray.from_arrays([pa.array(labels[label], pa.string()), pa.array(n, pa.int64())], ["lang", "words"])
                    cols.append(pa.ListArray.from_arrays(pa.array(where, pa.int32()), items))
                yield pa.record_batch([*[b.column(c).slice(i, j - i) for c in keep], *cols], names=names)

    held = docs.select(*keep, F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    return held.mapInArrow(predict, schema)


def op3_crf_language(spark, sf_dir: str) -> DataFrame:
    """Languages of whole documents and of their words. Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: see identify."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text", is_held_out().alias("held_out")), model, ("doc_id", "held_out"), stretches=True)
