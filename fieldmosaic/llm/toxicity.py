"""Toxicity by a chain of linear models: each category's model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, mix, range_hashes, spans, table, utf8, words

BUCKETS = 1 << 18
#: The chain's order. A text that is junk is told from one that is toxic by more than its insults.
CATEGORIES = ("junk", "toxic")


def text_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each row as (row, bucket), in row order; words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased."""
    low = lower_ascii(data)
    letter = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    low = np.where(letter, low, 32).astype(np.uint8)
    begin, end, row = words(low, at)
    pairs = np.unique(row.astype(np.uint64) * np.uint64(BUCKETS) + mix(range_hashes(low, begin, end)) % np.uint64(BUCKETS))
    return (pairs // np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)


def shape_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of capitals, of marks and digits, and the log of the length."""
    size = np.maximum(np.diff(at), 1)
    share = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at]) / size
    marks = (data < 128) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & (data != 32)
    return np.stack([share((data >= 65) & (data <= 90)), share(marks), np.log1p(np.diff(at)) / 10], 1)


class Linear:
    """Logistic regression over sparse hashed words and a few dense columns."""

    def __init__(self, width: int) -> None:
        self.words, self.dense, self.bias = np.zeros(BUCKETS), np.zeros(width), 0.0

    def margin(self, n: int, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.words[bucket], minlength=n)[:n] + dense @ self.dense + self.bias

    def fit(self, n: int, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, shrink: float = 2e-3, least: int = 3) -> Linear:
        """Adagrad with soft thresholding. Only words that occur in `least` rows of the sample have weights."""
        known = np.bincount(bucket, minlength=BUCKETS) >= least
        keep = known[bucket]
        row, bucket = row[keep], bucket[keep]
        used, bucket = np.unique(bucket, return_inverse=True)
        w, s = np.zeros(len(used)), np.full(len(used), 1e-10)
        ds, bs = np.full(dense.shape[1], 1e-10), 1e-10
        weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) if y.any() and not y.all() else np.full(n, 1 / max(n, 1))
        self.bias = 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[bucket], minlength=n) + dense @ self.dense + self.bias, -30, 30)))
            off = (y - p) * weight
            g, gd, gb = np.bincount(bucket, off[row], minlength=len(used)), dense.T @ off, off.sum()
            s, ds, bs = s + g * g, ds + gd * gd, bs + gb * gb
            step = rate / np.sqrt(s)
            w = w + step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            self.dense = self.dense + rate * gd / np.sqrt(ds)
            self.bias += rate * gb / np.sqrt(bs)
        self.words[used] = w
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain:
    """Models in order; model k sees the probabilities of models 0..k-1 as dense columns."""

    def __init__(self, categories: tuple[str, ...], models: list[Linear], thresholds: list[float]) -> None:
        self.categories, self.models, self.thresholds = categories, models, thresholds

    def predict(self, n: int, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = sigmoid(m.margin(n, row, bucket, np.hstack([dense, out[:, :k]])))
        return out


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold probabilities, midway between the two neighbouring probabilities."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(p[order][1:] < p[order][:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def fit_chain(n: int, row: np.ndarray, bucket: np.ndarray, dense: np.ndarray, labels: np.ndarray, categories: tuple[str, ...] = CATEGORIES, folds: int = 3) -> Chain:
    """labels: n x categories, 0 or 1. What a later model sees of an earlier category was predicted by models that hadn't seen the row."""
    models, thresholds, before = [], [], np.zeros((n, 0))
    fold = np.arange(n) % folds
    for k in range(len(categories)):
        y, x = labels[:, k].astype(bool), np.hstack([dense, before])
        out = np.zeros(n)
        for f in range(folds):
            use, rest = fold != f, fold == f
            if use.any() and rest.any():
                place = np.cumsum(use) - 1
                m = Linear(x.shape[1]).fit(int(use.sum()), place[row[use[row]]], bucket[use[row]], x[use], y[use])
                out[rest] = sigmoid(m.margin(n, row, bucket, x)[rest])
        thresholds.append(_best_threshold(out, y))
        models.append(Linear(x.shape[1]).fit(n, row, bucket, x, y))
        before = np.hstack([before, out[:, None]])
    return Chain(categories, models, thresholds)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = utf8(b.column("text"))
        for i, j in spans(at):
            part, here = data[at[i] : at[j]], at[i : j + 1] - at[i]
            row, bucket = text_features(part, here)
            offsets = np.searchsorted(row, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket, pa.int32()))
            shape = pa.FixedSizeListArray.from_arrays(pa.array(shape_features(part, here).ravel()), 3).cast(pa.list_(pa.float64()))
            yield pa.record_batch([b.column("y").slice(i, j - i), lists, shape], names=["y", "buckets", "shape"])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, max_rows: int = 6000) -> Chain | None:
    """A chain from at most max_rows labelled documents, in a hashed order; whole texts. None if no row has all labels.

    categories gives each category's condition over the columns of labels, in the order of the chain.
    """
    conditions = categories or {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    y = labels.select("doc_id", F.array(*[c.cast("int") for c in conditions.values()]).alias("y")).where(F.forall("y", lambda x: x.isNotNull()))
    ids = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text")  # at most max_rows rows are sent
    rows = rows.mapInArrow(_featurise, "y array<int>, buckets array<int>, shape array<double>").toArrow()
    n = rows.num_rows
    if not n:
        return None
    targets = np.array(rows.column("y").to_pylist())
    buckets = rows.column("buckets").combine_chunks()
    row = np.repeat(np.arange(n), buckets.value_lengths().to_numpy())
    dense = rows.column("shape").combine_chunks().flatten().to_numpy().reshape(n, -1)
    return fit_chain(n, row, buckets.flatten().to_numpy().astype(np.int64), dense, targets, tuple(conditions))


def score(docs: DataFrame, chain: Chain | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns of `keep`, p_<category> for each, and <category> as a verdict against its threshold.

    Null and empty texts have no words; they, and all rows if there is no chain, have probability 0 and are not rejected. Very long
    texts are read whole; equal texts have equal results, whatever their ids, and repeated rows stay. A column of `keep` with the name
    of a new one is replaced by it. An empty table gives an empty result.
    """
    categories = chain.categories if chain else CATEGORIES
    keep = tuple(c for c in keep if c not in categories and c not in [f"p_{x}" for x in categories])
    schema = T.StructType(docs.select(*keep).schema.fields + [T.StructField(f"p_{c}", T.DoubleType()) for c in categories] + [T.StructField(c, T.BooleanType()) for c in categories])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            data, at = utf8(b.column(text))
            p = np.zeros((b.num_rows, len(categories)))
            for i, j in spans(at) if model else ():
                part, here = data[at[i] : at[j]], at[i : j + 1] - at[i]
                p[i:j] = model.predict(j - i, *text_features(part, here), shape_features(part, here))
                p[i:j][np.diff(here) == 0] = 0
            hit = [pa.array((p[:, k] > model.thresholds[k]) if model else np.zeros(b.num_rows, bool)) for k in range(len(categories))]
            yield pa.record_batch([*[b.column(c) for c in keep], *[pa.array(p[:, k]) for k in range(len(categories))], *hit], schema=None, names=[*keep, *[f"p_{c}" for c in categories], *categories])

    held = docs.select(*keep) if text in keep else docs.select(*keep, text)
    return held.mapInArrow(predict, schema)


def op5_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts for all `documents`, by a chain trained on those with labels; odd input: see score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
