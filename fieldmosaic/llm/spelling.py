"""Spelling variants: words at edit distance one by a self-join of a partitioned trie."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, table

#: Distinct words that a task counts before it hands them on, and what it takes into one trie: words and code points.
COUNTED, TRIE_WORDS, TRIE_POINTS = 200_000, 30_000, 1 << 20
PAIR = "word string, n long, other string, other_n long"


class Level:
    """The nodes of one depth: parent, character, the word that ends there (or -1), the number of words below; children are numbered in a row."""

    def __init__(self, parent: np.ndarray, char: np.ndarray, ends: np.ndarray, held: np.ndarray) -> None:
        self.parent, self.char, self.ends, self.held = parent, char, ends, held
        self.key = (parent.astype(np.int64) << 32) | char  # ascending, as words are sorted

    def __len__(self) -> int:
        return len(self.parent)

    def children(self, below: Level) -> None:
        self.first = np.searchsorted(below.parent, np.arange(len(self)))
        self.fan = np.searchsorted(below.parent, np.arange(len(self)), side="right") - self.first


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range [first, first + count): its number, and its members."""
    who = np.repeat(np.arange(len(count)), count)
    return who, first[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


def _followed(v: np.ndarray, u: np.ndarray, above_v: Level, below_v: Level, below_u: Level) -> tuple[np.ndarray, np.ndarray]:
    """Children of both nodes of each pair with one character: their distance is the pair's."""
    who, child = _spread(above_v.first[v], above_v.fan[v])
    key = (u[who].astype(np.int64) << 32) | below_v.char[child]
    at = np.minimum(np.searchsorted(below_u.key, key), max(0, len(below_u) - 1))
    hit = below_u.key[at] == key if len(below_u) else np.zeros(len(key), bool)
    return child[hit], at[hit]


def _siblings(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of one node; there are as many as characters at most."""
    last = np.searchsorted(level.parent, level.parent, side="right")
    here = np.arange(len(level))
    return _spread(here + 1, last - here - 1)


def trie_pairs(cores: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of strings of one group at edit distance one, each pair once. Groups stand in a row, and strings are distinct and ascending in each.

    Two prefixes are at distance one if their last characters are equal and what is before them is at distance one, or if they are
    siblings, or one is the other's parent. So the active nodes of a node are its siblings, parent and children, and the
    children of its parent's active nodes with its own character. They are propagated down the trie one depth at a time, for
    all nodes at once: pairs at one depth, and pairs of which the second is one deeper. Nodes with one word and no
    active node are left, so a trie is only followed as deep as words have others near.
    """
    points = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(c) for c in cores], np.int64)
    begin = np.cumsum(size) - size

    def deeper(words: np.ndarray, node: np.ndarray, depth: int) -> tuple[Level, np.ndarray, np.ndarray]:
        """The level below, its words, and their nodes there."""
        long = size[words] > depth
        words, node = words[long], node[long]
        char = points[begin[words] + depth]
        new = np.ones(len(words), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        at = np.cumsum(new) - 1
        first = words[new]
        return Level(node[new], char[new], np.where(size[first] == depth + 1, first, -1), np.bincount(at, minlength=len(first))), words, at

    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(v: np.ndarray, u: np.ndarray, a: Level, b: Level) -> None:
        both = (a.ends[v] >= 0) & (b.ends[u] >= 0)
        if both.any():
            found.append((a.ends[v[both]], b.ends[u[both]]))

    words = np.arange(len(cores))
    _, roots = np.unique(group, return_inverse=True)
    top = np.bincount(roots)
    first = np.searchsorted(roots, np.arange(len(top)))
    level = Level(np.zeros(len(top), np.int64), np.arange(len(top)), np.where(size[first] == 0, first, -1), top)
    words = words[top[roots] > 1]
    below, words, node = deeper(words, roots[words], 0)
    level.children(below)
    even = (none, none)  # both at this depth
    odd = (below.parent, np.arange(len(below)))  # the second one deeper
    depth = 0
    while len(below):
        emit(*odd, level, below)
        sib = _siblings(below)
        follow = _followed(*even, level, below, below)
        even = tuple(np.concatenate(x) for x in zip(sib, follow, strict=True))
        emit(*even, below, below)
        needed = below.held > 1
        for x in (*even, odd[1], _spread(level.first[odd[0]], level.fan[odd[0]])[1]):
            needed[x] = True
        live = needed[node]
        depth += 1
        under, words, node = deeper(words[live], node[live], depth)
        below.children(under)
        own = below.held[under.parent] > 1  # a single word isn't its own neighbour
        follow = _followed(*odd, level, below, under)
        other = under.parent[follow[1]] != follow[0]  # a repeated character leads to a child that stands below already
        follow = (follow[0][other], follow[1][other])
        odd = tuple(np.concatenate(x) for x in zip((under.parent[own], np.arange(len(under))[own]), follow, strict=True))
        level, below = below, under
    if not found:
        return none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, core, word, n), sorted by path and core; whole paths go into tries of bounded size."""

    def pairs(b: pa.Table) -> pa.RecordBatch:
        path = b.column("path").combine_chunks().dictionary_encode()
        group = (path if isinstance(path, pa.DictionaryArray) else path.combine_chunks()).indices.to_numpy(zero_copy_only=False)
        v, u = trie_pairs(b.column("core").to_pylist(), group)
        one, two = pa.array(np.concatenate((v, u))), pa.array(np.concatenate((u, v)))
        cols = [b.column(c).take(x).combine_chunks() for x in (one, two) for c in ("word", "n")]
        return pa.record_batch(cols, names=["word", "n", "other", "other_n"])

    held: list[pa.Table] = []
    rows = points = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        while len(t):
            if rows < TRIE_WORDS and points < TRIE_POINTS:
                held.append(t)
                rows, points = rows + len(t), points + t.column("core").nbytes
                break
            path = t.column("path").to_pylist()
            last = held[-1].column("path")[-1].as_py()
            same = next((i for i, p in enumerate(path) if p != last), len(path))
            held.append(t.slice(0, same))
            t = t.slice(same)
            if len(t):
                yield pairs(pa.concat_tables(held))
                held, rows, points = [], 0, 0
    if held:
        yield pairs(pa.concat_tables(held))


def _parted(df: DataFrame) -> DataFrame:
    """Each word under the halves of its core that a word near it shares: (path, core, word, n) with longer paths and shorter cores.

    Of two strings at distance one, the shorter of L characters, at least L - 1 characters are a common prefix or a common
    suffix, so one of the two has (L - 1) // 2 at least. A string may be the shorter or the longer of its pair, so it
    stands under the half for its own length and that for one less.
    """
    size = F.char_length("core")
    half = F.array_distinct(F.array(*[F.greatest(F.lit(0), F.floor((size - k) / 2).cast("int")) for k in (1, 2)]))
    part = df.withColumn("half", F.explode(half)).withColumn("side", F.explode(F.array(F.lit("F"), F.lit("B"))))
    shared = F.when(F.col("side") == "F", F.substring("core", F.lit(1), F.col("half"))).otherwise(F.substring("core", F.char_length("core") - F.col("half") + 1, F.col("half")))
    rest = F.when(F.col("side") == "F", F.substring("core", F.col("half") + 1, F.char_length("core"))).otherwise(F.substring("core", F.lit(1), F.char_length("core") - F.col("half")))
    path = F.concat("path", "side", F.col("half").cast("string"), F.lit(":"), shared)
    short = F.when(F.octet_length(path) <= 48, path).otherwise(F.concat(F.lit("#"), F.md5(path.cast("binary"))))
    return part.select(short.alias("path"), rest.alias("core"), "word", "n")


def near_pairs(words: DataFrame, most: int = 20_000) -> DataFrame:
    """All pairs of distinct words at edit distance one, in both directions: word, n, other, other_n. words has word (distinct, not null) and n.

    The trie is partitioned by prefixes, and a second one by suffixes, so that the words of a pair meet in one of them. Parts of more than `most`
    words are parted again by the halves of what is left, until two characters are.
    """
    parts = _parted(words.select(F.lit("").alias("path"), F.col("word").alias("core"), "word", "n"))
    done: DataFrame | None = None
    while True:
        hot = cut(parts.groupBy("path").agg(F.count(F.lit(1)).alias("k"), F.max(F.char_length("core")).alias("longest")).where((F.col("k") > most) & (F.col("longest") > 2)).select("path"), "hot")
        if hot.isEmpty():
            done = parts if done is None else done.unionByName(parts)
            break
        rest = parts.join(hot, "path", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        parts = cut(_parted(parts.join(hot, "path", "left_semi")), "parts")
    met = done.repartition(partitions_for(words), "path").sortWithinPartitions("path", "core")
    return met.mapInArrow(_joined, PAIR).distinct()


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n).

    A word's form is its near word of largest n (ties: the first in code-point order), if that is at least factor times its own n (factor is 2
    or more); root follows forms to the last. A word without a form is its own root.
    """
    words = cut(words.where("word IS NOT NULL").select("word", "n"), "words")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    near = alone.unionByName(near_pairs(words)).groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= F.col("n") * factor
    held = cut(near.select("word", "n", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = held.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; n grows by the factor with each step, so rounds are few
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _counted(pattern: str, least: int, spoil: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, count = re.compile(f"(?:{pattern}){{{least},}}"), Counter()
        out = lambda: pa.record_batch({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})
        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                if not text.is_valid:
                    continue
                own = text.as_buffer().to_pybytes().lower()  # lower-cases A-Z only
                seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for word, n in Counter(runs.findall(own.decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if spoil and h % spoil == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        count[word] += n
                if len(count) > COUNTED:
                    yield out()
                    count.clear()
        if count:
            yield out()

    return run


def vocabulary(docs: DataFrame, pattern: str = r"[A-Za-zÀ-ÿ]", least: int = 7, occurrences: int = 2, spoil: int = 0) -> DataFrame:
    """(word, n): maximal runs of the pattern's characters in whole texts, A-Z lower-cased, with at least `least` code points and `occurrences` occurrences over all documents.

    spoil > 0 deletes a character from each run whose crc32 with the document's id it divides, to make misspellings; a null
    id counts as empty. Null and empty texts have no words.
    """
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counted(pattern, least, spoil), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def op12_trie_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all `documents`, with characters deleted as the contract says.

    Null and empty texts have no words, very long runs are words like others, repeated rows count each time, other columns
    aren't read, and an empty table gives no rows. Ties of n go to the first word in code-point order.
    """
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), spoil=31))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, r, count(*) AS n, string_split(concat(doc_id, ':', r), '') AS s FROM run WHERE length(r) >= 7 GROUP BY doc_id, r),
bytes AS (SELECT r, n, flatten(list_transform(s, lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS b FROM each),
crc AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS h FROM bytes, tab),
spoilt AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
shorter AS (SELECT DISTINCT d.word AS a, d.n AS an, w.word AS b, w.n AS bn FROM d JOIN w ON w.word = d.rest),
pairs AS (SELECT x.word AS a, x.n AS an, y.word AS b, y.n AS bn FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT a, an, b, bn FROM shorter UNION ALL SELECT b, bn, a, an FROM shorter),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM pairs GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * w.n THEN b END AS form, CASE WHEN bn >= 10 * w.n THEN bn END AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON f.word = chain.word AND chain.next IS NULL
"""
