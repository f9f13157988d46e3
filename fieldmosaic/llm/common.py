"""What several operators of this subpackage share: a place for cut lineage, and Arrow text as numpy bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: whatever stands between these ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed value: multiplier for polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that Spark hands to Python at once; a longer row stands alone.
BATCH_BYTES = 2 << 20
#: Folders of local sessions without spark.checkpoint.dir.
LOCAL: dict[str, str] = {}

#: What an inner product beyond 64 bits counts as.
LEAST, MOST = -(2**63), 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a local session (tests, one machine) has a folder of its own; a cluster's session must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="fieldmosaic-")
        LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what tasks hand to Python at once by bytes as well as rows, as texts and sets of shingles can be long. A smaller bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps don't depend on executors that may be lost."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session: large clusters set them, the code doesn't guess."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc32_unsigned(text: str = "text"):
    """CRC-32 of a text's UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def trim() -> None:
    """What this process's freed arrays held goes back to the machine."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if give:
        give(0)


def trimmed(run):
    """run, a function over batches, after which what its arrays held goes back to the machine: Python workers live on between tasks, beside each other on one executor."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return go


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, most: int = 32 << 20) -> Iterator[pa.Table]:
    """Rows sorted by a whole-number key in tables of about `most` bytes or of one key; a key's rows are never in two of them."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        if held and size >= most:
            keys = b.column(key).to_numpy(zero_copy_only=False)
            same = int(np.searchsorted(keys, last, side="right"))
            if same < b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(0, same)]) if same else pa.Table.from_batches(held)
                held, size, b = [], 0, b.slice(same)
        held.append(b)
        size += b.nbytes
        last = b.column(key)[b.num_rows - 1].as_py()
    if held:
        yield pa.Table.from_batches(held)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, back to back, and the n + 1 places where rows begin and end. Nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, where, data = array.buffers()
    if len(array) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(where, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def spans(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about `most` bytes together; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


BYTE_VALUE = _byte_values()


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, by in (("up", BASE), ("down", self.inverse)):
                    x = np.full(n, by, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], from one running sum over the bytes."""
    up, down = POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[:-1], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def sequence_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[begin:end] of mixed 64-bit values. Hashes of a text's overlapping grams make one of the text that keeps none of the structure of its bytes."""
    up, down = POWERS.get(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values + BASE) * up[:-1], out=total[1:])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end] that mixes eight bytes at a time, so no two strings are known to collide. For strings that are short or few."""
    size = end - begin
    out = mix(size.astype(np.uint64) + BASE)
    if not len(size):
        return out
    text = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", text, 0, (1,))
    left, live = size.copy(), np.flatnonzero((size > 0) & (size <= 64))
    place = begin.copy()
    while len(live):
        x = eight[place[live]]
        few = left[live] < 8
        x = np.where(few, x & ((np.uint64(1) << (np.minimum(left[live], 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), x)
        with np.errstate(over="ignore"):
            out[live] = mix((out[live] ^ x) + BASE)
        place[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    for i in np.flatnonzero(size > 64):
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the row each belongs to; words never cross rows."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    solid = ~blank
    first = solid.copy()
    first[1:] &= blank[:-1]
    last = solid.copy()
    last[:-1] &= blank[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def floored(vector: str, scale: int = 256):
    """floor(scale * x) of a vector's components, as doubles: those of 2**53 and more are whole as they are, and floor() gives a long."""
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**53, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integral doubles, row by row, exact. Where a sum may pass 2**53 it is made of Python's integers; beyond 64 bits it is the nearest long."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    if peak < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(np.dot(whole(a), whole(x).T), LEAST, MOST).astype(np.int64)
