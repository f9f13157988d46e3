"""MPEG transport streams: a lossless carrier of payload bytes, and a reader that parses program tables, checks continuity and reassembles elementary packets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID, NULL_PID, PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 188, 0x47, 0, 0x100, 0x101, 0x1FFF, 0xBD, 0x06, 90_000
#: Bytes of payload for each elementary packet, and the ticks between two of them.
UNIT, TICKS = 16 * 192, 3_600
UNIT_HEADER = 14


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        x = np.where(x & np.uint64(0x80000000), (x << np.uint64(1)) ^ np.uint64(0x04C11DB7), x << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return x


CRC = [int(x) for x in _crc_table()]


def section_crc(section: bytes) -> int:
    """The CRC-32 of program table sections; over a section with its CRC it is 0."""
    crc = 0xFFFFFFFF
    for b in section:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ CRC[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    held = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return held + section_crc(held).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10, 0]) + section).ljust(PACKET, b"\xff")


PROGRAM_TABLES = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream with one private stream. Every unit of payload is an elementary packet
    with a timestamp; its first transport packet is a random-access point with a clock reference."""
    parts, counter = [PROGRAM_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts = k * TICKS
        body = payload[at : at + UNIT]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + UNIT_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + body
        first = b"\x07\x50" + ((pts << 15) | 0x7E00).to_bytes(6, "big")  # length, random access and clock flags, clock reference
        head, data = data[: PACKET - 4 - len(first)], data[PACKET - 4 - len(first) :]
        if len(head) < PACKET - 4 - len(first):  # all in one packet: stuff the adaptation field
            fill = PACKET - 4 - len(first) - len(head)
            first = bytes([first[0] + fill]) + first[1:] + b"\xff" * fill
        parts.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + first + head)
        counter = (counter + 1) & 15
        whole, left = divmod(len(data), PACKET - 4)
        if whole:
            m = np.empty((whole, PACKET), np.uint8)
            m[:, 0], m[:, 1], m[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            m[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            m[:, 4:] = np.frombuffer(data, np.uint8, whole * (PACKET - 4)).reshape(whole, -1)
            parts.append(m.tobytes())
            counter = (counter + whole) & 15
        if left:
            fill = PACKET - 4 - left
            field_ = bytes([fill - 1]) + (b"\x00" + b"\xff" * (fill - 2) if fill > 1 else b"")
            parts.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | counter]) + field_ + data[whole * (PACKET - 4) :])
            counter = (counter + 1) & 15
    return b"".join(parts)


@dataclass
class Stream:
    """What a reader finds: programs as {number: {pid: stream type}}, elementary packets by pid as (timestamp, bytes), random-access points as (pid, timestamp)."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: dict[int, list[tuple[int | None, bytes]]] = field(default_factory=dict)
    random_access: list[tuple[int, int | None]] = field(default_factory=list)
    packets: int = 0
    lost_sync: int = 0
    continuity_errors: int = 0
    bad_sections: int = 0


def _sections(data: np.ndarray) -> bytes | None:
    """The section that starts in a packet's payload, if its CRC holds. Longer sections than one packet are not used by single-program streams."""
    if not len(data) or 1 + data[0] >= len(data):
        return None
    held = data[1 + int(data[0]) :].tobytes()
    size = 3 + ((held[1] & 0x0F) << 8 | held[2]) if len(held) > 3 else 0
    return held[:size] if 12 <= size <= len(held) and section_crc(held[:size]) == 0 else None


def _unit(data: bytes) -> tuple[int | None, bytes]:
    """Timestamp and payload of an elementary packet; a stated length cuts off what follows."""
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None, b""
    size = int.from_bytes(data[4:6], "big")
    pts = None
    if data[7] & 0x80 and len(data) >= UNIT_HEADER:
        p = data[9:14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1
    return pts, data[9 + data[8] : 6 + size if size else None]


def demux(media: bytes) -> Stream:
    """Reads a whole stream. Packets without the sync byte, null packets and repeated packets carry nothing."""
    out = Stream(packets=len(media) // PACKET)
    m = np.frombuffer(media, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = m[:, 0] == SYNC
    out.lost_sync = int((~good).sum()) + bool(len(media) % PACKET)
    m = m[good]
    pid = (m[:, 1].astype(np.int64) & 0x1F) << 8 | m[:, 2]
    start, adapts, carries, counter = m[:, 1] & 0x40 > 0, m[:, 3] & 0x20 > 0, m[:, 3] & 0x10 > 0, m[:, 3] & 15
    begin = np.where(adapts, 5 + m[:, 4].astype(np.int64), 4)
    access = adapts & (m[:, 4] > 0) & (m[:, 5] & 0x40 > 0)
    broken = adapts & (m[:, 4] > 0) & (m[:, 5] & 0x80 > 0)
    pmt: dict[int, int] = {}
    for i in np.flatnonzero((pid == PAT_PID) & start & carries):
        s = _sections(m[i, begin[i] :])
        out.bad_sections += s is None
        for k in range(8, len(s or b"") - 4, 4):
            if number := int.from_bytes(s[k : k + 2], "big"):
                pmt[(s[k + 2] & 0x1F) << 8 | s[k + 3]] = number
    for p, number in pmt.items():
        for i in np.flatnonzero((pid == p) & start & carries):
            s = _sections(m[i, begin[i] :])
            out.bad_sections += s is None
            k = 12 + ((s[10] & 0x0F) << 8 | s[11]) if s else 0
            while s and k + 5 <= len(s) - 4:
                out.programs.setdefault(number, {})[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    for p in sorted({x for streams in out.programs.values() for x in streams}):
        at = np.flatnonzero((pid == p) & carries)
        step = (counter[at][1:].astype(np.int64) - counter[at][:-1]) % 16
        repeated = np.concatenate(([False], (step == 0) & (m[at][1:, 4:] == m[at][:-1, 4:]).all(1))) if len(at) else np.zeros(0, bool)
        jumped = np.concatenate(([False], (step != 1) & ~repeated[1:] & ~broken[at][1:])) if len(at) else repeated
        out.continuity_errors += int(jumped.sum())
        at = at[~repeated]
        begins = np.flatnonzero(start[at])
        units = out.units.setdefault(p, [])
        for a, b in zip(begins, [*begins[1:], len(at)], strict=True):
            rows = at[a:b]
            plain = (begin[rows] == 4).all()
            keep = np.arange(PACKET) >= begin[rows][:, None]
            units.append(_unit(m[rows, 4:].tobytes() if plain else m[rows][keep].tobytes()))
            if access[rows[0]]:
                out.random_access.append((p, units[-1][0]))
    return out


def pad(data: bytes) -> bytes:
    return data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))


def feature(s: Stream) -> str:
    stamps = [p for u in s.units.values() for p, _ in u if p is not None]
    return ";".join(
        f"{k}={v}"
        for k, v in (("programs", len(s.programs)), ("streams", sum(map(len, s.programs.values()))), ("packets", s.packets), ("units", sum(map(len, s.units.values()))), ("access", len(s.random_access)), ("errors", s.continuity_errors + s.lost_sync + s.bad_sections), ("last_pts", max(stamps, default=-1)))
    )


def media_columns(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and every text as a transport stream (media) with its bytes (n_bytes, without padding), timestamps (pts) and random-access points (random_access_pts).

    A null text counts as empty; an empty one is a stream with one unit of blanks. Equal texts have equal streams, repeated rows
    stay, an empty table gives an empty one. A very long text is one value, held in memory a few times over. Columns of
    `keep` mustn't have the names of the new ones.
    """
    schema = df.select(*keep).schema.add("n_bytes", "long").add("media", "binary").add("pts", T.ArrayType(T.LongType())).add("random_access_pts", T.ArrayType(T.LongType()))
    held = df.select(*keep, F.col(text).alias("__text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__text")
            for k in range(0, b.num_rows, 256):
                raw = [(t.as_py() or "").encode() for t in texts.slice(k, 256)]
                made = [mux(pad(x)) for x in raw]
                stamps = pa.array([unit_stamps(len(x)) for x in raw], pa.list_(pa.int64()))  # each unit has a timestamp and is a random-access point
                yield pa.record_batch([*[b.column(c).slice(k, 256) for c in keep], pa.array([len(x) for x in raw], pa.int64()), pa.array(made, pa.binary()), stamps, stamps], names=[*keep, "n_bytes", "media", "pts", "random_access_pts"])

    return held.mapInArrow(write, schema)


def unit_stamps(n_bytes: int) -> list[int]:
    """Timestamps of the units of a text of n_bytes."""
    return [k * TICKS for k in range(-(-max(192, n_bytes) // UNIT))]


def media_digests(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of a table that media_columns made, and a digest of each stream, read from its bytes.

    The feature says what the reader found; `stamps` tells whether its timestamps and random-access points are those of the columns.
    A null stream is read as one without packets. An empty table gives an empty result.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = media.select(*keep).schema
    for n, t in zip(names, ["long", "long", "string", "long", "long", "string", "string"], strict=True):
        schema = schema.add(n, t)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, m, pts, access in zip(*(b.column(c) for c in ("n_bytes", "media", "pts", "random_access_pts")), strict=True):
                m = m.as_py() or b""
                s = demux(m)
                units = s.units.get(DATA_PID, [])
                back = b"".join(x for _, x in units)
                same = pts.as_py() == [p for p, _ in units] and access.as_py() == [p for _, p in s.random_access]
                rows.append((n.as_py(), len(back), sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), sha256(m).hexdigest(), f"{feature(s)};stamps={'held' if same else 'differ'}"))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([*[b.column(c) for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*keep, *names])

    return media.select(*keep, "n_bytes", "media", "pts", "random_access_pts").mapInArrow(digest, schema)


def op8_mpeg_ts(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a transport stream and read back. Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: see media_columns."""
    stored = cut(media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")), "media", "zstd")
    return media_digests(stored)
