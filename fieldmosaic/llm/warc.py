"""WARC archives of pages, compressed record by record with a Zstandard dictionary that stands first in each archive."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, shared_dir, table

#: Fixed values of the formats: what the skippable frame of a dictionary and a frame begin with, and the profile of revisits.
DICT_FRAME, FRAME_MAGIC = 0x184D2A5D.to_bytes(4, "little"), 0xFD2FB528.to_bytes(4, "little")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A page's own date isn't known to its row; this stands in every record.
DATE = "1970-01-01T00:00:00Z"
READ = "archive string, page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path there; Hadoop's names of schemes are understood."""
    if folder.startswith("/") or folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _block(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record; fields without a value are left out, and blanks and control characters in a value are escaped where they would end its line."""
    lines = [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{row}'.encode()).digest()[:16], version=5)}>"


def page_record(row: int, page_id: int | None, url: str | None, sha1: str, payload: bytes, first: tuple[int | None, int] | None = None) -> bytes:
    """A response, or, if first (page_id, row) is another row with the same payload, a revisit of it: its payload isn't stored again."""
    again = first is not None and first[1] != row
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", _record_id(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace(" ", "%20") if url else url),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"), ("WARC-Profile", REVISIT if again else None), ("WARC-Refers-To", _record_id(*first) if again else None),
        ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", first[0] if again else None), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, _block(len(payload)) + (b"" if again else payload))


def page_rows(pages: DataFrame) -> DataFrame:
    """row (a key of the row's own), page_id, url, payload (the html as UTF-8, a null one empty), size, sha1 and key (its SHA-256, by which payloads are told apart: SHA-1 collisions can be made).

    Written once, as a row's key must not change between the passes that group rows and write records, which then read hashes only or rows as they are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return cut(held.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "key": F.sha2("payload", 256)}), "pages")


def with_first(rows: DataFrame, least: int = 1000) -> DataFrame:
    """Adds first, (page_id, row) of the row with the largest page_id among those of equal payloads of at least `least` bytes; null where a payload is shorter or alone.

    Only hashes are shuffled to find groups; rows of a large group are joined with one row, a join that Spark can split.
    """
    groups = rows.where(F.col("size") >= least).select("key", "page_id", "row").groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    held = cut(groups.where("n > 1").select("key", "first"), "payloads")
    return rows.withColumn("key", F.when(F.col("size") >= least, F.col("key"))).join(held, "key", "left").drop("key")


def train_dictionary(rows: DataFrame, most: int = 32 << 10, sample_records: int = 1000, sample_bytes: int = 3 << 20, longest: int = 32 << 10) -> bytes:
    """A Zstandard dictionary of at most `most` bytes, of a bounded sample of the records that are to be archived; empty where they are too few.

    The sample: of the sample_records rows with the smallest hashes, those of at most `longest` bytes, different payloads only, up to sample_bytes together.
    """
    drawn = rows.where((F.col("size") > 0) & (F.col("size") <= longest)).select("row", "size").orderBy(F.xxhash64("row"), "row").limit(sample_records).collect()
    chosen, total = [], 0
    for r in drawn:
        total += r["size"]
        if total <= sample_bytes:
            chosen.append(r.row)
    found = {r.key: page_record(r.row, r.page_id, r.url, r.sha1, bytes(r.payload)) for r in rows.where(F.col("row").isin(chosen)).collect()} if chosen else {}
    samples = [found[k] for k in sorted(found)]
    try:
        return zstandard.train_dictionary(most, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b""


def _writer(folder: str, dictionary: bytes, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(folder)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if given:
            given.precompute_compress(level=level)
        press = zstandard.ZstdCompressor(level=level, dict_data=given)
        out = name = None
        n = 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.record_batch({"archive": pa.array([f"{folder}/{name}"]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for r in zip(*(b.column(c) for c in ("row", "page_id", "url", "sha1", "payload", "first_page", "first_row")), strict=True):
                row, page_id, url, sha1, payload, first_page, first_row = (x.as_py() for x in r)
                if out is None:
                    store.create_dir(path, recursive=True)
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0  # a task that runs again writes another file; only files in the manifest count
                    out = store.open_output_stream(f"{path}/{name}", compression=None)  # else it is chosen by the name
                    if dictionary:
                        out.write(DICT_FRAME + len(dictionary).to_bytes(4, "little") + dictionary)
                    out.write(press.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                out.write(press.compress(page_record(row, page_id, url, sha1, payload, None if first_row is None else (first_page, first_row))))
                n += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(rows: DataFrame, folder: str, dictionary: bytes = b"", archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes rows (page_rows, with_first) as .warc.zst files into a folder that all executors reach; returns the manifest: archive, records, bytes.

    Each archive starts with the dictionary in a skippable frame, and a record is a frame of its own, so any record can be read
    with its archive's dictionary alone. An archive is closed once it has archive_bytes. Files of tasks that failed or ran twice
    aren't in the manifest.
    """
    held = rows.select("row", "page_id", "url", "sha1", "payload", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"))
    return cut(held.mapInArrow(_writer(folder, dictionary, archive_bytes, level), "archive string, records long, bytes long"), "manifest")


def records_of(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive: fields (names in lower case) and block. One record is in memory at a time."""
    start = file.read(8)
    given = None
    if start[:4] == DICT_FRAME:
        held = file.read(int.from_bytes(start[4:], "little"))
        if held[:4] == FRAME_MAGIC:  # a dictionary may be compressed itself
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        given = zstandard.ZstdCompressionDict(held)
    else:
        file.seek(0)
    with zstandard.ZstdDecompressor(dict_data=given).stream_reader(file, read_across_frames=True, closefd=False) as plain:
        lines = io.BufferedReader(plain, 1 << 16)
        while first := lines.readline():
            if first.strip() != b"WARC/1.1":
                raise ValueError("an archive's record doesn't start with its version")
            fields = {}
            while (line := lines.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.decode().partition(":")
                fields[k.lower()] = v.strip()
            block = lines.read(int(fields["content-length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("an archive's record doesn't end where it says")
            yield fields, block


def _page(archive: str, fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    response, whole = fields["warc-type"] == "response", lambda k: int(fields[k]) if k in fields else None
    said = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
    digest = hashlib.sha1(payload).hexdigest() if response else said
    intact = digest == said and (len(payload) == size if response else not payload)
    return archive, whole("x-page-id"), fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-type"], whole("x-refers-to-page-id"), len(payload) if response else size, digest, intact, payload if response else None


def _reader(with_payload: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for archive in b.column("archive").to_pylist():
                store, path = _opened(archive)
                held, size = [], 0
                with store.open_input_file(path) as file:
                    for fields, block in records_of(file):
                        if fields["warc-type"] in ("response", "revisit"):
                            held.append(_page(archive, fields, block))
                            size += 500 + (len(block) if with_payload else 0)
                        if size > 1 << 20:
                            yield out(held)
                            held, size = [], 0
                if held:
                    yield out(held)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The responses and revisits of the manifest's archives: archive, page_id, url, record_id, record_type, refers_to, payload_bytes, payload_digest and intact, with_payload also payload (null for revisits).

    Size and digest of a response are those of what was read; of a revisit those that it names, as its payload stands at the response. intact
    says whether a record is as its own fields say.
    """
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    text = READ + ", payload binary" * with_payload
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in text.split(", ")])
    return manifest.select("archive").repartition(partitions_for(manifest), "archive").mapInArrow(_reader(with_payload, schema), text)


def archive_pages(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest for read_archives.

    Of rows with equal payloads of at least `least` bytes, the one with the largest page_id (of several, one row) is a response and the others revisit it; a null
    page_id is the smallest. Rows are told apart by a key of their own, so repeated rows are records of their own. A null html
    is empty, a null url or page_id has no field and is read back as null; control characters and blanks of a url are
    percent-escaped. Very long payloads are one record each. Other columns aren't read. Without rows nothing is written.
    """
    rows = page_rows(pages)
    return write_archives(with_first(rows, least), folder, train_dictionary(rows), archive_bytes)


def op13_dictionary_warc(spark, sf_dir: str) -> DataFrame:
    """Archives all `pages` in the shared folder and reads the archives back; handling as in archive_pages."""
    manifest = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS size, sha1(html) AS sha1, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1 AS payload_digest, CASE WHEN size >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND k > 1 THEN top END AS refers_to FROM r
"""
