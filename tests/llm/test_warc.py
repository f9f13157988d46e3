"""Archives written and read back, and each record read with nothing but its own frame and its archive's dictionary."""

import hashlib
import random
from pathlib import Path

import duckdb
import pytest
import zstandard

from fieldmosaic.llm import warc

SCHEMA = "page_id long, url string, html string, row string, size string, payload string, first string"


def pages(seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghié", k=rng.randint(2, 9))) for _ in range(300)]
    make = lambda n: "<html><body><p>" + " ".join(rng.choices(words, k=n)) + "</p></body></html>"
    copy, short, edge = make(400), make(20), "é" * 500  # 1000 bytes
    rows = [(k, f"http://a.example/{k}", make(rng.randint(5, 600))) for k in range(120)]
    rows += [(200 + k, "http://copy.example/", copy) for k in range(60)] + [(300 + k, None, short) for k in range(5)] + [(310, "http://x/", edge), (311, "http://x/", edge), (312, "http://x/", "é" * 499 + "x"), (313, "http://x/", "é" * 499 + "x")]
    rows += [(None, "http://null.example/ a\r\nWARC-Type: revisit", copy), (None, None, None), (400, "", ""), (400, "", ""), (259, "http://copy.example/again", copy), (259, "http://copy.example/", copy)]
    return rows + [(500, "http://long.example/", make(300_000)), (501, "http://odd.example/", "a\r\n\r\nWARC/1.1\r\n\r\n" * 200)]


def brute(rows, least=1000):
    out, done = [], set()
    body = [(i, (h or "").encode()) for _, _, h in rows for i in [0]]
    top = {}
    for (page_id, _, _), (_, b) in zip(rows, body, strict=True):
        top[b] = max(top.get(b, -1), -1 if page_id is None else page_id)
    for (page_id, _, _), (_, b) in zip(rows, body, strict=True):
        first = len(b) < least or ((-1 if page_id is None else page_id) == top[b] and b not in done)
        if first and len(b) >= least:
            done.add(b)
        out.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first or top[b] == -1 else top[b]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark, tmp_path):
    manifest = warc.archive_pages(frame(spark, pages()), f"{tmp_path}/a")
    back = warc.read_archives(manifest, with_payload=True).cache()
    assert got(back) == brute(pages())
    assert back.where("intact").count() == len(pages()) == manifest.agg({"records": "sum"}).first()[0]
    held = {r.record_id: r for r in back.collect()}
    assert len(held) == len(pages())
    want = sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in pages())
    assert sorted(r.payload_digest for r in held.values()) == want
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in held.values() if r.record_type == "response")
    assert {r.url for r in held.values() if r.page_id is None} == {"http://null.example/%20a%0D%0AWARC-Type:%20revisit", None}


def test_archives_stand_alone(spark, tmp_path):
    """The first frame is the dictionary, and each record can be read from its own frame with that dictionary only."""
    plain_rows = warc.page_rows(frame(spark, pages()))
    rows, dictionary = warc.with_first(plain_rows), warc.train_dictionary(plain_rows)
    assert 1000 < len(dictionary) <= 32 << 10
    manifest = warc.write_archives(rows, f"{tmp_path}/b", dictionary, archive_bytes=40_000).collect()
    assert len(manifest) > 4
    records = 0
    for m in manifest:
        data = Path(m.archive).read_bytes()
        assert len(data) == m.bytes and data[:4] == warc.DICT_FRAME
        n = int.from_bytes(data[4:8], "little")
        assert data[8 : 8 + n] == dictionary
        rest, plain = data[8 + n :], zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]))
        while rest:
            one = plain.decompressobj()
            text = one.decompress(rest)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
            rest, records = one.unused_data, records + (b"WARC-Type: warcinfo" not in text[:40])
    assert records == len(pages())
    bare = warc.write_archives(rows, f"{tmp_path}/c", archive_bytes=40_000)
    assert got(warc.read_archives(bare)) == brute(pages())
    small = frame(spark, [(k, f"http://a/{k}", f"<html><head><title>page {k}</title></head><body>words that stand on all pages, and a number: {k * k}</body></html>") for k in range(400)])
    small = warc.page_rows(small)
    kept = [warc.write_archives(warc.with_first(small), f"{tmp_path}/{len(d)}", d).agg({"bytes": "sum"}).first()[0] for d in (b"", warc.train_dictionary(small, most=4096))]
    assert kept[1] < 0.6 * kept[0]


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    manifest = warc.archive_pages(frame(spark, pages()), f"file:{tmp_path}/d")
    some = next(Path(f"{tmp_path}/d").iterdir())
    Path(f"{tmp_path}/d/left-by-a-lost-task.warc.zst").write_bytes(some.read_bytes()[:-7])
    assert got(warc.read_archives(manifest)) == brute(pages())


def test_damage_is_seen(tmp_path):
    text = warc.page_record(1, 1, "http://a/", hashlib.sha1(b"abc").hexdigest(), b"abc")
    for bad in (text.replace(b"abc", b"abd"), text.replace(b"Content-Length: 3", b"Content-Length: 4")):
        (tmp_path / "x").write_bytes(zstandard.ZstdCompressor().compress(bad))
        with open(tmp_path / "x", "rb") as f:
            assert [warc._page("x", *r)[8] for r in warc.records_of(f)] == [False]
    (tmp_path / "y").write_bytes(zstandard.ZstdCompressor().compress(text[:-2]))
    with open(tmp_path / "y", "rb") as f, pytest.raises(ValueError):
        list(warc.records_of(f))


def test_compressed_dictionary(tmp_path):
    texts = [f"<p>{k} and some more words for {k * k}</p>".encode() * 3 for k in range(500)]
    d = zstandard.train_dictionary(2048, texts).as_bytes()
    small = zstandard.ZstdCompressor().compress(d)
    records = [warc.page_record(k, k, None, hashlib.sha1(t).hexdigest(), t) for k, t in enumerate(texts)]
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    (tmp_path / "z").write_bytes(warc.DICT_FRAME + len(small).to_bytes(4, "little") + small + b"".join(press.compress(r) for r in records))
    with open(tmp_path / "z", "rb") as f:
        assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.records_of(f)] == texts


def test_no_rows(spark, tmp_path):
    manifest = warc.archive_pages(frame(spark, []), f"{tmp_path}/e")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0
    one = warc.archive_pages(frame(spark, [(None, None, None)]), f"{tmp_path}/f")
    assert got(warc.read_archives(one)) == brute([(None, None, None)])


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP13_SQL})").fetchall(), key=str)
    assert got(warc.op13_dictionary_warc(spark, "/root/testdata/sf0.001")) == want
