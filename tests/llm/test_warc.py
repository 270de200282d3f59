"""Archives: what they hold after a round trip, their dictionary frame, and the choice of responses."""

import base64
import hashlib
import io
import random
import struct

import pyarrow.fs as fs
import zstandard

from pricewell.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least):
    lead = {}
    for i, (page, _, html) in enumerate(rows):
        key = (page is None, page or 0, i)
        if len((html or "").encode()) >= least:
            lead[digest(html)] = min(lead.get(digest(html), key), key)
    out = []
    for i, (page, _, html) in enumerate(rows):
        first = lead.get(digest(html))
        again = first is not None and first[2] != i
        refers = (None if first[0] else first[1]) if again else None
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", refers))
    return sorted(out, key=str)


def pages(seed):
    rng = random.Random(seed)
    words = ["<p>price</p>", "naïve", "日本", "<div class='x'>", "\r\n\r\n", "WARC/1.1\r\n", "\x00", " "]
    rows = [(i, f"http://h{i % 7}.example/{i}", "".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(1000 - i, "u", "same page " * 50) for i in range(60)] + [(5, "u", None), (6, None, ""), (7, "a b\r\nc", ""), (None, "u", "lone"), (None, "u", "lone"), (3, "u", "lone")]
    return [*rows, *rows[:30], (9, "u", None), (9, "u", None), (8, "u", "x" * 3_000_000)]


def test_round_trip(spark):
    for least in (0, 40):
        rows = pages(least)
        df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(1)
        got = warc.archive_and_read(df, archive_bytes=20_000, least=least)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least)


def test_archives(spark, tmp_path):
    rows = [(i, f"http://e.example/{i}", f"<html><title>Title {i % 9}</title>" + "<p>common line of every page</p>" * 20 + f"{i}</html>") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path), archive_bytes=60_000).collect()
    assert sum(m.n_records for m in manifest) == 400 and len(manifest) > 3
    for m in manifest:
        data = open(m.archive, "rb").read()
        assert len(data) == m.n_bytes and (m.dictionary_bytes > 0 or m.n_records < 40)
        if m.dictionary_bytes:
            magic, size = struct.unpack("<II", data[:8])
            assert magic == 0x184D2A5D and size == m.dictionary_bytes
            words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
            first = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and first.unused_data
    back = warc.read_archives(spark.createDataFrame(manifest), str(tmp_path)).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in back} == set(rows)


def test_dictionary_saves_bytes():
    records = [warc.record(i, f"http://e.example/{i}", b"<p>a line that all pages share</p>" * 3, 102, "D", f"<urn:page:{i}:D>", None, warc.DATE) for i in range(2000)]
    out = io.BytesIO()
    words = warc.write_archive(out, records)
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert words and len(out.getvalue()) < 0.5 * sum(len(plain.compress(r)) for r in records)
    assert [b for _, b in warc.read_archive(io.BytesIO(out.getvalue()))][7].endswith(b"share</p>")
    few = io.BytesIO()
    assert warc.write_archive(few, records[:2]) == 0 and len(list(warc.read_archive(io.BytesIO(few.getvalue())))) == 2


def test_lost_task_leaves_nothing(spark, tmp_path):
    """A file that the manifest does not name is never read."""
    df = spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path))
    fs.LocalFileSystem().copy_file(manifest.first().archive, f"{tmp_path}/archives/left.warc.zst")
    assert warc.read_archives(manifest, str(tmp_path)).count() == 1


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
