"""WARC archives compressed record by record with a Zstandard dictionary of their own, and their reading back.

Each archive is one file: a skippable frame with the dictionary (built from the records of that archive), then one frame for each record.  Of equal payloads
one is stored as a response; the others are revisit records that refer to it.  Tasks write archives to a folder that all machines share and return one row
for each; the table of these rows (the manifest) says which archives count, so a file that a lost task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

# Payload bytes of an archive; it holds one record at least, however long that is.
ARCHIVE = 32 << 20
LEVEL = 3
DICTIONARY = 64 << 10
# The dictionary is built from records spread evenly over the archive, of at most this many times its size.
SAMPLES = 100
SLICE = 64 << 10
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n"
_PAGE = re.compile(r"<urn:page:(-?\d+)?:")
_BREAKS = re.compile(r"[\x00-\x20\x7f]")


def _fields(lines: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode()


def record(page_id, url, payload: bytes | None, size: int, digest: str, own: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to the record of the same payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + END
    block = http + payload if refers_to is None else http
    head = _fields([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url)), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", None if refers_to is None else PROFILE), ("WARC-Refers-To", refers_to), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return b"".join([VERSION.encode(), END, head, END, block, END, END])


def train(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most ``size`` bytes from records spread over the list; None where they are too few for one."""
    total = sum(map(len, records))
    step = -(-total // (SAMPLES * size))
    samples = [r[i : i + SLICE] for r in records[:: max(step, 1)] for i in range(0, len(r), SLICE)]
    size = min(size, total // 16)
    if size < 1024 or len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8, level=LEVEL)
    except zstandard.ZstdError:  # too little in common
        return None


def write_archive(out, records: list[bytes], level: int = LEVEL) -> int:
    """Write the records to a binary stream; returns the bytes of the embedded dictionary (0 without one)."""
    words = train(records)
    body = b""
    if words is not None:
        body = zstandard.ZstdCompressor(level=19).compress(words.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        words.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=words)
    for r in records:
        out.write(press.compress(r))
    return len(body)


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, one at a time; field names in lower case."""
    lead = stream.read(8)
    words = None
    if len(lead) == 8 and struct.unpack("<I", lead[:4])[0] == SKIPPABLE:
        body = stream.read(struct.unpack("<I", lead[4:])[0])
        if body[:4] == FRAME:
            body = zstandard.ZstdDecompressor().decompress(body)
        words, lead = zstandard.ZstdCompressionDict(body), b""

    class Rest(io.RawIOBase):
        first = lead

        def readable(self):
            return True

        def readinto(self, into):
            got = self.first or stream.read(len(into))
            got, self.first = got[: len(into)], self.first[len(into) :]
            into[: len(got)] = got
            return len(got)

    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(Rest(), read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if line.strip().decode() != VERSION:
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = dict(_headers(plain))
        block = plain.read(int(fields["content-length"]))
        if plain.read(4) != END + END:
            raise ValueError("a record does not end where its length says")
        yield fields, block


def _headers(lines) -> Iterator[tuple[str, str]]:
    while (line := lines.readline()) not in (END, b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        yield name.lower(), value


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE, least: int = 0, date: str = DATE) -> DataFrame:
    """Write a record for each page (page_id, url, html) and return the manifest: archive, n_records, n_bytes, dictionary_bytes.

    Payloads are the html in UTF-8, null as empty.  Of equal payloads of at least ``least`` bytes the row of the smallest page_id is the response (null ids
    last, then the first row) and all others, repeated rows too, revisit it; smaller payloads are all responses.  Other columns are ignored; an empty table
    gives no archive.  ``folder`` is a path or address that every machine reaches.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit("")).cast("binary")
    # Row numbers decide between rows of one page_id, so they are written before they are used.
    (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "row": F.monotonically_increasing_id()}).write.option("compression", "zstd").parquet(f"{folder}/rows"))
    rows = spark.read.parquet(f"{folder}/rows")
    lead = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("f"))
    lead = lead.where("n > 1").select("digest", F.col("f.page_id").alias("lead_id"), F.col("f.row").alias("lead_row"))

    def run(batches):
        place, at = _place(folder)
        at = f"{at}/archives"
        place.create_dir(at, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush():
            path = f"{at}/{uuid.uuid4().hex}.warc.zst"
            info = _fields([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", 0)])
            with place.open_output_stream(path, compression=None) as out:
                words = write_archive(out, [b"".join([VERSION.encode(), END, info, END, END, END]), *held])
                n = out.tell()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)]), pa.array([n]), pa.array([words])], ["archive", "n_records", "n_bytes", "dictionary_bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, body, hexed, n, row, lead_id, lead_row = (c[i].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                name = lambda x: "" if x is None else x
                again = lead_row is not None and row != lead_row
                # The record that others refer to has a name they can tell from its page and payload.
                own = f"<urn:page:{name(page_id)}:{digest}>" if lead_row == row else f"<urn:page:{name(page_id)}:{digest}:{row}>"
                held.append(record(page_id, url, body, n, digest, own, f"<urn:page:{name(lead_id)}:{digest}>" if again else None, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    joined = rows.join(lead, "digest", "left").select("page_id", "url", "payload", "digest", "size", "row", "lead_id", "lead_row")
    joined.mapInArrow(run, "archive string, n_records long, n_bytes long, dictionary_bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record; a revisit has no payload.

    A response whose payload does not have the length and digest of its header fails the job.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def rows(path, place):
        with place.open_input_stream(path, compression=None) as stream:
            for fields, block in read_archive(stream):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                body = io.BytesIO(block)
                body.readline()
                http = dict(_headers(body))
                size, digest, payload = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
                if kind == "response":
                    payload = body.read()
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: {fields['warc-record-id']} does not hold the payload of its header")
                lead = _PAGE.match(fields["warc-refers-to"])[1] if kind == "revisit" else None
                own = fields.get("warc-page-id")
                yield None if own is None else int(own), fields.get("warc-target-uri"), size, digest, kind, None if lead is None else int(lead), payload

    def run(batches):
        place, _ = _place(folder)
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, size = [], 0
                for r in rows(path, place):
                    held.append(r)
                    size += 200 + len(r[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(parts).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, archive_bytes: int = ARCHIVE, least: int = 0) -> DataFrame:
    """Archive all pages in the shared folder and return what the archives say of each: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, archive_bytes, least), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
