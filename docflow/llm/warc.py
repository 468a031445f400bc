"""WARC archives: written through Spark, and read back in splits that find their own records.

Archives are files of gzip members, one record each.  A reader task scans a byte range for the gzip magic, takes a
place for the start of a record only if what inflates from there begins with a WARC header, and owns every record that
starts inside its range, wherever it ends.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docflow.llm.common import shared_path

SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_BLANK = b"\r\n\r\n"
#: Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = "none"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _urn(ident: int | None) -> str:
    return f"<urn:page:{_NO_ID if ident is None else ident}>"


def _record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, own_digest: str) -> bytes:
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(ident),
        "WARC-Date": datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or ""),
        "WARC-Payload-Digest": f"sha1:{own_digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": _PROFILE}
    block = b"" if revisit else payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    raw = f"WARC/1.1\r\n{lines}Content-Type: text/html\r\nContent-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + _BLANK
    member = gzip.compress(raw, 6, mtime=0)
    # The writer ends every row with one zero byte, which is the last byte of a member unless the record is large.
    if member[-1]:
        member += gzip.compress(b"", mtime=0)
    return member[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for ident, url, html, refers, own in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            out.append(_record(ident.as_py(), url.as_py(), payload, refers.as_py(), own.as_py()))
            size += len(out[-1])
            if size > READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


@F.arrow_udf(StringType())
def _payload_digest(html: pa.Array) -> pa.Array:
    return pa.array([digest((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in html], pa.string())


def write(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row to archives in a folder.

    Of records with equal payloads of at least `least_bytes` bytes, the one with the largest id is a response, the
    others are revisits of it.  Rows that repeat the largest id are all responses; rows without an id are responses,
    unless an equal payload has an id.  A null payload is an empty one.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("own", _payload_digest("html"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    heads = rows.where(long).groupBy("own").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    # Only revisits have to learn their head; the payloads themselves are not shuffled.
    revisits = (
        rows.where(long).select("page_id", "own").join(heads, "own").where(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull())
    )
    refers = revisits.select(F.col("page_id").alias("of"), F.col("own").alias("digest"), F.col("head").alias("refers_to")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("digest"))
    linked = rows.join(refers, same, "left").select("page_id", "url", "html", "refers_to", "own")
    members = linked.mapInArrow(_members, "member binary")
    # Rows are members less their last byte, which is zero; the line separator puts it back, so files are plain gzip.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(folder)


class _Source:
    """Bytes of a file from a place on, read as needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, b""

    def upto(self, end: int) -> bool:
        """Hold the bytes before `end`; False if the file ends sooner."""
        while self.start + len(self.data) < min(end, self.size):
            more = self.file.read_at(min(READ_BYTES, self.size - self.start - len(self.data)), self.start + len(self.data))
            self.data += more
        return end <= self.size

    def drop(self, before: int) -> None:
        if before - self.start > READ_BYTES:
            self.data = self.data[before - self.start :]
            self.start = before


def _inflated(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record that starts at a place and where its member ends, or None if none does."""
    inflate = zlib.decompressobj(31)
    out, place, header = [], at, b""
    try:
        while not inflate.eof:
            source.upto(place + 65536)
            piece = source.data[place - source.start : place - source.start + 65536]
            if not piece:
                return None
            out.append(inflate.decompress(piece))
            place += len(piece)
            if len(header) < len(_VERSION):
                header = (header + out[-1])[: len(_VERSION)]
                if header != _VERSION[: len(header)]:
                    return None
        return (b"".join(out), place - len(inflate.unused_data)) if header == _VERSION else None
    except zlib.error:
        return None


def records(file, size: int, first: int, after: int) -> Iterator[tuple[int, bytes]]:
    """Records whose members start in [first, after) of a file, and where."""
    source, place = _Source(file, size, first), first
    while place < after:
        source.drop(place)
        source.upto(min(after, place + READ_BYTES) + len(_MAGIC) - 1)
        found = source.data.find(_MAGIC, place - source.start)
        if found < 0:
            place = max(place + 1, source.start + len(source.data) - len(_MAGIC) + 1)
            if source.start + len(source.data) >= size:
                return
            continue
        place = source.start + found
        if place >= after:
            return
        got = _inflated(source, place)
        if got:
            yield place, got[0]
        place = got[1] if got else place + 1


def parse(record: bytes) -> dict:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = record.partition(_BLANK)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    out = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, v in fields.items()}
    return out | {"block": rest[: int(out.get("content-length", 0))]}


_READ = "path string, at long, type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    for batch in batches:
        for path, size, first, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, inner = pa.fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_file(inner) as file:
                for at, raw in records(file, size, first, after):
                    r = parse(raw)
                    rows.append(
                        (path, at, r.get("warc-type"), r.get("warc-record-id"), r.get("warc-refers-to"), r.get("warc-target-uri"),
                         r.get("warc-payload-digest", "").removeprefix("sha1:"), int(r.get("x-payload-length", len(r["block"]))), r["block"])
                    )
                    held += len(r["block"])
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives in a folder, each read by the task in whose byte range it starts.

    Bytes that are no WARC record (other members, padding, a broken member) are passed over.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = files.select("path", "length", starts.alias("first"))
    splits = splits.withColumn("after", F.least(F.col("first") + split_bytes, F.col("length")))
    dealt = splits.repartition(F.col("path"), F.col("first"))
    return dealt.mapInArrow(_scan, _READ)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive all pages in the shared folder and read the archives back.

    page_id, payload_bytes, payload_digest (of the full payload, checked against what a response holds), record_type
    and refers_to (null for responses).
    """
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, least_bytes)
    found = read(pages.sparkSession, folder)
    ident = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    is_response = F.col("type") == "response"
    sound = ~is_response | (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is not as long as written")))
    return found.select(
        ident("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(~is_response, ident("refers_to")).alias("refers_to"),
    )
