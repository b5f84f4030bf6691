"""Operator 2: WARC archives with revisits resolved by payload digest.

`write_archive` writes one response record a row, `read_archive` reads any such
folder back, `resolve` decides from headers alone which records repeat an
earlier payload, and `deduplicate` writes archives anew, with fresh record ids:
records that repeat a payload become revisit records, which have the HTTP header
of their own and the new id, URI and date of the original under WARC-Refers-To,
but no payload.

A record is a gzip member of its own (several, if it has more than MEMBER bytes).
Files are written by Spark's text writer, so a lost executor's files never come
to be part of a folder, and any file system that Spark knows will do. The writer
ends each row by a zero byte, which is the last byte of every member of less than
16 MB (the highest of its length): rows are members without it. A row holds
about ROW_BYTES of members and a file at most FILE_ROWS rows, so files are
bounded by bytes, whatever records are like.

Only headers are shuffled, by digest; payloads never are. Their counts and least
ids are partial sums; the join back to headers is left to adaptive skew
handling. Files are rewritten where they are read: what is to become of their
records is sent to all tasks, for so many files at a time that it has WAVE_BYTES
at most.

Edge cases: a null payload is an empty one; payloads below MIN_BYTES are all
responses; of equal payloads the smallest id is the response (a null id is
last); repeated ids are records of their own; line ends in a URI are left out; an
empty table writes an archive without records; payloads may hold any bytes,
CRLFs and WARC headers included, as they are read by Content-Length; extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.store import bounded_batches, drop, keep, table, tidy
from tidewater.session import fresh_path

MIN_BYTES = 100
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a member at most (before it is compressed), of a row about, rows of a file, and bytes of decisions sent at a time.
MEMBER, ROW_BYTES, FILE_ROWS, WAVE_BYTES = 8 << 20, 1 << 20, 16, 32 << 20


def http_header(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of WARC 1.1."""
    lines = [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """data as gzip members, at the fastest level: archives of raw pages are read about as often as written."""
    for lo in range(0, len(data), MEMBER):
        gz = zlib.compressobj(1, zlib.DEFLATED, 31)
        yield gz.compress(data[lo : lo + MEMBER]) + gz.flush()


class Rows:
    """Members gathered to rows of the text writer."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        for x in members(data):
            self.held.append(x)
            self.size += len(x)
        if self.size >= ROW_BYTES:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            # the writer adds the last byte, a zero
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(self.held)[:-1]], pa.binary())], names=["value"])
            self.held, self.size = [], 0


def _write(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.select(F.col("value").cast("string").alias("value")).write.mode(mode).option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", FILE_ROWS).text(path)


def record_id(page: int | None, *more: str) -> str:
    """A URI of a page's record; more tells archives and places apart."""
    return "<urn:page:" + ("" if page is None else str(page)) + "".join(":" + x for x in more) + ">"


def fresh_id(page: int | None, path: str, place: int) -> str:
    """The id in the archive written anew of what was record number place of file path: the same whenever it is asked for."""
    return record_id(page, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{place}")))


def write_archive(pages: DataFrame, path: str, page: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """One response record a row of pages."""

    def run(batches):
        rows = Rows()
        for batch in batches:
            for i, u, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                body = body or b""
                # line ends inside a URI would end the header
                uri_ = re.sub(r"[\r\n]+", "", u or "")
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(i)), ("WARC-Target-URI", uri_), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())]
                yield from rows.add(record(fields, http_header(len(body)) + body))
        yield from rows.out()

    bounded_batches(pages.sparkSession)
    own = pages.select(F.col(f"`{page}`").cast("long"), F.col(f"`{uri}`").cast("string"), F.col(f"`{payload}`").cast("binary"))
    _write(own.mapInArrow(tidy(run), "value binary"), path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Records of one decompressed file: header fields (names in lower case), HTTP header and payload."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        head, _, body = block.partition(b"\r\n\r\n")
        yield fields, head, body


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)(:.*)?>", name or "")
    return int(found[1]) if found else None


HEADERS = "path string, place int, page_id long, kind string, uri string, date string, payload_bytes long, payload_digest string, refers_to long"
_ARROW = pa.schema([("path", pa.string()), ("place", pa.int32()), ("page_id", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: file, place in it, header fields, and length and digest of the payload.

    Of a response they are computed from the payload read; of a revisit they
    are what its header says of the payload that it stands for.
    """
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                    for place, (f, head, body) in enumerate(parse(stream)):
                        revisit = f["warc-type"] == "revisit"
                        told = f.get("warc-payload-digest", "").removeprefix("sha256:")
                        size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", head)[1]) if revisit else len(body)
                        digest = told if revisit else hashlib.sha256(body).hexdigest()
                        if digest != told:
                            raise ValueError(f"payload of {f['warc-record-id']} is not what its digest says")
                        rows.append((name.as_py(), place, _page(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri", ""), f["warc-date"], size, digest, _page(f.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)] if rows else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)

    return _files(spark, path).mapInArrow(tidy(run), HEADERS)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def resolve(headers: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """headers with original (path, place, page_id, uri, date of the response it repeats), null for responses."""
    row = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "place", "uri", "date")
    groups = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(row).alias("original"))
    groups = groups.filter("n > 1").select("payload_digest", "original")
    found = headers.join(groups, "payload_digest", "left")
    own = (F.col("original.path") == F.col("path")) & (F.col("original.place") == F.col("place"))
    return found.withColumn("original", F.when(~own & (F.col("payload_bytes") >= least), F.col("original")))


def deduplicate(spark: SparkSession, path: str, resolved: DataFrame, to: str) -> None:
    """Write the archive at path anew to `to`, repeated payloads as revisit records."""
    revisits = resolved.filter("original is not null").select("path", "place", F.col("original.page_id").alias("page"), F.col("original.path").alias("at"), F.col("original.place").alias("nth"), F.col("original.uri").alias("uri"), F.col("original.date").alias("date"))
    revisits = keep(revisits, "warc-revisits")
    size = revisits.agg(F.sum(F.length("path") + F.length("at") + F.length("uri") + 64)).first()[0] or 0
    waves = -(-size // WAVE_BYTES) or 1
    wave = F.pmod(F.xxhash64("path"), F.lit(waves))
    bounded_batches(spark)
    for n in range(waves):
        # a folder's files are listed by the driver in any case
        own = path if waves == 1 else [r.path for r in resolved.filter(wave == n).select("path").distinct().collect()]
        if not own:
            continue
        known: dict[str, dict[int, tuple]] = {}
        for r in revisits.filter(wave == n).toArrow().to_pylist():
            known.setdefault(r["path"], {})[r["place"]] = (fresh_id(r["page"], r["at"], r["nth"]), r["uri"], r["date"])
        sent = spark.sparkContext.broadcast(known)

        def run(batches, sent=sent):
            rows = Rows()
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    name = name.as_py()
                    own = sent.value.get(name, {})
                    with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                        for place, (f, head, body) in enumerate(parse(stream)):
                            fields = [("WARC-Type", "response"), ("WARC-Record-ID", fresh_id(_page(f["warc-record-id"]), name, place)), ("WARC-Target-URI", f.get("warc-target-uri", "")), ("WARC-Date", f["warc-date"]), ("WARC-Payload-Digest", f["warc-payload-digest"])]
                            if place in own:
                                original, uri, date = own[place]
                                fields[0] = ("WARC-Type", "revisit")
                                fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", original), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
                                body = b""
                            yield from rows.add(record(fields, head + b"\r\n\r\n" + body))
            yield from rows.out()

        _write(_files(spark, own).mapInArrow(tidy(run), "value binary"), to, "append")
        sent.destroy()
    drop(revisits)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to archives, archives to deduplicated archives, and what those say of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first, second = fresh_path(spark, "warc"), fresh_path(spark, "warc-deduplicated")
    write_archive(pages, first)
    headers = keep(read_archive(spark, first), "warc-headers")
    resolved = keep(resolve(headers), "warc-resolved")
    deduplicate(spark, first, resolved, second)
    drop(headers, resolved)
    return read_archive(spark, second).select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLE_SQL = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to FROM o
"""
}
