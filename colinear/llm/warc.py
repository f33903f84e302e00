"""WARC archives: written, normalised member by member, indexed and read back.

1. ``write_archives`` writes one ``response`` record per row into monolithic
   ``.warc.gz`` files (one gzip stream for a whole file, as crawlers that pipe
   through gzip leave them), each of a bounded size. No payload is shuffled.
2. ``normalise`` inflates each such file once, as a stream, and writes every
   record again as a gzip member of its own, with a sidecar index of offsets.
   Records whose payload is already held by another record become ``revisit``
   records; which ones is decided beforehand on digests alone.
3. ``read_records`` reads the sidecars, and single members by the offsets there.
   What a record revisits is what its headers say.

Files live in the folder that the cluster shares and are written through
``pyarrow.fs``, so any file system with a URI serves. Each attempt of a task
writes files of its own name; the rows that the surviving attempt returns name
its files, so a lost executor leaves at most files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colinear.session import partitions, scratch, stored, table

#: Uncompressed bytes after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Bytes inflated at a time.
STEP = 1 << 16
#: zlib levels: the monolithic stream is read once only.
FAST, GOOD = 1, 6
GZIP = 31
CRLF = b"\r\n"
#: Records that are read at a time.
READ_ROWS = 256
#: A fixed date: reruns agree.
DATE = "2000-01-01T00:00:00Z"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record_id(file: str, place: int) -> str:
    return f"urn:record:{file[:32]}:{place}"


def clean_uri(text: str) -> str:
    """A url as it may stand in a header: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def response(record_id: str, url: str, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {clean_uri(url)}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + CRLF + CRLF


def revisit(headers: dict[str, str], block: bytes, refers_to: str) -> bytes:
    """The record's revisit form: its HTTP headers, without the payload."""
    http = block[: block.index(CRLF + CRLF) + 4]
    head = (
        f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: {headers['WARC-Record-ID']}\r\nWARC-Date: {headers['WARC-Date']}\r\nWARC-Target-URI: {headers['WARC-Target-URI']}\r\n"
        f"WARC-Payload-Digest: {headers['WARC-Payload-Digest']}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{refers_to}>\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    )
    return head.encode() + http + CRLF + CRLF


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


class Records:
    """Splits a stream of inflated bytes into (headers, block, raw record)."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        self.held += data
        while (end := self.held.find(CRLF + CRLF)) >= 0:
            headers = parse_headers(bytes(self.held[:end]))
            body = end + 4
            size = int(headers["Content-Length"])
            if len(self.held) < body + size + 4:
                return
            yield headers, bytes(self.held[body : body + size]), bytes(self.held[: body + size + 4])
            del self.held[: body + size + 4]


def inflate(f) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, step by step."""
    z = zlib.decompressobj(GZIP)
    while data := f.read(STEP):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(GZIP)
    yield z.flush()


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GOOD, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


WRITTEN = "file string, place long, id {id}, payload_bytes long, digest string"


def write_archives(rows: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a response record per row and returns ``file, place, id, payload_bytes, digest`` (place: from 0 in its file).

    Null payloads and urls count as empty. Every row gets a record of its own, rows with equal or null ids too.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        name, out, z, size = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.write(z.flush())
                out.close()

        for b in batches:
            got: list[list] = [[], [], [], []]
            for u, h in zip(b.column("url"), b.column("html"), strict=True):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name, place, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(FAST, zlib.DEFLATED, GZIP)
                payload = (h.as_py() or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                record = response(record_id(name, place), u.as_py() or "", payload, digest)
                out.write(z.compress(record))
                for c, v in zip(got, (name, place, len(payload), digest), strict=True):
                    c.append(v)
                place, size = place + 1, size + len(record)
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.string()), pa.array(got[1], pa.int64()), b.column("id"), pa.array(got[2], pa.int64()), pa.array(got[3], pa.string())], ["file", "place", "id", "payload_bytes", "digest"])
        close()

    return rows.mapInArrow(run, WRITTEN.format(id=kind))


def decide_revisits(written: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``to``: the record (struct file, place, id) that a record revisits, else null.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest id is the response (null ids are smallest, equal ids tie by file and
    place). Digests are aggregated before they meet the records, so a payload that
    a third of all rows share is one row there.
    """
    found = F.struct("id", "file", "place")
    keep = written.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(found).alias("keep")).where("n > 1").select("digest", "keep")
    both = written.join(keep, "digest", "left")
    revisits = F.col("keep").isNotNull() & (F.col("payload_bytes") >= least) & ~((F.col("keep.file") == F.col("file")) & (F.col("keep.place") == F.col("place")))
    return both.withColumn("to", F.when(revisits, F.col("keep"))).drop("keep")


def by_file(rows: DataFrame) -> DataFrame:
    """Rows dealt by ``file`` over enough partitions that each has few files. (Rows are small and files are not, so Spark must not merge them by size.)"""
    spark = rows.sparkSession
    files = rows.select("file").distinct().count()
    return rows.repartition(max(1, min(3 * files, 20 * max(partitions(spark), spark.sparkContext.defaultParallelism))), "file")


def normalise(decided: DataFrame, folder: str) -> DataFrame:
    """Rewrites every archive of ``decided`` with one gzip member per record and writes a ``.cdx`` sidecar beside it.

    Returns ``file, records`` of the new archives. A file's rows are bounded by
    ``ARCHIVE_BYTES``, so each task holds the plan of one file and one record at a time.
    """
    plan = decided.select("file", "place", "to.file", "to.place").toDF("file", "place", "to_file", "to_place")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("place")
        name = key[0].as_py()
        system, base = open_fs(folder)
        new = f"{name[:32]}-{uuid.uuid4().hex[:8]}.norm.warc.gz"
        targets = list(zip(rows.column("to_file").to_pylist(), rows.column("to_place").to_pylist(), strict=True))
        index, at, split = [], 0, Records()
        with system.open_input_stream(f"{base}/{name}", compression=None) as f, system.open_output_stream(f"{base}/{new}", compression=None) as out:
            for data in inflate(f):
                for headers, block, raw in split.feed(data):
                    to_file, to_place = targets[len(index)]
                    member = gzip_member(raw if to_file is None else revisit(headers, block, record_id(to_file, to_place)))
                    out.write(member)
                    index.append(f"{headers['WARC-Record-ID'][1:-1]} {at} {len(member)}\n")
                    at += len(member)
        if len(index) != len(targets):
            raise ValueError(f"{name}: {len(index)} records, {len(targets)} planned")
        with system.open_output_stream(f"{base}/{new}.cdx", compression=None) as out:
            out.write("".join(index).encode())
        yield pa.RecordBatch.from_arrays([pa.array([new], pa.string()), pa.array([len(index)], pa.int64())], ["file", "records"])

    return by_file(plan).groupBy("file").applyInArrow(run, "file string, records long")


READ = "record string, record_type string, payload_bytes long, payload_digest string, refers_to_record string"


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """Reads every record of normalised archives (``file``) by its sidecar: ``record, record_type, payload_bytes, payload_digest, refers_to_record``.

    Size and digest of a response are computed from the payload read; a revisit's are those of its headers.
    """
    names = [c.split()[0] for c in READ.split(", ")]

    def one(f: pa.NativeFile, name: str, record: str, offset: int, length: int) -> tuple:
        headers, block, _ = next(Records().feed(zlib.decompress(f.read_at(length, offset), GZIP)))
        if headers["WARC-Record-ID"] != f"<{record}>":
            raise ValueError(f"{name} at {offset}: another record than the sidecar says")
        cut_at = block.index(CRLF + CRLF) + 4
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response":
            payload = block[cut_at:]
            size, found = len(payload), hashlib.sha1(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{name} at {offset}: payload and digest differ")
        else:
            size = int(parse_headers(block[: cut_at - 4])["Content-Length"])
        return record, headers["WARC-Type"], size, digest, headers.get("WARC-Refers-To", "")[1:-1] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with system.open_input_stream(f"{base}/{name}.cdx", compression=None) as f:
                    index = f.read().decode().splitlines()
                with system.open_input_file(f"{base}/{name}") as f:
                    for a in range(0, len(index), READ_ROWS):
                        entries = (line.rsplit(" ", 2) for line in index[a : a + READ_ROWS])
                        got = list(zip(*(one(f, name, record, int(offset), int(length)) for record, offset, length in entries), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for c, n in zip(got, names, strict=True)], names)

    return by_file(files.select("file")).mapInArrow(run, READ)


def archive(rows: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Writes and normalises the archives of ``rows`` under ``folder``; returns the archives (file, records) and whose records they hold (record, id)."""
    written = stored(write_archives(rows, folder, id_col, url, html), "written")
    known = written.select(F.concat(F.lit("urn:record:"), F.substring("file", 1, 32), F.lit(":"), F.col("place").cast("string")).alias("record"), "id")
    return stored(normalise(decide_revisits(written), folder), "archives"), known


def read_back(archives: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """``id, payload_bytes, payload_digest, record_type, refers_to``: the records read, and whose they are, by record id.

    Spark would take the records for as few as the files that they are read from, and broadcast them: it is told to sort and merge.
    Responses, which refer to nothing, look for a name of their own that no record has, so that they don't meet under one null key.
    Empty archives give no rows; ids may be null or repeat, as each record stands for one row.
    """
    known = known.hint("merge")
    read = read_records(archives, folder).join(known, "record").withColumn("wanted", F.coalesce("refers_to_record", F.concat(F.lit("none:"), "record"))).hint("merge")
    target = known.select(F.col("record").alias("wanted"), F.col("id").alias("refers_to"))
    return read.join(target.hint("merge"), "wanted", "left").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_back(*archive(table(spark, sf_dir, "pages"), folder), folder).withColumnRenamed("id", "page_id")


ORACLE = {
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.n > 1 AND p.page_id <> g.keep AND p.payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND p.page_id <> g.keep AND p.payload_bytes >= 1000 THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
}
