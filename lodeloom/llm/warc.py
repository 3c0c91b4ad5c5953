"""Legacy archives (ARC 1 and 2) and their conversion to WARC 1.1.

Archives are gzipped text files written by Spark, so they may lie in any store
that Spark reaches: a record is one text row, and the line separator is the
record separator of the format (``\\n`` in ARC, two CRLF in WARC). Readers get
whole files as binary rows, unpack them as a stream and follow the declared
lengths, never the separators. A conversion moves the packed files and a few
numbers of each record between machines, but no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import meet
from .store import Scratch

CRLF = b"\r\n"
#: The field names of each ARC version's record line.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length",
    ],
}
#: Rows, and bytes of their payloads, that a reader hands on at once.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
CAPTURED = "20200101000000"
#: How archives are packed: time counts more than the last bytes.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def sha1_32(x: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def http_block(page_id: int | None, body: bytes) -> bytes:
    """An HTTP response with the page's id in a header."""
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode() + body


def _url(url: str | None) -> str:
    """A URL without white space or control characters (a null one: ``unknown:``)."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "unknown:"


def arc_line(version: int, url: str, ip: str, date: str, mime: str, block: bytes, offset: int, name: str) -> str:
    first = [url, ip, date, mime]
    return " ".join(first + (["200", sha1_32(block), "-", str(offset), name] if version == 2 else []) + [str(len(block))])


def _write_arc(date: str):
    """Text rows of an ARC file for each task: its version block, then a record for each page.

    Odd and even tasks write different versions, so both are always read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        version = 1 + part % 2
        name = f"part-{part}.arc"
        fields = f"{version} 0 lodeloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
        head = arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", fields, 0, name)
        offset, begun = len(head) + len(fields) + 2, False
        for batch in batches:
            rows = []
            if not begun and batch.num_rows:
                rows.append(f"{head}\n{fields.decode()}".encode())
                begun = True
            bodies = batch.column("html").cast(pa.binary()).to_pylist()
            for page, url, body in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), bodies, strict=True):
                block = http_block(page, body or b"")
                row = arc_line(version, _url(url), "0.0.0.0", date, "text/html", block, offset, name).encode() + b"\n" + block
                offset += len(row) + 1
                rows.append(row)
            yield _as_text(pa.array(rows, pa.binary()))

    return run


def write_arc(pages: DataFrame, root: str, date: str = CAPTURED) -> None:
    """Write ``pages(page_id, url, html)`` as ARC files; a null html is an empty one."""
    rows = pages.select("page_id", "url", "html").mapInArrow(_write_arc(date), "value string")
    rows.write.mode("overwrite").options(lineSep="\n", **PACKED).text(root)


def _take(stream: io.BufferedIOBase, n: int) -> bytes:
    got = stream.read(n)
    if len(got) != n:
        raise ValueError("an archive ends within a record")
    return got


def _unzip(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of one ARC file, by the field names that its version block declares."""
    stream = _unzip(content)
    fields, offset = None, 0
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            offset += len(line)
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        block = _take(stream, int(parts[-1]))
        if fields is None:
            lines = block.decode("ascii", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            fields = lines[1].split(" ") if len(lines) > 1 and lines[1] else ARC_FIELDS[version]
            names = fields if len(fields) == len(parts) else ARC_FIELDS[version]
        else:
            names = fields
            version = 2 if len(fields) > 5 else 1
        # A URL may hold spaces in old files: the other fields are counted from the end.
        extra = len(parts) - len(names)
        values = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        yield dict(zip(names, values, strict=True)) | {"offset": offset, "version": version, "block": block}
        offset += len(line) + len(block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header part (with its blank line) and body of an HTTP response."""
    at = block.find(CRLF + CRLF)
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def _header(head: bytes, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


RECORD = "file string, offset long, page_id long, url string, captured string, mime string, head binary, payload binary"


def _batches(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and bytes; the last column is the large one."""
    some, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, (_, k) in zip(zip(*some, strict=True), schema, strict=True)], names=[n for n, _ in schema]
        )

    for row in rows:
        some.append(row)
        size += len(row[-1] or b"") if isinstance(row[-1], bytes) else 0
        if len(some) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield made()
            some, size = [], 0
    if some:
        yield made()


def _as_text(rows: pa.Array) -> pa.RecordBatch:
    """Bytes as text for Spark's writer, which passes them on whatever their encoding is."""
    return pa.RecordBatch.from_arrays([rows.view(pa.string())], names=["value"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield path.as_py(), content.as_py()


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for path, content in _files(batches):
        for r in parse_arc(content):
            if not r["URL"].startswith("filedesc:"):
                head, payload = split_http(r["block"])
                page = _header(head, "X-Page-Id")
                yield path, r["offset"], int(page) if page else None, r["URL"], r["Archive-date"], r["Content-type"], head, payload


def _read_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()),
             ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary())]
    yield from _batches(_arc_rows(batches), kinds)


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()),
             ("digest", pa.string()), ("n", pa.int64())]
    yield from _batches(((*r[:5], sha1_32(r[7]), len(r[7])) for r in _arc_rows(batches)), kinds)


def _arc_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root).select("path", "content")


def read_arc(spark: SparkSession, root: str) -> DataFrame:
    """Records of the ARC files under ``root``: ``file, offset, page_id, url, captured, mime, head, payload``."""
    return _arc_files(spark, root).mapInArrow(_read_arc, RECORD)


def iso_date(date: str) -> str:
    """WARC-Date of a 14-digit (or shorter) ARC date."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int, url: str, date: str) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {file.rsplit("/", 1)[-1]} {offset}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block


def _convert_file(path: str, content: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    """The WARC records of one ARC file: its warcinfo, then one for each record. ``revisits``: by offset, the record each refers to."""
    begun = False
    for r in parse_arc(content):
        url, date = r["URL"], r["Archive-date"]
        if not begun:
            own = [("WARC-Date", iso_date(date)), ("WARC-Record-ID", record_id(path, -1, "warcinfo", date)), ("Content-Type", "application/warc-fields")]
            yield warc_record("warcinfo", own, b"software: lodeloom\r\nformat: WARC File Format 1.1\r\n")
            begun = True
        if url.startswith("filedesc:"):
            continue
        head, payload = split_http(r["block"])
        to = revisits.get(r["offset"])
        fields = [
            ("WARC-Record-ID", record_id(path, r["offset"], url, date)),
            ("WARC-Target-URI", url),
            ("WARC-Date", iso_date(date)),
            ("WARC-Payload-Digest", f"sha1:{sha1_32(payload)}"),
            ("Content-Type", "application/http; msgtype=response" if head else r["Content-type"]),
        ]
        page = _header(head, "X-Page-Id")
        if page:
            fields.append(("X-Page-Id", page))
        block = r["block"]
        if to is not None:
            block = head
            fields += [
                ("WARC-Refers-To", record_id(to["file"], to["offset"], to["url"], to["captured"])),
                ("WARC-Refers-To-Target-URI", to["url"]),
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("X-Payload-Length", str(len(payload))),
            ]
            if to["page_id"] is not None:
                fields.append(("X-Refers-To-Page-Id", str(to["page_id"])))
        fields.append(("WARC-Block-Digest", f"sha1:{sha1_32(block)}"))
        yield warc_record("revisit" if to is not None else "response" if head else "resource", fields, block)


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records, as text, of the ARC files ``path, content, revisits``."""
    for batch in batches:
        for path, content, revisits in zip(*(batch.column(c) for c in ("path", "content", "revisits")), strict=True):
            known = {x["at"]: x["to"] for x in revisits.as_py() or []}
            records = ((x,) for x in _convert_file(path.as_py(), content.as_py(), known))
            for some in _batches(records, [("value", pa.binary())]):
                yield _as_text(some.column("value"))


def convert(spark: SparkSession, arcs: str, warcs: str, scratch: Scratch, min_bytes: int = 0) -> None:
    """Convert the ARC files under ``arcs`` to WARC files under ``warcs``.

    Of records with equal payloads of at least ``min_bytes``, the one with the
    largest page_id (then place) stays a response and the others become
    revisits of it. Files are parsed twice: first for digests, of which those
    that occur often are settled, then, packed as they are, beside the list of
    their own revisits. Such a list is no longer than its file.
    """
    small = scratch.keep(
        _arc_files(spark, arcs).mapInArrow(
            _read_digests, "file string, offset long, page_id long, url string, captured string, digest string, n long"
        ),
        "digests",
    )
    place = F.struct("page_id", "file", "offset", "url", "captured")
    long_ones = small.filter(F.col("n") >= min_bytes)
    best = long_ones.groupBy("digest").agg(F.max(place).alias("to"), F.count("*").alias("copies")).filter("copies > 1")
    best = scratch.keep(best, "best")
    told = meet(long_ones, best, ["digest"], small.count(), "copies").filter((F.col("to.file") != F.col("file")) | (F.col("to.offset") != F.col("offset")))
    revisits = told.groupBy("file").agg(F.collect_list(F.struct(F.col("offset").alias("at"), "to")).alias("revisits"))
    files = _arc_files(spark, arcs).join(revisits.withColumnRenamed("file", "path"), "path", "left")
    files.mapInArrow(_to_warc, "value string").write.mode("overwrite").options(lineSep="\r\n\r\n", **PACKED).text(warcs)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of one WARC file."""
    stream = _unzip(content)
    while line := stream.readline():
        if line == CRLF:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {}
        while (line := stream.readline()) not in (CRLF, b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, _take(stream, int(fields["content-length"]))


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, content in _files(batches):
            for fields, block in parse_warc(content):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                if fields["warc-block-digest"] != f"sha1:{sha1_32(block)}":
                    raise ValueError("a block does not match its digest")
                named = fields["warc-payload-digest"].removeprefix("sha1:")
                page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                payload = None
                n = int(fields.get("x-payload-length", 0))
                if kind != "revisit":
                    _, payload = split_http(block)
                    n = len(payload)
                    if sha1_32(payload) != named:
                        raise ValueError("a payload does not match its digest")
                yield (int(page) if page else None, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], n, named,
                       kind, int(to) if to else None, payload)

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    yield from _batches(rows(), kinds)


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """Records of the WARC files under ``root``; block and payload digests are checked, a revisit's payload is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(root).select("path", "content")
    return files.mapInArrow(
        _read_warc,
        "page_id long, url string, date string, record_id string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary",
    )


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ARC, convert to WARC and read that back.

    A record per page, repeated rows included: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``. A null html is an empty payload,
    a null url the URL ``unknown:``, a null page_id the smallest. Other columns
    are ignored. Empty table: no rows.
    """
    scratch = Scratch(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    arcs, warcs = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arcs)
    convert(spark, arcs, warcs, scratch, min_bytes)
    scratch.drop("arc", "digests", "best")
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
