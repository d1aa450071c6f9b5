"""Legacy ARC archives to WARC: version-specific headers, declared lengths, identifiers, dates, types, digests, revisits."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.base import col, query, table
from panelforge.session import scratch_path

#: The field names that the two versions of the format declare.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PER_ARCHIVE = 200
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "page_id long, uri string, date string, type string, payload binary, bytes long, sha1 string, sha256 string"


def word(text: str) -> str:
    """A text as one field of a header line: white space and controls as percent codes, nothing as a minus."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text) or "-"


def legacy_record(version: int, page: int | None, url: str, payload: bytes, offset: int, archive: str) -> bytes:
    """An ARC record: header line, HTTP answer, line end. The page's id is in the answer's headers."""
    seconds = (page or 0) % 86400
    date = f"20000101{seconds // 3600:02d}{seconds // 60 % 60:02d}{seconds % 60:02d}"
    page_line = f"X-Page-Id: {page}\r\n" if page is not None else ""
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page_line}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    if version == 1:
        head = f"{word(url)} 0.0.0.0 {date} text/html {len(answer)}"
    else:
        head = f"{word(url)} 0.0.0.0 {date} text/html 200 {hashlib.md5(answer).hexdigest()} - {offset} {archive} {len(answer)}"
    return head.encode() + b"\n" + answer + b"\n"


def legacy(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as ARC archives (name, content), up to 200 pages each, the two versions in turn."""

    def run(batches):
        for batch in batches:
            ids, urls, texts = (batch.column(i).to_pylist() for i in range(3))
            for a in range(0, len(ids), PER_ARCHIVE):
                version = 1 + a // PER_ARCHIVE % 2
                name = f"pages-{zlib.crc32(repr((ids[a], urls[a])).encode()):08x}.arc"
                first = f"{version} 0 pages\n{FIELDS[version]}\n".encode()
                middle = "" if version == 1 else " 200 - - 0 " + name
                parts = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{middle} {len(first)}\n".encode() + first + b"\n"]
                size = len(parts[0])
                for i in range(a, min(a + PER_ARCHIVE, len(ids))):
                    parts.append(legacy_record(version, ids[i], urls[i] or "", texts[i] or b"", size, name))
                    size += len(parts[-1])
                yield pa.RecordBatch.from_pydict({"name": [name], "content": pa.array([b"".join(parts)], pa.binary())})

    rows = pages.select(col(id_).cast("long").alias("i"), col(url).alias("u"), col(html).cast("binary").alias("h"))
    return rows.mapInArrow(run, "name string, content binary")


def legacy_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of an ARC archive, by the fields that its version block declares."""

    def block(at: int, names: list[str] | None):
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8", "replace").split(" ")
        if names is not None and len(line) != len(names):
            raise ValueError(f"{len(line)} fields in an archive that declares {len(names)}")
        size = int(line[-1])
        body = content[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError("a record is shorter than it declares")
        return line, body, end + 1 + size + 1

    _, body, at = block(0, None)
    version, names = body.split(b"\n")[:2]
    if version.split(b" ")[0] not in (b"1", b"2"):
        raise ValueError(f"unknown version {version[:20]!r}")
    names = names.decode().split(" ")
    while at < len(content):
        line, body, at = block(at, names)
        yield dict(zip(names, line)), body


def converted(archives: DataFrame) -> DataFrame:
    """The records of ARC archives as the fields of WARC records.

    Dates become ISO ones; an HTTP answer becomes a ``response`` whose payload
    is what follows its headers, anything else a ``resource``; digests are of the payload.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, body in legacy_records(content.as_buffer().to_pybytes()):
                    page, payload, kind = None, body, "resource"
                    if body.startswith(b"HTTP/"):
                        head, _, payload = body.partition(b"\r\n\r\n")
                        kind = "response"
                        found = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
                        page = int(found[1]) if found else None
                    d = fields["Archive-date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((page, fields["URL"], date, kind, payload, len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).hexdigest()))
                names = [x.split()[0] for x in RECORD.split(", ")]
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.mapInArrow(run, RECORD)


def record_id(page: int | None, sha256: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page}/{sha256}')}>"


def written(records: DataFrame, keepers: DataFrame) -> str:
    """Write WARC files, and return their folder; ``keepers`` (sha256, keeper): the page whose record holds a payload.

    Spark's text writer makes one gzip file per task, in any store; a record
    ends with the line ends that separate records.
    """
    df = records.join(keepers.select(F.col("sha256").alias("_s"), "keeper"), F.col("sha256") == F.col("_s"), "left").drop("_s")
    df = df.withColumn("keeper", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")))

    def run(batches):
        for batch in batches:
            out = []
            for page, uri, date, kind, payload, size, sha1, sha256, keeper in zip(*(batch.column(i).to_pylist() for i in range(9))):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n" if kind == "response" else ""
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if keeper is not None else kind}", f"WARC-Record-ID: {record_id(page, sha256)}",
                    f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}",
                ]
                if page is not None:
                    lines.append(f"X-Page-Id: {page}")
                if keeper is not None:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                              f"WARC-Refers-To: {record_id(keeper, sha256)}", f"X-Refers-To-Page-Id: {keeper}"]
                    payload = b""
                block = head.encode() + payload
                lines += [f"Content-Type: {'application/http; msgtype=response' if head else 'text/html'}", f"Content-Length: {len(block)}"]
                out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block)
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    order = [x.split()[0] for x in RECORD.split(", ")]
    path = scratch_path(records.sparkSession, "warc")
    # Payloads are UTF-8, so a record is a string; the writer puts the separator after each.
    lines = df.select(*order, "keeper").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)
    return path


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, by declared length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it declares")
        yield fields, block
        at = end + 8 + size


def read(spark, path: str) -> DataFrame:
    """What WARC files say of each record; the digest of a kept payload is taken anew and must agree."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in warc_records(zlib.decompress(content.as_buffer(), 31)):
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} does not agree")
                    page, keeper = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), size, digest, fields["WARC-Type"], keeper and int(keeper), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string, date string")


def archived(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Pages through ARC archives into WARC files and back: one row per page.

    Of equal payloads of ``least`` bytes or more, the largest id is a
    response, the others revisit it and keep no payload; smaller ones are all
    responses. Payloads are grouped by SHA-256 of the whole page.

    A null page is empty; a null url is ``-``; white space in a url comes back
    as percent codes. Rows that repeat an id are separate records, and those
    with the largest id of their payload are all responses. Rows without an
    id are kept without one, as responses. No rows give none.
    """
    size = F.octet_length(col(html))
    long = pages.where(size >= least).groupBy(F.sha2(col(html).cast("binary"), 256).alias("sha256"))
    keepers = long.agg(F.max(col(id_).cast("long")).alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("sha256", "keeper")
    spark = pages.sparkSession
    return read(spark, written(converted(legacy(pages, id_, url, html)), keepers))


@query("op10_archives", sql="""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (h)""")
def op10_archives(spark, folder):
    """All pages."""
    got = archived(table(spark, folder, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
