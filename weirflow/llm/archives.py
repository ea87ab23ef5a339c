"""Legacy web archives: ARC files, versions 1 and 2, are written, parsed by their header lines and declared lengths, and
converted to WARC records with identifiers, timestamps, types and digests.

A record keeps what was archived: an HTTP response its status line and headers, byte for byte, whatever its status and type;
any other document becomes a resource of its declared type. Header lines that can't be parsed are counted and passed over.

Files are written and read by Spark, so they may lie in any store. A file that is written holds FILE_RECORDS records and
FILE_BYTES bytes at most, or one longer record; one that is read is taken by one task, unpacked piece by piece.
Payloads are bytes, of any encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import remove
from .common import arrow_schema, bounded_batches, discard, shared_path, utf8, written

#: Of a file that is written; its version block or warcinfo is a record.
FILE_RECORDS, FILE_BYTES = 2000, 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Groups of equal payloads up to which their digests (20 bytes) and ids (8) are broadcast: 6 MB. More are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Records of equal payloads from which their group is broadcast in any case: at most a HOT_ROWS-th as many as records.
HOT_ROWS = 10_000
OUT_BYTES = 8 << 20

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

ARC_ROWS = "page_id long, url string, ip string, date string, mime string, status int, arc_version int, head binary, payload binary, payload_bytes long, digest binary, file string, offset long, record_id string, problem string"
WARC_ROWS = "page_id long, url string, record_id string, date string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, status int, mime string"
#: A year to a second, all digits.
ARC_DATE = re.compile(r"\d{4}(?:\d\d){0,5}")
HEAD_END = re.compile(rb"\r?\n\r?\n")


class Stream:
    """Lines and counted bytes from a file that may be gzip, in one or many members."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.parts, self.buffer, self.offset = self._plain(data, step), bytearray(), 0

    @staticmethod
    def _plain(data: bytes, step: int) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        at, rest, z = 0, b"", None
        while rest or at < len(data):
            if not rest:
                rest, at = data[at : at + step], at + step
            z = z or zlib.decompressobj(31)
            yield z.decompress(rest, OUT_BYTES)
            rest, z = (z.unused_data, None) if z.eof else (z.unconsumed_tail, z)
        if z:
            yield z.flush()

    def _fill(self) -> bool:
        part = next(self.parts, None)
        self.buffer += part or b""
        return part is not None

    def line(self) -> bytes | None:
        """The next line without its end, or None at the end."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._fill():
                if not self.buffer:
                    return None
                end = len(self.buffer)
                break
        out = bytes(self.buffer[:end]).rstrip(b"\r")
        self.offset += min(end + 1, len(self.buffer))
        del self.buffer[: end + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._fill():
            pass
        if len(self.buffer) < n:
            raise ValueError(f"a record declares {n} bytes; the file has {len(self.buffer)}")
        out = bytes(self.buffer[:n])
        self.offset += n
        del self.buffer[:n]
        return out


def field(text: str | None, default: str = "-") -> str:
    """A header field: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text) if text else default


def http_head(page_id: int | None, length: int) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n{own}\r\n".encode()


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 weirflow\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    doc = http_head(page_id, len(payload)) + payload
    more = "" if version == 1 else f" 200 {hashlib.md5(payload).hexdigest()} - {offset} {name}"
    return f"{field(url)} 192.0.2.1 20000101000000 text/html{more} {len(doc)}\n".encode() + doc


def version_block(stream: Stream, line: bytes) -> tuple[int, list[str]]:
    """The version of an ARC file and the fields of its header lines, whatever ends the block's lines."""
    parts = line.decode("utf-8", "replace").split(" ")
    if not parts[0].startswith("filedesc://") or not parts[-1].isdecimal():
        raise ValueError("an ARC file begins with a version block")
    block = [x.strip("\r") for x in stream.take(int(parts[-1])).decode("utf-8", "replace").split("\n")]
    version, names = block[0].split(" ")[0], block[1].split() if len(block) > 1 else []
    if not version.isdecimal() or not {"URL", "IP-address", "Archive-date", "Content-type", "Archive-length"} <= set(names):
        raise ValueError("a version block names the fields of header lines")
    return int(version), names


def header(line: bytes, names: list[str]) -> dict[str, str] | None:
    """The fields of a header line, of which the URL may hold blanks; None if it is none."""
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    head = dict(zip(names, parts, strict=False))
    sound = len(parts) == len(names) and head["Archive-length"].isdecimal() and ARC_DATE.fullmatch(head["Archive-date"])
    return head if sound else None


def arc_entries(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """(offset, version, header fields, document, problem) of each record after the version block. A problem has no document:
    a line where a header should be, after which the lines up to the next header are passed over, or a length beyond the
    file's end."""
    stream, version, names, lost = Stream(data), 0, [], False
    while True:
        offset = stream.offset
        try:
            line = stream.line()
        except zlib.error as e:
            yield offset, version, {}, b"", f"damaged gzip data: {e}"
            return
        if line is None:
            return
        if not line:
            continue
        try:
            if not version:
                version, names = version_block(stream, line)
                continue
            head = header(line, names)
            if head is None:
                if not lost:
                    yield offset, version, {}, b"", f"no header line of {len(names)} fields"
                lost = True
                continue
            doc, lost = stream.take(int(head["Archive-length"])), False
        except (ValueError, zlib.error) as e:
            yield offset, version, {}, b"", str(e)
            return
        yield offset, version, head, doc, None


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, document) of each record; ValueError at the first problem."""
    for _, version, head, doc, problem in arc_entries(data):
        if problem:
            raise ValueError(problem)
        yield version, head, doc


def http_parts(doc: bytes) -> tuple[int | None, dict[str, str], bytes, bytes]:
    """Status, headers, head with the empty line that ends it, and body of an HTTP response, whose lines end with CR LF or
    LF; one without an empty line is all head. What is none is all body. A status that is no number is None."""
    if not doc.startswith(b"HTTP/"):
        return None, {}, b"", doc
    end = HEAD_END.search(doc)
    head, body = (doc[: end.end()], doc[end.end() :]) if end else (doc, b"")
    first, *rest = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    status = first.split()[1:2]
    return int(status[0]) if status and status[0].isdecimal() and len(status[0]) < 10 else None, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, head, body


def record_id(*parts) -> str:
    """A UUID (version 5 layout) that the parts decide."""
    h = bytearray(hashlib.sha1("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def warc_date(arc_date: str) -> str:
    """What the date leaves out is the first month, day or second."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def mime_type(text: str | None) -> str:
    """A declared type; what is none is octets."""
    return text if text and re.fullmatch(r"[\w.+-]+/[\w.+-]+(?:\s*;.*)?", text) else "application/octet-stream"


def warc_record(row: dict) -> bytes:
    """The WARC record, without the two line ends that close it, of a row of ARC_ROWS with refers_to and refers_to_record."""
    payload, head, digest, again = utf8(row["payload"]), utf8(row["head"]), row["digest"], row["refers_to"] is not None
    block = head if again else head + payload
    b32 = lambda x: base64.b32encode(x).decode()
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if again else 'response' if head else 'resource'}",
        *([f"WARC-Target-URI: {row['url']}"] if row["url"] is not None else []),
        f"WARC-Date: {warc_date(row['date'])}",
        f"WARC-Record-ID: {row['record_id']}",
        *([f"WARC-IP-Address: {row['ip']}"] if row["ip"] not in (None, "-", "0.0.0.0") else []),
        f"WARC-Payload-Digest: sha1:{b32(digest)}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-Id: {row['page_id']}"] if row["page_id"] is not None else []),
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {row['refers_to_record']}", f"X-Refers-To-Page: {row['refers_to']}"] if again else []),
        f"Content-Type: {'application/http; msgtype=response' if head else mime_type(row['mime'])}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_info(name: str) -> bytes:
    body = b"software: weirflow\r\nformat: WARC File Format 1.0\r\n"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        head = {}
        while line := stream.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.lower()] = v.strip()
        yield head, stream.take(int(head["content-length"]))


def files(kind: str, rows: Iterable, first, record, end: bytes) -> Iterator[pa.RecordBatch]:
    """A row for each file: first(version, name) and then record(version, name, offset, row) of up to FILE_RECORDS - 1 rows,
    FILE_BYTES in all at most unless one row has more; `end` between them."""
    from pyspark import TaskContext

    part, k, n, held = TaskContext.get().partitionId(), 0, 0, bytearray()
    version = name = None
    whole = lambda: pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], ["value"])
    for row in rows:
        if n and (n >= FILE_RECORDS - 1 or len(held) >= FILE_BYTES):
            yield whole()
            k, n, held = k + 1, 0, bytearray()
        if not n:
            version, name = 1 + (part + k) % 2, f"part-{part:05d}-{k:05d}.{kind}"
            held += first(version, name)
        held += end
        held += record(version, name, len(held), row)
        n += 1
    if n:
        yield whole()


def gathered(rows: Iterable[dict], schema: T.StructType, size=lambda r: len(r.get("payload") or "")) -> Iterator[pa.RecordBatch]:
    """Batches of about OUT_BYTES."""
    arrow, held, total = arrow_schema(schema), [], 0
    for r in rows:
        held.append(r)
        total += 200 + size(r)
        if total >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def write_arc(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Gzip ARC files, of version 1 and 2 by turns, one record a row of `pages`."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b["id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True))
        yield from files("arc", rows, arc_version_block, lambda v, name, at, r: arc_record(v, name, at, r[0], r[1], r[2] or b""), b"\n")

    read = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("html"))
    write_lines(read.mapInArrow(run, "value binary"), path, "\n")


def write_lines(lines: DataFrame, path: str, end: str) -> None:
    """A gzip file of each value of a binary column, as it is, followed by `end`. Spark's text writer writes a string's
    bytes, so the cast keeps those that are no UTF-8."""
    text = lines.select(F.col("value").cast("string"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_row(name: str, offset: int, version: int, head: dict[str, str], doc: bytes, problem: str | None) -> dict:
    """A row of ARC_ROWS. A record with a page's id has an identifier that the page, its payload and the date decide; any
    other one that file, offset and date decide."""
    if problem:
        return {"arc_version": version, "file": name, "offset": offset, "problem": problem}
    status, http, block, body = http_parts(doc)
    page, digest = http.get("x-page-id", ""), hashlib.sha1(body).digest()
    page_id = int(page) if re.fullmatch(r"-?\d{1,18}", page) else None
    ours = ("page", page_id, digest.hex()) if page_id is not None else ("file", name, offset)
    return {
        "page_id": page_id, "url": None if head["URL"] == "-" else head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "mime": head["Content-type"],
        "status": status, "arc_version": version, "head": block, "payload": body, "payload_bytes": len(body), "digest": digest, "file": name, "offset": offset,
        "record_id": record_id(*ours, head["Archive-date"]),
    }


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """ARC_ROWS of all records and problems in the files of a folder; each file is parsed once."""
    schema = T._parse_datatype_string(ARC_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                    for entry in arc_entries(data.as_py()):
                        yield arc_row(name.rpartition("/")[2], *entry)

        yield from gathered(rows(), schema)

    return whole_files(spark, path).mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC_ROWS of all records that can be parsed."""
    return parsed(spark, path).where("problem is null")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, problem) of what can't be parsed."""
    return parsed(spark, path).where("problem is not null").select("file", "offset", "problem")


def with_references(records: DataFrame, least: int = LEAST_BYTES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """`records`, a table, with refers_to and refers_to_record: of those with equal payloads of at least `least` bytes, the
    largest page_id and its record, where that isn't the row's own; else null.

    Payloads are shuffled only if more than `most_broadcast` groups have several records. Then records of payloads that are
    too small stay where they are, and groups of over HOT_ROWS records are broadcast, so that no task gets all of one."""
    groups = records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("kept"), F.max_by("record_id", "page_id").alias("kept_record"))
    groups = written(groups.where("n > 1 and kept is not null").select(F.col("digest").alias("kept_digest"), "kept", "kept_record", "n"), "archive-groups")
    meets = F.col("digest") == F.col("kept_digest")
    if groups.count() <= most_broadcast:
        joined = records.join(F.broadcast(groups), meets, "left")
    else:
        some = F.broadcast(groups.where(F.col("n") > HOT_ROWS))
        small, large = records.where(F.col("payload_bytes") < least), records.where(F.col("payload_bytes") >= least)
        hot, others = large.join(some, meets), large.join(some.select("kept_digest"), meets, "left_anti").join(groups.where(F.col("n") <= HOT_ROWS), meets, "left")
        none = small.withColumns({c: F.lit(None).cast(t) for c, t in groups.dtypes})
        joined = none.unionByName(hot).unionByName(others)
    other = ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.withColumns({"refers_to": F.when(other, F.col("kept")), "refers_to_record": F.when(other, F.col("kept_record"))}).drop("kept", "kept_record", "kept_digest", "n")


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip WARC files of rows of ARC_ROWS with refers_to."""
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        yield from files("warc", rows, lambda v, name: warc_info(name), lambda v, name, at, r: warc_record(r), b"\r\n\r\n")

    write_lines(records.mapInArrow(run, "value binary"), path, "\r\n\r\n")


def warc_row(head: dict[str, str], block: bytes) -> dict:
    """A row of WARC_ROWS; verified: digests and lengths are those of what was read."""
    kind, mime = head["warc-type"], head.get("content-type", "")
    status, http, _, body = http_parts(block) if mime.startswith("application/http") else (None, {"content-type": mime}, b"", block)
    own = hashlib.sha1(body).digest()
    told, length = head.get("warc-payload-digest", ""), int(head.get("x-payload-length", len(body)))
    digest = base64.b32decode(told[5:]) if told.startswith("sha1:") and len(told) == 37 else own
    sound = head.get("warc-block-digest") == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    if kind != "revisit":
        sound &= own == digest and length == len(body)
    page, to = head.get("x-page-id"), head.get("x-refers-to-page")
    return {
        "page_id": int(page) if page else None, "url": head.get("warc-target-uri"), "record_id": head["warc-record-id"], "date": head["warc-date"], "record_type": kind,
        "refers_to": int(to) if to else None, "payload_bytes": length, "payload_digest": digest.hex(), "verified": sound, "status": status, "mime": http.get("content-type"),
    }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_ROWS of all response, resource and revisit records."""
    schema = T._parse_datatype_string(WARC_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for b in batches for data in b["content"] for r in warc_records(data.as_py()))
        yield from gathered((warc_row(head, block) for head, block in records if head["warc-type"] in ("response", "resource", "revisit")), schema)

    return whole_files(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, **options) -> int:
    """ARC files to WARC files; returns how many problems, as malformed() lists them, were passed over.

    Each ARC file is parsed once. An HTTP response is a response with the head that was archived, any other document a
    resource of its declared type. Equal payloads of at least LEAST_BYTES become revisits of the one with the largest
    page_id; a record without a page_id is a revisit where another has one, and rows that repeat that page_id are all
    responses.
    """
    return converted(taken(spark, arc_path), warc_path, **options)


def taken(spark: SparkSession, arc_path: str) -> DataFrame:
    """parsed(), as a table."""
    return written(parsed(spark, arc_path), "arc-records")


def converted(records: DataFrame, warc_path: str, **options) -> int:
    """convert() from the table of taken(), which is gone afterwards."""
    sound = records.where("problem is null").drop("problem")
    write_warc(with_references(sound, **options), warc_path)
    problems = records.where("problem is not null").count()
    discard(records)
    return problems


def archived(pages: DataFrame, **options) -> DataFrame:
    """WARC_ROWS read back after `pages` (page_id, url, html) were written as ARC files and converted to WARC files.

    Other columns are ignored, whatever their names. A null or empty html is an empty payload; a null url stays null; a
    null page_id stays null; rows that repeat give a record each, and share an identifier where page_id and html are equal;
    a payload of any length is one record; an empty table gives none.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc)
    records = taken(spark, arc)
    remove(spark, arc)
    converted(records, warc, **options)
    return read_warc(spark, warc)


def op8_archive(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, cast(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS kept FROM p WHERE n >= {LEAST_BYTES} GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM p LEFT JOIN k USING (digest)
"""
