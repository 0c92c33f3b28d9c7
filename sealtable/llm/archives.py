"""Operator 1: legacy ARC archives converted to WARC, and both read back.

An ARC file begins with a ``filedesc`` record whose body names the version and the fields
of the header lines that follow; version 1 has five fields, version 2 ten, and the last is
always the declared length of the record's content.  The converter reads the lines by the
version their file declares and the content by its length, and makes up what WARC asks
for: a record id (a UUID of file, offset and header line, so a repeated task gives the
same one), an ISO date from the 8 to 14 digits, a type, and SHA-1 digests of block and
payload.  The type comes from the URL's scheme; the query, all of whose pages have an HTTP
head, also takes HTTP messages of other schemes as responses.  Of records with equal payloads of at least ``min_bytes``,
the one with the largest page id is the response, and the others revisit it without a
body.  Responses are found by a grouped maximum of digests; a digest that very many
records share is dealt over parts, so no task gets them all.

Files are made of gzip members, one per record, as both formats have it.  Spark's text
writer puts bytes down as they are and ends each line with a separator; a member's last
byte is the high byte of its length, zero below 16 MB, and that is the separator here.  A
longer record ends with an empty member.  Reading takes whole files, so a file is what one
task wrote; nothing is opened but by Spark's readers.

Defined cases: null html is an empty payload; a null or malformed URL is percent-encoded
or replaced by ``unknown:``; a row without page id has no id line, is never referred to
and has no columns but its payload's; repeated rows are records of their own, of which the
one with the largest record id is the response; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.llm import common
from sealtable.session import work_path

MIN_BYTES = 0
# Compression of both archives: a third of the time of the usual level 6, a tenth more bytes.
LEVEL = 3
# Parts that the records of one digest are dealt over.
PARTS = 64
# Fixed values of the two versions of the ARC format: the fields of a header line.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value: the profile of a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, ADDRESS = "20000101000000", "0.0.0.0"
_MEMBER_LIMIT, _PIECE = 1 << 24, 1 << 12


def member(raw: bytes) -> bytes:
    """The bytes as a gzip member that ends with a zero byte."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if len(raw) < _MEMBER_LIMIT else out + member(b"")


def members(raw: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one at a time.  Input goes in by small
    pieces: what a member leaves over is copied, and must not be the rest of the file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            piece = view[at : at + _PIECE]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            parts.append(packer.decompress(piece))
            at += len(piece)
        at -= len(packer.unused_data)
        out = b"".join(parts)
        if out:
            yield out


def _lines(df: DataFrame, folder: str) -> None:
    """Writes the binary column ``record`` as files of gzip members."""
    lines = df.select(F.expr("cast(substring(record, 1, octet_length(record) - 1) as string)").alias("value"))
    lines.write.option("lineSep", "\0").option("compression", "none").text(folder)


def safe_url(url: str | None) -> str:
    """A URL that can stand in a header line."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]._-") if url else "unknown:"


def arc_records(pages: DataFrame, version: int = 1) -> DataFrame:
    """``record``: gzip members of ARC files, each task's first one its file's header."""
    fields = ARC_FIELDS[version]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, offset = f"part-{TaskContext.get().partitionId()}.arc", 0

        def line(url, kind, code, body):
            start = [url, ADDRESS, DATE, kind]
            if version == 2:
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                start += [str(code), digest, "-", str(offset), name]
            return (" ".join([*start, str(len(body))]) + "\n").encode() + body + b"\n"

        body = f"{version} 0 sealtable\n{fields}\n".encode()
        out = [member(line(f"filedesc://{name}", "text/plain", 200, body))]
        offset += len(out[0])
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                    head += f"X-Page-Id: {page}\r\n\r\n" if page is not None else "\r\n"
                    out.append(member(line(safe_url(url), "text/html", 200, head.encode() + payload)))
                    offset += len(out[-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    source = pages.select("page_id", "url", "html")
    return source.mapInArrow(run, "record binary")


def parse_arc(raw: bytes, version: int | None = None) -> Iterator[dict]:
    """The records in uncompressed ARC bytes.  Without a version they must begin with the
    file's own header, which declares it."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\n", at)
        if stop < 0:
            raise ValueError("an ARC header line has no end")
        if stop == at:  # the line break after a record
            at += 1
            continue
        line = raw[at:stop].decode()
        values = line.split(" ")
        if version is None and not line.startswith("filedesc:"):
            raise ValueError("an ARC file does not begin with its own header")
        fields = ARC_FIELDS[version or (1 if len(values) == 5 else 2)].split(" ")
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line has {len(values)} fields, its version {len(fields)}")
        record = dict(zip(fields, values))
        size = int(record["Archive-length"])
        content = raw[stop + 1 : stop + 1 + size]
        if len(content) != size:
            raise ValueError("an ARC record is shorter than it declares")
        # Beyond the first record, a page may have such a URL.
        if line.startswith("filedesc:") and (version is None or not is_http(content)):
            version = int(content.split(b" ", 1)[0])
            if ARC_FIELDS.get(version) != content.split(b"\n")[1].decode() or ARC_FIELDS[version] != " ".join(fields):
                raise ValueError("an ARC file's header lines are not those of its version")
        yield record | {"content": content, "line": line, "version": version}
        at = stop + 1 + size


def iso_date(digits: str) -> str:
    """A WARC date from 4 to 14 digits; what is missing is the start of the period."""
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_type(url: str) -> str:
    """warcinfo for the file's own header, response for web pages, else resource."""
    scheme = url.split(":", 1)[0].lower()
    return {"filedesc": "warcinfo", "http": "response", "https": "response", "unknown": "response"}.get(scheme, "resource")


def sha1(raw: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def is_http(content: bytes) -> bool:
    """Whether a record's content begins with the status line of an HTTP response."""
    return re.match(rb"HTTP/\d+(\.\d+)? \d{3}[ \r\n]", content) is not None


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, head and body of an HTTP message."""
    head, gap, body = content.partition(b"\r\n\r\n")
    fields = dict(f.split(": ", 1) for f in head.decode("latin-1").split("\r\n")[1:] if ": " in f)
    return {k.lower(): v for k, v in fields.items()}, head + gap, body


_CONVERTED = (
    "file string, record_id string, page_id long, type string, url string, date string, mime string, address string, "
    "head binary, body binary, payload_digest string, payload_bytes long, meta boolean"
)


def converted(files: DataFrame, bodies: bool = True, by_content: bool = False) -> DataFrame:
    """WARC records synthesised from ARC files ``(path, content)``; without ``bodies``
    their columns ``head`` and ``body`` are null.  With ``by_content`` every HTTP message
    is a response, whatever its URL's scheme."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64())]
            + [(n, pa.string()) for n in ("type", "url", "date", "mime", "address")]
            + [("head", pa.binary()), ("body", pa.binary()), ("payload_digest", pa.string())]
            + [("payload_bytes", pa.int64()), ("meta", pa.bool_())]
        )
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, rows, number = path.rsplit("/", 1)[-1], [], 0
                version = None
                for part in members(content.as_buffer()):
                    for r in parse_arc(part, version):
                        version = r["version"]
                        kind = record_type(r["URL"])
                        if by_content and is_http(r["content"]):
                            kind = "response"
                        head, body, page = b"", r["content"], None
                        if kind == "response":
                            found, head, body = http_parts(r["content"])
                            page = int(found["x-page-id"]) if "x-page-id" in found else None
                        identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{number} {r['line']}")
                        rows.append(
                            (name, f"<urn:uuid:{identity}>", page, kind, r["URL"], iso_date(r["Archive-date"]))
                            + (r["Content-type"], r["IP-address"], head if bodies else None, body if bodies else None)
                            + (sha1(body), len(body), kind == "warcinfo")
                        )
                        number += 1
                    if len(rows) >= 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.mapInArrow(run, _CONVERTED)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record's bytes."""
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a WARC record does not begin with its version")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin, size = stop + 4, int(fields["content-length"])
        if raw[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is not as long as it declares")
        yield fields, raw[begin : begin + size]
        at = begin + size + 4


def responses(meta: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(payload_digest, part, chief)`` for each digest of several records and each part
    its records are dealt over; the chief is the record that is the response."""
    several = meta.where((F.col("payload_bytes") >= min_bytes) & ~F.col("meta"))
    order = F.struct(F.col("page_id").alias("page"), "record_id", "url", "date")
    parts = several.groupBy("payload_digest", _part().alias("part")).agg(
        F.max(order).alias("chief"), F.count("*").alias("records")
    )
    parts = common.stored(parts, "digests")
    whole = parts.groupBy("payload_digest").agg(F.max("chief").alias("chief"), F.sum("records").alias("records"))
    whole = whole.where("records > 1").select("payload_digest", "chief")
    return parts.select("payload_digest", "part").join(whole, "payload_digest")


def _part():
    return F.pmod(F.xxhash64("record_id"), F.lit(PARTS))


def warc_records(records: DataFrame, chiefs: DataFrame) -> DataFrame:
    """``record``: gzip members of WARC files from ``converted`` records."""
    dealt = records.withColumn("part", _part())
    both = dealt.join(chiefs, ["payload_digest", "part"], "left").select(
        "record_id", "page_id", "type", "url", "date", "mime", "address", "head", "body", "payload_digest", "chief"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"software: sealtable\r\nformat: WARC File Format 1.1\r\n"
        part = f"part-{TaskContext.get().partitionId()}"
        name = uuid.uuid5(uuid.NAMESPACE_URL, part)
        first = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", iso_date(DATE))]
        first += [("WARC-Filename", f"{part}.warc.gz"), ("Content-Type", "application/warc-fields")]
        out = [member(warc_record("warcinfo", first, about))]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                for r in whole.slice(at, 200).to_pylist():
                    chief = r["chief"] if r["type"] == "response" else None
                    again = chief is not None and chief["record_id"] != r["record_id"]
                    fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"])]
                    fields += [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["address"])]
                    fields += [("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
                    block = r["head"] if again else r["head"] + r["body"]
                    fields += [("WARC-Block-Digest", f"sha1:{sha1(block)}")]
                    if again:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", chief["record_id"])]
                        fields += [("WARC-Refers-To-Target-URI", chief["url"]), ("WARC-Refers-To-Date", chief["date"])]
                    kind = "application/http; msgtype=response" if r["type"] == "response" else r["mime"]
                    fields += [("Content-Type", kind)]
                    out.append(member(warc_record("revisit" if again else r["type"], fields, block)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return both.mapInArrow(run, "record binary")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``(record_id, record_type, url, page_id, payload_digest, payload_bytes,
    refers_to_id)`` of every record but the files' own; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "page_id", "payload_digest", "payload_bytes", "refers_to_id"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for part in members(content.as_buffer()):
                    for fields, block in parse_warc(part):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        if fields["warc-block-digest"] != f"sha1:{sha1(block)}":
                            raise ValueError(f"the block of {fields['warc-record-id']} is damaged")
                        page, size = None, len(block)
                        if kind in ("response", "revisit"):
                            found, _, body = http_parts(block)
                            page = int(found["x-page-id"]) if "x-page-id" in found else None
                            size = len(body)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and digest != sha1(block[len(block) - size :]):
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        rows.append(
                            (fields["warc-record-id"], kind, fields["warc-target-uri"], page, digest)
                            + (None if kind == "revisit" else size, fields.get("warc-refers-to"))
                        )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "record_id string, record_type string, url string, page_id long, payload_digest string, payload_bytes long, refers_to_id string"
    return read_files(spark, folder).select("content").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with length and page of what a revisit refers to.  Only the responses
    that revisits name are joined, dealt over parts as the revisits are."""
    again = records.where("refers_to_id is not null").withColumn("part", _part())
    named = again.select("refers_to_id", "part").distinct()
    targets = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full")
    )
    known = named.join(targets, "refers_to_id")
    found = again.join(known, ["refers_to_id", "part"]).withColumn("payload_bytes", F.col("full"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
    plain = records.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.select(*names).unionByName(found.select(*names))


def convert(
    spark: SparkSession, arc_folder: str, warc_folder: str, min_bytes: int = MIN_BYTES, by_content: bool = False
) -> None:
    """Converts a folder of ARC files to WARC files.  They are read twice: for the digests,
    which are small, and for the records."""
    files = read_files(spark, arc_folder)
    chiefs = common.stored(responses(converted(files, bodies=False, by_content=by_content), min_bytes), "chiefs")
    records = converted(files, by_content=by_content).where("not meta")
    _lines(warc_records(records, chiefs), warc_folder)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as ARC, converted to WARC and read back."""
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    pages = common.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _lines(arc_records(pages), arc)
    convert(spark, arc, warc, by_content=True)
    return resolved(common.stored(read_warc(spark, warc), "records")).drop("record_id", "url")


# The same rows in DuckDB, where SHA-1 comes in hexadecimal; five bits make a digit.
ORACLE = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, url,
        sha1(coalesce(html, '')) AS hex FROM pages
), digested AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + cast(substr(list_reduce(list_transform(range(1, 41), lambda k: right('000' || bin(strpos('0123456789abcdef', substr(hex, k, 1)) - 1), 4)), lambda a, b: a || b), 5 * i + 1, 5)::BIT AS INTEGER), 1)), '') AS payload_digest
    FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN NULL ELSE max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM digested
"""
