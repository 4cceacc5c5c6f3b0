"""Legacy ARC archives to WARC, with revisits of equal payloads.

The converter reads an ARC file by its version block: the block names the fields of a record line (five in version 1,
ten in version 2), each record line declares the length of its body, and only that length says where a record ends.
From them it makes WARC identifiers (name-based UUIDs of archive and offset), timestamps, types and SHA-256 digests.
Payloads of at least ``least`` bytes are written once: the record of the smallest page is the response, others become
revisits that keep the payload's length and digest. WARC files are written by Spark's text writer, one record a row
and compressed as a whole, so lost tasks are redone as usual; they are read back by declared lengths.

Sizes: an archive holds at most ``per_file`` records, so a reader holds one such file in memory.

Defined results: null bodies are empty; null urls become ``about:blank``; null ids are always responses; equal ids with
equal payloads are responses alike; records without an HTTP head become ``resource``; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.llm.common import slices, stored

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PER_FILE, PER_ARC = 2_000, 200
LEAST_PAYLOAD = 100


# ARC


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, date, content type, body)."""
    block = f"{version} 0 beaconry\n{FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain".encode(), b" 200 - - 0 " + name.encode() if version == 2 else b"",
           f" {len(block)}\n".encode(), block, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, body in records:
        more = f" 200 {hashlib.md5(body).hexdigest()} - {at} {name}" if version == 2 else ""
        line = f"{url} {ip} {date} {kind}{more} {len(body)}\n".encode()
        out += [line, body, b"\n"]
        at += len(line) + len(body) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, body) of every record; the version block comes first, with its own fields."""
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            body = data[end + 1 : end + 1 + length]
            names = body.decode("ascii", "replace").splitlines()[1].split()
            fields = dict(zip(("URL", "IP-address", "Archive-date", "Content-type"), line.split(" ")))
        else:
            parts = line.rsplit(" ", len(names) - 1)  # an address may hold blanks, the fields after it don't
            fields = dict(zip(names, parts))
            length = int(fields["Archive-length"])
            body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"ARC record at {at} declares {length} bytes, {len(body)} are left")
        yield at, fields, body
        at = end + 1 + length


def warc_date(date: str) -> str:
    """ARC dates of 8, 12 or 14 digits as WARC timestamps."""
    d = (date + "00000000000000")[:14] if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload; without an HTTP head all is payload."""
    if body[:5] != b"HTTP/":
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (b"", body)


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


RECORDS = ("record_id string, url string, ip string, date string, type string, page_id long, head binary, "
           "payload_bytes long, payload_digest string, payload binary")


def convert(arcs: DataFrame, payloads: bool = True) -> DataFrame:
    """WARC records of ARC files given as (name, content): identifier, timestamp, type, digest, head and payload."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        for b in slices(batches, 1):
            rows = []
            name, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for at, f, body in parse_arc(data):
                if f["URL"].startswith("filedesc:"):
                    continue
                head, payload = split_http(body)
                page = http_field(head, b"X-Page-Id")
                rows.append((f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}')}", f["URL"], f["IP-address"],
                             warc_date(f["Archive-date"]), "response" if head else "resource", int(page) if page else None,
                             head, len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None))
            types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return arcs.select("name", "content").mapInArrow(run, RECORDS)


def arcs_of_pages(pages: DataFrame, per_arc: int = PER_ARC) -> DataFrame:
    """The pages as ARC files (name, content), versions 1 and 2 in turn; the page id goes into the HTTP head."""

    def run(batches):
        for b in slices(batches, per_arc):
            ids, urls, bodies = (c.to_pylist() for c in b.columns)
            first = f"{ids[0]}-{uuid.uuid5(uuid.NAMESPACE_URL, repr(ids)).hex[:12]}.arc"
            version = 1 + sum(i or 0 for i in ids) % 2
            records = []
            for i, url, body in zip(ids, urls, bodies):
                own = b"" if i is None else f"X-Page-Id: {i}\r\n".encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + f"Content-Length: {len(body)}\r\n\r\n".encode()
                safe = "".join(url.split()) or "about:blank"
                records.append((safe, "192.0.2.1", "20240101000000", "text/html", head + body))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([arc_file(first, version, records)], pa.binary())],
                                             names=["name", "content"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary")).alias("html"))
    return rows.mapInArrow(run, "name string, content binary")


# WARC


def revisits(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, payload_digest, refers_to): what has an equal payload on a smaller page. No payload moves."""
    rows = records.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    firsts = rows.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    many = firsts.where("last > refers_to").drop("last")
    return rows.join(many, "payload_digest").where("page_id > refers_to").distinct()


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def warc_text(rows: DataFrame) -> Column:
    """The record without its last line end, which the writer adds. Revisits keep the head and leave the payload out."""
    again = F.col("refers_to").isNotNull()
    payload = F.when(again, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    body = F.concat(F.col("head"), payload)
    header = F.concat(
        F.lit("WARC/1.0\r\n"), _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.col("type"))),
        _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-IP-Address", F.col("ip")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(again, F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            _line("X-Refers-To-Page", F.col("refers_to")))).otherwise(F.lit("")),
        F.coalesce(_line("X-Page-Id", F.col("page_id")), F.lit("")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        F.when(F.col("type") == "response", _line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(F.lit("")),
        _line("Content-Length", F.octet_length(body)), F.lit("\r\n"))
    return F.concat(header.cast("binary"), body, F.lit(b"\r\n").cast("binary")).cast("string")


def write_warc(records: DataFrame, path: str, digests: DataFrame | None = None, least: int = LEAST_PAYLOAD,
               per_file: int = PER_FILE) -> None:
    """Compressed WARC files of converted records; equal payloads become revisits of the smallest page.

    ``digests``: the same records without payloads, if they are cheaper to get.
    """
    again = revisits((records if digests is None else digests).select("page_id", "payload_bytes", "payload_digest"), least)
    rows = records.join(again, ["page_id", "payload_digest"], "left")
    (rows.select(warc_text(rows).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it declares")
        yield fields, data[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and the payload (null for revisits)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for b in slices(batches, 1):
            rows = []
            for f, block in parse_warc(gzip.decompress(b.column(0)[0].as_py())):
                _, payload = split_http(block)
                kind, digest = f["warc-type"], f["warc-payload-digest"].partition(":")[2]
                page, refers = f.get("x-page-id"), f.get("x-refers-to-page")
                if kind != "revisit":
                    digest = hashlib.sha256(payload).hexdigest()  # what is there, not what is claimed
                size = int(f["x-payload-length"]) if kind == "revisit" else len(payload)
                rows.append((int(page) if page else None, f["warc-target-uri"], size, digest, kind,
                             int(refers) if refers else None, None if kind == "revisit" else payload))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to long, payload binary")


def archive(pages: DataFrame, path: str) -> None:
    """Pages to ARC files, these to WARC files at ``path``."""
    arcs = arcs_of_pages(pages)
    write_warc(convert(arcs), path, digests=convert(arcs, payloads=False))
