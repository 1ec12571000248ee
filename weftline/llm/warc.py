"""Legacy archives (ARC) turned into WARC, written to the shared folder and read back.

An ARC file begins with a version block; it says how the header line of each record is laid out.
A record is its header line, the declared number of bytes, and a line feed. The converter parses
both layouts and makes of each record the WARC fields that ARC lacks: record ids, ISO dates,
types and digests. Each WARC record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import new_path, small_batches

#: The layouts of header lines by ARC version.
LAYOUTS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LEAST_REVISIT = 1000
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    kind: str
    block: bytes


def arc_field(value: str | None) -> str:
    """A header field: without white space, ``-`` if there is nothing."""
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in value or "") or "-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    """The response of a server as an archive keeps it."""
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def write_arc(records: Iterable[ArcRecord], out: BinaryIO, version: int, name: str = "pages.arc") -> None:
    body = f"{version} 0 pages\n{LAYOUTS[version]}\n".encode()
    more = {1: "", 2: "200 - - 0 {} ".format(arc_field(name))}[version]
    out.write(f"filedesc://{arc_field(name)} 0.0.0.0 19960101000000 text/plain {more}{len(body)}\n".encode() + body + b"\n")
    for r in records:
        out.write(f"{arc_field(r.url)} {arc_field(r.ip)} {r.date} {arc_field(r.kind)} {more}{len(r.block)}\n".encode() + r.block + b"\n")


def read_arc(source: BinaryIO) -> Iterator[ArcRecord]:
    """The records behind the version block; an archive that ends within one raises ValueError."""
    first = source.readline().split()
    if not first or not first[0].startswith(b"filedesc://"):
        raise ValueError("no version block")
    block = source.read(int(first[-1]))
    layout = block.split(b"\n")[1].decode().split()
    if int(block.split()[0]) not in LAYOUTS or layout[-1] != "Archive-length":
        raise ValueError(f"unknown layout {layout}")
    source.readline()
    while line := source.readline():
        if not line.strip():
            continue
        fields = line.decode().rstrip("\r\n").split(" ")
        if len(fields) != len(layout):
            raise ValueError(f"{len(fields)} fields in {line!r}")
        by = dict(zip(layout, fields, strict=True))
        length = int(by["Archive-length"])
        block = source.read(length)
        if len(block) < length:
            raise ValueError(f"{by['URL']} ends early")
        yield ArcRecord(by["URL"], by["IP-address"], by["Archive-date"], by["Content-type"], block)


def iso_date(stamp: str) -> str:
    """An ARC time stamp, of eight digits or more, as WARC writes it."""
    d = stamp.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP fields (lower-case names), the head with its blank line, and the payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = (x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return {k.lower(): v for k, v in fields}, head + mark, payload


def convert(record: ArcRecord, refers_to: int | None) -> bytes:
    """The WARC record of an ARC record; with ``refers_to`` a revisit, which has the HTTP head only."""
    fields, head, payload = parts(record.block)
    revisit, block = refers_to is not None, record.block if refers_to is None else head
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(f"page:{fields['x-page-id']}" if "x-page-id" in fields else f"{record.url} {record.date}")),
        ("WARC-Date", iso_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", sha1_field(payload)),
        ("WARC-Block-Digest", sha1_field(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"page:{refers_to}")), ("X-Refers-To-Page-Id", str(refers_to))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in lines], "\r\n"]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_warc(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, one in memory at a time."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields = {}
        while (line := source.readline()).strip():
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k.lower()] = v
        block = source.read(length := int(fields["content-length"]))
        if len(block) < length or fields["warc-block-digest"] != sha1_field(block):
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        yield fields, block


def described(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record read back."""
    http, _, payload = parts(block)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {fields['warc-record-id']}")
    page, to = http.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (None if page is None else int(page), int(http["content-length"]), digest, fields["warc-type"], None if to is None else int(to))


def write_archives(pages: DataFrame, *, folder: str | None = None, date: str = "19961231235959") -> DataFrame:
    """Writes a WARC file per partition; returns path and n_records of each.

    Pages pass through legacy archives of either version, by partition. Of pages with equal payloads
    of ``LEAST_REVISIT`` bytes or more the one with the largest page_id is a response, the others
    revisit it. Null html is an empty payload. Repeated rows of that page_id are all responses, and
    so are all of a group that has null ids alone; null urls are written as ``-``. Other columns are
    not read. Groups are found by digest and length, without the payloads.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    page = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    page = page.withColumn("digest", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha1("html")))
    equal = page.where("digest IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    large = page.where("digest IS NOT NULL").join(equal, F.col("digest") == equal["d"], "left")
    large = large.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    chosen = large.unionByName(page.where("digest IS NULL").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        version = 1 + task.partitionId() % 2
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path, count = f"{root}/part-{task.partitionId()}-{task.taskAttemptId()}.warc.gz", 0
        out = None
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                ids, urls, htmls, refers = (c.to_pylist() for c in whole.slice(at, 200).columns)
                legacy = io.BytesIO()
                write_arc((ArcRecord(u, "0.0.0.0", date, "text/html", http_block(i, h.encode())) for i, u, h in zip(ids, urls, htmls, strict=True)), legacy, version)
                legacy.seek(0)
                out = out or fs.open_output_stream(path, compression=None)
                for record, to in zip(read_arc(legacy), refers, strict=True):
                    out.write(member(convert(record, to)))
                    count += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "n_records"])

    return small_batches(chosen).mapInArrow(run, "path string, n_records long"), folder


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives whose paths are given: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, io.BufferedReader(GzipMembers(raw), 1 << 20) as source:
                    for fields, block in read_warc(source):
                        rows.append(described(fields, block))
                        if len(rows) == 2000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return archives.select("path").mapInArrow(run, READ)


class GzipMembers(io.RawIOBase):
    """What a file of gzip members holds, as one stream."""

    def __init__(self, source):
        self.source, self.z, self.left = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self.left or self.source.read(1 << 20)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(into))
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                into[: len(got)] = got
                return len(got)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives and reads them back: a row per page."""
    archives, folder = write_archives(pages)
    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return read_archives(archives.repartition(4 * n, "path"), folder)
