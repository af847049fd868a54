"""Legacy ARC archives to WARC.

An ARC file begins with a version block that names the fields of the header lines
after it: version 1 has five, version 2 ten, the last always the length of what
follows. Records are found by those lengths alone. Each becomes a WARC record: the
version block a ``warcinfo``, a capture a ``response``, or a ``revisit`` of an
earlier response with the same payload. Identifiers are derived from what is
archived, so that converting twice gives the same ones; timestamps, block digests
and payload digests (SHA-1 in base 32) are made from the record.

Archives are written and read by Spark through whatever file system the path
names. A file has up to ``FILE_BLOCKS`` blocks of about ``BLOCK_BYTES`` before they are
compressed, each whole gzip members and followed by an empty member; readers split
files at those, so a task holds a block at a time however large files are. In a WARC
file every record is a gzip member of its own, in an ARC file a block is one member
and an archive that begins with its own version block.

What a record becomes is decided on keys alone: the archives are read for digests
first, equal ones meet in one aggregation, and the few numbers of the revisits of a
block then go to that block, as it is read again and converted. Records themselves
are never shuffled, compressed ARC blocks are once.

Nulls and edge cases: null or empty HTML is an empty payload; a record longer than a
block is a block of its own; pages without an id keep a null one and are responses;
rows that repeat an id with equal payloads are alike in type; URLs of any characters
are escaped; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi.llm.common import shared_path

BLOCK_BYTES, FILE_BLOCKS = 4_000_000, 128
#: The last field is the length in both versions (fixed by the format).
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CAPTURED = "20000101000000"
#: What stands between two rows in a written file: a gzip member of no bytes.
NOTHING = gzip.compress(b"", mtime=0)
ID_HEADER = "X-Page-Id"


class ArcError(ValueError):
    """The bytes don't follow the format."""


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def member(raw: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def unpacked(data: bytes) -> bytes:
    """Compressed or plain bytes as plain ones."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data


def arc_version_block(version: int, name: str, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    tail = "text/plain 200 - - 0 " + name if version == 2 else "text/plain"
    return f"filedesc://{name} 0.0.0.0 {date} {tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, block: bytes, *, date: str = CAPTURED, ip: str = "0.0.0.0", mime: str = "text/html", name: str = "-") -> bytes:
    """A header line of that version, the block, and the line break between records."""
    middle = f"{mime} 200 - - 0 {name}" if version == 2 else mime
    return f"{url} {ip} {date} {middle} {len(block)}\n".encode() + block + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of one archive or of several in a row."""
    data, at, version, names = unpacked(data), 0, 0, []
    while at < len(data):
        if data[at] == 10:  # the line break after a record
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError("a header line doesn't end")
        values = data[at:stop].decode("utf-8", "surrogateescape").split(" ")
        if not values[-1].isdigit():
            raise ArcError(f"no length in {values!r:.200}")
        at, length = stop + 1, int(values[-1])
        block = data[at : at + length]
        if len(block) < length:
            raise ArcError("a block is cut short")
        at += length
        if values[0].startswith("filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            number = lines[0].split(" ")[0]
            if not number.isdigit() or int(number) not in FIELDS or len(lines) < 2:
                raise ArcError(f"unknown version {number!r}")
            version, names = int(number), lines[1].split(" ")
        if len(values) != len(names):
            raise ArcError(f"{len(values)} fields, {len(names)} are declared")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), block)


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload; all is payload without a header."""
    if block.startswith(b"HTTP/"):
        stop = block.find(b"\r\n\r\n")
        if stop >= 0:
            return block[: stop + 4], block[stop + 4 :]
    return b"", block


def http_field(header: bytes, name: str) -> str | None:
    for line in header.decode("latin-1").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def __bytes__(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{lines}Content-Length: {len(self.block)}\r\n\r\n".encode("utf-8", "surrogateescape") + self.block + b"\r\n\r\n"


def record_id(arc: ArcRecord) -> str:
    """From what is archived, so that converting twice gives the same."""
    uri, date = arc.fields["URL"], arc.fields["Archive-date"].ljust(14, "0")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {sha1(arc.block)}')}>"


def to_warc(arc: ArcRecord) -> WarcRecord:
    """The equivalent record: ``warcinfo`` for a version block, else ``response`` (``resource`` outside HTTP)."""
    uri, date = arc.fields["URL"], arc.fields["Archive-date"].ljust(14, "0")
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    header, payload = http_parts(arc.block)
    known = {"WARC-Record-ID": record_id(arc), "WARC-Date": stamp}
    if uri.startswith("filedesc://"):
        return WarcRecord({"WARC-Type": "warcinfo", **known, "WARC-Filename": uri.removeprefix("filedesc://"), "Content-Type": "text/plain"}, arc.block)
    kind, content = ("response", "application/http; msgtype=response") if header else ("resource", arc.fields["Content-type"])
    ip = {"WARC-IP-Address": arc.fields["IP-address"]} if arc.fields["IP-address"] != "0.0.0.0" else {}
    return WarcRecord({"WARC-Type": kind, **known, "WARC-Target-URI": uri, **ip, "WARC-Block-Digest": f"sha1:{sha1(arc.block)}", "WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": content}, arc.block)


def to_revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """The record without its payload, pointing at the response that has it."""
    header, _ = http_parts(record.block)
    changed = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to, "WARC-Block-Digest": f"sha1:{sha1(header)}"}
    return WarcRecord(record.headers | changed, header)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records by their declared lengths."""
    data, at = unpacked(data), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ArcError("not a WARC record")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.pop("Content-Length"))
        yield WarcRecord(headers, data[stop + 4 : stop + 4 + length])
        at = stop + 4 + length + 4


def _blocks(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Parts gathered to blocks."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= BLOCK_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _write(blocks: DataFrame, path: str) -> None:
    """Rows of bytes one after the other; Spark's text writer leaves the bytes as they are."""
    blocks.select(F.col("block").cast("string")).write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """(block): a row for each block; ``NOTHING`` stands between them, and in no other place, as gzip's first bytes are in no UTF-8 text."""
    return spark.read.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("block")).where(F.octet_length("block") > 0)


def _as_batch(blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Pages as ARC archives; every block begins with a version block, versions 1 and 2 in turn."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0

        def records(version: int) -> Iterator[bytes]:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                own = "" if page is None else f"{ID_HEADER}: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                yield arc_record(version, quote(url or "urn:unknown", safe="%/:=&?~#+!$,;'@()*[]-._"), head.encode() + payload)

        for n, batch in enumerate(batches):
            version = 1 + n % 2
            for block in _blocks(records(version)):  # an archive of its own, compressed in one
                yield _as_batch([member(arc_version_block(version, f"pages-{part}-{k}.arc") + block, 3)])
                k += 1

    _write(pages.select(F.col(id_col).cast("long").alias("id"), url_col, payload_col).mapInArrow(written, "block binary"), path)


def known_records(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, place, record_id, page_id, payload_digest, payload_bytes) of the captures in ARC archives: what their WARC records are known by."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()
        names = ["block_id", "place", "record_id", "page_id", "payload_digest", "payload_bytes"]
        for batch in batches:
            for block_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for place, arc in enumerate(read_arc(content.as_py())):
                    if arc.fields["URL"].startswith("filedesc://"):
                        continue
                    header, payload = http_parts(arc.block)
                    own = http_field(header, ID_HEADER)
                    rows.append((block_id, place, record_id(arc), None if own is None else int(own), sha1(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _read(spark, path).select(F.md5("block").alias("block_id"), "block").mapInArrow(listed, "block_id string, place int, record_id string, page_id long, payload_digest string, payload_bytes long")


def revisits(known: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(block_id, places, refers_to): for each block its records that revisit another. Of equal payloads of at least ``least_bytes`` the smallest page_id's is the response."""
    able = known.where(F.col("payload_bytes") >= least_bytes).where("page_id is not null")
    first = able.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.max("page_id").alias("last")).where("last > first.page_id").select("payload_digest", "first")
    found = able.select("block_id", "place", "page_id", "payload_digest").join(first, "payload_digest").where("page_id > first.page_id")
    return found.groupBy("block_id").agg(F.collect_list("place").alias("places"), F.collect_list("first.record_id").alias("refers_to"))  # as many as a block has records


def convert(spark: SparkSession, path: str, decided: DataFrame, to: str) -> None:
    """ARC archives to WARC archives; ``decided`` says which records are revisits."""

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places, refers_to in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                target = dict(zip(places or (), refers_to or (), strict=True))

                def records(content=content, target=target) -> Iterator[bytes]:
                    for place, arc in enumerate(read_arc(content.as_py())):
                        warc = to_warc(arc)
                        yield member(bytes(warc if place not in target else to_revisit(warc, target[place])))

                yield _as_batch([b"".join(records())])

    blocks = _read(spark, path).select(F.md5("block").alias("block_id"), "block").join(decided, "block_id", "left").select("block", "places", "refers_to")
    _write(blocks.mapInArrow(converted, "block binary"), to)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of WARC archives, lengths and digests from the payloads themselves; a revisit's are its response's."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        names = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "target"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for warc in read_warc(content.as_py()):
                    if warc.headers["WARC-Type"] == "warcinfo":
                        continue
                    header, payload = http_parts(warc.block)
                    own, kind = http_field(header, ID_HEADER), warc.headers["WARC-Type"]
                    digest = warc.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind != "revisit" and sha1(payload) != digest:
                        raise ArcError(f"the payload of {warc.headers['WARC-Record-ID']} doesn't have its digest")
                    rows.append((warc.headers["WARC-Record-ID"], kind, None if own is None else int(own), None if kind == "revisit" else len(payload), digest, warc.headers.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    # parsed once; every record meets the response that it refers to, a response itself
    _read(spark, path).mapInArrow(parsed, "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, target string").write.parquet(f"{path}-read")
    found = spark.read.parquet(f"{path}-read").withColumn("target", F.coalesce("target", "record_id"))
    responses = found.where("record_type <> 'revisit'").select("target", F.col("page_id").alias("response_id"), F.col("payload_bytes").alias("known_bytes")).dropDuplicates(["target"])
    revisit = F.col("record_type") == "revisit"
    return found.join(responses, "target", "left").select("page_id", F.col("known_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, F.col("response_id")).alias("refers_to"))


def archive(pages: DataFrame, *, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC archives then hold."""
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    write_arc(pages, f"{path}/arc", **columns)
    known_records(spark, f"{path}/arc").write.parquet(f"{path}/known")
    convert(spark, f"{path}/arc", revisits(spark.read.parquet(f"{path}/known"), least_bytes=least_bytes), f"{path}/warc")
    return read_back(spark, f"{path}/warc")
