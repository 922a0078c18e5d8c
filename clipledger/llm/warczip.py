"""WARC records in ZIP archives: written per task, read by ranges without extraction.

An archive holds two stored members: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdx``, one JSON line per record with its place in the first. The reader finds both
from the end of the archive alone: end record, ZIP64 record where there is one, central directory.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm.common import slices, text_or_empty
from clipledger.session import scratch_path, store
from clipledger.sources.files import resolve

MIN_REVISIT = 100
# Stored payload after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
# Bytes fetched by one range read.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DOS_EPOCH = 0x21


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


# --- writing -------------------------------------------------------------------------------------


def _zip64(values: list[int], always: bool) -> tuple[list[int], bytes]:
    """Header fields for ``values``, and the extra field that holds those that do not fit."""
    large = [always or v >= FULL32 for v in values]
    body = b"".join(struct.pack("<Q", v) for v, big in zip(values, large) if big)
    extra = struct.pack("<HH", 1, len(body)) + body if body else b""
    return [FULL32 if big else v for v, big in zip(values, large)], extra


def local_header(name: str, crc: int, size: int, zip64: bool = False) -> bytes:
    (packed, whole), extra = _zip64([size, size], zip64)
    raw = name.encode()
    fixed = struct.pack(
        "<4sHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, DOS_EPOCH, crc, packed, whole, len(raw), len(extra)
    )
    return fixed + raw + extra


def central_directory(members: list[Member], begin: int, zip64: bool = False) -> bytes:
    out = b""
    for m in members:
        (size, packed, header), extra = _zip64([m.size, m.packed, m.header], zip64)
        raw = m.name.encode()
        out += struct.pack(
            "<4sHHHHHHIIIHHHHHII",
            CENTRAL, 45, 45, 0x800, m.method, 0, DOS_EPOCH, m.crc, packed, size,
            len(raw), len(extra), 0, 0, 0, 0, header,
        ) + raw + extra
    count, size, wide = len(members), len(out), zip64
    if wide or count >= FULL16 or size >= FULL32 or begin >= FULL32:
        place = begin + size
        out += struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, begin)
        out += struct.pack("<4sIQI", LOCATOR64, 0, place, 1)
        count, size, begin = FULL16, FULL32, FULL32
    return out + struct.pack("<4sHHHHIIH", END, 0, 0, count, count, size, begin, 0)


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has no block. Control characters of the address are escaped."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes one archive front to back. The file appears under its name only when closed."""

    def __init__(self, folder: str, zip64: bool = False) -> None:
        self.system, inner = resolve(folder)
        self.system.create_dir(inner, recursive=True)
        self.path, self.inner = f"{folder}/{uuid.uuid4().hex}.wacz", inner
        self.held, self.index, self.offset, self.zip64 = [], [], 0, zip64

    def add(self, page_id, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.offset, "length": len(packed)}))
        self.held.append(packed)
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        index = "".join(line + "\n" for line in self.index).encode()
        members, place = [], 0
        with self.system.open_output_stream(f"{self.inner}/{self.path.rsplit('/', 1)[1]}") as out:
            for name, parts in ((DATA, self.held), (INDEX, [index])):
                crc, size = 0, 0
                for part in parts:
                    crc, size = zlib.crc32(part, crc), size + len(part)
                head = local_header(name, crc, size, self.zip64)
                out.write(head)
                for part in parts:
                    out.write(part)
                members.append(Member(name, 0, crc, size, size, place))
                place += len(head) + size
            tail = central_directory(members, place, self.zip64)
            out.write(tail)
        return self.path, place + len(tail), len(self.index)


def write_archives(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Archives of ``pages`` (page_id, url, payload, digest, refers_to): rows (path, bytes, records).

    Runs once, as its rows are written to the shared folder: they name the archives of tasks that
    ended well, and what a lost task left behind is in none of them.
    """
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches):
        writer, done = None, []
        for batch in batches:
            for rows in slices(batch, "payload"):
                columns = [rows.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
                for i in range(rows.num_rows):
                    page, url, payload, digest, refers = (c[i].as_py() for c in columns)
                    writer = writer or ArchiveWriter(folder, zip64)
                    writer.add(page, warc_record(page, url, payload, digest, refers))
                    if writer.offset >= ARCHIVE_BYTES:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema
        )

    return store(pages.mapInArrow(run, "path string, bytes bigint, records bigint"), "wacz-paths")


# --- reading -------------------------------------------------------------------------------------


def read_members(file, size: int) -> list[Member]:
    """The central directory of an archive: only its end is read."""
    tail_size = min(size, 22 + FULL16)
    file.seek(size - tail_size)
    tail = file.read(tail_size)
    at = tail.rfind(END, 0, max(0, tail_size - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive: no end record")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, begin):
        file.seek(size - tail_size + at - 20)
        mark, _, place, _ = struct.unpack("<4sIQI", file.read(20))
        if mark == LOCATOR64:
            file.seek(place)
            record = file.read(56)
            if record[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            count, length, begin = struct.unpack_from("<QQQ", record, 32)
    file.seek(begin)
    raw = file.read(length)
    members, at = [], 0
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, crc, packed, whole = struct.unpack_from("<H4xIII", raw, at + 10)
        name_size, extra_size, note_size = struct.unpack_from("<HHH", raw, at + 28)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + name_size].decode()
        extra = raw[at + 46 + name_size : at + 46 + name_size + extra_size]
        # The ZIP64 field holds, in this order, those values that are full.
        values, wide = [whole, packed, header], iter(_zip64_values(extra))
        whole, packed, header = (next(wide, v) if v == FULL32 else v for v in values)
        members.append(Member(name, method, crc, packed, whole, header))
        at += 46 + name_size + extra_size + note_size
    return members


def _zip64_values(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def member_place(file, member: Member) -> int:
    """Where the bytes of a stored member begin; the local header has its own lengths."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def read_index(file, size: int) -> list[tuple[int, int]]:
    """(place in the archive, length) of every record that the index members list."""
    members = {m.name: m for m in read_members(file, size)}
    place = member_place(file, members[INDEX])
    base = member_place(file, members[DATA])
    file.seek(place)
    lines = file.read(members[INDEX].size).decode().splitlines()
    found = [json.loads(line) for line in lines if line]
    return [(base + x["offset"], x["length"]) for x in found]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _page(value: str | None) -> int | None:
    found = _PAGE.fullmatch(value or "")
    return int(found[1]) if found else None


RECORD = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, bytes), read by ranges of about RANGE_BYTES.

    One task reads the index of an archive; its records are then dealt out in ranges, so a large
    archive is read by many tasks. A response is checked against its digest.
    """
    spans = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def index(batches):
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist()):
                system, inner = resolve(path)
                with system.open_input_file(inner) as file:
                    places = read_index(file, size)
                rows, held = [], None
                for begin, length in places:
                    if held and held[1] + sum(held[2]) == begin and sum(held[2]) < RANGE_BYTES and len(held[2]) < 4096:
                        held[2].append(length)
                    else:
                        held = [path, begin, [length]]
                        rows.append(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(spans)], schema=spans
                )

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def records(batches):
        for batch in batches:
            for path, begin, lengths in zip(*(batch.column(n).to_pylist() for n in spans.names)):
                system, inner = resolve(path)
                with system.open_input_file(inner) as file:
                    file.seek(begin)
                    raw = file.read(sum(lengths))
                out, at = [], 0
                for length in lengths:
                    fields, block = parse_record(gzip.decompress(raw[at : at + length]))
                    at += length
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind = fields["warc-type"]
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"damaged record in {path}")
                    out.append(
                        (
                            _page(fields["warc-record-id"]),
                            fields["warc-target-uri"],
                            block if payload else None,
                            int(fields["x-payload-length"]),
                            digest,
                            kind,
                            _page(fields.get("warc-refers-to")),
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names
                )

    spread = archives.select("path", "bytes").repartition("path").mapInArrow(
        index, "path string, begin bigint, lengths array<bigint>"
    )
    return spread.repartition("path", "begin").mapInArrow(records, RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and return their paths.

    Of equal payloads of MIN_REVISIT bytes or more, the smallest page_id is a response and the
    others revisit it; shorter payloads are all responses. Only digests are compared; pages meet
    their verdict by page and digest. A null html is an empty payload, a null url an empty
    address. Rows that repeat page_id and html are all of one kind. Null page_ids are responses
    unless a page with an id has the same payload. An empty table writes no archive; other columns
    are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(text_or_empty("html"), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(
        F.col("n") >= MIN_REVISIT
    )
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = groups.filter("n > 1 and first is not null").select("digest", "first")
    again = (
        slim.select("page_id", "digest")
        .join(firsts, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .distinct()
        .select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first").alias("refers_to"))
    )
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    return write_archives(
        marked.select("page_id", "url", "payload", "digest", "refers_to"), folder or scratch_path(spark, "wacz")
    )
