"""Converting legacy ARC archives to WARC records."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = b"\r\n"
_V1 = re.compile(r"^(\S.*?) (\S+) (\d{8,17}) (.*) (\d+)$")
_V2 = re.compile(r"^(\S.*?) (\S+) (\d{8,17}) (.*) (\S+) (\S+) (\S+) (\d+|-) (\S+) (\d+)$")
_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


@dataclass(frozen=True)
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    short: bool  # the archive ends before the declared length
    skipped: int = 0  # bytes before the header that belong to no record, blank lines left out


def _unpacked(data: bytes, step: int = 1 << 16) -> tuple[bytes, bool]:
    """The bytes of gzip members, one or many, as far as they can be had, and whether all of them could."""
    parts: list[bytes] = []
    while data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        at = 0
        try:
            while at < len(data) and not unzip.eof:
                parts.append(unzip.decompress(data[at : at + step]))
                at += step
        except zlib.error:
            return b"".join(parts), False
        if not unzip.eof:
            return b"".join([*parts, unzip.flush()]), False
        data = unzip.unused_data + data[at:]
    return b"".join(parts), not data.strip(b"\0\r\n ")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; gzip members, one or many, are unpacked.

    Where a member is damaged, records end with what came before; the last one is then ``short``, whatever length it has.

    The version that the file's first record states decides the header line's fields: five in version 1, ten in version 2. Blocks
    have exactly the declared length, whatever they hold. A URL or content type may contain blanks. Bytes where a header line
    should be and isn't are passed over up to the next line that is one, and counted as its ``skipped``. A header without version block is taken as version 1.
    """
    sound = True
    if data[:2] == b"\x1f\x8b":
        data, sound = _unpacked(data)
    version, at, skipped = 1, 0, 0
    held: ArcRecord | None = None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        head = line.startswith("filedesc:")
        match = None
        if line:
            match = _V1.match(line) if head or version == 1 else _V2.match(line) or _V1.match(line)
        if match is None:
            skipped += end - at if line else 0
            at = end + 1
            continue
        fields = match.groups()
        start, size = end + 1, int(fields[-1])
        block = data[start : start + size]
        if head:
            version = 2 if block[:1] == b"2" else 1
        if held is not None:
            yield held
        held = ArcRecord(at, fields[0], fields[1], fields[2], fields[3].strip(), block, len(block) < size, skipped)
        at, skipped = start + size, 0
    if held is not None:
        yield held if sound else replace(held, short=True)


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block) records; blanks in URLs are escaped."""
    body = f"{version} 0 archive\n{_FIELDS[version]}\n".encode()
    date = records[0][2] if records else "19960101000000"
    extra = f"200 - - 0 {name} " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode(), body]
    for url, ip, when, kind, block in records:
        url, kind = re.sub(r"\s", lambda m: f"%{ord(m.group()) & 255:02X}", url), re.sub(r"\s+", "", kind) or "no-type"
        digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
        extra = f"200 {digest} - {sum(map(len, out))} {name} " if version == 2 else ""
        out += [f"\n{url} {ip} {when} {kind} {extra}{len(block)}\n".encode(), block]
    return b"".join([*out, b"\n"])


def warc_date(date: str) -> str:
    """14-digit ARC date, or its prefix of 8 digits or more, as a WARC date; digits past the seconds are dropped."""
    d = date[:14].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, block_digest: str) -> str:
    """An identifier in the form of a name-based UUID of URL, date and block: converting again gives the same."""
    h = hashlib.md5(f"{url} {date} {block_digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-8{h[17:20]}-{h[20:]}>"


@dataclass(frozen=True)
class WarcRecord:
    record_id: str
    warc_type: str
    target_uri: str | None
    warc_date: str
    ip_address: str | None
    content_type: str
    block_digest: str
    payload_digest: str | None
    truncated: str | None
    block: bytes

    def to_bytes(self) -> bytes:
        named = (
            ("WARC-Type", self.warc_type), ("WARC-Record-ID", self.record_id), ("WARC-Date", self.warc_date), ("WARC-Target-URI", self.target_uri),
            ("WARC-IP-Address", self.ip_address), ("WARC-Block-Digest", self.block_digest), ("WARC-Payload-Digest", self.payload_digest),
            ("WARC-Truncated", self.truncated), ("Content-Type", self.content_type), ("Content-Length", str(len(self.block))),
        )
        head = b"".join(f"{k}: {v}\r\n".encode() for k, v in named if v is not None)
        return b"WARC/1.0\r\n" + head + CRLF + self.block + CRLF + CRLF


def to_warc(r: ArcRecord) -> WarcRecord:
    """The equivalent WARC record: warcinfo for the version block, response for HTTP and DNS answers, resource for the rest.

    Only a response to HTTP has a payload apart from its block, what follows the header's empty line. An address of 0.0.0.0
    or one without digits isn't known and is left out.
    """
    date, block = warc_date(r.date), _digest(r.block)
    ip = r.ip if re.fullmatch(r"[0-9a-fA-F.:]*\d[0-9a-fA-F.:]*", r.ip) and r.ip != "0.0.0.0" else None
    cut = "length" if r.short else None
    if r.url.startswith("filedesc:"):
        return WarcRecord(record_id(r.url, date, block), "warcinfo", None, date, None, "text/plain", block, None, cut, r.block)
    if re.match(r"https?://", r.url, re.I) and r.block[:5] == b"HTTP/":
        found = re.search(rb"\r?\n\r?\n", r.block)
        payload = r.block[found.end() :] if found else b""
        return WarcRecord(record_id(r.url, date, block), "response", r.url, date, ip, "application/http; msgtype=response", block, _digest(payload), cut, r.block)
    if r.url.lower().startswith("dns:"):
        return WarcRecord(record_id(r.url, date, block), "response", r.url, date, ip, "text/dns", block, block, cut, r.block)
    kind = r.content_type if r.content_type not in ("", "-", "no-type") else "application/octet-stream"
    return WarcRecord(record_id(r.url, date, block), "resource", r.url, date, ip, kind, block, block, cut, r.block)


WARC_SCHEMA = "archive string, arc_offset long, record_id string, warc_type string, target_uri string, warc_date string, ip_address string, content_type string, content_length long, block_digest string, payload_digest string, truncated string, skipped long, record binary"


def convert_archives(archives: DataFrame, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """WARC_SCHEMA rows, one for each record of each ARC file (name, bytes), ``record`` being the WARC record as written to a file.

    ``truncated`` says that the archive ends, or is damaged, within or after the record; ``skipped`` counts bytes before it that
    belong to none. One narrow pass; an archive is parsed by one task. The file's name may be any column's, others are ignored. Null and empty contents have no records; a null name stays null; repeated
    archives are converted each time. Equal records have equal identifiers.
    """
    names = [f.split()[0] for f in WARC_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                held = 0
                for r in parse_arc(data or b""):
                    w = to_warc(r)
                    raw = w.to_bytes()
                    rows.append((name, r.offset, w.record_id, w.warc_type, w.target_uri, w.warc_date, w.ip_address, w.content_type, len(w.block), w.block_digest, w.payload_digest, w.truncated, r.skipped, raw))
                    held += len(raw)
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return archives.select(F.col(name_col).cast("string").alias("n"), F.col(content_col).cast("binary").alias("c")).mapInArrow(run, WARC_SCHEMA)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [_ARROW[f.split()[1]] for f in WARC_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of ARC files below path, plain or gzipped."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def pack_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 1 << 20) -> DataFrame:
    """(path, content): ARC files of about ``archive_bytes`` that hold each page as an HTTP answer; even ids in version 1, odd ones in 2.

    The archive date is the id in seconds after the year 2000 began, modulo 2**31; null ids count as 0. A null page is an empty
    body. Pages without URL can't be archived and are left out. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            held: dict[int, list] = {1: [], 2: []}
            size = {1: 0, 2: 0}
            out: list[tuple[str, bytes]] = []
            for key, url, when, html in zip(*(c.to_pylist() for c in batch.columns)):
                body = (html or "").encode()
                version = 1 + (key or 0) % 2
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                held[version].append((url, "0.0.0.0", when, "text/html", block))
                size[version] += len(block)
                if size[version] >= archive_bytes:
                    made += 1
                    out.append((f"pages-{made:06d}.arc", arc_file(f"pages-{made:06d}.arc", version, held[version])))
                    held[version], size[version] = [], 0
                    if len(out) >= 4:
                        yield _two(out)
                        out = []
            for version, rows in held.items():
                if rows:
                    made += 1
                    out.append((f"pages-{made:06d}.arc", arc_file(f"pages-{made:06d}.arc", version, rows)))
            if out:
                yield _two(out)

    def _two(out: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out]), pa.array([c for _, c in out], pa.binary())], ["path", "content"])

    seconds = F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(1 << 31)), F.lit(0)) + 946684800
    when = F.date_format(F.timestamp_seconds(seconds), "yyyyMMddHHmmss")
    thin = pages.select(F.col(id_col).cast("long").alias("k"), F.col(url_col).cast("string").alias("u"), when.alias("w"), F.col(html_col).cast("string").alias("h")).where("trim(u) <> ''")
    return thin.mapInArrow(run, "path string, content binary")
