"""WARC records in ZIP-packaged archives: written with revisits, and read by range without extraction.

An archive is a ZIP file of stored members: archive/data.warc.gz with one gzip member per record, and
indexes/index.cdx with a line "page_id offset length" per record. Sizes and offsets are always in ZIP64
fields, so an archive may pass 4 GB.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, saved, scratch, small_batches, table
from ledgerlens.llm.files import read_from, write_to

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads below this size are never revisits.
LEAST = 0
DATE = "1970-01-01T00:00:00Z"
END, END64, LOCATOR, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
FULL = 0xFFFFFFFF


class ZipWriter:
    """Writes stored members one after another; sizes follow each in a descriptor, so nothing is held back."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        self.name, self.began, self.crc, self.size = raw, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL, FULL, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self._put(data)
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)

    def finish(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.began))

    def close(self) -> None:
        first = self.at
        for name, crc, size, began in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, began)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, FULL, FULL, len(name), len(extra), 0, 0, 0, 0, FULL) + name + extra)
        size, end = self.at - first, self.at
        n = len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, first))
        self._put(struct.pack("<IIQI", LOCATOR, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, FULL, FULL, 0))


def members(f) -> dict[str, tuple[int, int]]:
    """Name to (offset, size) of each stored member's bytes, from the central directory, ZIP64 or not."""
    f.seek(0, 2)
    length = f.tell()
    back = min(length, 22 + 0xFFFF)
    f.seek(length - back)
    tail = f.read(back)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, size, first = struct.unpack_from("<HII", tail, at + 10)
    if FULL in (size, first) or count == 0xFFFF:
        f.seek(length - back + at - 20)
        sign, _, where, _ = struct.unpack("<IIQI", f.read(20))
        if sign != LOCATOR:
            raise ValueError("no ZIP64 locator")
        f.seek(where)
        head = f.read(56)
        if struct.unpack_from("<I", head)[0] != END64:
            raise ValueError("no ZIP64 end record")
        count, size, first = struct.unpack_from("<QQQ", head, 32)
    f.seek(first)
    central, at, out = f.read(size), 0, {}
    for _ in range(count):
        sign, _, _, flags, method, _, _, _, packed, full, n, extra, note, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", central, at)
        if sign != CENTRAL:
            raise ValueError("a central directory entry is broken")
        name = central[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, end = at + 46 + n, at + 46 + n + extra
        while more + 4 <= end:
            tag, span = struct.unpack_from("<HH", central, more)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{span // 8}Q", central, more + 4))
                full = next(wide) if full == FULL else full
                packed = next(wide) if packed == FULL else packed
                where = next(wide) if where == FULL else where
            more += 4 + span
        at = end + note
        if method == 0:
            f.seek(where)
            head = f.read(30)
            if struct.unpack_from("<I", head)[0] != LOCAL:
                raise ValueError(f"{name}: no local header")
            out[name] = (where + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    lines += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record by lower-case name, its type and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = http.decode("latin-1")
    out["payload"] = payload
    return out


def originals(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = LEAST) -> DataFrame:
    """(payload_sha1, first, copies) of each payload that several pages have: `first` is the smallest page_id.

    Minima are taken before the shuffle. Of rows that repeat the smallest page_id, all are responses. Pages
    without an id are responses, unless another with an id has their payload.
    """
    own = pages.select(F.col(page_id).alias("page_id"), _sha1(html).alias("payload_sha1"), _size(html).alias("size"))
    own = own.where(F.col("size") >= least).drop("size")
    classes = own.groupBy("payload_sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    return classes.where("copies > 1 AND first IS NOT NULL")


def _payload(html: str):
    return F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))


def _sha1(html: str):
    return F.sha1(_payload(html))


def _size(html: str):
    return F.octet_length(_payload(html))


def write(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> list[dict]:
    """Writes one archive per partition under `out`; returns [{path, records}], those of successful attempts only.

    Null html is an empty payload. Further columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), _payload(html).alias("payload"), _sha1(html).alias("payload_sha1"))
    classes = saved(originals(pages, page_id, html, least))
    rows = attach(rows, classes, "payload_sha1", "copies")
    ref = F.when(F.col("first").eqNullSafe(F.col("page_id")) | (F.length("payload") < least), None).otherwise(F.col("first"))
    rows = rows.select("page_id", "url", "payload", ref.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{out}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        zipped, f, lines, at = None, None, [], 0
        for b in batches:
            for page, where, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if zipped is None:
                    f = write_to(path)
                    zipped = ZipWriter(f)
                    zipped.start(DATA)
                kind = "response" if refers is None else "revisit"
                coder = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = coder.compress(warc_record(kind, page, where, payload, refers)) + coder.flush()
                zipped.write(member)
                lines.append(f"{'-' if page is None else page} {at} {len(member)}\n")
                at += len(member)
        if zipped is not None:
            zipped.finish()
            zipped.start(INDEX)
            zipped.write("".join(lines).encode())
            zipped.finish()
            zipped.close()
            f.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": len(lines)}])

    return [r.asDict() for r in rows.mapInArrow(run, "path string, records long").collect()]


def records(uri: str) -> Iterator[dict]:
    """Records of an archive: each is range-read by the index, nothing is extracted."""
    with read_from(uri) as f:
        there = members(f)
        start, size = there[INDEX]
        f.seek(start)
        index = f.read(size).decode().splitlines()
        base, _ = there[DATA]
        for line in index:
            _, at, n = line.split(" ")
            f.seek(base + int(at))
            yield parse(zlib.decompress(f.read(int(n)), 31))


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each record, one task per archive.

    A response's digest and length are those of its payload as read, and must equal its header; a revisit's
    come from its header, since its payload is elsewhere.
    """
    small_batches(spark)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def row(r: dict) -> dict:
        stated = r["warc-payload-digest"].removeprefix("sha1:")
        whole = int(re.search(r"Content-Length: (\d+)", r["http"])[1])
        here = r["warc-type"] == "response"
        if here and (digest(r["payload"]) != stated or len(r["payload"]) != whole):
            raise ValueError(f"page {r.get('x-page-id')}: the payload isn't the one written")
        number = lambda k: int(r[k]) if k in r else None
        return {"page_id": number("x-page-id"), "url": r["warc-target-uri"], "record_type": r["warc-type"], "payload_bytes": whole, "payload_digest": stated, "refers_to": number("x-refers-to-page-id"), "payload": r["payload"] if here else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in map(row, records(path)):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 512 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

    files = spark.createDataFrame([(m["path"],) for m in manifest], "path string").repartition(max(1, len(manifest)))
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
