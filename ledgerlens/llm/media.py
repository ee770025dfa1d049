"""ISO media containers as columns: written losslessly, and walked without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, table

UNIT = 64  #: bytes that payloads are padded to, and bytes of a sample
CHUNK = 256  #: samples of a chunk
SYNC = 16  #: every so many samples, one is a sync sample
RATE = 8000  #: 8-bit values a second
DEPTH = 32  #: levels that boxes may nest
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, rows: list[int], width: int = 1, code: str = "I") -> bytes:
    return _full(kind, struct.pack(f">I{len(rows)}{code}", len(rows) // width, *rows))


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of the unit."""
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def mux(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit values, in samples of 64; equal payloads make equal files."""
    n = len(payload) // UNIT
    duration = n * UNIT
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0), b"isommp42")
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if len(payload) + 8 >= 1 << 32 else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(data)
    offsets = [first + i * CHUNK * UNIT for i in range(chunks)]
    wide = offsets[-1] >= 1 << 32
    last = n - (chunks - 1) * CHUNK
    runs = [1, CHUNK, 1] if last == CHUNK else [1, last, 1] if chunks == 1 else [1, CHUNK, 1, chunks, last, 1]
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    table_ = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _table(b"stts", [n, UNIT], 2),
        _table(b"stss", list(range(1, n + 1, SYNC))),
        _table(b"stsc", runs, 3),
        _full(b"stsz", struct.pack(">II", UNIT, n)),
        _table(b"co64", offsets, code="Q") if wide else _table(b"stco", offsets),
    )
    v = int(duration >= 1 << 32)
    times = lambda *x: struct.pack(">QQ" + "IQ" * v + "II" * (1 - v) if v else ">IIII", *x)
    span = times(0, 0, RATE, duration)
    track = struct.pack(">QQIIQ" if v else ">IIIII", 0, 0, 1, 0, duration)
    moov = _box(
        b"moov",
        _full(b"mvhd", span, struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=v),
        _box(
            b"trak",
            _full(b"tkhd", track, struct.pack(">8xHHHH", 0, 0, 0x100, 0), matrix, struct.pack(">II", 0, 0), version=v, flags=3),
            _box(
                b"mdia",
                _full(b"mdhd", span, struct.pack(">HH", 0x55C4, 0), version=v),
                _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"data\0"),
                _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table_),
            ),
        ),
    )
    return b"".join((head, data, payload, moov))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first, end) of the content of each box in order, nested ones too. Raises ValueError where a size doesn't fit, or boxes nest deeper than DEPTH."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        start, end, path = todo.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError(f"box cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        first = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"box cut off at {start}")
            size, first = struct.unpack_from(">Q", data, first)[0], start + 16
        elif size == 0:
            size = end - start
        if start + size > end or size < first - start:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        here = (*path, kind)
        yield here, first, start + size
        todo.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(here) == DEPTH:
                raise ValueError(f"boxes nest too deep at {start}")
            todo.append((first, start + size, here))


def _rows(data: bytes, at: int, end: int, width: int, code: str = "I") -> np.ndarray:
    """A sample table's rows as 64-bit integers."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width * struct.calcsize(code) > end:
        raise ValueError("a sample table doesn't fit its box")
    flat = np.frombuffer(data, f">u{struct.calcsize(code)}", n * width, at + 8)
    if n and int(flat.max()) >= 1 << 62:
        raise ValueError("a sample table holds impossible numbers")
    return flat.astype(np.int64).reshape(n, width)


def probe(data: bytes) -> list[dict]:
    """Tracks: codec, timescale, duration, samples, sync samples, byte ranges of keyframes and of all samples.

    Sizes, chunks and offsets come from the sample tables; no payload byte is read. A keyframe's range is
    that of its sample; ranges that touch are joined. Work and memory are bounded by the tables' bytes.
    """
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            t = tracks[-1]
            if kind == b"mdhd":
                v = data[at]
                t["timescale"], t["duration"] = struct.unpack_from(">IQ" if v else ">II", data, at + (20 if v else 12))
                if t["duration"] >= 1 << 63:
                    raise ValueError("a duration is impossible")
            elif kind == b"stsd":
                t["codec"] = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stss":
                t["stss"] = _rows(data, at, end, 1)[:, 0]
            elif kind == b"stsc":
                t["stsc"] = _rows(data, at, end, 3)
            elif kind in (b"stco", b"co64"):
                t["offsets"] = _rows(data, at, end, 1, "I" if kind == b"stco" else "Q")[:, 0]
            elif kind == b"stsz":
                fixed, n = struct.unpack_from(">II", data, at + 4)
                t["fixed"], t["samples"] = fixed, n
                if not fixed:
                    t["sizes"] = _rows(data, at + 4, end, 1)[:, 0]
    return [_track(t, len(data)) for t in tracks]


def _track(t: dict, length: int) -> dict:
    none = np.empty(0, np.int64)
    fixed, n, offsets, runs = t.get("fixed", 0), t.get("samples", 0), t.get("offsets", none), t.get("stsc", none.reshape(0, 3))
    first = runs[:, 0]
    if len(first) and (first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > len(offsets)):
        raise ValueError("runs of chunks don't rise")
    per = np.repeat(runs[:, 1], np.diff(np.append(first, len(offsets) + 1))) if len(first) else none
    until = np.cumsum(per)
    if len(per) != len(offsets) or (int(until[-1]) if len(until) else 0) != n:
        raise ValueError("samples don't fit their chunks")
    if fixed * n > length:
        raise ValueError("samples are larger than the file")
    ahead = None if fixed else np.concatenate([[0], np.cumsum(t.get("sizes", none))])  # bytes of all samples before one
    before = (lambda i: i * fixed) if fixed else (lambda i: ahead[i])
    base = before(until - per)
    starts, ends = offsets, offsets + before(until) - base
    if len(ends) and int(ends.max()) > length or (ahead is not None and int(ahead[-1]) > length):
        raise ValueError("samples don't fit the file")
    ranges = _joined(starts, ends)
    sync = t.get("stss")
    if sync is None:
        keyframes = ranges
    else:
        if len(sync) and (int(sync.min()) < 1 or int(sync.max()) > n):
            raise ValueError("a sync sample isn't there")
        chunk = np.searchsorted(until, sync - 1, side="right")
        at = offsets[chunk] + before(sync - 1) - base[chunk]
        keyframes = _joined(at, at + before(sync) - before(sync - 1))
    return {
        "codec": t.get("codec"), "timescale": t.get("timescale"), "duration": t.get("duration"), "samples": n, "sync": n if sync is None else len(sync),
        "keyframes": keyframes, "ranges": ranges,
    }


def _joined(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges in order, those that touch as one."""
    if not len(starts):
        return []
    fresh = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
    return list(zip(starts[fresh].tolist(), ends[np.append(fresh[1:], len(ends)) - 1].tolist(), strict=True))


RANGE = "array<struct<start:long,end:long>>"
TRACK = f"codec string, timescale long, duration long, samples long, sync long, keyframes {RANGE}, ranges {RANGE}"


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded, in a container. Null counts as empty.

    Every row of docs gives one row, repeated ones too; other columns are not read. Works row by row,
    without a shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(list(map(len, raw)), pa.int64()), "media": pa.array([mux(pad(x)) for x in raw], pa.binary())})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with the first track's metadata, the payload's digests and `error`.

    A file that can't be walked has a null track and says why in `error`.
    """
    small_batches(stored.sparkSession)

    def one(media: bytes) -> dict:
        out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
        try:
            track = next(iter(probe(media)), None)
            payload = b"".join(media[a:b] for a, b in track["ranges"]) if track else b""
        except (ValueError, struct.error, IndexError) as error:
            return out | {"error": str(error)}
        if track:
            spans = {k: [{"start": a, "end": b} for a, b in track[k]] for k in ("keyframes", "ranges")}
            out |= {"track": track | spans, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:])}
        return out

    extra = [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("track", None), ("error", pa.string())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("sync", pa.int64()), ("keyframes", span), ("ranges", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x or b"") for x in b.column(2).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": b.column(1)} | {n: pa.array([g.get(n) for g in got], t or kind) for n, t in extra})

    id_type = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, track struct<{', '.join(p.strip().replace(' ', ':', 1) for p in TRACK.split(', '))}>, error string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features(store(table(spark, sf_dir, "documents")))
    t = lambda n: F.col(f"track.{n}")
    keys = F.transform(t("keyframes"), lambda r: F.concat_ws("-", r["start"], r["end"]))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim(t("codec"))), F.concat(F.lit("duration="), t("duration"), F.lit("/"), t("timescale")), F.concat(F.lit("samples="), t("samples")), F.concat(F.lit("keyframes="), F.array_join(keys, ",")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
