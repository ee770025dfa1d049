import base64
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from ledgerlens.llm import media, warc


def test_media_round_trip(spark):
    texts = ["", None, "a", "x" * 64, "é" * 5000, "word " * 40000]
    df = spark.createDataFrame([(i, t, b"c") for i, t in enumerate(texts)] + [(None, "a", b"c"), (2, "a", b"c")], "doc_id long, text string, media binary")
    got = media.features(media.store(df)).collect()
    assert len(got) == 8 and all(r.error is None for r in got)
    for r in got:
        raw = (texts[r.doc_id] if r.doc_id is not None else "a") or ""
        payload = raw.encode() + bytes(-len(raw.encode()) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.track.duration == len(payload) and r.track.samples * 64 == len(payload) and r.track.sync == -(-r.track.samples // 16)
    assert len({r.media_sha256 for r in got if (texts[r.doc_id] if r.doc_id is not None else "a") == "a"}) == 1
    assert media.features(media.store(df.limit(0))).count() == 0


def test_media_boxes():
    data = media.mux(media.pad(b"q" * 64 * 300))
    paths = [b"/".join(p) for p, _, _ in media.walk(data)]
    assert paths[:3] == [b"ftyp", b"mdat", b"moov"] and b"moov/trak/mdia/minf/stbl/stss" in paths
    t = media.probe(data)[0]
    assert t["codec"] == "raw " and t["keyframes"][0] == (32, 96) and len(t["keyframes"]) == 19 and t["ranges"] == [(32, 32 + 64 * 300)]
    with pytest.raises(ValueError):
        list(media.walk(data[:-5]))


def _box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_media_hostile_files(spark):
    """No file ends a job: each has its error, and a good one beside them is read."""
    good = media.mux(media.pad(b"q" * 64 * 300))
    nested = b""
    for _ in range(3000):
        nested = _box(b"moov", nested)
    stsz = lambda fixed, n: _box(b"stsz", struct.pack(">III", 0, fixed, n))
    track = lambda *tables: _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", b"".join(tables))))))
    stsc = _box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 4_000_000_000, 1))
    at = good.index(b"stss") + 12
    bad = [
        nested, track(stsz(1, 4_000_000_000), stsc, _box(b"stco", struct.pack(">III", 0, 1, 0))), track(stsz(64, 4_294_967_295)), good[:-5], good[:at] + struct.pack(">I", 0) + good[at + 4 :], good[:at] + struct.pack(">I", 999) + good[at + 4 :],
        track(stsz(0, 5)), track(_box(b"stsc", struct.pack(">IIIII", 0, 1, 0, 1, 1)), _box(b"stco", struct.pack(">III", 0, 1, 0)), stsz(1, 1)), track(_box(b"co64", struct.pack(">IIQ", 0, 1, (1 << 64) - 1))), b"\0" * 7,
    ]
    rows = [(i, 0, bytearray(x)) for i, x in enumerate([good, *bad])]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[0].error is None and got[0].payload_sha256 == hashlib.sha256(b"q" * 64 * 300).hexdigest()
    assert all(got[i].error and got[i].track is None for i in range(1, len(rows)))


def test_media_of_samples_of_own_sizes():
    sizes, per = [5, 0, 7, 300, 2, 9], [2, 1, 3]
    body = bytes(range(256)) * 2
    head, spans, chunks, i, at = _box(b"ftyp", b"isom"), [], [], 0, 100
    for n in per:
        chunks.append(at)
        for s in sizes[i : i + n]:
            spans.append((at, at + s))
            at += s
        at += 4  # chunks lie apart
        i += n
    stsc = _box(b"stsc", struct.pack(">II9I", 0, 3, 1, 2, 1, 2, 1, 1, 3, 3, 1))
    tables = [stsc, _box(b"stsz", struct.pack(">III6I", 0, 0, 6, *sizes)), _box(b"stco", struct.pack(">II3I", 0, 3, *chunks)), _box(b"stss", struct.pack(">II3I", 0, 3, 1, 4, 6))]
    data = head + _box(b"mdat", body) + _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", b"".join(tables))))))
    t = media.probe(data)[0]
    assert t["keyframes"] == [spans[0], spans[3], spans[5]] and t["ranges"] == [(100, 105), (109, 116), (120, 431)] and t["samples"] == 6


def test_warc_contract(spark, tmp_path):
    pages = [(5, "http://a", "same"), (3, "http://b", "same"), (9, "http://c c", ""), (1, None, None), (7, "u", "é" * 3000), (7, "u", "é" * 3000), (None, "n", "same"), (None, "n", "lonely"), *((100 + i, "hot", "hot") for i in range(60))]
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in pages], "page_id long, url string, html string, first string").repartition(3)
    manifest = warc.write(df, f"file://{tmp_path}/w")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, manifest).collect()), key=str)
    least = {}
    for p, _, h in pages:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = least.get(h or "")
        ref = None if first is None or first == p else first
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if ref is not None else "response", ref))
    assert got == sorted(want, key=str)
    with zipfile.ZipFile(manifest[0]["path"].removeprefix("file://")) as z:  # another reader accepts the archive
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    assert warc.write(df.limit(0), f"file://{tmp_path}/none") == []


def test_plain_zip_is_read():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/b", b"hello")
        z.writestr("c", b"world")
        z.comment = b"a comment PK\x05\x06"
    found = warc.members(buffer)
    at, n = found["c"]
    assert buffer.getvalue()[at : at + n] == b"world"
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no archive"))
