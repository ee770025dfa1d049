"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record is: length (8 bytes), masked CRC-32C of those (4), payload, masked CRC-32C of the payload (4), all
little-endian. A payload is one flag byte, the doc_id (8 bytes) and the ids, of 2 bytes each where all fit,
else 4. The index beside each file holds offset and length of each record (8 bytes each), so a reader can
fetch records in any order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import default_path
from ledgerlens.llm.common import scratch, small_batches, table
from ledgerlens.llm.crc32c import masked_many
from ledgerlens.llm.files import read_from, write_to

NO_ID, NARROW = 1, 2
#: Distinct pieces that a worker remembers.
REMEMBERED = 1_000_000
#: Bytes that a reader or writer holds at once, besides one record.
BLOCK = 8 << 20
#: A text with a space beside other white space, at an end, or with an added token, is coded as a whole.
ODD = r"[ ][\s\x0B\x{85}\p{Z}]|[\s\x0B\x{85}\p{Z}][ ]|^ | $|<\|"


class LibraryEncoder:
    """Byte-level BPE by the tokenizers library, each distinct piece between spaces coded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        vocab = self.library.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True  # the letter that stands for a space

    def _code(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Codes pieces as one text, each after a space: the one token of each that starts with a space begins it."""
        raw = self._code([" " + " ".join(pieces)])[0]
        starts = np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])
        if len(starts) == len(pieces):
            bounds = [*(starts * 4).tolist(), len(raw)]
            self.known.update((p, raw[a:b]) for p, a, b in zip(pieces, bounds[:-1], bounds[1:], strict=True))
        else:
            self.known.update(zip(pieces, self._code([" " + p for p in pieces]), strict=True))

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        In a text where spaces stand alone, a piece and the space before it are coded alike wherever they
        stand, since no token of the pattern goes across a space that other text follows.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for text, whole in zip(texts.to_pylist(), odd, strict=True):
            if whole:
                out += self._code([text])
                continue
            head, *rest = text.split(" ")
            try:
                ids = b"".join([known[p] for p in rest])
            except KeyError:
                new = list({p for p in rest if p not in known})
                self._learn(new)
                ids = b"".join([known[p] for p in rest])
            first = self.heads.get(head)
            if first is None:
                if len(self.heads) > REMEMBERED:
                    self.heads.clear()
                first = self.heads[head] = self._code([head])[0]
            out.append(first + ids)
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def payload(doc_id: int | None, ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    flags = (NO_ID if doc_id is None else 0) | (NARROW if narrow else 0)
    return struct.pack("<Bq", flags, doc_id or 0) + (wide.astype("<u2").tobytes() if narrow else ids)


def parse(data: bytes) -> tuple[int | None, bytes]:
    """doc_id, and the ids as little-endian unsigned 32-bit integers."""
    flags, doc_id = struct.unpack_from("<Bq", data)
    ids = np.frombuffer(data, "<u2" if flags & NARROW else "<u4", offset=9).astype("<u4").tobytes()
    return None if flags & NO_ID else doc_id, ids


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = zip(heads, masked_many(heads), payloads, masked_many(payloads), strict=True)
    return [b"".join((h, struct.pack("<I", c), p, struct.pack("<I", d))) for h, c, p, d in sums]


def blocks(uri: str) -> Iterator[list[bytes]]:
    """Payloads of a file in order, some at a time; raises where a checksum doesn't hold."""
    with read_from(uri) as f:
        kept, size = [], 0
        while True:
            head = f.read(12)
            if head:
                if len(head) < 12:
                    raise ValueError(f"{uri}: cut off")
                n = struct.unpack_from("<Q", head)[0]
                body = f.read(n + 4)
                if len(body) < n + 4:
                    raise ValueError(f"{uri}: cut off")
                kept.append((head, body))
                size += n
            if kept and (not head or size >= BLOCK):
                heads, data = [h[:8] for h, _ in kept], [bytes(b[:-4]) for _, b in kept]
                if [struct.unpack("<I", h[8:])[0] for h, _ in kept] != masked_many(heads) or [struct.unpack("<I", b[-4:])[0] for _, b in kept] != masked_many(data):
                    raise ValueError(f"{uri}: a checksum doesn't hold")
                yield data
                kept, size = [], 0
            if not head:
                return


def fetch(uri: str, index_uri: str, n: int) -> bytes:
    """The payload of the nth record by the index alone."""
    with read_from(index_uri) as f:
        f.seek(16 * n)
        at, size = struct.unpack("<QQ", f.read(16))
    with read_from(uri) as f:
        f.seek(at)
        return f.read(size)[12:-4]


def write(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, parts: int | None = None) -> list[dict]:
    """Encodes docs, appends id 0 to each, and writes record files in ascending doc_id order under `out`.

    Returns the manifest: one entry (part, path, index, records, ids) per file, in order. Texts are dealt
    into ranges of (doc_id, hash of text, row), so rows that share a doc_id spread over ranges; they are
    encoded after the shuffle, in one pass with the writing. A task that runs again writes new files; the
    manifest names those of the successful attempt only. Rows without a doc_id come first. Null texts have
    the end id alone.
    """
    spark = docs.sparkSession
    path = path or default_path("byte_bpe_50k.json")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{out}/part-{part:06d}-{uuid.uuid4().hex}"
        data = index = None
        at = records = total = 0
        own = library(path)
        for b in batches:
            if data is None:
                data, index = write_to(f"{name}.records"), write_to(f"{name}.index")
            ids = [x + b"\0\0\0\0" for x in own.batch(b.column(1))]
            framed = frames([payload(d, x) for d, x in zip(b.column(0).to_pylist(), ids, strict=True)])
            for x in framed:
                index.write(struct.pack("<QQ", at, len(x)))
                at += len(x)
            data.write(b"".join(framed))
            records += len(framed)
            total += sum(map(len, ids)) // 4
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{name}.records", "index": f"{name}.index", "records": records, "ids": total}])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")
    made = rows.mapInArrow(run, "part long, path string, index string, records long, ids long").collect()
    return [r.asDict() for r in sorted(made, key=lambda r: r["part"])]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each record: start is the number of ids before it. One task per file."""
    small_batches(spark)
    ahead, todo = 0, []
    for m in manifest:
        todo.append((m["path"], ahead))
        ahead += m["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                start = r["ahead"]
                for data in blocks(r["path"]):
                    ids, texts, starts = [], [], []
                    for d, x in map(parse, data):
                        ids.append(d)
                        texts.append(x)
                        starts.append(start)
                        start += len(x) // 4
                    yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in texts], pa.int64()), "ids": pa.array(texts, pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64())})

    files = spark.createDataFrame(todo, "path string, ahead long").repartition(max(1, len(todo)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files, at most one per partition, is all that the driver holds."""
    manifest = write(table(spark, sf_dir, "documents"), scratch(spark, "records"))
    return read(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
