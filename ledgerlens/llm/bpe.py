"""BPE encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding.

The file format is that of the tokenizers library. Two kinds of file are read: byte-level BPE, and BPE
with word ends, lower case and dropped white space.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, table

#: The Unicode White_Space characters.
SPACE = regex.compile(r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+")
CONTROL = regex.compile(r"[\x1C-\x1F]")
#: Distinct pieces whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 250_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary with merge ranks; encodes words and decodes ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) to (rank, id of both)
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        steps = spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]
        self.words = next((regex.compile(s["pattern"]["Regex"]) for s in steps if s["type"] == "Split"), None)
        self.first = [self.vocab.get(c) for c in self.letters]
        self.last = [self.vocab.get(c + self.end) for c in self.letters]
        self.texts = {i: t for t, i in {**self.vocab, **self.added}.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest rank merges first, the leftmost of equals."""
        ids = [self.first[b] for b in word]
        if self.end:
            ids[-1] = self.last[word[-1]]
        if None in ids:  # a letter that the vocabulary lacks gives no id
            ids = [i for i in ids if i is not None]
        n = len(ids)
        ranks = self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, both = heapq.heappop(queue)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:  # stale: a symbol has been merged since
                continue
            ids[i], ids[j] = both, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := ranks.get((both, ids[k])):
                    heapq.heappush(queue, (m[0], i, both, ids[k], m[1]))
            h = left[i]
            if h >= 0 and (m := ranks.get((ids[h], both))):
                heapq.heappush(queue, (m[0], h, ids[h], both, m[1]))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> list[int]:
        """Ids of a piece of text without white space."""
        out: list[int] = []
        at = 0
        for m in self.split.finditer(text) if self.split and "<" in text else ():
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letter by letter
        out: list[int] = []
        for w in self.words.findall(text.lower()):
            out += self.merge(w.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, with a space between; unknown ids have none."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker; the vocabulary serves its later tasks."""
    return Encoder(path)


class Encoder:
    """Encodes texts; the ids of a piece between white space are remembered."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; none for null."""
        known = self.known
        if not text:
            return b""
        # split() also splits at four control characters that aren't white space in Unicode's sense
        pieces = SPACE.split(text) if CONTROL.search(text) else text.split()
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = array("I", self.bpe.piece(p)).tobytes()
            return b"".join([known[p] for p in pieces])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows and rows without a doc_id stay, each with its ids.
    Further columns of docs are not read.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            ids = list(map(own.encode, b.column(1).to_pylist()))
            yield pa.record_batch({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary())})
        own.known.clear()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, ids binary")


def decoder(path: str):
    """A function from an array of ids to one of texts: the vocabulary's strings, in order."""
    bpe = load(path)
    names = pa.array([bpe.texts.get(i) for i in range(max(bpe.texts) + 1)], pa.string())

    def run(coded: pa.Array) -> pa.Array:
        raw = [x or b"" for x in coded.to_pylist()]
        ids = np.frombuffer(b"".join(raw), "<u4")
        if len(ids) and int(ids.max()) >= len(names):
            return pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in raw], pa.string())
        ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(ids))), " ")

    return run


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded (doc_id, ids) with `decoded`: the vocabulary's strings of the ids, in order."""
    path = path or default_path()
    small_batches(coded.sparkSession)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = decoder(path)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "ids": b.column(1), "decoded": texts(b.column(1))})

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def both_ways(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): what encode and decode make of each row's whole text, in one pass of one worker."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts = encoder(path), decoder(path)
        for b in batches:
            ids = pa.array(list(map(own.encode, b.column(1).to_pylist())), pa.binary())
            yield pa.record_batch({"doc_id": b.column(0), "ids": ids, "decoded": texts(ids)})
        own.known.clear()  # the worker goes on to other work

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digest(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and its ids if asked for."""
    return both_ways(docs, path=path).select(
        "doc_id",
        *(["ids"] if with_ids else []),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
