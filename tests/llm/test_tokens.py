import hashlib
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, crc32c, records

TEXTS = [
    "", "  ", None, "Hello   World", "Straße ΑΣ ΣΑΣ İstanbul ǅ", "it's I'VE don't <|endoftext|>x<|startoftext|> <|endoftex|>", "a\x1cb\x85c\xa0d​e　f",
    "é café ﬁ １２ ²³ ½ \U0001f600\U0001f1e9", "Å Å 한", "123 4.5e10 __init__ \r\n\t x", "x " * 20000, "y" * 3000, "a  b", " a", "a ", "a\n b", "a \nb",
    "'s 'S I've", "\n\n a", "a.\nB c's 'll", "日本語 текст Ёё ñ",
]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(bpe.default_path())
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (1, "twice", "x"), (1, "twice", "x")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest(df).collect()), key=str)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digest(df.limit(0)).count() == 0


def test_merge_order():
    m = bpe.load(bpe.default_path())
    assert m.decode(m.piece("hello")) == "hello</w>"
    assert bpe.Encoder(bpe.default_path()).encode(None) == b""


def test_crc32c():
    assert crc32c.crc32c_many([b"123456789", b"", b"a" * 100000])[0] == 0xE3069283
    rnd = np.random.default_rng(1)
    data = [rnd.bytes(n) for n in (0, 1, 3, 4, 63, 64, 65, 127, 128, 1000, 4097)]
    assert crc32c.crc32c_many(data).tolist() == [crc32c._plain(d) for d in data]


def test_record_files(spark, tmp_path):
    library = Tokenizer.from_file(records.default_path("byte_bpe_50k.json"))
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int").repartition(4)
    manifest = records.write(df, f"file://{tmp_path}/out", parts=3)
    got = records.read(spark, manifest).collect()
    start = 0
    ids = {}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
        ids.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4").tolist())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(v) for k, v in want.items()}
    m = manifest[0]
    assert records.parse(records.fetch(m["path"], m["index"], m["records"] - 1))[1][-4:] == b"\0\0\0\0"
    assert records.read(spark, records.write(df.limit(0), f"file://{tmp_path}/none", parts=2)).count() == 0


def test_broken_record_is_noticed(tmp_path):
    path = f"{tmp_path}/x"
    whole = records.frames([records.payload(7, struct.pack("<3I", 1, 2, 70000))])[0]
    assert records.parse(whole[12:-4]) == (7, struct.pack("<3I", 1, 2, 70000))
    for bad in (whole[:-1], whole[:14] + b"\xff" + whole[15:]):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            list(records.blocks(path))
