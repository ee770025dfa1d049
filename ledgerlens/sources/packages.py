"""ZIP packages: members as rows, with the safety limits and codes, nested archives to a fixed depth."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import cut
from ledgerlens.operators.tables import running_budget

ENTRIES, UNPACKED, MEMBER, RATIO, DEPTH = 2_000, 500 << 20, 100 << 20, 200, 3
SCHEMA = "path string, parent string, root string, depth int, size_bytes long, status string, code string, content binary"


def member_name(raw: str) -> str | None:
    """The name with forward slashes, without empty and single-dot components; null for absolute names, drives and names that lead up."""
    name = raw.replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if name.startswith("/") or (name[:1].isascii() and name[:1].isalpha() and name[1:3] == ":/") or not parts or ".." in parts:
        return None
    return "/".join(parts)


def collision_key(name: str) -> str:
    return unicodedata.normalize("NFC", name).casefold()


def _refusal(infos: list[zipfile.ZipInfo]) -> str | None:
    """Why a whole archive is refused, from its directory alone."""
    if len(infos) > ENTRIES:
        return "zip_limit_exceeded"
    seen: set[str] = set()
    total = 0
    for i in infos:
        name = member_name(i.filename)
        if name is None:
            return "zip_unsafe_path"
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            return "zip_symlink_forbidden"
        if i.flag_bits & 1:
            return "zip_encrypted_entry"
        key = collision_key(name)
        if key in seen:
            return "zip_path_collision"
        seen.add(key)
        total += i.file_size
        if i.file_size > MEMBER or total > UNPACKED or i.file_size > RATIO * max(1, i.compress_size):
            return "zip_limit_exceeded"
    return None


def members(content: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, content, code) of an archive's files; one row with a code if it is refused or broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if code := _refusal(infos):
                yield None, None, code
                return
            for i in infos:
                if i.is_dir():
                    continue
                with z.open(i) as f:
                    data = f.read(MEMBER + 1)
                if len(data) != i.file_size:
                    yield member_name(i.filename), None, "zip_size_mismatch"
                else:
                    yield member_name(i.filename), data, None
    except (zipfile.BadZipFile, NotImplementedError, EOFError, OSError, RuntimeError):
        yield None, None, "zip_invalid"


def _opened(archives: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, root, depth, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for name, data, code in members(content or b""):
                    where = path if name is None else f"{path}!/{name}"
                    yield pa.RecordBatch.from_pylist([{"path": where, "parent": path, "root": root, "depth": depth + 1, "size_bytes": len(data or b""), "status": "rejected" if code else "reliable", "code": code, "content": data}], kind)

    kind = pa.schema([("path", pa.string()), ("parent", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("size_bytes", pa.int64()), ("status", pa.string()), ("code", pa.string()), ("content", pa.binary())])
    return archives.select("path", "root", "depth", "content").mapInArrow(run, SCHEMA)


def expand(files: DataFrame, budget: int = UNPACKED) -> DataFrame:
    """Members of the ZIP files of files (path, content), to DEPTH levels; rows as SCHEMA.

    Archives deeper than that are kept and say so. Once the members of a root archive, in order of path, use
    up the budget of bytes or the number of entries, the rest is rejected.
    """
    level = files.where(F.lower("path").endswith(".zip")).select("path", F.col("path").alias("root"), F.lit(0).alias("depth"), "content")
    found = []
    for _ in range(DEPTH):
        got = cut(_opened(level))  # read by the next level, the budget and the result, but unpacked once
        found.append(got)
        level = got.where(F.lower("path").endswith(".zip") & F.col("code").isNull())
    out = reduce(DataFrame.unionByName, found)
    deep = F.lower("path").endswith(".zip") & (F.col("depth") == DEPTH) & F.col("code").isNull()
    out = out.withColumns({"code": F.when(deep, "zip_nesting_limit").otherwise(F.col("code")), "status": F.when(deep, "not_inspected").otherwise(F.col("status"))})
    spent = running_budget(out.drop("content"), "root", ["path"], "size_bytes", budget, ENTRIES).select("path", F.col("accepted"))
    over = ~F.col("accepted") & F.col("code").isNull()
    out = out.join(spent, "path")
    return out.withColumns({"code": F.when(over, "zip_global_limit_exceeded").otherwise(F.col("code")), "status": F.when(over, "rejected").otherwise(F.col("status")), "content": F.when(over, F.lit(None)).otherwise(F.col("content"))}).drop("accepted")
