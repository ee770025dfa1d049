"""Inventory of input files: path, type, size, hash, and which reader takes each."""

from __future__ import annotations

import os
import stat
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import lookup

READERS = {"ooxml": ["xlsx", "xlsm"], "xls": ["xls"], "pdf": ["pdf"], "xml": ["xml", "gge", "mge"], "zip": ["zip"]}
UNSUPPORTED = "unsupported_or_not_yet_extracted"
#: Levels of folders; how many files and bytes a package may have is for the caller to say.
MAX_DEPTH = 64
SCHEMA = "path string, size_bytes long, sha256 string, extension string, reader string, content binary"
# Media types by extension.
MEDIA = {
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12", "xls": "application/vnd.ms-excel", "pdf": "application/pdf",
    "xml": "application/xml", "gge": "application/xml", "mge": "application/xml", "zip": "application/zip", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "csv": "text/csv", "json": "application/json",
}


class Rejected(ValueError):
    """The input isn't read; the message is a code, `locator` the entry."""

    def __init__(self, code: str, locator: str):
        super().__init__(code)
        self.locator = locator


def media_type(extension_: Column) -> Column:
    return F.coalesce(lookup(MEDIA, extension_), F.lit("application/octet-stream"))


def local(root: str) -> str | None:
    """The path of a file: address or a plain path; None for other schemes."""
    parts = urlsplit(root)
    return root if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


def preflight(root: str, max_files: int | None = None, max_bytes: int | None = None, max_depth: int = MAX_DEPTH) -> list[tuple[str, int]]:
    """(path below root, bytes) of all files of a local folder, or of the one file, by path; nothing is read.

    Links, and what is neither file nor folder, refuse the package, as do the limits. Other stores have no links.
    """
    path = local(root)
    if path is None:
        return []
    out: list[tuple[str, int]] = []
    todo = [(path, "", 0)]
    total = 0
    while todo:
        at, shown, depth = todo.pop()
        name = shown or os.path.basename(path.rstrip("/"))
        try:
            found = os.lstat(at)
            inside = sorted(os.listdir(at)) if stat.S_ISDIR(found.st_mode) else []
        except OSError as error:
            raise Rejected("input_directory_unreadable", name) from error
        if stat.S_ISLNK(found.st_mode):
            raise Rejected("input_symlink_forbidden", name)
        if stat.S_ISDIR(found.st_mode):
            if depth > max_depth:
                raise Rejected("input_directory_limit_exceeded", name)
            todo += [(os.path.join(at, n), f"{shown}/{n}" if shown else n, depth + 1) for n in inside]
        elif stat.S_ISREG(found.st_mode):
            total += found.st_size
            if (max_files is not None and len(out) >= max_files) or (max_bytes is not None and total > max_bytes):
                raise Rejected("input_directory_limit_exceeded" if shown else "input_file_limit_exceeded", name)
            out.append((name, found.st_size))
        else:
            raise Rejected("input_special_file_forbidden", name)
    return sorted(out)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def reader(path: Column) -> Column:
    """The reader of a file by its extension; contents aren't looked at."""
    return F.coalesce(lookup(READERS, extension(path)), F.lit(UNSUPPORTED))


def scan(spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Rows as SCHEMA for all files below root, folders followed; limits hold on the listing, before contents are read.

    Spark lists and reads what has bytes. It passes over empty files, so those are added from the listing of a local
    folder, and from the store's own elsewhere.
    """
    if local(root) is not None:
        base = os.path.abspath(local(root))
        single = os.path.isfile(base)
        empty = [f"file:{base}" if single else f"file:{base}/{n}" for n, size in preflight(root, max_files, max_bytes) if not size]
        some = any(size for _, size in preflight(root))
    else:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
        empty, n, size = [], 0, 0
        while listed.hasNext():
            f = listed.next()
            n, size = n + 1, size + f.getLen()
            if (max_files is not None and n > max_files) or (max_bytes is not None and size > max_bytes):
                raise Rejected("input_directory_limit_exceeded", root)
            if not f.getLen():
                empty.append(f.getPath().toString())
        some = size > 0
    files = spark.createDataFrame([(p, 0, bytearray()) for p in empty], "path string, length long, content binary")
    if some:
        full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.unionByName(full.select("path", "length", "content"))
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), extension(F.col("path")).alias("extension"), reader(F.col("path")).alias("reader"), "content")
