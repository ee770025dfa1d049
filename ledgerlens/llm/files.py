"""Opens files of shared storage by URI, on the driver or an executor."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlsplit


def local(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for other schemes."""
    parts = urlsplit(uri)
    return uri if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


def _other(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_to(uri: str) -> BinaryIO:
    """A new file for writing; its folder is made."""
    if path := local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    system, path = _other(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def read_from(uri: str) -> BinaryIO:
    """A file for reading, with seek and tell."""
    if path := local(uri):
        return open(path, "rb")
    system, path = _other(uri)
    return system.open_input_file(path)
