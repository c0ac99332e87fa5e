"""Files in the folder that driver and executors share, as tasks see it."""

from __future__ import annotations

import uuid


def open_store(uri: str):
    """(file system, path) of a folder's URI: file:, hdfs:, s3:, gs: or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def new_name(stem: str, end: str) -> str:
    """A name no other attempt of the same task uses: readers only know files that a finished task has named."""
    return f"{stem}-{uuid.uuid4().hex}.{end}"
