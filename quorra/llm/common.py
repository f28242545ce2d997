"""Helpers that the corpus operators share: shared-folder tables, words, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorra.sources.shared import fresh_dir, release, saved, shared_root  # noqa: F401

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents whose rows in a small table go to one file, about.
PER_FILE = 20_000


def parts(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))


def file_count(docs: DataFrame) -> int:
    """Files for a table with some small rows a document: a few for each core, more for many documents.

    On a local disk each file starts several short processes, which for a moment show their executor's whole memory.
    """
    return parts(docs.count(), PER_FILE, 4 * docs.sparkSession.sparkContext.defaultParallelism)


def as_long(column: F.Column) -> F.Column:
    return column.cast(T.LongType())


def open_shared(uri: str):
    """(filesystem, path) of a file or folder in the shared store; local and any store that Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write) -> int:
    """Write a file under a private name, then rename it: a repeated or speculative task leaves one whole file."""
    store, folder = open_shared(uri)
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden, compression=None) as out:
        write(out)
    store.move(hidden, f"{folder}/{name}")
    return store.get_file_info(f"{folder}/{name}").size
