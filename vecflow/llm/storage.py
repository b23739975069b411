"""Shared work folders: where operators keep tables and files that several tasks need.

Files are opened with the standard library for file: addresses and with pyarrow's file systems for
all others.
"""

from __future__ import annotations

import math
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..workspace import remove, stored, workdir  # noqa: F401 (the operators' way to the shared folder)

def local_path(uri: str) -> str | None:
    """The path of a file: address, None for any other scheme."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def opened(uri: str):
    """A file opened for reading; it can be read on, and sought."""
    if path := local_path(uri):
        with open(path, "rb") as f:
            yield f
        return
    system, path = _remote(uri)
    with system.open_input_file(path) as f:
        yield f


def file_size(uri: str) -> int:
    if path := local_path(uri):
        return os.path.getsize(path)
    system, path = _remote(uri)
    return system.get_file_info(path).size


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    if path := local_path(uri):
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(-1 if length is None else length)
    system, path = _remote(uri)
    with system.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


@contextmanager
def new_file(uri: str):
    """A file opened for writing under a temporary name, moved into place when all went well."""
    temporary = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path := local_path(uri):
        spare = local_path(temporary)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(spare, "wb") as f:
                yield f
            os.replace(spare, path)
        finally:
            if os.path.exists(spare):
                os.remove(spare)
        return
    system, path = _remote(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    _, spare = _remote(temporary)
    with system.open_output_stream(spare) as f:
        yield f
    system.move(spare, path)


def list_files(uri: str, suffix: str) -> list[str]:
    if path := local_path(uri):
        return sorted(f"{uri.rstrip('/')}/{x}" for x in os.listdir(path) if x.endswith(suffix))
    from pyarrow import fs

    system, path = _remote(uri)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(f"{uri.rstrip('/')}/{x.base_name}" for x in found if x.base_name.endswith(suffix))


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of df's size, from file sizes and statistics; nothing is run. None
    where it has nothing to go by."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def partitions_for(df: DataFrame, target_bytes: int) -> int:
    """So many partitions that each holds about target_bytes, and at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((plan_bytes(df) or 0) / target_bytes))
