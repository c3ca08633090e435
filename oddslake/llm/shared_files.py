"""Arrays in the folder that all executors share, memory-mapped where they are read.

Tasks write raw arrays under a name that follows from their content's place, first beside it and
then by a rename, so a repeated task leaves the same file. A worker maps a local path as it is; from a
store without paths it copies the file to a nameless local one first.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from oddslake.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).view(np.uint8).data)
    fs.move(draft, f"{base}/{name}")


@lru_cache(maxsize=100_000)
def mapped_array(folder: str, name: str, kind: str) -> np.ndarray:
    """A read-only view of a written array; pages are loaded as they are looked at."""
    fs, base = _open(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype=kind, mode="r") if os.path.getsize(f"{base}/{name}") else np.empty(0, kind)
    with fs.open_input_stream(f"{base}/{name}") as source, tempfile.TemporaryFile() as copy:
        while block := source.read(16 << 20):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype=kind, mode="r") if copy.tell() else np.empty(0, kind)
