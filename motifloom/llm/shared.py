"""Files that the driver and every executor see.

Everything lies in the folder that motifloom.storage names. Arrays are written
whole under a name of their own and then renamed, so a task that runs twice leaves
the same file. Paths on the local file system are memory-mapped in place; others
are first copied to an unnamed local file.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, shared_dir
from ..storage import stored as saved

__all__ = ["discard", "free_name", "lean", "map_array", "saved", "shared_dir", "short_slices", "small", "write_array"]

Batches = Iterator[pa.RecordBatch]


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores, as a name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small(df: DataFrame, most: int) -> DataFrame:
    """df for a join: sent to all tasks if its rows take no more than `most` bytes there, measured."""
    width = F.lit(16)
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        width += F.coalesce(F.octet_length(name), F.lit(0)) + 16 if isinstance(field.dataType, T.StringType | T.BinaryType) else F.lit(16)
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow; a worker, which outlives its tasks, gives back at the end of each what that freed."""

    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return out


def short_slices(batch: pa.RecordBatch, text: int, most: int = 2_000_000) -> Batches:
    """All rows of batch, in runs of about `most` bytes in column `text` or one longer text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _uri(uri: str) -> str:
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_array(uri: str, array: np.ndarray) -> None:
    fs, path = _place(_uri(uri))
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        np.lib.format.write_array_header_1_0(out, np.lib.format.header_data_from_array_1_0(array))
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    fs.move(part, path)


@lru_cache(maxsize=4096)
def map_array(uri: str) -> np.ndarray:
    """The array, memory-mapped read-only."""
    fs, path = _place(_uri(uri))
    if isinstance(fs, pafs.LocalFileSystem):
        return _mapped(path)
    with tempfile.NamedTemporaryFile(suffix=".npy") as own:  # the mapping outlives the name
        with fs.open_input_stream(path) as source:
            while piece := source.read(1 << 22):
                own.write(piece)
        own.flush()
        return _mapped(own.name)


def _mapped(path: str) -> np.ndarray:
    if os.path.getsize(path) > 128:
        return np.load(path, mmap_mode="r")
    return np.load(path)  # nothing to map in an empty array
