"""What the operators share: shipping the code, the shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bucketlane.sources.shared import checkpoint  # noqa: F401
from bucketlane.sources.shared import folder as shared_dir  # noqa: F401

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = tempfile.mkdtemp(prefix="bucketlane-")  # the driver serves the file from here while the application lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "bucketlane_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the machine, as workers serve many stages one after the other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """run (batches to batches), which leaves its worker's memory tidy."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone, no row is cut."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi
