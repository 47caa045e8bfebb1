"""Helpers for the operators that compute inside Arrow tasks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SHIPPED: set[str] = set()
_ONE = threading.Lock()  # models are fitted from several threads


def ship(df: DataFrame) -> DataFrame:
    """Send this package to the executors, once for each application, so that their Python can import it: Spark's
    ``addPyFile`` copies the archive, which the driver removes when it ends."""
    sc = df.sparkSession.sparkContext
    with _ONE:
        if sc.applicationId not in _SHIPPED:
            root = Path(__file__).resolve().parents[1]
            folder = tempfile.mkdtemp(prefix="cohortflow-code-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            name = os.path.join(folder, f"{root.name}.zip")
            with zipfile.ZipFile(name, "w") as out:
                for p in sorted(root.rglob("*.py")):
                    out.write(p, p.relative_to(root.parent))
            sc.addPyFile(name)
            _SHIPPED.add(sc.applicationId)
    return df


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes: one value a row crosses between Spark and Python, not one an entry."""
    ends = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(col: pa.Array, dtype, width: int) -> np.ndarray:
    """The matrix of ``width`` columns that :func:`packed` has written (without nulls); a view where that can be."""
    if not len(col):
        return np.empty((0, width), dtype)
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype, len(col) * width, int(ends[0])).reshape(-1, width) if width else np.empty((len(col), 0), dtype)


def pack_rows(df: DataFrame) -> DataFrame:
    """``df`` with its first column, arrays of doubles of one length, as bytes."""
    def run(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([packed(x), *b.columns[1:]], names=b.schema.names)

    first, *rest = df.dtypes
    return ship(df).mapInArrow(run, ", ".join([f"{first[0]} binary", *(f"{c} {t}" for c, t in rest)]))


def runs(batch: pa.RecordBatch, columns) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that agree in ``columns`` (of whole numbers, without nulls)."""
    if not batch.num_rows:
        return []
    cut = np.zeros(batch.num_rows - 1, bool)
    for c in columns:
        x = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        cut |= x[1:] != x[:-1]
    ends = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
    return list(zip(ends, ends[1:], strict=False))
