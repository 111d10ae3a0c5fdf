"""Views of Arrow columns that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corvane.storage import bound_batches

__all__ = ["batch", "bound_batches", "byte_view", "take"]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, offsets, valid)`` of a string column without copying the text; row i is bytes[offsets[i]:offsets[i+1]]."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets, np.asarray(column.is_valid())


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from Python or numpy columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def take(column: pa.Array, rows) -> pa.Array:
    """The rows of a column by number, as one array."""
    got = column.take(pa.array(rows, pa.int64()))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
