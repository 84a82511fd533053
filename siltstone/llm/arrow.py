"""Small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a kernel sees at once; temporaries are a few dozen times that.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most`` bytes of ``column``; one longer text stays whole."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_slices(df: DataFrame, column: str, schema: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE) -> DataFrame:
    """``mapInArrow`` with ``kernel`` on each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def list_column(ptr: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
