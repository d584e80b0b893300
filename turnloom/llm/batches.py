"""Arrow batches cut by bytes, so that the memory a step needs doesn't follow the number of rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.  A single longer text is handled alone.
CHUNK_BYTES = 2 << 20


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting; much faster on large arrays of numbers than the hash table of numpy."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def text_bytes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_chunks(batches: Iterator[pa.RecordBatch], *columns: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices with about ``size`` bytes in the given string columns."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = np.cumsum(sum(text_bytes(batch.column(c)) for c in columns))
        start = 0
        while start < n:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
