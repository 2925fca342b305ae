"""Building Arrow batches for mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows, and bytes of text, handled at once; bound a worker's memory. A longer text comes alone.
SLICE, SLICE_BYTES = 512, 16 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        if batch.num_rows <= rows and sum(c.nbytes for c in texts) <= size:
            if batch.num_rows:
                yield batch
            continue
        held = np.zeros(batch.num_rows, dtype=np.int64)
        for c in texts:
            held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(held)
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            end = min(max(at + 1, most), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of int64 from arrays of 64-bit values."""
    lengths = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))
