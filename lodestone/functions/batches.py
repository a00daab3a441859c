"""Arrow batches within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column that are plain Python values at once (a longer value stands alone).
STEP_BYTES = 1 << 20


def in_steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most `limit` bytes of a column, so that what a worker makes of them doesn't
    grow with the batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        at, held = 0, 0
        for row, size in enumerate(sizes):
            if row > at and held + size > limit:
                yield batch.slice(at, row - at)
                at, held = row, 0
            held += size
        if at < len(sizes):
            yield batch.slice(at)
        pa.default_memory_pool().release_unused()  # a worker lives on for other tasks
