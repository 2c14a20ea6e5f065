"""Arrow batches of bounded text, so that numpy's working arrays stay small beside an executor's heap."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text; a longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.diff(np.frombuffer(col.cast(pa.large_string()).buffers()[1], np.int64, len(col) + 1, 0)) if col.offset == 0 else \
            np.array([len(x.as_buffer()) if x.is_valid else 0 for x in col])
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # workers are reused: what a batch needed is not kept
