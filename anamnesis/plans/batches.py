"""Arrow batches cut to a bounded size, so that working memory does not follow the length of the texts in them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounded(batches: Iterable[pa.RecordBatch], column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds at most so many bytes of text, or list entries, or one row."""
    for b in batches:
        c = b.column(column)
        size = pc.fill_null(pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, lo = np.cumsum(size), 0
        while lo < len(size):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
