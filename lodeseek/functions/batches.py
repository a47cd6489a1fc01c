"""Arrow batches of texts, taken in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts of an Arrow batch that are Python strings at a time.
SLICE_CHARS = 1 << 20


def slices(texts: pa.Array, size: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """A text array in consecutive slices of about `size` bytes, or of one longer text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) + 64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop
