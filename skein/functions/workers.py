"""What functions in Python workers share: slices of a column by bytes, and memory that is given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def give_back() -> None:
    """At the end of a task: free what is no longer used, since a waiting worker counts against the executor's other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_slices(col: pa.Array, limit: int) -> Iterator[list[str | None]]:
    """The values of a string column in order, in lists of about limit bytes and at least one value."""
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)).astype("int64")
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield col.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n
    if start < len(col):
        yield col.slice(start).to_pylist()
