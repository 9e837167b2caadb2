"""Record batches in short runs, so that what Python makes of them at once does not grow with the batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: bytes of text that are taken at once; a longer text stands alone or ends its run.
RUN_BYTES = 1 << 20


def _sizes(texts: pa.Array) -> np.ndarray:
    if pa.types.is_list(texts.type):
        each = pc.fill_null(pc.binary_length(texts.flatten()), 0)
        return np.bincount(pc.list_parent_indices(texts).to_numpy(), each.to_numpy(zero_copy_only=False), len(texts))
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose texts (or lists of texts) hold about ``most`` bytes; rows count too, a little."""
    if not len(texts):
        return
    part = np.cumsum(_sizes(texts) + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, b - a


def sliced(batches: Iterable[pa.RecordBatch], text: int | str = 1, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in such runs, by the column of this place or name."""
    for batch in batches:
        for a, n in runs(batch.column(text), most):
            yield batch.slice(a, n)
