"""Arrow batches in slices, so that what a Python worker holds does not follow Spark's batches."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: examples whose scores are worked on at a time
ROWS = 1024


def cuts(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(start, end) of runs of rows whose weights add up to ``most`` or little more; a row heavier
    than that does not make others wait for it. No rows are one empty run."""
    if not len(weights):
        return [(0, 0)]
    run = (np.cumsum(weights) - weights) // most
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(weights)], strict=True))


def sliced(run: Callable[..., pa.Array], rows: int = ROWS) -> Callable[..., pa.Array]:
    """``run`` over arrays of one length, called for ``rows`` of them at a time."""
    def over_slices(*arrays: pa.Array) -> pa.Array:
        parts = cuts(np.ones(len(arrays[0]), np.int64), rows)
        return pa.concat_arrays([run(*(a.slice(start, end - start) for a in arrays)) for start, end in parts])
    return over_slices


def in_slices(run: Callable[..., pa.Array], rows: int = ROWS) -> Callable[[Iterator], Iterator[pa.Array]]:
    """The same over the batches of an iterator, each slice's result given out before the next is made, for
    results that are many times larger than what they are made from."""
    def over_batches(batches):
        for arrays in batches:
            for start, end in cuts(np.ones(len(arrays[0]), np.int64), rows):
                yield run(*(a.slice(start, end - start) for a in arrays))
    return over_batches
