"""Words of whole texts inside an Arrow task: runs of characters other than ASCII
white space, A-Z lower-cased."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: text bytes that a task turns into words at a time; a longer text comes alone
SLICE_BYTES = 2 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of one column, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, word numbers, distinct words): row i has the words numbered
    ``numbers[offsets[i]:offsets[i + 1]]``. NULL and blank texts have none."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    bounds = parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.sum(full).as_py() != len(flat):  # white space at an end leaves an empty part
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        bounds, flat = kept[bounds - bounds[0]], flat.filter(full)
    coded = flat.dictionary_encode()
    return bounds - bounds[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that scatters close values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def hashes(distinct: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def chained(codes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each sequence of words, given as one array for each place."""
    total = np.full(len(codes[0]), len(codes), np.uint64)
    for code in codes:
        total = mix((total + _STEP) ^ code)
    return total
