"""Seeded, key-based randomness.

``rand()`` depends on how rows fall into partitions, so a retried task would
draw again. Every random decision here is a hash of the row's own key instead:
the same answer under any partitioning, after any retry, and in any engine that
can compute MD5 and XXH64.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what a draw is for; keeps the decisions taken about one key independent.
PAIRING, SPLIT, SHUFFLE, FILE_ORDER, MASK, SAMPLE, SCORE = range(1, 8)

#: draws of one position are uniform in [0, 2**32).
SPAN = 1 << 32

#: order draws are cut into this many equal ranges when rows are ranked.
BUCKET_BITS = 16


def row_key(seed: int, *names) -> Column:
    """60-bit integer key of a row, from the seed and string columns."""
    parts = F.concat_ws("|", F.lit(str(seed)), *names)
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def fold(key: Column, *parts) -> Column:
    """Extend a key by integers (a purpose, an epoch, an id)."""
    longs = [(p if isinstance(p, Column) else F.lit(p)).cast("long") for p in parts]
    return F.xxhash64(key, *longs)


def draw(key: Column, position: Column) -> Column:
    """Uniform integer in [0, 2**32) for one position under ``key``."""
    return F.shiftrightunsigned(fold(key, position), 32)


def order_draw(key: Column, *parts) -> Column:
    """Non-negative 63-bit integer to sort by."""
    return F.shiftrightunsigned(fold(key, *parts), 1)


def bucket_of(order: Column) -> Column:
    """Which of the ``2**BUCKET_BITS`` equal ranges an order draw falls in."""
    return F.shiftright(order, 63 - BUCKET_BITS)


def threshold(probability: float) -> int:
    """``draw < threshold(p)`` holds with probability p."""
    return int(probability * SPAN)
