"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last few bytes rolls over a text. Where its low bits are all ones a piece
ends, so boundaries depend on what stands around them and an edit moves none but those next
to it. Each piece becomes one character, a text the string of its pieces' characters. The
number of low bits, the block size, follows from the text's length, and a fingerprint holds
the strings at three successive block sizes. Two fingerprints are compared by the edit
distance of their strings at the finest block size that both have.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import mix, slices
from tokenmill.sources import scratch

#: pieces of a string that the block size aims at, and that it is doubled beyond
AIM, MOST = 64, 128

#: strings of a fingerprint, at block sizes that double
SIZES = 3

#: bytes that decide whether a piece ends
WINDOW = 7

#: text bytes hashed at a time
STRETCH = 1 << 18

#: text bytes of consecutive documents that are one unit of work
PART_BYTES = 32 << 20

# The characters of pieces.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_ROLL, _STEP = np.uint32(0x9E3779B1), 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int) -> np.ndarray:
    """``base`` to the powers from 0 to ``STRETCH``, modulo 2^64."""
    if base not in _powers:
        factors = np.full(STRETCH + 1, base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return _powers[base]


def _triggers(content: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte but the first ``WINDOW - 1``, which lead in."""
    n = len(content) - WINDOW + 1
    total = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        total = total * _ROLL + content[k:k + n] + np.uint32(1)
    total = (total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return total ^ (total >> np.uint32(13))


def _stretches(content: np.ndarray, bits: int) -> Iterator[tuple]:
    """(ends of pieces, low ones of their triggers, sums up to them) of a text, stretch by
    stretch, where at least ``bits`` low bits are ones. The last end is the text's."""
    forward = _powers_of(_STEP)
    mask = np.uint32((1 << bits) - 1)
    lead, carry, scale = np.zeros(WINDOW - 1, np.uint8), np.uint64(0), 1
    for start in range(0, len(content), STRETCH):
        piece = content[start:start + STRETCH]
        trigger = _triggers(np.concatenate([lead, piece]).astype(np.uint32))
        with np.errstate(over="ignore"):
            sums = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * forward[:len(piece)], dtype=np.uint64)
            sums = sums * np.uint64(scale) + carry
        places = np.flatnonzero((trigger & mask) == mask)
        if start + len(piece) == len(content) and (not len(places) or places[-1] != len(piece) - 1):
            places = np.append(places, len(piece) - 1)
        yield start + places + 1, trigger[places], sums[places]
        lead = np.concatenate([lead, piece])[-(WINDOW - 1):]
        carry, scale = sums[-1], scale * int(forward[len(piece)]) & ((1 << 64) - 1)


def _back(places: np.ndarray) -> np.ndarray:
    """The inverse power that a sum from each place on is moved to the start by."""
    back = _powers_of(_BACK)
    if places[-1] < STRETCH:
        return back[places]
    blocks, rest = np.divmod(places, STRETCH)
    result, factor, at = back[rest], 1, 0
    for block in np.unique(blocks).tolist():
        factor = factor * pow(int(back[STRETCH]), block - at, 1 << 64) % (1 << 64)
        at = block
        result[blocks == block] *= np.uint64(factor)
    return result


def fingerprint(content: bytes) -> str:
    """``<block bits>:<string>:<string>:<string>`` of a text's bytes, the strings at block sizes
    2^bits, 2^(bits + 1) and 2^(bits + 2)."""
    if not content:
        return ":".join(["0"] + [""] * SIZES)
    bits = ((len(content) - 1) // AIM).bit_length()
    parts = list(_stretches(np.frombuffer(content, np.uint8), bits))
    ends, triggers, sums = (np.concatenate(column) for column in zip(*parts, strict=True))
    strings = []
    while True:
        at = (triggers & np.uint32((1 << bits) - 1)) == np.uint32((1 << bits) - 1)
        at[-1] = True
        if at.sum() <= MOST:
            break
        bits += 1
    for more in range(SIZES):
        mask = np.uint32((1 << bits + more) - 1)
        at = (triggers & mask) == mask
        at[-1] = True
        stops, totals = ends[at], sums[at]
        starts, before = np.append(0, stops[:-1]), np.append(np.uint64(0), totals[:-1])
        hashes = mix((totals - before) * _back(starts) + (stops - starts).astype(np.uint64))
        strings.append(ALPHABET[hashes >> np.uint64(58)].tobytes().decode())
    return ":".join([str(bits), *strings])


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two strings, all rows of a column of
    the table at once as bits of integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for char in b:
        equal = where.get(char, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | ~(diagonal | up), up & diagonal
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise = rise << 1 | 1
        up = (fall << 1 | ~(diagonal | rise)) & full
        down = rise & diagonal & full
    return distance


def likeness(first: str, second: str) -> float:
    """1 for equal fingerprints down to 0: the share of the longer string that the edit
    distance leaves. Block sizes that differ more than ``2^(SIZES - 1)`` fold give 0."""
    if first == second:
        return 1.0
    (bits_a, *a), (bits_b, *b) = (f.split(":") for f in (first, second))
    gap = int(bits_b) - int(bits_a)
    if abs(gap) >= SIZES:
        return 0.0
    x, y = a[max(gap, 0)], b[max(-gap, 0)]
    longest = max(len(x), len(y))
    return 1 - edit_distance(x, y) / longest if longest else 0.0


# the next document

def _cuts(batches):
    """The first key of each part of about ``PART_BYTES`` in a task's sorted keys."""
    held, before, first = 0, None, []
    for batch in batches:
        for doc_id, tie, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "size")), strict=True):
            if before is None or held >= PART_BYTES and (doc_id, tie) != before:
                first.append((doc_id, tie))
                held = 0
            before = doc_id, tie
            held += size
    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([f[0] for f in first], pa.int64()),
                                      "tie": pa.array([f[1] for f in first], pa.int64())})


def _order(key: tuple) -> tuple:
    return (key[0] is not None, key[0] or 0, key[1])


def in_parts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, border, doc_id, tie, text) and the number of parts: the documents, dealt to runs of consecutive ones in
    the order of doc_id, NULL first, then of a hash of the text; and after each run once more
    the document that follows it, as its border, the first one after the last run.

    Only keys are sorted to find the runs; the driver and the tasks hold one key for each
    ``PART_BYTES`` of text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys, path = scratch.placed(rows.select("doc_id", "tie", (F.octet_length("text") + 16).alias("size")), "keys", "zstd")
    ordered = keys.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    firsts = sorted(((r.doc_id, r.tie) for r in ordered.mapInArrow(_cuts, "doc_id long, tie long").collect()), key=_order)
    scratch.remove(docs.sparkSession, path)
    ids = np.array([-1 if f[0] is None else f[0] for f in firsts], np.int64)
    known, ties = np.array([f[0] is not None for f in firsts], bool), np.array([f[1] for f in firsts], np.int64)

    @F.arrow_udf("long")
    def part_of(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        nulls, tie = doc_id.is_null().to_numpy(zero_copy_only=False), tie.to_numpy()
        own, base = doc_id.fill_null(-1).to_numpy(), int((~known).sum())
        part = base + np.searchsorted(ids[base:], own, side="right") - 1
        # rows of a doc_id that a part begins with are dealt by their ties
        for i in np.flatnonzero(nulls | (ids[np.maximum(part, 0)] == own)).tolist():
            low, high = (0, base) if nulls[i] else (base + int(np.searchsorted(ids[base:], own[i])), part[i] + 1)
            part[i] = low + int(np.searchsorted(ties[low:high], tie[i], side="right")) - 1
        return pa.array(part, pa.int64())

    spark = docs.sparkSession
    dealt = rows.select(part_of("doc_id", "tie").alias("part"), F.lit(False).alias("border"), "doc_id", "tie", "text")
    marks = [((place - 1) % len(firsts), *first) for place, first in enumerate(firsts)]
    wanted = spark.createDataFrame(marks, "before long, first_id long, first_tie long")
    borders = (rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("first_id"))
                         & (F.col("tie") == F.col("first_tie")))
               .groupBy("before", "doc_id", "tie").agg(F.first("text").alias("text"))
               .select(F.col("before").alias("part"), F.lit(True).alias("border"), "doc_id", "tie", "text"))
    return dealt.union(borders), len(firsts)


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by as many first characters of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _paired(batches):
    """Each document with the one after it in its part."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
    held = None  # the row before, where it still waits for the next one
    for batch in slices(batches):
        rows = []
        for border, doc_id, text in zip(*(batch.column(c) for c in ("border", "doc_id", "text")), strict=True):
            text = text.as_py()
            print_ = fingerprint(text.encode())
            if held is not None:
                own_id, own, own_print = held
                changed = edited(own, text).encode()
                changed_print = fingerprint(changed)
                rows.append((own_id, len(own), hashlib.sha256(changed).hexdigest(), own_print, changed_print,
                             likeness(own_print, changed_print), likeness(own_print, print_)))
            held = None if border.as_py() else (doc_id.as_py(), text, print_)
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``; a NULL text is an empty one."""
    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(text.encode()) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())],
                                             ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    for each row of ``docs`` (doc_id, text).

    The edited text is the document's with its last half replaced from the next document, by
    ascending doc_id; rows of one doc_id follow each other by a hash of their text, NULL
    doc_ids come first, and after the last row comes the first. A NULL text is empty; the
    only row of a table follows itself; no rows give no rows.
    """
    rows, parts = in_parts(docs)
    spread = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(spread, "part").sortWithinPartitions("part", "border", F.asc_nulls_first("doc_id"), "tie")
    return rows.select("border", "doc_id", "text").mapInArrow(
        _paired, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")
