"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m characters counts as contained in a document if some stretch of
it is at most k = floor(rate * m) single-character edits away from the whole item,
both lower-cased with every run of other characters than letters and digits as one
space. Such a stretch shares at least m - q + 1 - k * q of the item's q-grams, and all
of these lie within k + 1 neighbouring diagonals. So hits are counted in diagonal bands
of a width of at least k that overlap by k: a band that reaches the bound is aligned
with the item, all others cannot hold a match.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import slices
from tokenmill.sources import scratch

#: length of the grams, and edits allowed for each character of an item
Q, RATE = 8, 0.08

#: benchmark characters sent to the tasks at a time; more are taken in several passes
BLOCK_CHARS = 4_000_000

#: normalised characters of a document looked up at a time
WINDOW = 1 << 20

_SPACE, _STEP = 32, np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter or digit, else a space."""
    global _table
    if _table is None:
        _table = np.full(0x110000, _SPACE, np.uint32)
        for code in range(0x34000):  # no letters or digits above
            char = chr(code)
            if char.isalnum():
                lower = char.lower()
                _table[code] = ord(lower) if len(lower) == 1 else code
    return _table


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): the text's normalised characters and where each stands in it."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    kept = np.ones(len(codes), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    places = np.flatnonzero(kept)
    codes = codes[places]
    first, last = int(len(codes) > 0 and codes[0] == _SPACE), len(codes)
    last -= int(last > first and codes[-1] == _SPACE)
    return codes[first:last], places[first:last]


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all stretches of q codes, from those of its two halves."""
    if q == 1:
        return codes.astype(np.uint64)
    half = q // 2
    head = _grams(codes, half)
    tail = head if q == 2 * half else _grams(codes, q - half)
    n = max(len(codes) - q + 1, 0)
    return head[:n] * np.uint64(pow(int(_STEP), q - half, 1 << 64)) + tail[half:half + n]


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of benchmark items. Items whose bound is below 1, which
    are those of fewer than ``q`` normalised characters, match nothing."""

    ids: np.ndarray
    items: list
    edits: np.ndarray
    bounds: np.ndarray
    widths: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    q: int

    @classmethod
    def of(cls, rows: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> "Index":
        items = [normalised(text)[0] for _, text in rows]
        lengths = np.array([len(x) for x in items], np.int64)
        edits = np.minimum(np.floor(rate * lengths), (lengths - q) // q).clip(0).astype(np.int64)
        bounds = lengths - q + 1 - edits * q
        grams = [_grams(x, q) if bound > 0 else _grams(x[:0], q) for x, bound in zip(items, bounds, strict=True)]
        counts = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        distinct, starts = np.unique(flat[order], return_index=True)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[cls.slot(distinct)] = True
        return cls(np.array([i for i, _ in rows], np.int64), items, edits, bounds,
                   np.maximum(16, 2 ** np.ceil(np.log2(edits + 1)).astype(np.int64)), distinct,
                   np.append(starts, len(flat)), np.repeat(np.arange(len(items)), counts)[order],
                   np.concatenate([*(np.arange(c) for c in counts), np.zeros(0, np.int64)])[order], maybe, q)

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER_BITS)

    def hits(self, codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of every q-gram that ``codes`` shares with an item."""
        grams = _grams(codes, self.q)
        where = np.flatnonzero(self.maybe[self.slot(grams)])
        found = np.searchsorted(self.grams, grams[where])
        found[found == len(self.grams)] = 0
        right = self.grams[found] == grams[where] if len(self.grams) else np.zeros(len(where), bool)
        where, found = where[right], found[right]
        first, count = self.starts[found], self.starts[found + 1] - self.starts[found]
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.owner[entry], base + np.repeat(where, count) - self.place[entry]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs whose hits reach the item's bound. Band b of an item of
        width w has the diagonals from b * w to (b + 1) * w + k - 1."""
        items, diagonals = [], []
        for base in range(0, max(len(codes) - self.q + 1, 0), WINDOW):
            found = self.hits(codes[base:base + WINDOW + self.q - 1], base)
            items.append(found[0])
            diagonals.append(found[1])
        if not items or sum(map(len, items)) < max(1, self.bounds[self.bounds > 0].min(initial=1)):
            return []
        item, diagonal = np.concatenate(items), np.concatenate(diagonals)
        width = self.widths[item]
        band, inside = diagonal // width, diagonal % width
        lower = inside < self.edits[item]  # also in the overlap of the band before
        item, band = np.concatenate([item, item[lower]]), np.concatenate([band, band[lower] - 1])
        offset = int(band.min())
        keys, counts = np.unique(item * (int(band.max()) - offset + 1) + (band - offset), return_counts=True)
        owner, band = np.divmod(keys, int(band.max()) - offset + 1)
        full = counts >= self.bounds[owner]
        return list(zip(owner[full].tolist(), (band[full] + offset).tolist(), strict=True))


def _reach(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with a stretch of the text
    whose path stays on the diagonals low..high; the stretch begins at 0 if anchored,
    else anywhere. Ties go to the first end."""
    size, far = high - low + 1, len(item) + len(text) + 1
    steps = np.arange(size)
    padded = np.full(len(item) + size + 1, 0xFFFFFFFF, np.uint32)  # text place p + d stands at p + d - low
    lo, hi = max(0, low), min(len(text), low + len(padded))
    if hi > lo:
        padded[lo - low:hi - low] = text[lo:hi]
    begins = steps + low
    cost = np.where((begins == 0) if anchored else (begins >= 0) & (begins <= len(text)), 0, far)
    cost = np.minimum.accumulate(cost - steps) + steps if anchored else cost
    for p, char in enumerate(item):
        best = cost + (padded[p:p + size] != char)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        outside = (begins + p + 1 < 0) | (begins + p + 1 > len(text))
        best[outside] = far
        cost = np.minimum.accumulate(best - steps) + steps
        cost[outside] = far
    end = int(cost.argmin())
    return int(cost[end]), len(item) + low + end


def _place(text: np.ndarray, wanted: np.ndarray) -> int:
    """Where the text first holds the item unchanged, or -1."""
    content, sought, at = text.tobytes(), wanted.tobytes(), -1
    while (at := content.find(sought, at + 1)) >= 0 and at % 4:
        pass
    return at // 4 if at >= 0 else -1


def _aligned(index: Index, codes: np.ndarray, item: int, band: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the matches of an item in a band that are within budget: the
    best one, then those in what is left before and after it."""
    wanted, k, width = index.items[item], int(index.edits[item]), int(index.widths[item])
    low, high = band * width, (band + 1) * width + k - 1
    left = [(max(0, low - k), min(len(codes), high + len(wanted) + k + 1))]
    while left:
        start, stop = left.pop()
        if stop - start < max(1, len(wanted) - k):
            continue
        text = codes[start:stop]
        first, edits = _place(text, wanted), 0
        end = first + len(wanted)
        if first < 0:
            edits, end = _reach(wanted, text, low - k - start, high + k - start, anchored=False)
            if edits > k:
                continue
            first = end - _reach(wanted[::-1], text[:end][::-1], -k, k, anchored=True)[1]
        if end > first:
            yield start + first, start + end, edits
            left += [(start, start + first), (start + end, stop)]


def found_in(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) of every match in a text, in characters of the
    text; of overlapping matches of one item the one with fewest edits, then the first."""
    codes, places = normalised(text)
    matches = []
    for item, band in index.bands(codes):
        matches += [(item, edits, start, stop) for start, stop, edits in _aligned(index, codes, item, band)]
    chosen: list[tuple] = []
    for item, edits, start, stop in sorted(set(matches)):
        if not any(c[0] == item and start < c[3] and c[2] < stop for c in chosen):
            chosen.append((item, edits, start, stop))
    return sorted((int(index.ids[i]), int(places[a]), int(places[b - 1]) + 1, edits) for i, edits, a, b in chosen)


def _indexes(benchmark: DataFrame, q: int, rate: float, block_chars: int) -> tuple[int, Iterator[Index]]:
    """How many blocks of about ``block_chars`` characters the items are dealt to, and the
    blocks' indexes, of which the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_chars)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))

    def each():
        for block in range(blocks):
            rows = dealt.where(F.col("block") == block).orderBy("item_id", "text").collect()
            yield Index.of([(r.item_id, r.text) for r in rows], q, rate)
    return blocks, each()


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, start, end, edits) for each benchmark item found in a
    document; start and end are characters of the document's text.

    NULL, empty and very short texts hold nothing; items that are NULL or have fewer
    than ``q`` letters, digits and single spaces match nothing; repeated rows on either
    side give repeated matches. The items go to the tasks in blocks of about
    ``block_chars`` characters, one pass over the documents for each block.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["doc_id", "item_id", "start", "end", "edits"]
    types = [pa.int64()] * 4 + [pa.int32()]

    def matcher(index: Index):
        def run(batches):
            for batch in slices(batches):
                rows = [(doc, *match) for doc, text in zip(batch.column("doc_id").to_pylist(),
                                                          batch.column("text"), strict=True)
                        for match in found_in(index, text.as_py() or "")]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        return run

    schema = "doc_id long, item_id long, start long, end long, edits int"
    result = texts.sparkSession.createDataFrame([], schema)
    blocks, indexes = _indexes(benchmark, q, rate, block_chars)
    for index in indexes:
        found = texts.mapInArrow(matcher(index), schema)
        result = result.union(found if blocks == 1 else scratch.table(found, "leaks"))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns.
    The texts are judged inside the scan, in one pass for each block of items; only verdicts
    come back from Python."""
    def cleaner(index: Index):
        @F.arrow_udf("boolean")
        def is_clean(texts: pa.Array) -> pa.Array:
            return pa.array([not found_in(index, text.as_py() or "") for text in texts], pa.bool_())
        return is_clean(F.col("text").cast("string"))

    blocks, indexes = _indexes(benchmark, q, rate, block_chars)
    before = None
    for index in indexes:
        docs = docs.where(cleaner(index))
        if blocks > 1:
            docs, path = scratch.placed(docs, "clean")
            if before:
                scratch.remove(docs.sparkSession, before)
            before = path
    return docs
