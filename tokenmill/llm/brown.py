"""Language-model scoring with Brown's class-based bigrams.

P(word | word before) = P(class | class before) * P(word | class). The classes come from
exchange clustering of every word of the training texts: starting from classes by rank,
each round counts how often every word stands after and before each class, and moves half
of the words to the class that raises the training likelihood most. All counts cover all
training tokens.

The corpus is held as blocks of documents with a word list each, so that a word costs one
row in a shuffle for each block it occurs in and not for each occurrence: the counts go
back to the blocks, and all further passes are arithmetic on arrays inside a block. What
stands after and before each word is one table, a row for each run of ``_GROUP`` words; its
tasks choose the words' best classes. The driver and the workers hold the class by class
counts and one byte for each word.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tokenmill.llm import words as wd
from tokenmill.sources import scratch

#: classes that exchange clustering fills, and its rounds
CLASSES, ROUNDS = 64, 6

#: text bytes of a block
BLOCK_BYTES = 4 << 20

#: additive count of the unigram baseline
BASE = 0.1

#: class 0 is the end of a document; then the clustered ones and that of unseen words
_TOTAL = 1 + CLASSES + 1
_UNSEEN = _TOTAL - 1

#: words whose neighbours are in one row, and words that are ranked together
_GROUP, _RANKED = 1 << 14, 1 << 16

#: tokens whose neighbours a task counts at a time, and neighbours that it holds besides a
#: group's before it merges equal ones
_HELD, _MERGED = 1 << 21, 1 << 20

#: a looked-up word is its place in the block's list above these bits, and its number below
_VALUE_BITS = 40


def held_out(doc_id):
    """Documents that teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _shrunk(values: np.ndarray) -> bytes:
    """Compressed with the first bytes of all values together, then the second ones, and so on."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _grown(content: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(content), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _blocks(batches):
    for batch in wd.slices(batches, most=BLOCK_BYTES):
        offsets, numbers, distinct = wd.split(batch.column("text"))
        held = batch.column("held").to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        ends = np.cumsum(lengths + 1)
        sequence = np.zeros(len(numbers) + len(lengths), np.int32)  # 0 is the end of a document
        inside = np.ones(len(sequence), bool)
        inside[ends - 1] = False
        sequence[inside] = numbers + 1
        learned = np.repeat(~held, lengths + 1)
        counts = np.bincount(sequence[learned], minlength=len(distinct) + 1)
        yield pa.RecordBatch.from_pydict({
            "doc_ids": pa.array([batch.column("doc_id")], pa.list_(pa.int64())),
            "held": pa.array([batch.column("held")], pa.list_(pa.bool_())),
            "ends": pa.array([ends], pa.list_(pa.int64())),
            "sequence": pa.array([_shrunk(sequence)], pa.binary()),
            "words": pa.array([["", *distinct.to_pylist()]], pa.list_(pa.string())),
            "counts": pa.array([counts], pa.list_(pa.int64()))})


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: ids, held-out marks, token ends, the tokens as numbers of the
    block's word list (number 0, the empty string, ends a document), compressed, and
    training counts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       held_out(F.col("doc_id")).alias("held"))
    return rows.mapInArrow(_blocks, "doc_ids array<long>, held array<boolean>, ends array<long>, sequence binary, "
                                    "words array<string>, counts array<long>") \
        .withColumn("block", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Counts:
    """Training totals: tokens, distinct tokens, tokens seen once, and how many words have
    a number (0 is the end of a document)."""

    tokens: int
    distinct: int
    once: int
    common: int


def counted(cut: DataFrame) -> tuple[DataFrame, Counts]:
    """The blocks with ``words``: for each word of a block's list its place and its number,
    which for a word of no training text is the first free one, and its training count in the
    whole corpus, in any order."""
    listed = cut.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    vocabulary, path = scratch.placed(
        listed.where("w.counts > 0").groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("total")),
        "vocabulary", "zstd")
    tokens, distinct, once = (x or 0 for x in vocabulary.agg(
        F.sum("total"), F.count("total"), F.sum((F.col("total") == 1).cast("long"))).first())
    part = F.when(F.col("word") == "", 0).otherwise(F.pmod(F.xxhash64("word"), F.lit(-(-max(distinct, 1) // _RANKED))))
    vocabulary = vocabulary.withColumn("part", part.cast("int"))
    sizes = dict(vocabulary.groupBy("part").count().collect())  # a row for each _RANKED words
    first, starts = 0, []
    for number in sorted(sizes):
        starts.append((number, first))
        first += sizes[number]
    starts = cut.sparkSession.createDataFrame(starts, "part int, first long")
    rank = F.row_number().over(W.Window.partitionBy("part").orderBy(F.col("word") != "", F.desc("total"), "word")) - 1
    numbered = scratch.table(
        vocabulary.withColumn("rank", rank).join(F.broadcast(starts), "part")
        .select("word", "total", (F.col("first") + F.col("rank")).alias("number")), "numbered", "zstd")
    scratch.remove(cut.sparkSession, path)
    scratch.release(cut.sparkSession)
    placed = F.shiftleft(F.col("place").cast("long"), _VALUE_BITS).bitwiseOR(F.coalesce("number", F.lit(distinct)))
    looked_up = (cut.select("block", F.posexplode("words").alias("place", "word")).join(numbered, "word", "left")
                 .select("block", placed.alias("placed"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
                 .groupBy("block").agg(F.struct(F.collect_list("placed").alias("placed"),
                                                F.collect_list("total").alias("totals")).alias("words")))
    return cut.drop("words", "counts").join(looked_up, "block"), Counts(tokens, distinct, once, distinct)


def _sequence(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return _grown(batch.column("sequence")[row].as_py(), np.int32)


def _numbers(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, total) of a block's words."""
    placed, totals = (batch.column("words").field(name)[row].values.to_numpy() for name in ("placed", "totals"))
    order = np.argsort(placed)
    return placed[order] & ((1 << _VALUE_BITS) - 1), totals[order]


def _classes(batch: pa.RecordBatch, row: int, size: int, of_common: np.ndarray) -> tuple:
    """(sequence, totals, numbers or -1, class) of a block, the last three by word. ``size``
    words have a number."""
    number, totals = _numbers(batch, row)
    classes = np.append(of_common, np.uint8(_UNSEEN))[number]
    return _sequence(batch, row), totals, np.where(number < size, number, -1), classes


def _learned(batch: pa.RecordBatch, row: int, sequence: np.ndarray) -> np.ndarray:
    held = batch.column("held")[row].values.to_numpy(zero_copy_only=False)
    return sequence[np.repeat(~held, np.diff(batch.column("ends")[row].values.to_numpy(), prepend=0))]


def _counted(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(each different pair in order, how often it occurs or the sum of its ``counts``); without
    counts the pairs are sorted where they are."""
    if counts is None:
        pairs.sort()
    else:
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.append(len(pairs) > 0, pairs[1:] != pairs[:-1]))
    total = np.diff(starts, append=len(pairs)) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts
    return pairs[starts], total


def _paired_up(blocks: list[np.ndarray], after: bool) -> np.ndarray:
    """A pair (word, neighbour) of 32 bits each for each token, from the words of blocks. Documents
    begin after an end; nothing is known after a block's last token."""
    pairs, at = np.empty(sum(len(b) if after else len(b[1:]) for b in blocks), np.uint64), 0
    for numbers in blocks:
        words, found = (numbers, np.append(np.uint32(0), numbers[:-1])) if after else (numbers[:-1], numbers[1:])
        part = pairs[at:at + len(words)]
        np.left_shift(words, np.uint64(32), out=part, dtype=np.uint64)
        part |= found[:len(words)]
        at += len(words)
    return pairs


def _rows(blocks: list[np.ndarray]):
    """Rows of the neighbour table, one for each group, from the words of blocks in order."""
    sides = [_counted(_paired_up(blocks, after)) for after in (True, False)]
    groups = np.unique(np.concatenate([pairs >> np.uint64(32) for pairs, _ in sides]) // np.uint64(_GROUP))
    for group in groups.tolist():
        ends = np.array([group * _GROUP << 32, (group + 1) * _GROUP << 32], np.uint64)
        cuts = [np.searchsorted(pairs, ends) for pairs, _ in sides]
        yield _row(group, [(pairs[a:b], counts[a:b]) for (pairs, counts), (a, b) in zip(sides, cuts, strict=True)])


def _row(group: int, sides) -> pa.RecordBatch:
    names, values = ["group"], [pa.array([group], pa.int64())]
    for side, (pairs, counts) in zip(("after", "before"), sides, strict=True):
        words = (pairs >> np.uint64(32)).astype(np.int64) - group * _GROUP
        parts = np.diff(words, prepend=0).astype(np.uint16), pairs.astype(np.uint32), counts.astype(np.uint64)
        names.append(side)
        values.append(pa.array([[_shrunk(x) for x in parts]], pa.list_(pa.binary())))
    return pa.RecordBatch.from_arrays(values, names)


def _unpacked(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word in the group, neighbour, count)."""
    steps, neighbours, counts = (_grown(x, kind) for x, kind in zip(
        batch.column(side)[row].as_py(), (np.uint16, np.uint32, np.uint64), strict=True))
    return np.cumsum(steps, dtype=np.uint16), neighbours, counts


def _neighbours(batches):
    """For each group of words, what stands after and before each in a task's blocks."""
    blocks, held = [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            numbers = _numbers(batch, row)[0].astype(np.uint32)[_learned(batch, row, _sequence(batch, row))]
            blocks.append(numbers)
            held += len(numbers)
            if held >= _HELD:
                yield from _rows(blocks)
                blocks, held = [], 0
    if held:
        yield from _rows(blocks)


def _merged(batches):
    """One row for each group, from rows in order of the group."""
    def merge(parts):
        return [_counted(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))]

    group, sides = None, ([], [])
    for batch in batches:
        for row, number in enumerate(batch.column("group").to_pylist()):
            if number != group:
                if group is not None:
                    yield _row(group, [merge(parts)[0] for parts in sides])
                group, sides = number, ([], [])
            for parts, side in zip(sides, ("after", "before"), strict=True):
                words, neighbours, counts = _unpacked(batch, row, side)
                parts.append((words.astype(np.uint64) + np.uint64(group * _GROUP) << np.uint64(32) | neighbours, counts))
                if len(parts) > 1 and sum(len(p) for p, _ in parts[1:]) >= max(_MERGED, len(parts[0][0])):
                    parts[:] = merge(parts)
    if group is not None:
        yield _row(group, [merge(parts)[0] for parts in sides])


def neighbours(corpus: DataFrame) -> tuple[DataFrame, str]:
    """(group, after, before), with its path: for each run of words, the words before and
    after each with counts, over all training tokens."""
    shape = "group long, after array<binary>, before array<binary>"
    rows = corpus.select("held", "ends", "sequence", "words").mapInArrow(_neighbours, shape)
    merged = rows.repartition("group").sortWithinPartitions("group").mapInArrow(_merged, shape)
    return scratch.placed(merged, "neighbours", "zstd")


def _table(batch: pa.RecordBatch, row: int, side: str, size: int, of_common: np.ndarray) -> np.ndarray:
    """Counts of a group's words by the class of the word before (``after``) or after."""
    words, found, counts = _unpacked(batch, row, side)
    place = words.astype(np.int64) * _TOTAL + of_common[found]
    return np.bincount(place, counts, size * _TOTAL).reshape(size, _TOTAL)


def _paired(of_common: np.ndarray):
    """Sums over a task's groups: class pairs; and for words seen once, the classes before
    and after."""
    def run(batches):
        pairs, once = np.zeros((_TOTAL, _TOTAL)), np.zeros((2, _TOTAL))
        for batch in batches:
            for row, group in enumerate(batch.column("group").to_pylist()):
                own = of_common[group * _GROUP:(group + 1) * _GROUP]
                after, before = (_table(batch, row, side, len(own), of_common) for side in ("after", "before"))
                pairs += after.T @ (own[:, None] == np.arange(_TOTAL))
                alone = after.sum(axis=1) == 1
                once += after[alone].sum(axis=0), before[alone].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"pairs": [pairs.tobytes()], "once": [once.tobytes()]})
    return run


def _pairs(table: DataFrame, of_common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class pairs, classes before and after words seen once) over all training tokens."""
    rows = table.mapInArrow(_paired(of_common), "pairs binary, once binary").collect()  # class by class for each task
    pairs = sum((np.frombuffer(r.pairs) for r in rows), np.zeros(_TOTAL * _TOTAL))
    once = sum((np.frombuffer(r.once) for r in rows), np.zeros(2 * _TOTAL))
    return pairs.reshape(_TOTAL, _TOTAL), once.reshape(2, _TOTAL)


def _moved(of_common: np.ndarray, pairs: np.ndarray, turn: int):
    def run(batches):
        for batch in batches:
            for row, group in enumerate(batch.column("group").to_pylist()):
                start = group * _GROUP
                own = of_common[start:start + _GROUP]
                after, before = (_table(batch, row, side, len(own), of_common) for side in ("after", "before"))
                best = exchanged(own, after.sum(axis=1), pairs, after, before, turn, start)
                yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int64()),
                                                  "classes": [best.astype(np.uint8).tobytes()]})
    return run


def _next(table: DataFrame, of_common: np.ndarray, pairs: np.ndarray, turn: int) -> np.ndarray:
    rows = table.mapInArrow(_moved(of_common, pairs, turn), "group long, classes binary").collect()  # a byte a word
    result = of_common.copy()
    for r in rows:
        result[r.group * _GROUP:(r.group + 1) * _GROUP] = np.frombuffer(r.classes, np.uint8)
    return result


def likelihood(pairs: np.ndarray) -> float:
    """The part of the training log likelihood that depends on the classes."""
    first, second = pairs.sum(axis=1, keepdims=True), pairs.sum(axis=0, keepdims=True)
    expected = first * second
    full = pairs > 0
    return float((pairs[full] * np.log(pairs[full] / expected[full].astype(float))).sum())


def exchanged(of_common: np.ndarray, counts: np.ndarray, pairs, after, before, turn: int, start: int = 0) -> np.ndarray:
    """Each word of this turn, the first having number ``start``, in the class that raises the
    likelihood most, given all others."""
    smooth = pairs + 0.05
    sizes = np.log(smooth.sum(axis=0))
    gain = after @ np.log(smooth) + before @ np.log(smooth).T - 2 * counts[:, None] * sizes
    best = 1 + gain[:, 1:1 + CLASSES].argmax(axis=1)
    number = start + np.arange(len(of_common))
    moves = (number % 2 == turn % 2) & (number > 0)
    return np.where(moves, best, of_common)


@dataclass(frozen=True)
class Model:
    counts: Counts
    of_common: np.ndarray
    transitions: np.ndarray  #: log10 P(class | class before)
    sizes: np.ndarray  #: training tokens of each class


def fitted(corpus: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    of_common = (np.arange(counts.common) % CLASSES + 1).astype(np.uint8)
    of_common[:1] = 0
    table, path = neighbours(corpus)
    scratch.release(corpus.sparkSession)
    best = None
    for turn in range(rounds + 1):
        pairs, once = _pairs(table, of_common)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = value, of_common, pairs, once
        if turn < rounds:
            of_common = _next(table, of_common, pairs, turn)
    scratch.remove(corpus.sparkSession, path)
    _, of_common, pairs, once = best
    return Model(counts, of_common, np.log10(_transitions(pairs, once, counts)), pairs.sum(axis=0))


def _transitions(pairs: np.ndarray, once: np.ndarray, counts: Counts) -> np.ndarray:
    """Smoothed P(class | class before). Unseen words, which no training text can show, get
    the neighbours of words seen once, whose share of the tokens is Turing's estimate of
    theirs. Class frequencies weigh as much as there are different classes after a class."""
    moved = pairs.astype(float)
    moved[:, _UNSEEN], moved[_UNSEEN] = once
    moved[_UNSEEN, _UNSEEN] = once[1].sum() * counts.once / max(counts.tokens, 1)
    overall = moved[:_UNSEEN].sum(axis=0)
    overall[_UNSEEN] += 0.5
    overall = overall / overall.sum()
    kinds = np.maximum((moved > 0).sum(axis=1, keepdims=True), 1)
    result = (moved + kinds * overall) / (moved.sum(axis=1, keepdims=True) + kinds)
    return np.maximum(result, 1e-300)


def _scores(model: Model):
    counts = model.counts
    base_total = counts.tokens + BASE * (counts.distinct + 1)
    schema = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sequence, totals, _, classes = _classes(batch, row, counts.common, model.of_common)
                base = np.log10((totals + BASE) / base_total)
                emission = np.where(totals > 0, np.log10(np.maximum(totals, 1) / np.maximum(model.sizes[classes], 1)), 0.0)
                follow = classes[sequence]
                precede = np.concatenate([[0], follow[:-1]])
                token = model.transitions[precede, follow] + emission[sequence]
                ends = batch.column("ends")[row].values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[row].values, batch.column("held")[row].values,
                    pa.array(ends - starts), pa.array(np.add.reduceat((totals > 0)[sequence].astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base[sequence], starts)), pa.array(np.add.reduceat(token, starts))], schema)
    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row
    of ``docs``, all learned from its rows that are not held out.

    A NULL or empty text is its end alone. A NULL doc_id is not held out; repeated rows
    count and are scored each. ``score`` is the log10 probability over the training words
    and one unknown word, as is ``base_score``. The end of a document has its own class and
    precedes the next document's first word.
    """
    spark, path = docs.sparkSession, scratch.folder(docs.sparkSession, "corpus")
    with scratch.passing(spark):
        joined, counts = counted(scratch.table(blocks(docs), "blocks", "zstd"))
        joined.write.option("compression", "zstd").parquet(path)
    corpus = spark.read.schema(joined.schema).parquet(path)
    model = fitted(corpus, counts, rounds)
    rows = corpus.select("doc_ids", "held", "ends", "sequence", "words").mapInArrow(
        _scores(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long")
                       .alias("train_tokens"), "base_score", "score")
