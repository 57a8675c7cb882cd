"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters are dealt to groups, the commonest ones each to its own, and a word is the vector of
how many of its letters each group holds. A trie arranges words by the counts of successive
groups. One inserted or deleted letter changes one count by one; a replaced one raises one
count and lowers another, or changes none. So a search that walks the trie depth first with
one surplus and one deficit to spend reaches every word one edit away, and the words of the
leaves it ends in are compared letter by letter.

The trie's top is built from counts of words only, as deep as it takes for a subtree to hold
no more than a bounded number of words. The subtrees are the units of work: a task holds one,
and the searches that the top lets through to it pass by in batches.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import slices
from tokenmill.sources import scratch

#: code points and occurrences of a word at least, and how many times commoner its form is
LEAST_LENGTH, LEAST_COUNT, COMMONER = 5, 3, 2

#: a run loses a code point if the checksum of its document's id and itself divides by this
DELETES = 97

#: letter groups: one for each of the commonest letters, and some shared by the others
SINGLE, SHARED = 20, 4
GROUPS = SINGLE + SHARED

#: counts from this one on are not told apart
_MOST = 15
_FANOUT = _MOST + 1

#: words of a subtree, and search states that a task expands at a time
SUBTREE, STATES = 1 << 13, 1 << 18

#: distinct words a task counts before it hands them on
_HELD = 1 << 19

#: letters a-z, then U+00C0 to U+00FF
LETTERS = 26 + 64

#: words of up to this many letters are compared as rows of one table
_ROW = 48

#: in UTF-8 U+00C0 to U+00FF are the byte C3 and one more
_RUNS = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")


# words and their counts

def shortened(run: bytes, place: int) -> bytes:
    """A run without its code point at a place."""
    text = run.decode()
    return (text[:place] + text[place + 1:]).encode()


def occurring(doc_id, text: bytes) -> Iterator[tuple[bytes, int]]:
    """(word, how often) of the runs of one text."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(_RUNS.findall(text.lower())).items():  # bytes: only A-Z change
        check = zlib.crc32(run, start)
        if check % DELETES == 0:
            run = shortened(run, check % (len(run) - run.count(b"\xc3")))
        yield run, n


def _counted(batches):
    def rows():
        return pa.RecordBatch.from_pydict({
            "word": pa.array(totals.keys(), pa.binary()).cast(pa.string()), "n": pa.array(totals.values(), pa.int64())})

    totals: dict[bytes, int] = {}
    for batch in slices(batches):
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            for word, n in occurring(doc_id, text.as_py()):
                if len(word) >= LEAST_LENGTH and len(word) - word.count(b"\xc3") >= LEAST_LENGTH:
                    totals[word] = totals.get(word, 0) + n
        if len(totals) >= _HELD:
            yield rows()
            totals.clear()
    yield rows()


def words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the distinct words of all texts that occur at least ``least_count`` times."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# count vectors

def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, letters): row i has the letters ``letters[offsets[i]:offsets[i + 1]]``, each
    a number below ``LETTERS``."""
    column = column.cast(pa.binary())
    content = b"".join(column.to_pylist())
    bytes_ = np.frombuffer(content, np.uint8)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    shown = bytes_ != 0xC3
    before = np.concatenate([[0], np.cumsum(shown)])
    bytes_ = bytes_[shown]
    return before[ends], np.where(bytes_ < 128, bytes_ - ord("a"), bytes_ - 128 + 26).astype(np.uint8)


def vectors(column: pa.Array, group_of: np.ndarray) -> np.ndarray:
    """How many letters of each group the words have, one row for each word."""
    offsets, codes = letters(column)
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    counts = np.bincount(rows * GROUPS + group_of[codes], minlength=len(column) * GROUPS)
    return np.minimum(counts, _MOST).astype(np.uint8).reshape(len(column), GROUPS)


def letter_groups(vocabulary: DataFrame) -> np.ndarray:
    """The group of each letter. Groups are in the order of their letters' frequency among
    the distinct words, so that the first levels of the trie tell most apart."""
    def run(batches):
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += np.bincount(letters(batch.column("word"))[1], minlength=LETTERS)
        yield pa.RecordBatch.from_pydict({"letter": pa.array(range(LETTERS), pa.int32()), "n": total})

    counted = vocabulary.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    order = [r.letter for r in counted.orderBy(F.desc("n"), "letter").collect()]  # a row for each letter
    group_of = np.zeros(LETTERS, np.int64)
    for place, letter in enumerate(order):
        group_of[letter] = place if place < SINGLE else SINGLE + place % SHARED
    return group_of


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(batch.num_rows, GROUPS)


def _vectored(group_of: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = vectors(batch.column("word"), group_of)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())],
                                             [*batch.schema.names, "counts"])
    return run


# the trie's top

@dataclass
class Top:
    """The trie down to its subtrees. ``keys[l]`` are the nodes below the l-th level's inner
    nodes as ``inner node * _FANOUT + count``, sorted; ``inner[l]`` is the number of each
    among the next level's inner nodes, or -1; ``subtree[l]`` its first subtree, or -1;
    ``parts[l]`` how many subtrees its words are dealt to.
    """

    keys: list[np.ndarray] = field(default_factory=list)
    inner: list[np.ndarray] = field(default_factory=list)
    subtree: list[np.ndarray] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def inner_nodes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, inner node of the last level that each is below), of those that are."""
        which, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for level, keys in enumerate(self.keys):
            node = self.inner[level][np.searchsorted(keys, node * _FANOUT + rows[which, level])]
            which, node = which[node >= 0], node[node >= 0]
        return which, node

    def add(self, keys: np.ndarray, sizes: np.ndarray, most: int) -> bool:
        """The next level from its nodes and how many words each holds; whether it has inner
        nodes. The last level has none: its nodes are dealt to parts of bounded size."""
        last = len(self.keys) == GROUPS - 1
        large = (sizes > most) & (not last)
        parts = np.where(large, 0, -(-sizes // most) if last else 1)
        self.keys.append(keys)
        self.inner.append(np.where(large, np.cumsum(large) - 1, -1))
        self.subtree.append(np.where(large, -1, self.size + np.cumsum(parts) - parts))
        self.parts.append(parts)
        self.size += int(parts.sum())
        return bool(large.any())

    def reached(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, words, place among the level's nodes, surplus left, deficit left) of every
        subtree's node that searches for the words get to."""
        start = np.arange(len(rows))
        stack = [(0, start, np.zeros(len(rows), np.int64), np.ones(len(rows), np.int8), np.ones(len(rows), np.int8))]
        while stack:
            level, *states = stack.pop()
            word, place, surplus, deficit = step(self.keys[level], rows[:, level], *states)
            ends = self.inner[level][place] < 0
            yield level, word[ends], place[ends], surplus[ends], deficit[ends]
            inside = ~ends
            if inside.any():
                stack += cut(level + 1, word[inside], self.inner[level][place[inside]], surplus[inside],
                             deficit[inside])


def step(keys: np.ndarray, counts: np.ndarray, word, node, surplus, deficit) -> tuple[np.ndarray, ...]:
    """Search states one level down: (word, place among ``keys``, surplus and deficit left)."""
    found = []
    own = counts[word].astype(np.int64)
    for change in (0, 1, -1):
        allowed = (surplus > 0) & (own < _MOST) if change > 0 else (deficit > 0) & (own > 0) if change else None
        states = (word, node, surplus, deficit, own)
        if allowed is not None:
            states = tuple(s[allowed] for s in states)
        w, n, s, d, c = states
        wanted = n * _FANOUT + c + change
        place = np.searchsorted(keys, wanted)
        place[place == len(keys)] = 0
        hit = keys[place] == wanted
        found.append((w[hit], place[hit], s[hit] - (change > 0), d[hit] - (change < 0)))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def cut(level: int, *states: np.ndarray) -> list[tuple]:
    """States of one level in pieces of bounded size, for a stack."""
    return [(level, *(s[i:i + STATES] for s in states)) for i in range(0, len(states[0]), STATES)]


def top_of(vocabulary: DataFrame, most: int = SUBTREE) -> Top:
    """The top of the trie of (word, counts). Each level is one count of the words below the
    inner nodes of the one before; the driver gets at most ``_FANOUT`` numbers for each inner
    node, and there are no more of these than words / ``most`` on a level."""
    top = Top()
    while True:
        level = len(top.keys)

        def run(batches, level=level):
            for batch in batches:
                rows = _matrix(batch)
                which, node = top.inner_nodes(rows)
                keys, sizes = np.unique(node * _FANOUT + rows[which, level], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": keys.astype(np.int64), "n": sizes.astype(np.int64)})

        counted = (vocabulary.select("counts").mapInArrow(run, "key long, n long").groupBy("key")
                   .agg(F.sum("n").alias("n")).orderBy("key").collect())
        if not top.add(np.array([r.key for r in counted], np.int64), np.array([r.n for r in counted], np.int64), most):
            return top


def _part_of(words: list[str], parts: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % p if p > 1 else 0 for w, p in zip(words, parts.tolist(), strict=True)],
                    np.int64)


def _routed(top: Top):
    names = ["subtree", "level", "guest", "surplus", "deficit", "word", "n", "counts"]

    def run(batches):
        for batch in batches:
            rows, words = _matrix(batch), batch.column("word").to_pylist()
            own = np.zeros(len(rows), np.int64)
            pieces = list(top.reached(rows))
            for level, word, place, surplus, deficit in pieces:
                home = (surplus == 1) & (deficit == 1) & (  # the same counts down to the node
                    top.keys[level][place] % _FANOUT == rows[word, level])
                parts = top.parts[level][place[home]]
                own[word[home]] = top.subtree[level][place[home]] + _part_of([words[w] for w in word[home]], parts)
            for level, word, place, surplus, deficit in pieces:
                parts = top.parts[level][place]
                subtree = np.repeat(top.subtree[level][place] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
                word, surplus, deficit = (np.repeat(x, parts) for x in (word, surplus, deficit))
                # a pair in two subtrees is found in the later one, by the word of the earlier one
                sent = subtree >= own[word]
                word = word[sent]
                yield pa.RecordBatch.from_arrays([
                    pa.array(subtree[sent]), pa.array(np.full(len(word), level, np.int32)),
                    pa.array(subtree[sent] != own[word]), pa.array(surplus[sent].astype(np.int32)),
                    pa.array(deficit[sent].astype(np.int32)),
                    *(batch.column(c).take(pa.array(word)) for c in names[5:])], names)
    return run


# a subtree

class Subtree:
    """The words of one subtree as a trie of the levels below its node, and the search."""

    def __init__(self, level: int, words: pa.Array, n: np.ndarray, rows: np.ndarray):
        self.words, self.n, self.first = words, n, level + 1
        node, self.keys = np.zeros(len(rows), np.int64), []
        for place in range(self.first, GROUPS):
            keys, node = np.unique(node * _FANOUT + rows[:, place], return_inverse=True)
            self.keys.append(keys)
        self.order = np.argsort(node, kind="stable")
        self.starts = np.searchsorted(node[self.order], np.arange(int(node.max()) + 2))
        self.letters = Rows(words)

    def near(self, words: pa.Array, rows: np.ndarray, surplus, deficit) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, place here) of words one edit apart."""
        asked, found, sought = [], [], Rows(words)
        stack = cut(0, np.arange(len(rows)), np.zeros(len(rows), np.int64), surplus, deficit)
        while stack:
            level, *states = stack.pop()
            if level < len(self.keys):
                states = step(self.keys[level], rows[:, self.first + level], *states)
                stack += cut(level + 1, *states)
                continue
            word, node = states[:2]
            sizes = self.starts[node + 1] - self.starts[node]
            word = np.repeat(word, sizes)
            here = self.order[np.repeat(self.starts[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            for start in range(0, len(word), STATES):
                a, b = word[start:start + STATES], here[start:start + STATES]
                right = one_edit(sought, a, self.letters, b)
                asked.append(a[right])
                found.append(b[right])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(asked or none), np.concatenate(found or none)


class Rows:
    """Words as rows of a table of their letters, short ones filled up; long ones apart."""

    def __init__(self, words: pa.Array):
        offsets, codes = letters(words)
        self.sizes = np.diff(offsets)
        self.table = np.full((len(words), _ROW + 1), 255, np.uint8)
        rows = np.repeat(np.arange(len(words)), self.sizes)
        places = np.arange(len(codes)) - offsets[rows]
        short = places < _ROW
        self.table[rows[short], places[short]] = codes[short]
        self.long = {i: codes[offsets[i]:offsets[i + 1]] for i in np.flatnonzero(self.sizes > _ROW).tolist()}

    def of(self, place: int) -> np.ndarray:
        return self.long[place] if place in self.long else self.table[place, :self.sizes[place]]


def one_edit(first: Rows, a: np.ndarray, second: Rows, b: np.ndarray) -> np.ndarray:
    """Whether word a of the first table is exactly one edit from word b of the second, for
    each pair."""
    gap = first.sizes[a] - second.sizes[b]
    result = np.zeros(len(a), bool)
    short = (first.sizes[a] <= _ROW) & (second.sizes[b] <= _ROW)
    for i in np.flatnonzero(~short & (np.abs(gap) <= 1)).tolist():
        result[i] = _apart(first.of(a[i]), second.of(b[i]))
    same = np.flatnonzero(short & (gap == 0))
    result[same] = (first.table[a[same]] != second.table[b[same]]).sum(axis=1) == 1
    for sign, longer, shorter, x, y in ((1, first, second, a, b), (-1, second, first, b, a)):
        which = np.flatnonzero(short & (gap == sign))
        p, q = longer.table[x[which]], shorter.table[y[which]]
        differ = p[:, :-1] != q[:, :-1]
        head = np.where(differ.any(axis=1), differ.argmax(axis=1), _ROW)
        shifted = p[:, 1:] != q[:, :-1]  # with one letter of the longer word left out before
        tail = np.where(shifted.any(axis=1), _ROW - shifted[:, ::-1].argmax(axis=1), 0)
        result[which] = tail <= head
    return result


def _apart(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) == len(b):
        return int((a != b).sum()) == 1
    if len(a) < len(b):
        a, b = b, a
    differ = np.flatnonzero(a[:-1] != b)
    place = int(differ[0]) if len(differ) else len(b)
    return bool((a[place + 1:] == b[place:]).all())


def _linked(batches):
    """(word, near, near_n) from rows sorted by subtree, those that live there first."""
    names = ["word", "near", "near_n"]

    def links(tree: Subtree, part: pa.RecordBatch, both: bool):
        words, n = part.column("word"), part.column("n").to_numpy()
        asked, found = tree.near(words, _matrix(part), *(part.column(c).to_numpy().astype(np.int8)
                                                         for c in ("surplus", "deficit")))
        sides = [(words.take(pa.array(asked)), tree.words.take(pa.array(found)), tree.n[found])]
        if both:
            sides.append((sides[0][1], sides[0][0], n[asked]))
        for side in sides:
            yield pa.RecordBatch.from_arrays([*side[:2], pa.array(side[2])], names)

    def grown(members: list):
        table = pa.Table.from_batches(members).combine_chunks().to_batches()[0]
        return table, Subtree(table.column("level")[0].as_py(), table.column("word"), table.column("n").to_numpy(),
                              _matrix(table))

    number, members, tree = None, [], None
    for batch in batches:
        places = batch.column("subtree").to_numpy()
        guests = batch.column("guest").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(places) != 0) | np.diff(guests)) + 1).tolist(), len(places)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if places[start] != number:
                if members and tree is None:
                    table, tree = grown(members)
                    yield from links(tree, table, False)
                number, members, tree = places[start], [], None
            if not guests[start]:
                members.append(part)
                continue
            if members and tree is None:
                table, tree = grown(members)
                yield from links(tree, table, False)
            if tree is not None:  # a part of an anagram class may hold no word
                yield from links(tree, part, True)
    if members and tree is None:
        table, tree = grown(members)
        yield from links(tree, table, False)


def near_words(vocabulary: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, near, near_n) of every two words of (word, n) one edit apart, both ways."""
    shape = "word string, n long, counts binary"
    rows = scratch.table(vocabulary.select("word", "n").mapInArrow(_vectored(letter_groups(vocabulary)), shape),
                         "vectors", "zstd")
    if rows.isEmpty():
        return rows.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    top = top_of(rows, subtree)
    routed = rows.mapInArrow(_routed(top), "subtree long, level int, guest boolean, surplus int, deficit int, " + shape)
    return (routed.repartition("subtree").sortWithinPartitions("subtree", "guest")
            .mapInArrow(_linked, "word string, near string, near_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following the forms ends. A form occurs at least
    twice as often as its word, so paths are short, and each round doubles the step."""
    spark = forms.sparkSession
    state, path = scratch.placed(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, next_path = scratch.placed(
            state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                       F.col("further").isNotNull().alias("moved")), "forms")
        scratch.remove(spark, path)
        state, path = moved.select("word", "root"), next_path
        if moved.where("moved").isEmpty():
            return state


def variants(docs: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text).

    A word is a maximal run of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at
    least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences; a run whose checksum
    with its doc_id divides by ``DELETES`` loses a code point first. ``form`` is the word's
    commonest near word if that is ``COMMONER`` times as common, ties going to the smallest.

    NULL and empty texts have no words; a NULL doc_id counts as an empty string in the
    checksum; repeated rows count each. A table without words gives no rows.
    """
    vocabulary = scratch.table(words(docs), "words", "zstd")
    near = near_words(vocabulary, subtree).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocabulary.join(near, "word", "left")
    formed = -F.col("best.less") >= COMMONER * F.col("n")
    listed = scratch.table(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "listed")
    ends = roots(listed.where("form is not null").select("word", "form"))
    return (listed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
