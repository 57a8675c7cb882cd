"""Token ids as wavelet matrices, one per shard file.

A shard file is a binary value: a header, then one bit plane for each bit of an id, the
highest first. A plane holds the current order's bits and the number of ones before each
block of them; the next plane's order puts the ids with a zero bit before those with a
one, each in order. So access, counting and finding the n-th occurrence of a token walk
the planes with rank and select and decode nothing else. The files are the rows of a
Parquet table, which Spark's committer makes safe against lost tasks on any store.
"""

import functools
import gc
import os
import struct
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tokenmill.llm.words import SLICE_BYTES, slices
from tokenmill.sources import scratch

#: tokens of a shard file after which the next document begins a new one
SHARD_TOKENS = 1 << 20

#: tokens of a range of documents that one task sorts, on average at most
PART_TOKENS = 1 << 24

#: id put after each document
END = 2

#: pieces whose ids a worker remembers, also for the tasks after; of other chunks an eighth as many
MEMO = 1 << 19

#: letters that are lower-cased one by one and marks that join one another: a chunk of letters and
#: then marks is two pieces
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªºµ")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: bits between two stored counts
_BLOCK = 512
_MAGIC = b"WVM1"


def build(ids: np.ndarray) -> bytes:
    """The file of a sequence of ids below 2^32."""
    highest = int(np.max(ids, initial=0))
    order = np.asarray(ids, np.uint16 if highest < 1 << 16 else np.uint32)
    planes = max(1, highest.bit_length())
    parts = [struct.pack("<4sQII", _MAGIC, len(order), planes, _BLOCK)]
    for plane in range(planes - 1, -1, -1):
        bits = (order & order.dtype.type(1 << plane)) != 0
        packed = np.zeros(-(-len(bits) // _BLOCK) * (_BLOCK // 8), np.uint8)
        packed[:-(-len(bits) // 8)] = np.packbits(bits)
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64)
        parts += [np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes(), packed.tobytes()]
        order = np.concatenate([order[np.flatnonzero(~bits)], order[np.flatnonzero(bits)]])
    return b"".join(parts)


class Matrix:
    """Queries on a file made by :func:`build`."""

    def __init__(self, content: bytes):
        magic, self.size, self.planes, self.block = struct.unpack_from("<4sQII", content)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at, blocks = struct.calcsize("<4sQII"), -(-self.size // self.block)
        self.counts, self.bits = [], []
        for _ in range(self.planes):
            self.counts.append(np.frombuffer(content, "<u4", blocks + 1, at))
            at += 4 * (blocks + 1)
            self.bits.append(np.frombuffer(content, np.uint8, blocks * self.block // 8, at))
            at += blocks * self.block // 8

    def _ones(self, plane: int, position: int) -> int:
        """Ones of a plane before a position."""
        block, rest = divmod(position, self.block)
        total = int(self.counts[plane][block])
        if rest:
            start = block * self.block // 8
            piece = np.unpackbits(self.bits[plane][start:start + -(-rest // 8)], count=rest)
            total += int(piece.sum())
        return total

    def _zeros(self, plane: int) -> int:
        return self.size - int(self.counts[plane][-1])

    def access(self, position: int) -> int:
        """The id at a position."""
        if not 0 <= position < self.size:
            raise IndexError(position)
        value = 0
        for plane in range(self.planes):
            ones = self._ones(plane, position)
            bit = self._ones(plane, position + 1) - ones
            value = value << 1 | bit
            position = self._zeros(plane) + ones if bit else position - ones
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences before ``stop`` stand after the last plane."""
        low, high = 0, min(max(stop, 0), self.size)
        if token < 0 or token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            ones = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.planes - 1 - plane) & 1:
                low, high = (self._zeros(plane) + n for n in ones)
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token stands in ``start:stop``."""
        stop = self.size if stop is None else stop
        low, high = self._range(token, stop)
        before = self._range(token, start)
        return max(0, high - low - (before[1] - before[0]))

    def find(self, token: int, n: int) -> int:
        """The position of the n-th occurrence of a token, from 0 on, or -1."""
        low, high = self._range(token, self.size)
        if not 0 <= n < high - low:
            return -1
        position = low + n
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            position = self._select(plane, bit, position - self._zeros(plane) if bit else position)
        return position

    def _select(self, plane: int, bit: int, n: int) -> int:
        """The position of the n-th one or zero of a plane."""
        counts = self.counts[plane].astype(np.int64)
        before = counts if bit else np.arange(len(counts)) * self.block - counts
        block = int(np.searchsorted(before, n, side="right")) - 1
        start = block * self.block // 8
        piece = np.unpackbits(self.bits[plane][start:start + self.block // 8])
        return block * self.block + int(np.flatnonzero(piece == bit)[n - int(before[block])])

    def all(self) -> np.ndarray:
        """Every id in order: the last plane's order is undone plane by plane."""
        order = np.zeros(self.size, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(self.bits[plane], count=self.size).astype(bool)
            zeros = self._zeros(plane)
            before = np.empty_like(order)
            before[np.flatnonzero(~bits)] = order[:zeros]
            before[np.flatnonzero(bits)] = order[zeros:] | order.dtype.type(1 << (self.planes - 1 - plane))
            order = before
        return order


class WordEncoder:
    """Ids of chunks of text without white space, as the library gives them.

    The library drops white space and joins nothing across it. A chunk of plain words and
    marks is cut into the pieces the library would cut it into, and each goes to its merge
    model directly; everything else, such as a chunk with one of the library's added tokens,
    goes through the library as it is. Ids are kept as bytes of 32 bits each.
    """

    #: fixed value: what the tokenizer file's pre-tokenizer keeps
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.model, self.normalize = self.library.model, self.library.normalizer.normalize_str
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = dict(zip(shown + hidden, map(chr, [*shown, *range(256, 256 + len(hidden))]), strict=True))
        self.memo, self.before = {}, {}  # pieces seen lately, and those seen before these
        self.odd, self.odd_before = {}, {}  # the same of chunks

    def _piece(self, piece: str) -> bytes:
        known = self.memo.get(piece)
        if known is None:
            if len(self.memo) >= MEMO // 2:
                self.memo, self.before = {}, self.memo
            known = self.before.get(piece)
            if known is None:
                as_bytes = piece if piece.isascii() else piece.encode().decode("latin1").translate(self.letters)
                known = array("I", [token.id for token in self.model.tokenize(as_bytes)]).tobytes()
            self.memo[piece] = known
        return known

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, chunk: str) -> bytes:
        known = self.odd.get(chunk)
        if known is None:
            if len(self.odd) >= MEMO // 16:
                self.odd, self.odd_before = {}, self.odd
            known = self.odd_before.get(chunk)
            self.odd[chunk] = known = self._chunk(chunk) if known is None else known
        return known

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if not chunk.isprintable():
                return self._whole(chunk)
            text = chunk.lower()
        else:
            # the library lower-cases letter by letter, without the rule for a final sigma
            plain = "Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)
            text = chunk.lower() if plain else self.normalize(chunk)
            if not text.rstrip(".,;:!?\")").isalpha():
                return self._whole(chunk)
        if text.isalpha():
            return self._piece(text)
        if text[:-1].isalpha() and not text[-1].isalnum() and "'" not in text:
            return self._piece(text[:-1]) + self._piece(text[-1])
        if any(token in chunk or token in text for token in self.added):
            return self._whole(chunk)
        return b"".join(map(self._piece, self.PIECES.findall(text)))

    def all(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks run together, their number in each)."""
        marks = pc.utf8_ltrim(chunks, characters=LETTERS)
        n_marks, n_bytes = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (marks, chunks))
        foreign = pc.binary_length(pc.ascii_ltrim(marks, characters=MARKS)).to_numpy(zero_copy_only=False)
        plain = (n_marks < n_bytes) & (foreign == 0)
        marked = plain & (n_marks > 0)
        words = pc.utf8_lower(pc.ascii_rtrim(chunks.filter(pa.array(plain)), characters=MARKS))
        pieces = pa.concat_arrays([words, marks.filter(pa.array(marked))]).dictionary_encode()
        ids = [self._piece(piece) for piece in pieces.dictionary.to_pylist()]
        number = pieces.indices.to_numpy(zero_copy_only=False)
        # what each chunk consists of, in order: a piece and its marks, or itself
        first = np.cumsum(1 + marked) - 1 - marked
        parts = np.zeros(len(chunks) + int(marked.sum()), np.int64)
        parts[first[plain]], parts[first[marked] + 1] = number[:len(words)], number[len(words):]
        parts[first[~plain]] = len(ids) + np.arange(len(chunks) - len(words))
        ids += [self(chunk) for chunk in chunks.filter(pa.array(~plain)).to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        found, ends = _gathered(np.frombuffer(b"".join(ids), np.uint32), lengths, parts)
        return found, np.diff(ends[np.append(first, len(parts))])


def _gathered(values: np.ndarray, lengths: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``picked`` of values run together, where each begins and the last ends)."""
    starts, size = np.cumsum(lengths) - lengths, lengths[picked]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(starts[picked] - ends[:-1], size) + np.arange(ends[-1])], ends


@functools.lru_cache(1)
def _kept(path: str, changed: int) -> WordEncoder:
    return WordEncoder(path)


def _tokenized(path: str, end: int, width: int):
    def run(batches):
        encode = _kept(path, os.stat(path).st_mtime_ns)  # a worker runs many tasks
        for batch in slices(batches, most=8 * SLICE_BYTES):
            chunks = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            coded = chunks.flatten().dictionary_encode()
            bounds = chunks.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            gc.disable()  # nothing here makes cycles, and many ids are costly to search for them
            flat, lengths = encode.all(coded.dictionary)
            gc.enable()
            tokens, ends = _gathered(flat.astype(f"<u{width}"), lengths, coded.indices.to_numpy(zero_copy_only=False))
            last = np.array([end], f"<u{width}").tobytes()
            rows = [tokens[ends[a]:ends[b]].tobytes() + last for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "ids"])
    return run


def tokenize(docs: DataFrame, path: str, end: int = END, width: int = 4) -> DataFrame:
    """(doc_id, ids): the ids of each row's text and the end id, as little-endian unsigned
    integers of ``width`` bytes. NULL and empty texts have the end id alone."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _tokenized(path, end, width), "doc_id long, ids binary")


def _packed(shard_tokens: int, width: int):
    def file_of(shard: int, number: int, docs: list, parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "part": pa.array([shard], pa.int32()), "number": pa.array([number], pa.int32()),
            "doc_ids": pa.array([docs], pa.list_(pa.int64())),
            "lengths": pa.array([[len(p) // width for p in parts]], pa.list_(pa.int64())),
            "n_tokens": pa.array([sum(map(len, parts)) // width], pa.int64()),
            "matrix": [build(np.frombuffer(b"".join(parts), f"<u{width}"))]})

    def run(batches):
        shard, number, docs, parts, held = None, 0, [], [], 0
        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if docs and (part != shard or held >= shard_tokens):
                    yield file_of(shard, number, docs, parts)
                    number, docs, parts, held = (number + 1 if part == shard else 0), [], [], 0
                shard, held = part, held + len(ids) // width
                docs.append(doc_id)
                parts.append(ids)
        if docs:
            yield file_of(shard, number, docs, parts)
    return run


def parts_for(n_tokens: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // PART_TOKENS))


def shards(tokens: DataFrame, parts: int | None = None, shard_tokens: int = SHARD_TOKENS, width: int = 4) -> DataFrame:
    """The shard files of (doc_id, ids): documents in ascending doc_id order, NULL first and
    repeated rows by their ids; a document is never divided. One row (part, number,
    doc_ids, lengths, n_tokens, matrix) for each file, in the order of part and number.

    The documents are dealt to ``parts`` ranges of doc_id, each sorted and cut into files; by
    default as many as the session shuffles to, or one for each ``PART_TOKENS`` tokens.
    """
    if not parts:
        total = tokens.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // width
        parts = parts_for(total, tokens.sparkSession)
    return (tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
            .select(F.spark_partition_id().alias("part"), "doc_id", "ids")
            .mapInArrow(_packed(shard_tokens, width), "part int, number int, doc_ids array<long>, lengths array<long>, "
                                               "n_tokens long, matrix binary"))


def placed(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: the tokens of all files before. Sums of the parts, of which
    there are as many as partitions, are added up first, so no window spans all files."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("earlier"))
    inside = W.Window.partitionBy("part").orderBy("number").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = files.select("part", "number", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    return (files.join(starts.join(sums, "part").select("part", "number", (F.col("earlier") + F.col("within"))
                                                        .alias("start")), ["part", "number"]))


def _read(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            ids = Matrix(batch.column("matrix")[row].as_py()).all().astype("<u4")
            lengths = batch.column("lengths")[row].values.to_numpy()
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_ids")[row].values, pa.array(batch.column("start")[row].as_py() + ends - lengths),
                pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def contents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shard files."""
    return placed(files).select("doc_ids", "lengths", "start", "matrix").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lookup(token: int, positions: bool):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                matrix = Matrix(batch.column("matrix")[row].as_py())
                total = matrix.count(token)
                start = batch.column("start")[row].as_py()
                found = [start + matrix.find(token, n) for n in range(total)] if positions else [total]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["found"])
    return run


def count(files: DataFrame, token: int) -> int:
    """How often a token stands in all files; none is decoded."""
    rows = files.select(F.lit(0).cast("long").alias("start"), "matrix").mapInArrow(_lookup(token, False), "found long")
    return rows.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """(position) of each occurrence of a token, counted over all files in order."""
    return (placed(files).select("start", "matrix").mapInArrow(_lookup(token, True), "found long")
            .select(F.col("found").alias("position")))


def write(tokens: DataFrame, path: str, parts: int | None = None, shard_tokens: int = SHARD_TOKENS,
          width: int = 4) -> DataFrame:
    """Write the shard files of ``tokens`` and read them back."""
    files = shards(tokens, parts, shard_tokens, width)
    files.write.option("compression", "zstd").parquet(path)
    return tokens.sparkSession.read.schema(files.schema).parquet(path)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokenize, write and read back: (doc_id, start, n_tokens, ids_crc32). Repeated rows
    are documents of their own; no documents give no rows."""
    width = 2 if WordEncoder(tokenizer).library.get_vocab_size() <= 1 << 16 else 4
    seen = Observation("tokens")
    made = tokenize(docs, tokenizer, width=width).observe(seen, F.sum(F.length("ids")).alias("bytes"))
    tokens, path = scratch.placed(made, "tokens", "zstd")
    parts = parts_for((seen.get["bytes"] or 0) // width, docs.sparkSession)
    files = write(tokens, scratch.folder(docs.sparkSession, "shards"), parts, width=width)
    scratch.remove(docs.sparkSession, path)
    return contents(files)
