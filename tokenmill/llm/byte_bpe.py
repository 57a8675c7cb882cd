"""Byte-level BPE encoding and decoding of whole texts by a rank file.

A text longer than a chunk is cut into overlapping chunks that become tasks of their
own. Each chunk is split into pre-tokens from its first character on, right or wrong.
In the overlap of two chunks the first boundary that both found is a true one as soon
as the left chunk's are, because the pattern only looks ahead; so from chunk to chunk
the left one counts up to that boundary and the right one from there. An overlap always
reaches past a change from other characters to white space, which is a boundary
wherever one starts, so two neighbours always meet.
"""

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.words import slices

#: characters of a chunk, and of the overlap with the next one at least
CHUNK, OVERLAP = 1 << 14, 1 << 9

#: pre-tokens whose ids a task remembers
MEMO = 1 << 16

_MEET = regex.compile(r"\S\s")


@functools.cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def cuts(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, meet, stop) of each chunk: the next chunk starts at ``start + chunk``,
    both have found a boundary at ``meet`` at the latest, and the chunk ends at ``stop``.
    The last chunk meets none: its meet is -1."""
    start = 0
    while True:
        found = _MEET.search(text, start + chunk + overlap) if start + chunk + overlap < len(text) else None
        if found is None:
            yield start, -1, len(text)
            return
        meet = found.start() + 1
        yield start, meet, min(meet + 4, len(text))
        start += chunk


def _cut(chunk: int, overlap: int):
    names = ["row", "doc_id", "part", "start", "head_end", "tail_start", "tail_end", "text"]
    types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        for batch in slices(batches):
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                text, head_end = text.as_py(), 0
                parts = []
                for part, (start, meet, stop) in enumerate(cuts(text, chunk, overlap)):
                    parts.append((row.as_py(), doc_id.as_py(), part, start, head_end, start + chunk, meet,
                                  text[start:stop]))
                    head_end = meet
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names)
    return run


def _encode_chunks(path: str, pattern: str):
    """Ids of a whole chunk, and how many of them precede each boundary it found in the
    overlap with the chunk before and in that with the chunk after."""
    split = regex.compile(pattern)
    names = ["row", "doc_id", "part", "ids", "head", "head_ids", "tail", "tail_ids"]

    def run(batches):
        # a pre-token is encoded by itself: a longer stretch could be split otherwise at its end
        encode = functools.lru_cache(MEMO)(_encoding(path, pattern).encode_ordinary)
        for batch in slices(batches):
            ids, marks = [], []
            for start, head_end, tail_start, tail_end, text in zip(
                    *(batch.column(c).to_pylist() for c in ("start", "head_end", "tail_start", "tail_end", "text")),
                    strict=True):
                pieces = split.findall(text)
                coded = [encode(piece) for piece in pieces]
                places = start + np.cumsum([0, *map(len, pieces)])
                counts = np.cumsum([0, *map(len, coded)])
                head = (places <= head_end) & (start > 0)
                tail = (places >= tail_start) & (places <= tail_end)
                ids.append(_packed(list(itertools.chain.from_iterable(coded))))
                marks.append((places[head], counts[head], places[tail], counts[tail]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:3]), pa.array(ids, pa.binary()),
                 *(pa.array([m[i] for m in marks], pa.list_(pa.int64())) for i in range(4))], names)
    return run


def stitched(parts: list[dict]) -> bytes:
    """The ids of a text from those of its chunks in order."""
    kept, begin, meet = [], 0, 0
    for part, after in zip(parts[:-1], parts[1:], strict=True):
        theirs = dict(zip(after["head"], after["head_ids"], strict=True))
        # before its own meeting with the chunk to the left a chunk's boundaries may be wrong
        meet, count = next((p, n) for p, n in zip(part["tail"], part["tail_ids"], strict=True)
                           if p >= meet and p in theirs)
        kept.append(part["ids"][4 * begin:4 * count])
        begin = theirs[meet]
    kept.append(parts[-1]["ids"][4 * begin:])
    return b"".join(kept)


#: what a task can return of a document's ids
_KINDS = {"ids": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _wanted(encoding: tiktoken.Encoding, ids: bytes, columns: tuple) -> Iterator:
    """The values of ``columns`` for one document; the last digest is of the bytes that its
    ids decode to."""
    for name in columns:
        if name == "ids":
            yield ids
        elif name == "n_tokens":
            yield len(ids) // 4
        elif name == "ids_sha256":
            yield hashlib.sha256(ids).hexdigest()
        else:
            yield hashlib.sha256(encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())).hexdigest()


def _rows(encoding: tiktoken.Encoding, doc_ids: pa.Array, all_ids: Iterator[bytes], columns: tuple) -> pa.RecordBatch:
    values = list(zip(*(_wanted(encoding, ids, columns) for ids in all_ids), strict=True)) or [[]] * len(columns)
    return pa.RecordBatch.from_arrays(
        [doc_ids, *(pa.array(v, _KINDS[c]) for v, c in zip(values, columns, strict=True))], ["doc_id", *columns])


def _stitch(path: str, pattern: str, columns: tuple):
    def run(batches):
        for batch in batches:
            yield _rows(_encoding(path, pattern), batch.column("doc_id"),
                        (stitched(parts.as_py()) for parts in batch.column("parts")), columns)
    return run


def _encode_whole(path: str, pattern: str, columns: tuple):
    def run(batches):
        encoding = _encoding(path, pattern)
        for batch in slices(batches):
            yield _rows(encoding, batch.column("doc_id"),
                        (_packed(encoding.encode_ordinary(text.as_py())) for text in batch.column("text")), columns)
    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP,
           columns: tuple = ("ids",)) -> DataFrame:
    """(doc_id, ids) for each row of ``docs``: the ids as little-endian unsigned 32-bit
    integers in one binary value. NULL and empty texts have none; repeated rows and NULL
    doc_ids give a row each. Texts of at most ``chunk`` characters are one chunk and are
    encoded where they are read; only longer ones are shuffled, chunk by chunk.

    ``columns`` are any of ids, n_tokens, ids_sha256 and decoded_sha256, all made in the
    task that has the ids.
    """
    shape = ", ".join(["doc_id long", *(f"{c} {_SQL[c]}" for c in columns)])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode_whole(path, pattern, columns), shape)
    long = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = long.mapInArrow(
        _cut(chunk, overlap), "row long, doc_id long, part int, start long, head_end long, tail_start long, "
                              "tail_end long, text string")
    coded = parts.repartition("row", "part").mapInArrow(
        _encode_chunks(path, pattern), "row long, doc_id long, part int, ids binary, head array<long>, "
                                       "head_ids array<long>, tail array<long>, tail_ids array<long>")
    fields = F.struct("part", "ids", "head", "head_ids", "tail", "tail_ids")
    whole = (coded.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(fields)).alias("parts"))
             .select("doc_id", "parts").mapInArrow(_stitch(path, pattern, columns), shape))
    return short.union(whole)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a column ``content``: the bytes of its ids, one after the other."""
    def run(batches):
        token_bytes = _encoding(path, pattern).decode_bytes
        for batch in slices(batches, "ids"):
            content = [token_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary())],
                                             [*batch.schema.names, "content"])

    return encoded.mapInArrow(run, encoded.schema.simpleString()[len("struct<"):-1] + ",content:binary")


def digests(docs: DataFrame, path: str, pattern: str, *more: str, chunk: int = CHUNK,
            overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents, and ``more`` of
    what :func:`encode` returns; the last digest is of the bytes that the ids decode to."""
    return encode(docs, path, pattern, chunk, overlap, ("n_tokens", "ids_sha256", "decoded_sha256", *more))
