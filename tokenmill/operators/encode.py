"""WordPiece encoding: one Arrow stage from texts to piece ids, the rest native.

The Arrow stage returns bare pieces. Truncation, overflow windows, special
tokens and masks follow as Spark expressions.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import arrays as ar
from tokenmill.functions import arrow
from tokenmill.functions.text import strip
from tokenmill.operators import vocab as vc
from tokenmill.operators.lines import texts_column
from tokenmill.operators.rows import inlined, numbered
from tokenmill.schema import BIG_FILE_CHARS

#: STRING array of texts -> LIST<INT32> array of their piece ids, without special tokens
Encoder = Callable[[pa.Array], pa.ListArray]

#: a task remembers the pieces of this many words
MEMO_WORDS = 1 << 16

#: texts handed to the tokenizer library at a time
SLICE = 4096

#: bytes of text that a task splits and encodes at a time, besides one file
SLICE_BYTES = 1 << 20


def list_encoder(encode_texts: Callable[[list], list]) -> Encoder:
    """An :data:`Encoder` from a function over Python lists."""
    def encode(texts):
        ids = []
        for start in range(0, len(texts), SLICE):
            ids += encode_texts(texts.slice(start, SLICE).to_pylist())
        return pa.array(ids, pa.list_(pa.int32()))
    return encode


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer the tasks can build.

    ``factory`` is called once per task and returns an :data:`Encoder`.
    ``splits_on_space`` states that encoding a text equals encoding its
    space-separated chunks one by one, so repeated chunks are encoded once.
    """

    factory: Callable[[], Encoder]
    vocab_size: int
    pad_id: int = vc.PAD
    cls_id: int = vc.CLS
    sep_id: int = vc.SEP
    mask_id: int = vc.MASK
    splits_on_space: bool = False


#: chunks the normalizer only lower-cases: printable ASCII, and no bracket that
#: could open a special token
PLAIN = r"^[!-Z\\-~]*$"

# The ASCII punctuation marks; each is a word of its own.
PLAIN_MARK = r"([!-/:-@\[-`{-~])"


def wordpiece(spark: SparkSession, vocab: dict[str, int]) -> Tokenizer:
    """Lower-casing WordPiece over a vocabulary, broadcast once."""
    shipped = spark.sparkContext.broadcast(vocab)

    def factory() -> Encoder:
        import os
        from functools import lru_cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import BertWordPieceTokenizer
        library = BertWordPieceTokenizer(shipped.value)._tokenizer
        normalize = library.normalizer.normalize_str

        @lru_cache(MEMO_WORDS)
        def pieces(word):
            return [token.id for token in library.model.tokenize(word)] if word else []

        def by_word(chunks):
            """Chunks of plain text: each distinct word once."""
            words = pc.utf8_split_whitespace(pc.replace_substring_regex(chunks, PLAIN_MARK, r" \1 "))
            distinct = words.flatten().dictionary_encode()
            ids = pa.array([pieces(w) for w in distinct.dictionary.to_pylist()], pa.list_(pa.int32()))
            return _joined(words, ids.take(distinct.indices))

        whole = list_encoder(lambda texts: [
            e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)])

        def encode(chunks):
            """Chunks that normalize to plain ASCII word by word, others by the library."""
            plain = pc.match_substring_regex(chunks, PLAIN)
            open_bracket = pc.match_substring(chunks, "[")
            foreign = chunks.filter(pc.invert(plain)).to_pylist()
            tidy = pa.array([c if "[" in c else normalize(c) for c in foreign], pa.string())
            clean = pc.replace_with_mask(pc.ascii_lower(chunks), pc.invert(plain), tidy)
            plain = pc.and_not(pc.match_substring_regex(clean, PLAIN), open_bracket)
            order = pc.array_sort_indices(pc.invert(plain))
            ids = pa.concat_arrays([by_word(clean.filter(plain)), whole(chunks.filter(pc.invert(plain)))])
            return ids.take(pc.array_sort_indices(order))

        return encode

    return Tokenizer(factory, len(vocab), *(vocab[vc.SPECIALS[i]] for i in (vc.PAD, vc.CLS, vc.SEP, vc.MASK)),
                     splits_on_space=True)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _joined(lists: pa.ListArray, ids: pa.ListArray) -> pa.ListArray:
    """The id lists of the elements of each list, run together."""
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(False))])
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(False))])
    return _lists(np.diff(ends[bounds]), ids.flatten())


def _ids_by_chunk(encode: Encoder, texts: pa.Array) -> pa.ListArray:
    """Encode each distinct space-separated chunk once and put the texts together again."""
    chunks = pc.split_pattern(texts, " ")
    distinct = chunks.flatten().dictionary_encode()
    return _joined(chunks, encode(distinct.dictionary).take(distinct.indices))


def encoded(texts: str, tokenizer: Tokenizer) -> Column:
    """ARRAY<ARRAY<INT>> of the piece ids of an ARRAY<STRING> column."""
    factory, by_chunk = tokenizer.factory, tokenizer.splits_on_space

    def of_files(encode: Encoder, files: pa.ListArray, sizes: pa.Array) -> pa.ListArray:
        flat = files.flatten()
        return _lists(sizes.to_numpy(False), _ids_by_chunk(encode, flat) if by_chunk else encode(flat))

    @F.arrow_udf("array<array<int>>")
    def encode_texts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        encode = factory()
        for batch, sizes in batches:
            # words, chunks and ids take many times the bytes of their texts
            n_bytes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.flatten()).fill_null(0).to_numpy(False))])
            ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(False))])
            yield pa.concat_arrays([of_files(encode, batch.slice(start, end - start), sizes.slice(start, end - start))
                                    for start, end in arrow.cuts(np.diff(n_bytes[ends]), SLICE_BYTES)])
        # a worker that is used again for another step would keep it
        pa.default_memory_pool().release_unused()

    # naming the texts twice keeps Spark from merging the expression that made
    # them into the call, which it cannot run when that holds nested lambdas
    return encode_texts(F.col(texts), F.size(texts))


def windows(pieces: Column, max_length: int | None, use_overflow: bool, tokenizer: Tokenizer) -> Column:
    """Framed id arrays of one text: its first window, or all of them with overflow; without a
    length the whole text is one."""
    if max_length is None:
        return F.array(ar.framed(pieces, tokenizer.cls_id, tokenizer.sep_id))
    room = max_length - 2
    if room < 1:
        raise ValueError("max_length must leave room for a piece between the specials")

    def window(start):
        return ar.framed(F.slice(pieces, start, room), tokenizer.cls_id, tokenizer.sep_id)

    if not use_overflow:
        return F.array(window(F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(room)), window)


#: an overflow example is numbered text_no * 2**CHUNK_BITS + its window number
CHUNK_BITS = 26


def segment_ids(text_no: Column, chunk_no: Column, use_overflow: bool) -> Column:
    """Number that identifies and orders the segments of a file."""
    if not use_overflow:
        return text_no.cast("long")
    return F.shiftleft(text_no.cast("long"), CHUNK_BITS) + chunk_no


def _of_text(pieces, text_no, max_length, use_overflow, tokenizer) -> Column:
    """Array of (seg_id, ids) of one text."""
    return F.transform(
        windows(pieces, max_length, use_overflow, tokenizer),
        lambda ids, chunk: F.struct(segment_ids(text_no, chunk, use_overflow).alias("seg_id"),
                                    ids.alias("ids")))


def _texts(n_sentences: int, texts: Column | None) -> Column:
    return texts_column(n_sentences) if texts is None else texts


def file_segments(files: DataFrame, tokenizer: Tokenizer, max_length=512, n_sentences=0,
                  use_overflow=False, texts: Column | None = None) -> DataFrame:
    """(file_key, segments ARRAY<(seg_id, ids)>), one row per file, no shuffle."""
    pieces = (files.select("file_key", _texts(n_sentences, texts).alias("texts"))
              .select("file_key", encoded("texts", tokenizer).alias("pieces")))
    return pieces.select("file_key", F.flatten(F.transform(
        "pieces", lambda p, i: _of_text(p, i, max_length, use_overflow, tokenizer)))
        .alias("segments"))



def spread_segments(files: DataFrame, tokenizer: Tokenizer, max_length=512, n_sentences=0,
                    use_overflow=False, texts: Column | None = None) -> DataFrame:
    """(file_key, n_chars, seg_id, ids), the texts of each file spread over all tasks."""
    rows = (numbered(files, ["file_key", "n_chars"], _texts(n_sentences, texts), "text_no", "text")
            .repartition("file_key", "text_no"))
    return text_segments(rows, tokenizer, max_length, use_overflow)


def line_rows(lines: DataFrame, chars_per_slice: int = BIG_FILE_CHARS) -> DataFrame:
    """(file_key, n_chars, text_no, text) of the clean lines of a line table.

    Sizes are pre-aggregated and only those above a slice are joined, so there
    are at most total characters / ``chars_per_slice`` of them.
    """
    clean = (lines.select("file_key", F.col("line_no").alias("text_no"), strip(F.col("line")).alias("text"))
             .where("text <> ''"))
    sizes = (clean.groupBy("file_key").agg(F.sum(F.length("text") + 1).alias("n_chars"))
             .where(F.col("n_chars") > chars_per_slice))
    return clean.join(sizes, "file_key", "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(1)))


def text_segments(rows: DataFrame, tokenizer: Tokenizer, max_length=512, use_overflow=False) -> DataFrame:
    """(file_key, n_chars, seg_id, ids) from (file_key, n_chars, text_no, text)."""
    pieces = rows.withColumn("texts", F.array("text")).select(
        "file_key", "n_chars", "text_no", encoded("texts", tokenizer).alias("pieces"))
    of_text = pieces.select("file_key", "n_chars", _of_text(
        F.element_at("pieces", 1), F.col("text_no"), max_length, use_overflow, tokenizer)
        .alias("segments"))
    return inlined(of_text, ["file_key", "n_chars"], "segments", "seg_id")


def by_size(files: DataFrame, big_file_chars: int = BIG_FILE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Files handled as one row each, and files whose rows are spread. Every file is in
    one of the two; one whose size is not known is handled as one row."""
    size = F.col("n_chars")
    return files.where(size.isNull() | (size <= big_file_chars)), files.where(size > big_file_chars)


def segments(files: DataFrame, tokenizer: Tokenizer, max_length=512, n_sentences=0,
             use_overflow=False, texts: Column | None = None,
             big_file_chars: int = BIG_FILE_CHARS) -> DataFrame:
    """(file_key, seg_id, ids) of every text of every file.

    ``texts``, an ARRAY<STRING> expression over a file, replaces the clean lines
    or sentence groups.
    """
    small, big = by_size(files, big_file_chars)
    options = dict(max_length=max_length, n_sentences=n_sentences, use_overflow=use_overflow,
                   texts=texts)
    of_small = inlined(file_segments(small, tokenizer, **options), ["file_key"], "segments", "seg_id")
    of_big = spread_segments(big, tokenizer, **options).drop("n_chars")
    return of_small.unionByName(of_big)
