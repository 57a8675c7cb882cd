"""Vocabulary tables (token, token_id)."""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions import arrow

#: bytes of text whose chunks a task counts at a time, besides one text
SLICE_BYTES = 4 << 20

# The special tokens, in id order.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS, SEP, MASK = range(5)

# A word is one punctuation mark, or a run without punctuation and space.
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
WORD = f"[{PUNCTUATION}]|[^\\s{PUNCTUATION}]+"


@F.arrow_udf(T.StringType())
def _normalized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from tokenizers.normalizers import BertNormalizer
    normalize = BertNormalizer(lowercase=True).normalize_str
    for texts in batches:
        distinct = texts.dictionary_encode()
        clean = [t if t is None else normalize(t) for t in distinct.dictionary.to_pylist()]
        yield pa.array(clean, pa.string()).take(distinct.indices)
    pa.default_memory_pool().release_unused()


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, n) of some texts at a time."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for start, end in arrow.cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            spaced = texts.slice(start, end - start)
            for mark in "\t\r\n":
                spaced = pc.replace_substring(spaced, mark, " ")
            chunks, counts = pc.split_pattern(spaced, " ").flatten().value_counts().flatten()
            yield pa.RecordBatch.from_arrays([chunks, counts], ["chunk", "n"])
    pa.default_memory_pool().release_unused()  # a worker that is used again for another step would keep it


def word_counts(files: DataFrame) -> DataFrame:
    """(word, n) of the normalized corpus.

    Space-separated chunks are counted as they stand first, in the tasks
    some texts at a time, so only distinct chunks are normalized and cut into words.
    """
    chunks = (files.select("text").mapInArrow(_chunk_counts, "chunk string, n long")
              .groupBy("chunk").agg(F.sum("n").alias("n")))
    words = chunks.select(
        F.explode(F.regexp_extract_all(_normalized("chunk"), F.lit(WORD), F.lit(0))).alias("word"),
        "n")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def build(files: DataFrame, n_words: int) -> DataFrame:
    """Specials, characters, ``##`` characters, then the ``n_words`` commonest words.

    The result has at most ``n_words`` rows besides the characters of the
    script, so numbering it in one window is safe.
    """
    counts = word_counts(files)
    # asking for n in both, where no filter can go below the counting, lets Spark count once for both uses
    letters = (counts.where("n > 0").select(F.explode(F.split("word", "")).alias("token"))
               .where("token <> ''").distinct())
    words = (counts.where(F.when(F.col("n") > 0, F.length("word") > 1))
             .orderBy(F.desc("n"), "word").limit(n_words))
    specials = files.sparkSession.createDataFrame(
        [(0, t, i) for i, t in enumerate(SPECIALS)], "part int, token string, ord long")
    alphabet = letters.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("part"), "token").select(
        "part", F.when(F.col("part") == 2, F.concat(F.lit("##"), "token")).otherwise(F.col("token"))
        .alias("token"), F.lit(0).cast("long").alias("ord"))
    ranked_words = words.select(F.lit(3).alias("part"), F.col("word").alias("token"),
                                (-F.col("n")).alias("ord"))
    parts = specials.unionByName(alphabet).unionByName(ranked_words)
    numbering = Window.orderBy("part", "ord", "token")
    return parts.select("token", (F.row_number().over(numbering) - 1).alias("token_id"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file, one token per line, ids in line order."""
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")))
    return lines.select(F.col("col").alias("token"), F.col("pos").alias("token_id"))


def as_dict(vocab: DataFrame, limit: int = 1 << 20) -> dict[str, int]:
    """The table as a dict for shipping to the tasks; refuses an unbounded table."""
    rows = vocab.select("token", "token_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a vocabulary of more than {limit} tokens is not shipped to tasks")
    return {row.token: row.token_id for row in rows}


def decode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``token`` to rows carrying ``token_id``; Spark broadcasts the vocabulary
    when its measured size allows."""
    return tokens.join(vocab, "token_id", "left")
