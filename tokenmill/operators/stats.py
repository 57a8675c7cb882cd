"""Counts of examples and tokens."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tokenmill.operators import encode
from tokenmill.schema import BIG_FILE_CHARS


def corpus(files: DataFrame, tokenizer: encode.Tokenizer, max_length=512, n_sentences=0,
           use_overflow=False, big_file_chars: int = BIG_FILE_CHARS) -> DataFrame:
    """(file_key, num_examples, num_tokens) of the segments of each file, before
    pairing. A file held in one row is counted in that row."""
    small, big = encode.by_size(files, big_file_chars)
    options = dict(max_length=max_length, n_sentences=n_sentences, use_overflow=use_overflow)
    tokens = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.size(s.ids))
    of_small = encode.file_segments(small, tokenizer, **options).select(
        "file_key", F.size("segments").cast("long").alias("num_examples"), tokens.alias("num_tokens"))
    counted = encode.spread_segments(big, tokenizer, **options).groupBy("file_key").agg(
        F.count("*").alias("num_examples"), F.sum(F.size("ids")).alias("num_tokens"))
    nothing = F.lit(0).cast("long")
    of_big = big.select("file_key").join(counted, "file_key", "left").select(
        "file_key", *[F.coalesce(n, nothing).alias(n) for n in ("num_examples", "num_tokens")])
    return of_small.unionByName(of_big)


def totals(per_file: DataFrame) -> DataFrame:
    """One row: files, examples and tokens of the corpus."""
    return per_file.agg(F.count("*").alias("num_files"), F.sum("num_examples").alias("num_examples"),
                        F.sum("num_tokens").alias("num_tokens"))


def cached(examples: DataFrame) -> DataFrame:
    """(file_key, num_examples, num_tokens) of a cache: its rows and attended positions."""
    attended = F.size(F.filter("attention_mask", lambda on: on))
    return examples.groupBy("file_key").agg(
        F.count("*").alias("num_examples"), F.sum(attended).alias("num_tokens"))


def observed(examples: DataFrame, progress: Observation) -> DataFrame:
    """The same rows; ``progress.get`` has their counts once an action has run."""
    return examples.observe(progress, F.count("*").alias("num_examples"),
                            F.sum("n_tokens").alias("num_tokens"))
