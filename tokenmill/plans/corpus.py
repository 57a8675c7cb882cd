"""Text files to a tokenized, split cache."""

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators import segments, split, stats
from tokenmill.operators.encode import Tokenizer
from tokenmill.sources import cache, files, scratch


def tokenize_and_cache(texts: DataFrame, tokenizer: Tokenizer, path: str, n_sentences=0,
                       use_overflow=False, two_segments=True, delete_existing=False,
                       max_length=512, seed: int = 0) -> DataFrame:
    """Tokenize the files the cache's manifest lacks (all of them with
    ``delete_existing``), add them as a batch, and return the whole cache."""
    spark = texts.sparkSession
    if delete_existing:
        scratch.remove(spark, path)
    cache.tidy(spark, path)
    todo = cache.pending(texts, cache.manifest(spark, path))
    made = segments.examples(todo, tokenizer, seed, two_segments, max_length, n_sentences, use_overflow)
    cache.add(todo, made, path, uuid.uuid4().hex)
    return cache.read(spark, path)


#: files and bytes of a batch of :func:`tokenize_tree` at most, besides one file
BATCH_FILES, BATCH_BYTES = 50_000, 1 << 40


def _batches(listed: DataFrame, most_files: int, most_bytes: int) -> Iterator[list[str]]:
    """Keys of files in batches; the driver holds one of these, and one partition of the keys."""
    keys, held = [], 0
    for row in listed.select("file_key", "n_bytes").orderBy("file_key").toLocalIterator():
        if keys and (len(keys) >= most_files or held + row.n_bytes > most_bytes):
            yield keys
            keys, held = [], 0
        keys.append(row.file_key)
        held += row.n_bytes
    if keys:
        yield keys


def tokenize_tree(spark: SparkSession, source: str, tokenizer: Tokenizer, path: str, batch_files: int = BATCH_FILES,
                  batch_bytes: int = BATCH_BYTES, progress: Callable[[str, dict], None] | None = None,
                  **options) -> DataFrame:
    """Tokenize the files below ``source`` that the cache's manifest lacks and return the whole
    cache; ``options`` are those of :func:`segments.examples`.

    The directory is listed without opening a file, and only files that are not finished are
    read, in batches that are committed one by one, so a job that dies loses one batch. A
    file that is no UTF-8 counts as finished and rejected. ``progress`` is called with a batch's
    name and its numbers of examples and tokens as they were counted while it was written.
    """
    cache.tidy(spark, path)
    listed = files.listing(spark, source)
    finished = cache.manifest(spark, path).select("file_key")
    todo = scratch.table(listed.join(finished, "file_key", "left_anti"), "listing")
    for keys in _batches(todo, batch_files, batch_bytes):
        batch, seen = uuid.uuid4().hex, Observation()
        read = files.decoded(files.read_binary(spark, source, keys))
        texts = read.where("accepted").select("file_key", "text", F.col("n_bytes").alias("n_chars"))
        made = segments.examples(texts, tokenizer, **options)
        named = spark.createDataFrame([(key,) for key in keys], "file_key string")
        cache.add(named, stats.observed(made, seen), path, batch, lambda empty: files.decoded(
            files.read_binary(spark, source, empty)).where("not accepted"))
        if progress:
            progress(batch, seen.get)
    return cache.read(spark, path)


def split_cache(examples: DataFrame, path: str, train=0.8, val=0.1, test=None, seed: int = 0) -> str:
    """Write examples into one folder per split, files kept whole."""
    parted = split.assign(examples, examples, train, val, test, seed)
    return cache.write(parted.where("split IS NOT NULL"), path, by=("split",))
