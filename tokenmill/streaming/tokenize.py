"""Structured Streaming form of the tokenized cache.

A file arrives whole in one micro-batch, so pairing inside a file needs no state.
Each micro-batch is a batch of the cache, named by the stream and its own number,
and leaves out files that the manifest already has; a micro-batch that is replayed
after its commit is skipped, so nothing is doubled, and a stream that starts anew
writes beside what earlier ones have written. Batch jobs may write, read and tidy
the same cache meanwhile.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenmill.operators import segments
from tokenmill.operators.encode import Tokenizer
from tokenmill.sources import cache, files as sources, log
from tokenmill.sources.files import spread

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def read_texts(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A directory of text files as a stream of ``FILES``, at most ``files_per_batch`` in a
    micro-batch; undecodable ones are left out, as the batch job leaves them out."""
    reader = spark.readStream.format("binaryFile").schema(_BINARY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(path)
    found = sources.decoded(rows.select(sources.file_key(), "content", F.col("length").alias("n_bytes")))
    return found.where("accepted").select("file_key", "text", F.col("n_bytes").alias("n_chars"))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream a checkpoint belongs to, kept beside its state."""
    name = f"{checkpoint}/stream-name"
    if not cache.exists(spark, name):
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").coalesce(1).write.parquet(name)
    return spark.read.parquet(name).first().name


def tokenize(files: DataFrame, tokenizer: Tokenizer, path: str, checkpoint: str,
             **options) -> StreamingQuery:
    """Append the examples of newly arrived files to the cache at ``path``;
    stops when what has arrived is done."""
    stream = stream_id(files.sparkSession, checkpoint)

    def write(arrived: DataFrame, batch_no: int) -> None:
        batch = f"{stream}-{batch_no}"
        if batch in log.batches(arrived.sparkSession, path):
            return
        todo = cache.pending(spread(arrived, "file_key"), cache.manifest(arrived.sparkSession, path))
        cache.add(todo, segments.examples(todo, tokenizer, **options), path, batch)

    return (files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
