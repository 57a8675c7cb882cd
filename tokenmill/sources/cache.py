"""The tokenized cache: Parquet with ragged arrays, a few large files."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.schema import EXAMPLES
from tokenmill.sources import log, scratch


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names for intermediate tables, removed
    when the session's process ends."""
    return scratch.folder(spark, name)


#: one row for each finished file, also for files without examples and rejected ones
MANIFEST = T.StructType([T.StructField("file_key", T.StringType()), T.StructField("num_examples", T.LongType()),
                         T.StructField("num_tokens", T.LongType()), T.StructField("rejected", T.BooleanType()),
                         T.StructField("batch", T.StringType())])


def _of_batches(spark: SparkSession, path: str, schema: T.StructType, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*[f"{path}/batch={batch}" for batch in batches])


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The finished files of a version of a cache, with their counts and the batch that wrote
    them."""
    return _of_batches(spark, f"{path}/_manifest", MANIFEST, log.batches(spark, path, version))


def add(files: DataFrame, examples: DataFrame, path: str, batch: str,
        rejects: Callable[[list[str]], DataFrame] | None = None) -> None:
    """Write the ``examples`` of ``files`` as a batch of the cache and its part of the manifest,
    then commit both as a new version. ``rejects`` finds, of the keys of files without examples,
    those that could not be decoded. A batch that is part of the cache already is left as it
    is. Files with equal keys are refused, as their examples could not be told apart."""
    spark, folder = files.sparkSession, f"{path}/batch={batch}"
    if batch in log.batches(spark, path):
        return
    shared = files.groupBy("file_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if shared:
        raise ValueError(f"several files have the key {shared[0].file_key}")
    log.begin(spark, path, batch)
    examples.write.mode("overwrite").parquet(folder)
    counts = (spark.read.schema(EXAMPLES).parquet(folder).groupBy("file_key")
              .agg(F.count(F.lit(1)).alias("num_examples"), F.sum("n_tokens").alias("num_tokens")))
    finished = files.select("file_key").join(counts, "file_key", "left").fillna(0)
    empty = [row.file_key for row in finished.where("num_examples = 0").collect()] if rejects else []
    if empty:  # no more keys than the batch has
        marked = rejects(empty).select("file_key", F.lit(True).alias("rejected"))
        finished = finished.join(marked, "file_key", "left").fillna(False, "rejected")
    else:
        finished = finished.withColumn("rejected", F.lit(False))
    finished.write.mode("overwrite").parquet(f"{path}/_manifest/batch={batch}")
    log.commit(spark, path, batch)


def tidy(spark: SparkSession, path: str) -> None:
    """Remove batches that were not finished and whose writers' leases are over."""
    if not exists(spark, path):
        return
    files, where = scratch.hadoop(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(where)]
    present = [name.removeprefix("batch=") for name in names if name.startswith("batch=")]
    for batch in log.abandoned(spark, path, present):
        scratch.remove(spark, f"{path}/batch={batch}")
        scratch.remove(spark, f"{path}/_manifest/batch={batch}")
        log.forget(spark, path, batch)


def write(examples: DataFrame, path: str, mode: str = "overwrite", by: tuple = ()) -> str:
    """``overwrite`` starts the cache anew, whether or not it existed."""
    examples.write.mode(mode).partitionBy(*by).parquet(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    files, where = scratch.hadoop(spark, path)
    return files.exists(where)


def read(spark: SparkSession, *paths: str, version: int | None = None) -> DataFrame:
    """Cached examples of any number of paths; an absent column reads as NULL. Of a cache made
    of batches only those of a version, by default the newest, are read; what writers have not
    finished is not seen."""
    folders = []
    for path in paths:
        made_of = [f"{path}/batch={batch}" for batch in log.batches(spark, path, version)]
        folders += made_of if log.versioned(spark, path) else [path]
    if not folders:
        return spark.createDataFrame([], EXAMPLES)
    return spark.read.schema(EXAMPLES).parquet(*folders).select(*EXAMPLES.names)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a cache written ``by=("split",)``; the other folders are not read."""
    schema = T.StructType(EXAMPLES.fields + [T.StructField("split", T.StringType())])
    return spark.read.schema(schema).parquet(path).where(F.col("split") == split)


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose key is not among the finished ones. Where the files have texts, these are
    joined only with the keys that are left."""
    keys = files.select("file_key").join(done.select("file_key"), "file_key", "left_anti")
    if files.columns == ["file_key"]:
        return keys
    return files.join(scratch.table(keys.distinct(), "pending"), "file_key", "left_semi")
