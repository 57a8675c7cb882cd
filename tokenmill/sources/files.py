"""Text files as tables.

``FILES`` holds one whole file per row, which keeps line order exact and every
per-file step narrow. Files too long for one row are read with
:func:`read_lines`, which splits them into blocks.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_key() -> Column:
    """The key of a file, the same whichever reader reads it: its location with escapes."""
    return F.col("_metadata.file_path").alias("file_key")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when a scan has fewer input splits than cores.

    A scan with enough splits, which any large table has, is returned untouched.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(2 * cores, *keys)


def from_table(rows: DataFrame, key: Column, text="text", n_chars=None) -> DataFrame:
    """A table with one text per row seen as files."""
    size = F.col(n_chars) if n_chars else F.length(text).cast("long")
    return rows.select(key.cast("string").alias("file_key"), F.col(text).alias("text"),
                       size.alias("n_chars"))


def _below(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_key, n_bytes, modified) of every file below a directory; none is opened."""
    return _below(spark, path).select(file_key(), F.col("length").alias("n_bytes"),
                                      F.col("modificationTime").alias("modified"))


def read_binary(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Every file below a directory as undecoded bytes, or those of the given keys: the others
    are left out by their names, before any is opened."""
    found = _below(spark, path)
    if keys is not None:
        found = found.where(F.col("_metadata.file_path").isin(keys))
    return found.select(file_key(), "content", F.col("length").alias("n_bytes"))


def decoded(binary_files: DataFrame) -> DataFrame:
    """(file_key, n_bytes, accepted, text) of undecoded files in one pass. One bad byte
    sequence rejects the whole file, whose text is NULL; a byte order mark is dropped."""
    as_string = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_string), F.regexp_replace(as_string, "^\ufeff", ""))
    return (binary_files.select("file_key", "n_bytes", text.alias("text"))
            .select("file_key", "n_bytes", F.col("text").isNotNull().alias("accepted"), "text"))


def decode(binary_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split undecoded files into (``FILES`` of the decodable ones, quarantine)."""
    rows = decoded(binary_files)
    good = rows.where("accepted").select("file_key", "text", F.col("n_bytes").alias("n_chars"))
    return good, rows.where("not accepted").select("file_key", "n_bytes")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of files of any length: (file_key, line_no, line).

    Files are read in splits. Lines are ranked inside their split, and the small
    table of split sizes turns those ranks into line numbers of the file, so no
    task ever holds more than one split. A file with an undecodable line is
    left out whole.
    """
    read = spark.read.option("recursiveFileLookup", True).text(path).select(
        file_key(),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("read_order"),
        F.col("value").alias("line"),
        (~F.is_valid_utf8("value")).alias("bad"))
    blocks = read.groupBy("file_key", "block").agg(
        F.count("*").alias("rows"), F.max("bad").alias("bad"))
    whole = Window.partitionBy("file_key")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks
              .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
              .withColumn("rejected", F.max("bad").over(whole))
              .where(~F.col("rejected")).select("file_key", "block", "start"))
    inside = Window.partitionBy("file_key", "block").orderBy("read_order")
    return (read.withColumn("rank", F.row_number().over(inside) - 1)
            .join(starts, ["file_key", "block"])
            .select("file_key", (F.col("start") + F.col("rank")).alias("line_no"), "line"))


def flat_name(path: Column) -> Column:
    """Directory with its slashes removed, a dash, the file name."""
    directory = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.concat_ws("-", F.replace(directory, F.lit("/"), F.lit("")),
                       F.substring_index(path, "/", -1))


def flatten_tree(files: DataFrame, path="path") -> DataFrame:
    """Flat key of every path, and how many paths share it (``a/b`` and ``ab`` may)."""
    keyed = files.select(F.col(path).alias("path"), flat_name(F.col(path)).alias("file_key"))
    shared = (keyed.groupBy("file_key").agg(F.count("*").alias("n_paths"))
              .where("n_paths > 1"))
    return (keyed.join(shared, "file_key", "left")
            .select("path", "file_key", F.coalesce("n_paths", F.lit(1)).alias("n_paths")))


def concat(*sources: DataFrame) -> DataFrame:
    """Bag union of tables; columns one of them lacks become NULL."""
    result = sources[0]
    for other in sources[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result
