"""Lines, joined texts and sentence groups of files. All narrow, one file per row."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import text as tx
from tokenmill.operators.rows import numbered


def whole_text() -> Column:
    """The text of a file; a NULL text is an empty file."""
    return F.coalesce(F.col("text"), F.lit(""))


def raw_lines(files: DataFrame) -> DataFrame:
    """(file_key, row_no, line): every physical line, blank ones too."""
    return numbered(files, ["file_key"], tx.physical_lines(whole_text()), "row_no", "line")


def clean_lines(files: DataFrame) -> DataFrame:
    """(file_key, line_no, line): stripped, blank lines dropped."""
    return numbered(files, ["file_key"], tx.stripped_lines(whole_text()), "line_no", "line")


def file_text(files: DataFrame) -> DataFrame:
    """(file_key, text): the clean lines of a file joined by a space."""
    joined = tx.joined_text(tx.stripped_lines(whole_text()))
    return files.select("file_key", joined.alias("text"))


def texts_column(n_sentences: int) -> Column:
    """What of a file gets encoded: clean lines, or groups of n sentences."""
    if n_sentences < 0:
        raise ValueError("n_sentences must not be negative")
    lines = tx.stripped_lines(whole_text())
    if n_sentences == 0:
        return lines
    joined = tx.joined_text(lines)
    return tx.sentences(joined) if n_sentences == 1 else tx.sentence_groups(joined, n_sentences)


def texts(files: DataFrame, n_sentences: int = 0) -> DataFrame:
    """(file_key, text_no, text): one row per text to encode."""
    return numbered(files, ["file_key"], texts_column(n_sentences), "text_no", "text")


#: lines of a file whose full stops are added up in one window
LINE_BLOCK_BITS = 16


def sentences_of_lines(lines: DataFrame, n_sentences: int, block_bits: int = LINE_BLOCK_BITS) -> DataFrame:
    """(file_key, text_no, text): sentences, or groups of n, of files given as lines
    (file_key, line_no, line), for files that do not fit one row; as :func:`texts` for the
    joined clean lines. A file without clean lines has no row here.

    A line's first piece belongs to the sentence whose number is that of the full stops
    before the line. Those are added up inside blocks of lines and over the blocks.
    """
    if n_sentences < 1:
        raise ValueError("n_sentences must be positive")
    clean = (lines.select("file_key", "line_no", tx.strip(F.col("line")).alias("line")).where("line <> ''")
             .withColumn("pieces", F.split("line", "\\.", -1)).drop("line")
             .withColumn("block", F.shiftright(F.col("line_no").cast("long"), block_bits)))
    stops = (F.size("pieces") - 1).cast("long")
    before = Window.partitionBy("file_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = clean.groupBy("file_key", "block").agg(F.sum(stops).alias("stops"))
    starts = blocks.select("file_key", "block", F.coalesce(F.sum("stops").over(before), F.lit(0)).alias("start"))
    inside = (Window.partitionBy("file_key", "block").orderBy("line_no")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (clean.withColumn("within", F.coalesce(F.sum(stops).over(inside), F.lit(0)))
              .join(starts, ["file_key", "block"])
              .select("file_key", "line_no", (F.col("start") + F.col("within")).alias("first"),
                      F.posexplode("pieces").alias("piece_no", "piece"))
              .withColumn("sentence", F.col("first") + F.col("piece_no")))
    sentences = placed.groupBy("file_key", "sentence").agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda p: p.piece), " "), F.lit(".")).alias("text"))
    numbered_groups = sentences.withColumn("text_no", F.floor(F.col("sentence") / n_sentences).cast("long"))
    return numbered_groups.groupBy("file_key", "text_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda p: p.text), " ").alias("text"))
