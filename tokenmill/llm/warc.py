"""WARC archives of pages, written and read by Spark, boundaries verified by chain.

A record is a line of a text table whose line separator is the two line ends that close a
record, so Spark's own writer makes the archives. They are read as text whose separator is
the record magic: every split of a file gives pieces that begin behind a magic, wherever
that stands, and the pieces' lengths give their offsets. A piece whose header states a
length is a candidate and points to the offset where the next record must begin. Only
what the chain from the start of the file reaches is a record; a magic inside a payload is
not. Chains are followed by pointer jumping, inside segments of a file first and then
from segment to segment.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tokenmill.sources import scratch

# Fixed values of the format.
MAGIC, LINE, CLOSE = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: bytes of a file whose candidates a task follows at a time
SEGMENT = 64 << 20

#: bytes of a file that one row stands for when records are matched with their pieces
_BIN = 1 << 20


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four digits for each 20 bits."""
    hexadecimal = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def records(pages: DataFrame, least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column, the text of a record for each row of ``pages`` (page_id, url, html).

    Of pages with equal payloads of at least ``least_revisit`` bytes those with the smallest
    page_id are responses, all others revisit it; NULL html is an empty payload. Pages whose
    page_id is NULL are always responses. Line ends in a URL are left out.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "")
                        .alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", digest(F.col("html").cast("binary")))
    size = F.octet_length("html")
    shared = (rows.where(size >= least_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).where("n > 1").drop("n"))
    # written first, so that Spark knows its size and leaves the payloads where they are if it is small
    marked = rows.join(scratch.table(shared, "shared"), "digest", "left")
    revisit = (size >= least_revisit) & F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))

    def line(name: str, *value) -> Column:
        return F.concat(F.lit(f"{name}: "), *(F.lit(v) if isinstance(v, str) else v for v in value), F.lit(LINE))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return marked.select(F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", date),
        line("WARC-Target-URI", F.coalesce("url", F.lit(""))),
        line("WARC-Payload-Digest", "sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", PROFILE)))
        .otherwise(F.lit("")),
        line("Content-Type", "text/html; charset=utf-8"),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(LINE), body).alias("value"))


def write(pages: DataFrame, folder: str, least_revisit: int = 0) -> None:
    records(pages, least_revisit).write.option("lineSep", CLOSE).text(folder)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces between magics, in order inside a (file, block)."""
    return (spark.read.option("lineSep", MAGIC).text(folder)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"))
            .withColumn("piece", F.monotonically_increasing_id()))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.nullif(found, F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a record text behind its magic."""
    end = F.instr(value, CLOSE)
    head = F.when(end > 0, F.substring(value, F.lit(1), end + 1))
    return {"head_bytes": F.octet_length(head).cast("long") + 2, "length": _field(head, "Content-Length").cast("long"),
            "type": _field(head, "WARC-Type"),
            "page_id": F.regexp_extract(_field(head, "WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1),
            "refers_to": F.regexp_extract(_field(head, "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1),
            "declared": F.regexp_extract(_field(head, "WARC-Payload-Digest"), r"^sha1:(\w+)$", 1)}


def _body(value: Column) -> Column:
    """What follows the header, without the line ends that close the record."""
    start = F.instr(value, CLOSE) + len(CLOSE)
    return F.substring(value, start, F.greatest(F.length(value) - start + 1 - len(CLOSE), F.lit(0)))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A narrow row for each piece of an archive: where its magic stands in the file, the
    header's fields, and the payload's digest if the record is this one piece."""
    scan = _scan(spark, folder)
    parsed = scan.select("file", "block", "piece", F.octet_length("value").cast("long").alias("bytes"),
                         *(column.alias(name) for name, column in _parsed(F.col("value")).items()), "value")
    whole = F.col("bytes") == F.col("head_bytes") + F.col("length") + len(CLOSE)
    parsed = parsed.withColumn("whole", F.coalesce(whole, F.lit(False)))
    parsed = parsed.withColumn("digest", F.when(F.col("whole"), digest(_body(F.col("value")).cast("binary")))) \
        .drop("value")
    parsed = scratch.table(parsed, "pieces")
    step = F.col("bytes") + len(MAGIC)
    before = W.Window.partitionBy("file", "block").orderBy("piece").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = parsed.groupBy("file", "block").agg(F.sum(step).alias("total"))
    earlier = W.Window.partitionBy("file").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum(step).over(before), F.lit(0))
    return (parsed.withColumn("within", within).join(blocks, ["file", "block"])
            .withColumn("offset", F.col("base") + F.col("within") - len(MAGIC)).drop("base", "within")
            .withColumn("next", F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(CLOSE)))


def _successors(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The place of each candidate's successor among the sorted offsets, or itself if the
    chain leaves them there."""
    at = np.searchsorted(offsets, following)
    inside = (at < len(offsets)) & (offsets[np.minimum(at, len(offsets) - 1)] == following)
    return np.where(inside, at, np.arange(len(offsets)))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each candidate's chain leaves the segment, by pointer jumping."""
    rows = rows.sort_values("offset").drop_duplicates("offset")
    last = _successors(rows["offset"].to_numpy(), rows["next"].to_numpy())
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    return pd.DataFrame({"file": rows["file"].to_numpy(), "offset": rows["offset"].to_numpy(),
                         "leaves": rows["next"].to_numpy()[last]})


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the segment's entries reach, by pointer jumping."""
    rows = rows.sort_values(["offset", "entry"], ascending=[True, False]).drop_duplicates("offset")
    jump, reached = _successors(rows["offset"].to_numpy(), rows["next"].to_numpy()), rows["entry"].to_numpy().copy()
    while True:
        reached[jump[reached]] = True
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return rows.loc[reached, ["file", "offset"]]


def chain(candidates: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(file, offset) of the candidates (file, offset, next) that the chain from offset 0 of
    their file reaches. A task holds one segment's candidates at a time; chains over several
    segments take a number of rounds that grows with the logarithm of the segment count."""
    cut = candidates.select("file", "offset", "next", F.floor(F.col("offset") / segment).alias("segment"))
    shape = "file string, offset long, leaves long"
    jumps = scratch.table(cut.groupBy("file", "segment").applyInPandas(
        lambda rows: _exits(rows), shape), "jumps")
    reached = scratch.table(jumps.where("offset = 0").select("file", "offset"), "reached")
    # only candidates that some chain enters a segment by can pass it on
    doors = jumps.select("file", F.col("leaves").alias("offset")).distinct().union(reached)
    jumps = scratch.table(jumps.join(doors, ["file", "offset"], "left_semi"), "jumps")
    count = reached.count()
    while count:
        onward = reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        onward = onward.join(jumps, ["file", "offset"], "left_semi")
        reached = scratch.table(reached.union(onward).distinct(), "reached")
        grown = reached.count()
        if grown == count:
            break
        count = grown
        second = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("beyond"))
        jumps = scratch.table(jumps.join(second, ["file", "leaves"], "left").select(
            "file", "offset", F.coalesce("beyond", "leaves").alias("leaves")), "jumps")
    entries = reached.withColumn("entry", F.lit(True))
    marked = cut.join(entries, ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "segment").applyInPandas(lambda rows: _reached(rows), "file string, offset long")


def _assembled(spark: SparkSession, folder: str, all_pieces: DataFrame, divided: DataFrame) -> DataFrame:
    """(file, offset, payload_bytes, digest) of records whose payload holds a magic."""
    bins = F.explode(F.sequence(F.floor(F.col("offset") / _BIN), F.floor(F.col("next") / _BIN)))
    spans = divided.select("file", "offset", "next", bins.alias("bin"))
    parts = (all_pieces.select("file", "piece", F.col("offset").alias("at"), F.floor(F.col("offset") / _BIN).alias("bin"))
             .join(spans, ["file", "bin"]).where("at >= offset and at < next").select("file", "piece", "offset"))
    texts = _scan(spark, folder).join(parts, ["file", "piece"]).groupBy("file", "offset").agg(
        F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"))
    body = _body(F.array_join(F.col("parts.value"), MAGIC)).cast("binary")
    return texts.select("file", "offset", F.octet_length(body).cast("long").alias("payload_bytes"),
                        digest(body).alias("digest"))


def read(spark: SparkSession, folder: str, segment: int = SEGMENT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    A revisit has the size and digest of the payload it refers to. A record that is cut off
    at the end of its file is left out, and so is everything that no chain from the start of
    its file reaches. An empty folder gives no rows.
    """
    found = scratch.table(pieces(spark, folder), "offsets")
    candidates = found.where("offset >= 0 and next is not null")
    records_at = candidates.join(chain(candidates, segment), ["file", "offset"], "left_semi")
    records_at = scratch.table(records_at, "records")
    divided = records_at.where(~F.col("whole"))
    whole = records_at.where("whole").withColumn("payload_bytes", F.col("length"))
    if not divided.isEmpty():
        put_together = _assembled(spark, folder, found, divided)
        whole = whole.unionByName(divided.drop("digest").join(put_together, ["file", "offset"])
                                  .where("payload_bytes = length"))
    ids = [F.expr(f"try_cast({name} as long)").alias(name) for name in ("page_id", "refers_to")]
    rows = whole.select(*ids, "type", "payload_bytes", "digest", "declared")
    responses = rows.where("type = 'response'")
    payloads = responses.select(F.col("page_id").alias("refers_to"), F.col("digest").alias("declared"),
                                "payload_bytes", "digest").distinct()
    revisits = rows.where("type = 'revisit'").drop("payload_bytes", "digest").join(payloads, ["refers_to", "declared"])
    names = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"),
             F.col("type").alias("record_type"), "refers_to"]
    return responses.select(*names).union(revisits.select(*names))


def round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    folder = scratch.folder(pages.sparkSession, "warc")
    write(pages, folder, least_revisit)
    return read(pages.sparkSession, folder)
