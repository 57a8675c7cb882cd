"""Examples from segments: single, or two segments of a file paired at random.

A file's segments are put in random order and taken two by two; an odd last one
is dropped. A file that fits one row is paired inside that row, without a
shuffle. A bigger file is ranked in slices of its random order, so no task ever
holds the whole file. Both ways give the same pairs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions import arrays as ar
from tokenmill.functions import draws
from tokenmill.operators import encode
from tokenmill.operators import lines as line_operators
from tokenmill.operators.rows import inlined
from tokenmill.schema import BIG_FILE_CHARS, EXAMPLES
from tokenmill.sources import scratch


def single(segments: DataFrame, *carried: str) -> DataFrame:
    """One example per segment, all of type 0; ``carried`` columns stay."""
    ids = F.col("ids")
    size = F.size(ids)
    return segments.select(
        *carried, "file_key", F.col("seg_id").alias("example_id"), F.col("seg_id").alias("seg_a_id"),
        F.lit(None).cast("long").alias("seg_b_id"), ids,
        ar.constant(True, size, "boolean").alias("attention_mask"),
        ar.frame_mask(size).alias("special_tokens_mask"),
        ar.constant(0, size, "tinyint").alias("token_type_ids"),
        size.alias("n_tokens"))


def joined(pairs: DataFrame) -> DataFrame:
    """Examples of (file_key, pair_no, a, b): b loses its first token and is of type 1."""
    a, b = F.col("a.ids"), F.col("b.ids")
    size_a, size_b = F.size(a), F.size(b)
    ids = F.concat(a, ar.tail(b))
    special = F.concat(ar.frame_mask(size_a), ar.tail(ar.frame_mask(size_b)))
    types = F.concat(ar.constant(0, size_a, "tinyint"), ar.constant(1, size_b - 1, "tinyint"))
    return pairs.select(
        "file_key", F.col("pair_no").cast("long").alias("example_id"),
        F.col("a.seg_id").alias("seg_a_id"), F.col("b.seg_id").alias("seg_b_id"),
        ids.alias("ids"),
        ar.constant(True, size_a + size_b - 1, "boolean").alias("attention_mask"),
        special.alias("special_tokens_mask"), types.alias("token_type_ids"),
        (size_a + size_b - 1).alias("n_tokens"))


def _place(key: Column, seg_id: Column) -> Column:
    """Place of a segment in the random order of its file."""
    return draws.order_draw(key, F.lit(draws.PAIRING), seg_id)


def pairs_in_rows(file_segments: DataFrame, seed: int) -> DataFrame:
    """(file_key, pair_no, a, b) from files held one per row."""
    keyed = file_segments.select("file_key", "segments",
                                 draws.row_key(seed, "file_key").alias("key"))
    shuffled = ar.bound(F.col("key"), lambda key: F.sort_array(F.transform("segments", lambda s: F.struct(
        _place(key, s.seg_id).alias("place"), s.seg_id.alias("seg_id"), s.ids.alias("ids")))))

    def couples(s):
        # with one segment or none the sequence would count downwards
        numbers = F.when(F.size(s) > 1, F.sequence(F.lit(0), F.floor(F.size(s) / 2).cast("int") - 1))
        return F.transform(numbers, lambda k: F.struct(
            k.alias("pair_no"), F.get(s, 2 * k).dropFields("place").alias("a"),
            F.get(s, 2 * k + 1).dropFields("place").alias("b")))

    rows = keyed.select("file_key", ar.bound(shuffled, couples).alias("couples"))
    return inlined(rows, ["file_key"], "couples", "pair_no")


def pairs_across_rows(segments: DataFrame, seed: int, chars_per_slice: int) -> DataFrame:
    """(file_key, pair_no, a, b) from (file_key, n_chars, seg_id, ids).

    The segments are written first, because the sizes of the slices and the rows both come
    from them and the encoder would run for each. The random order of a file is cut into ``n_chars / chars_per_slice`` equal
    ranges. Rows are ranked inside their range, and the sizes of the ranges
    before it complete the rank.
    """
    segments = scratch.table(segments, "segments")
    place = _place(draws.row_key(seed, "file_key"), F.col("seg_id"))
    slices = F.ceil(F.col("n_chars") / chars_per_slice)
    # the upper 31 bits of the place, scaled to the number of slices
    placed = segments.select(
        "file_key", "seg_id", "ids", place.alias("place"),
        F.shiftright(F.shiftright(place, 32) * slices, 31).alias("slice"))
    sizes = placed.groupBy("file_key", "slice").agg(F.count("*").alias("n"))
    before = (Window.partitionBy("file_key").orderBy("slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("file_key", "slice",
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file_key", "slice").orderBy("place", "seg_id")
    ranked = (placed.withColumn("rank", F.row_number().over(inside) - 1)
              .join(starts, ["file_key", "slice"])
              .select("file_key", (F.col("start") + F.col("rank")).alias("rank"),
                      F.struct("seg_id", "ids").alias("segment")))
    couples = ranked.groupBy("file_key", F.floor(F.col("rank") / 2).alias("pair_no")).agg(
        F.min_by("segment", "rank").alias("a"), F.max_by("segment", "rank").alias("b"),
        F.count("*").alias("n"))
    return couples.where("n = 2").drop("n")


def pairs(files: DataFrame, tokenizer: encode.Tokenizer, seed: int, max_length=512, n_sentences=0,
          use_overflow=False, big_file_chars: int = BIG_FILE_CHARS) -> DataFrame:
    """(file_key, pair_no, a, b) of every file, by the route its size calls for."""
    small, big = encode.by_size(files, big_file_chars)
    options = dict(max_length=max_length, n_sentences=n_sentences, use_overflow=use_overflow)
    of_small = pairs_in_rows(encode.file_segments(small, tokenizer, **options), seed)
    if big.isEmpty():  # decided by the sizes in the scan's statistics where these are kept
        return of_small.withColumn("pair_no", F.col("pair_no").cast("long"))
    of_big = pairs_across_rows(encode.spread_segments(big, tokenizer, **options), seed, big_file_chars)
    return of_small.unionByName(of_big)


def examples_of_lines(lines: DataFrame, tokenizer: encode.Tokenizer, seed: int = 0, two_segments=True,
                      max_length=512, n_sentences=0, use_overflow=False,
                      chars_per_slice: int = BIG_FILE_CHARS) -> DataFrame:
    """Examples from (file_key, line_no, line), for files that do not fit one row."""
    if n_sentences:
        texts = line_operators.sentences_of_lines(lines, n_sentences)
        lines = texts.select("file_key", F.col("text_no").alias("line_no"), F.col("text").alias("line"))
    rows = encode.text_segments(encode.line_rows(lines, chars_per_slice), tokenizer, max_length, use_overflow)
    made = joined(pairs_across_rows(rows, seed, chars_per_slice)) if two_segments else single(rows)
    return made.select(*EXAMPLES.names)


def examples(files: DataFrame, tokenizer: encode.Tokenizer, seed: int = 0, two_segments=True,
             max_length=512, n_sentences=0, use_overflow=False,
             big_file_chars: int = BIG_FILE_CHARS) -> DataFrame:
    """The tokenized corpus in the layout of ``schema.EXAMPLES``."""
    options = dict(max_length=max_length, n_sentences=n_sentences, use_overflow=use_overflow,
                   big_file_chars=big_file_chars)
    if two_segments:
        made = joined(pairs(files, tokenizer, seed, **options))
    else:
        made = single(encode.segments(files, tokenizer, **options))
    return made.select(*EXAMPLES.names)
