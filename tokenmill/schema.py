"""Table shapes shared by every stage. Arrays stay ragged until batch export."""

from pyspark.sql import types as T

#: one row per text file; ``n_chars`` is only a size hint used to route big files.
FILES = T.StructType([
    T.StructField("file_key", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

#: one row per training example, the layout of the tokenized cache.
EXAMPLES = T.StructType([
    T.StructField("file_key", T.StringType()),
    T.StructField("example_id", T.LongType()),
    T.StructField("seg_a_id", T.LongType()),
    T.StructField("seg_b_id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("attention_mask", T.ArrayType(T.BooleanType())),
    T.StructField("special_tokens_mask", T.ArrayType(T.BooleanType())),
    T.StructField("token_type_ids", T.ArrayType(T.ByteType())),
    T.StructField("n_tokens", T.IntegerType()),
])

#: label value of positions that take no part in the loss.
IGNORE = -100

#: a file longer than this many characters leaves the row-at-a-time route and is
#: spread over tasks line by line; both routes give the same rows.
BIG_FILE_CHARS = 1 << 24
