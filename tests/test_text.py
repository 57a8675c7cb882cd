"""Scans, lines and sentences against plain Python on the same texts."""

import pytest
from pyspark.sql import functions as F

from tokenmill.functions.text import WHITESPACE
from tokenmill.operators import lines, vocab
from tokenmill.sources import files as fs

TEXTS = {
    "empty": "", "one": "the cat", "two": "the cat\nsat", "blank": "\n  \n\t\n", "crlf": "a\r\nb\rc\n\nd",
    "ends": "a. b.", "nodot": "a b", "dots": "a..b\nc.", "odd": " x\x0b　y  \nz\x85\n",
}


def universal(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def physical(text):
    pieces = universal(text).split("\n")
    return pieces[:-1] if pieces[-1] == "" else pieces


def clean(text):
    return [line.strip() for line in universal(text).split("\n") if line.strip()]


def collected(rows, number, value):
    found = {key: {} for key in TEXTS}
    for row in rows.collect():
        found[row.file_key][row[number]] = row[value]
    return {key: [v for _, v in sorted(items.items())] for key, items in found.items()}


def test_whitespace_is_what_strip_removes():
    assert sorted(WHITESPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_raw_lines_keep_blanks(files):
    assert collected(lines.raw_lines(files(TEXTS)), "row_no", "line") == {k: physical(t) for k, t in TEXTS.items()}


def test_clean_lines(files):
    assert collected(lines.clean_lines(files(TEXTS)), "line_no", "line") == {k: clean(t) for k, t in TEXTS.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_texts(files, n):
    def expected(text):
        if n == 0:
            return clean(text)
        sentences = [piece + "." for piece in " ".join(clean(text)).split(".")]
        return [" ".join(sentences[i:i + n]) for i in range(0, len(sentences), n)]

    assert collected(lines.texts(files(TEXTS), n), "text_no", "text") == {k: expected(t) for k, t in TEXTS.items()}


def test_very_long_groups(files):
    found = lines.texts(files({"f": "ab c." * 50000}), 20000).collect()
    assert sorted(r.text.count(".") for r in found) == [10001, 20000, 20000]


def test_negative_grouping_is_refused(files):
    with pytest.raises(ValueError):
        lines.texts(files(TEXTS), -1)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "good.txt").write_bytes("naïve\ncafé\n".encode())
    (tmp_path / "a" / "b" / "bad.txt").write_bytes(b"fine\nabc\xc3\x28\n")
    (tmp_path / "long.txt").write_bytes(b"".join(b"line %d\n" % i for i in range(5000)))
    return str(tmp_path)


def test_one_bad_sequence_rejects_the_file(spark, folder):
    good, bad = fs.decode(fs.read_binary(spark, folder))
    assert {r.file_key.rsplit("/", 1)[1] for r in good.collect()} == {"good.txt", "long.txt"}
    assert [r.file_key.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.txt"]
    assert {r.text for r in good.where("file_key like '%good%'").collect()} == {"naïve\ncafé\n"}


def test_lines_of_files_read_in_blocks(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = fs.read_lines(spark, folder)
        blocks = spark.read.text(folder + "/long.txt").select("_metadata.file_block_start").distinct().count()
        rows = read.where("file_key like '%long.txt'").collect()
        names = {r.file_key.rsplit("/", 1)[1] for r in read.select("file_key").distinct().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 5
    assert {r.line_no: r.line for r in rows} == {i: f"line {i}" for i in range(5000)}
    assert names == {"good.txt", "long.txt"}


def test_flat_names_report_collisions(spark):
    paths = spark.createDataFrame([("/a/b/x",), ("/ab/x",), ("/a/y",)], "path string")
    found = {r.path: (r.file_key, r.n_paths) for r in fs.flatten_tree(paths).collect()}
    assert found == {"/a/b/x": ("ab-x", 2), "/ab/x": ("ab-x", 2), "/a/y": ("a-y", 1)}


def test_concat_fills_missing_columns(spark):
    left = spark.createDataFrame([(1, "a")], "id int, x string")
    right = spark.createDataFrame([(2,)], "id int")
    assert sorted(map(tuple, fs.concat(left, right).collect())) == [(1, "a"), (2, None)]


def test_spread_leaves_a_wide_scan_alone(spark):
    wide = spark.range(100, numPartitions=64).withColumn("k", F.col("id"))
    assert fs.spread(wide, "id") is wide


@pytest.mark.parametrize("n", [1, 2, 3, 50])
@pytest.mark.parametrize("bits", [0, 1, 16])
def test_sentences_of_line_tables_equal_those_of_whole_files(files, n, bits):
    rows = files(TEXTS | {"long": "a. b\nc.. d\n\ne\nf.g. " * 40})
    found = sorted(map(tuple, lines.sentences_of_lines(lines.raw_lines(rows).withColumnRenamed("row_no", "line_no"),
                                                       n, bits).collect()))
    whole = [r for r in lines.texts(rows, n).collect() if r.file_key not in ("empty", "blank")]
    assert found == sorted((r.file_key, r.text_no, r.text) for r in whole)


def test_words_are_counted_and_normalized_once(spark):
    texts = ["  a cat\tthe\r\ncat. ", "a\x0bb\x0cc The", None, "", "cat\x85the a\u3000cat", "\t"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_key string, text string").repartition(2)
    assert {r.word: r.n for r in vocab.word_counts(files).collect()} == {
        "a": 2, "cat": 3, ".": 1, "the": 2, "abc": 1, "catthe": 1}
    built = vocab.build(files, 2).orderBy("token_id")
    assert [r.token for r in built.collect()][-2:] == ["cat", "the"]
    ran = built._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ran.count("+- ArrowEvalPython") == 1
