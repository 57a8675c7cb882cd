"""Encoding, pairing and the two routes a file can take."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import encode, segments, stats, vocab
from tokenmill.plans import corpus
from tokenmill.sources import cache

WORDS = ["the", "cat", "sat,", "mat.", "Sitting", "naïve", "ﬁ", "中文", "[MASK]", "[x]", "a-b!", "q" * 101, "é", "x\ty", "☃"]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return {f"f{i}": "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 90))) for _ in range(rng.randint(0, 12)))
            for i in range(n)}


def lines_of(text):
    return [line.strip() for line in text.split("\n") if line.strip()]


def by_file(rows, *names):
    found = {}
    for row in rows.collect():
        found.setdefault(row.file_key, {})[row.seg_id] = row
    return {key: [items[i] for i in sorted(items)] for key, items in found.items()}


@pytest.mark.parametrize("use_overflow", [False, True])
@pytest.mark.parametrize("big", [1 << 24, 100])
def test_segments_equal_the_library(files, tokenizer, library, use_overflow, big):
    texts = random_texts(30)
    library.enable_truncation(max_length=16)
    expected = {}
    for key, text in texts.items():
        for e in library.encode_batch(lines_of(text)):
            expected.setdefault(key, []).append(e.ids)
            if use_overflow:
                expected[key] += [o.ids for o in e.overflowing]
    library.no_truncation()
    rows = encode.segments(files(texts), tokenizer, 16, use_overflow=use_overflow, big_file_chars=big)
    assert {k: [r.ids for r in v] for k, v in by_file(rows).items()} == expected


def test_a_tokenizer_that_cannot_be_cut_at_spaces(files, tokenizer):
    def factory():
        return encode.list_encoder(lambda texts: [[len(t)] for t in texts])

    lengths = replace(tokenizer, factory=factory, splits_on_space=False)
    rows = encode.segments(files({"f": "a b c\nabc"}), lengths, 16).collect()
    assert sorted(r.ids[1] for r in rows) == [3, 5]


def test_edge_texts_equal_the_library(files, tokenizer, library):
    odd = ["a [SEP] b", "x[MASK]y", "[", "a[b", "!", "?!a", "İ", "é[", "Ⅳ", "a\u0301b", "[UNK]", "x\u200dy", "a\tb\x0bc",
           "d\xa0e \u3000f", "“quote”—dash…", "ΣΑΣ", "a  b", "\x00c", "ß"]
    rows = encode.segments(files({str(i): t for i, t in enumerate(odd)}), tokenizer, 64).collect()
    assert {odd[int(r.file_key)]: r.ids for r in rows} == {t: library.encode(t).ids for t in odd}


def test_no_text_at_all(files, tokenizer):
    assert encode.segments(files({"a": "", "b": "\n \n"}), tokenizer).collect() == []
    assert encode.segments(files({"a": ""}).where("false"), tokenizer).collect() == []


def test_limits_of_a_window(files, tokenizer):
    texts = {"f": "\n".join(["a " * 14, "a " * 15, "a"])}
    kept = encode.segments(files(texts), tokenizer, 16).collect()
    assert sorted(len(r.ids) for r in kept) == [3, 16, 16]
    more = encode.segments(files(texts), tokenizer, 16, use_overflow=True).collect()
    assert sorted(len(r.ids) for r in more) == [3, 3, 16, 16]
    with pytest.raises(ValueError):
        encode.segments(files(texts), tokenizer, 2).collect()


def rows_set(examples):
    return sorted((r.file_key, r.example_id, r.seg_a_id, r.seg_b_id, tuple(r.ids), tuple(r.attention_mask),
                   tuple(r.special_tokens_mask), tuple(r.token_type_ids), r.n_tokens) for r in examples.collect())


@pytest.mark.parametrize("use_overflow", [False, True])
def test_both_routes_make_the_same_pairs(files, tokenizer, use_overflow):
    texts = files(random_texts(25, seed=1))
    options = dict(seed=3, max_length=16, use_overflow=use_overflow)
    whole = rows_set(segments.examples(texts, tokenizer, **options))
    for big in (700, 150, 1):
        assert rows_set(segments.examples(texts, tokenizer, big_file_chars=big, **options)) == whole


def test_line_tables_make_the_same_pairs(spark, files, tokenizer):
    """One file holds most of the lines."""
    texts = {**random_texts(8, seed=4), "hot": "\n".join(f"the cat {i}" for i in range(500))}
    texts = {key: "\n".join(lines_of(text)) for key, text in texts.items()}
    rows = [(key, i, f" {line} ") for key, text in texts.items() for i, line in enumerate(text.split("\n"))]
    table = spark.createDataFrame(rows, "file_key string, line_no int, line string").repartition(5)
    for use_overflow in (False, True):
        options = dict(seed=3, max_length=16, use_overflow=use_overflow)
        whole = rows_set(segments.examples(files(texts), tokenizer, **options))
        for chars in (1 << 24, 200):
            assert rows_set(segments.examples_of_lines(table, tokenizer, chars_per_slice=chars, **options)) == whole


def test_partitioning_does_not_matter(files, tokenizer):
    texts = random_texts(12, seed=2)
    first = rows_set(segments.examples(files(texts, 1), tokenizer, 5, max_length=16))
    for partitions in (3, 11):
        assert rows_set(segments.examples(files(texts, partitions), tokenizer, 5, max_length=16)) == first


def test_pairs_use_each_segment_once_and_drop_an_odd_one(files, tokenizer):
    texts = {f"f{n}": "\n".join(["the cat"] * n) for n in range(6)}
    pairs = segments.examples(files(texts), tokenizer, 1).collect()
    for n in range(6):
        mine = [r for r in pairs if r.file_key == f"f{n}"]
        used = [i for r in mine for i in (r.seg_a_id, r.seg_b_id)]
        assert len(mine) == n // 2 and len(set(used)) == len(used) and set(used) <= set(range(n))
        assert sorted(r.example_id for r in mine) == list(range(n // 2))


def test_pairing_is_random_and_seeded(files, tokenizer):
    texts = files({"f": "\n".join(["the cat"] * 200)})
    orders = [[(r.seg_a_id, r.seg_b_id) for r in segments.examples(texts, tokenizer, seed).sort("example_id").collect()]
              for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    assert sum(abs(a - b) for a, b in orders[0]) / 100 > 30


def test_shape_of_a_pair(files, tokenizer):
    row, = segments.examples(files({"f": "the cat\nsat"}), tokenizer, 0).collect()
    a, b = (["the cat", "sat"][i] for i in (row.seg_a_id, row.seg_b_id))
    size_a, size_b = len(a.split()) + 2, len(b.split()) + 1
    assert row.n_tokens == len(row.ids) == size_a + size_b and row.ids[0] == 2 and row.ids[-1] == 3
    assert row.token_type_ids == [0] * size_a + [1] * size_b
    assert [i for i, s in enumerate(row.special_tokens_mask) if s] == [0, size_a - 1, size_a + size_b - 1]
    assert all(row.attention_mask) and len(row.attention_mask) == row.n_tokens


def test_single_segments(files, tokenizer):
    row, = segments.examples(files({"f": "the cat"}), tokenizer, two_segments=False).collect()
    assert (row.seg_b_id, row.token_type_ids, row.special_tokens_mask) == (None, [0] * 4, [True, False, False, True])


@pytest.mark.parametrize("big", [1 << 24, 50])
def test_corpus_stats_count_empty_files(files, tokenizer, big):
    texts = {"none": " \n", "long blank": " \n" * 60, "two": "the cat\nsat", "many": "sat\n" * 40}
    found = {r.file_key: (r.num_examples, r.num_tokens)
             for r in stats.corpus(files(texts), tokenizer, 16, big_file_chars=big).collect()}
    assert found == {"none": (0, 0), "long blank": (0, 0), "two": (2, 7), "many": (40, 120)}


def test_a_file_is_encoded_once(files, tokenizer):
    plan = segments.examples(files({"f": "a"}), tokenizer, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_vocabulary(files):
    texts = files({"f": "the THE thé cat, cat", "g": "the 中"})
    built = {r.token_id: r.token for r in vocab.build(texts, 2).collect()}
    letters = sorted(set("thecat,中"))
    assert [built[i] for i in range(len(built))] == [
        *vocab.SPECIALS, *letters, *sorted("##" + c for c in letters), "the", "cat"]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("[PAD]\n[UNK]\n \nthe\n")
    assert vocab.as_dict(vocab.read_file(spark, str(tmp_path / "vocab.txt"))) == {
        "[PAD]": 0, "[UNK]": 1, " ": 2, "the": 3}
    with pytest.raises(ValueError):
        vocab.as_dict(spark.range(5).select(F.col("id").cast("string").alias("token"), F.col("id").alias("token_id")), 4)


def test_cache_appends_only_new_files_and_overwrites(spark, files, tokenizer, tmp_path):
    path = str(tmp_path / "cache")
    first, all_files = files({"a": "x\ny"}), files({"a": "x\ny", "b": "x\ny\nz\nw"})
    assert corpus.tokenize_and_cache(first, tokenizer, path).count() == 1
    again = corpus.tokenize_and_cache(all_files, tokenizer, path)
    assert sorted(r.file_key for r in again.collect()) == ["a", "b", "b"]
    assert corpus.tokenize_and_cache(first, tokenizer, path, delete_existing=True).count() == 1


def test_cache_without_type_ids_reads_null(spark, files, tokenizer, tmp_path):
    made = segments.examples(files({"a": "x\ny"}), tokenizer)
    typed = cache.write(made, str(tmp_path / "typed"))
    untyped = cache.write(made.drop("token_type_ids"), str(tmp_path / "untyped"))
    assert sorted(r.token_type_ids is None for r in cache.read(spark, typed, untyped).collect()) == [False, True]


def _at_most_100_chars():
    def encode_texts(texts):
        if sum(map(len, texts)) > 100:
            raise ValueError("too much text at once")
        return [[len(t)] for t in texts]
    return encode.list_encoder(encode_texts)


def test_a_batch_is_encoded_in_slices(spark, monkeypatch):
    """A task split and encoded all files of an Arrow batch at once, at many times their bytes."""
    monkeypatch.setattr(encode, "SLICE_BYTES", 50)
    texts = [["x" * (1 + i % 9)] * (i % 4) if i % 50 else ["y" * 60, "z"] for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_key int, texts array<string>").coalesce(1)
    found = rows.select("file_key", encode.encoded("texts", encode.Tokenizer(_at_most_100_chars, 10)).alias("p")).collect()
    assert {r.file_key: r.p for r in found} == {i: [[len(x)] for x in t] for i, t in enumerate(texts)}
