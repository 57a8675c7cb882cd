"""Order, splits, batches, padding and masking."""

import math

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import batch, encode, index, masking, segments, split
from tokenmill.plans import corpus, training
from tokenmill.schema import EXAMPLES
from tokenmill.sources import cache


@pytest.fixture(scope="module")
def examples(spark):
    """Files of very different length; one of them holds most rows."""
    sizes = {"hot": 900, **{f"f{i}": i % 7 for i in range(60)}}
    rows = []
    for key, n in sizes.items():
        for i in range(n):
            length = 4 + (i * 7 + len(key)) % 9
            ids = [2, *range(5, 5 + length - 2), 3]
            rows.append((key, i, 2 * i, 2 * i + 1, ids, [True] * length,
                         [True, *[False] * (length - 2), True], [0, *[1] * (length - 1)], length))
    return spark.createDataFrame(rows, EXAMPLES).repartition(5).cache()


def test_file_order_is_dense_and_keeps_files_together(examples):
    for bits in (20, 4, 0):
        rows = index.file_order(examples, 1, F.shiftright("example_id", bits)).sort("global_idx").collect()
        assert [r.global_idx for r in rows] == list(range(examples.count()))
        keys = [r.file_key for r in rows]
        assert sum(a != b for a, b in zip(keys, keys[1:])) == len(set(keys)) - 1
        assert all(a.example_id + 1 == b.example_id for a, b in zip(rows, rows[1:]) if a.file_key == b.file_key)


def test_random_order_is_dense_seeded_and_differs_by_epoch(examples):
    def order(rows, **options):
        found = index.random_order(rows, **options).sort("global_idx").collect()
        assert [r.global_idx for r in found] == list(range(len(found)))
        return [(r.file_key, r.example_id) for r in found]

    first = order(examples, seed=1)
    assert first == order(examples.repartition(17), seed=1)
    assert first != order(examples, seed=1, epoch=1) and first != order(examples, seed=2)
    assert sorted(first) == sorted(order(examples, seed=2))


def test_lookup(spark, examples):
    wanted = spark.createDataFrame([(0,), (5,), (5,), (10 ** 6,)], "global_idx long")
    assert sorted(r.global_idx for r in index.lookup(index.file_order(examples), wanted).collect()) == [0, 5]


@pytest.mark.parametrize("shares", [(0.8, 0.1, None), (0.8, 0.1, 0.05), (0.5, 0.5, None), (1.0, 0.0, None),
                                    (0.0, 0.0, None), (0.33, 0.33, 0.34), (0.8, 0.1, 0)])
@pytest.mark.parametrize("n", [1, 7, 200])
def test_split_counts(spark, n, shares):
    train, val, test = shares
    files = spark.range(n).select(F.col("id").cast("string").alias("file_key"))
    counts = {r.split: r["count"] for r in split.assign(files, files, train, val, test, 3).groupBy("split").count().collect()}
    n_train = int(n * train)
    n_val = min(int(n * val), n - n_train)
    rest = n - n_train - n_val
    n_test = min(int(n * test), rest) if test else rest
    expected = {"train": n_train, "val": n_val, "test": n_test, None: rest - n_test}
    assert counts == {k: v for k, v in expected.items() if v}


def test_split_keeps_files_whole_and_prunes(spark, examples, tmp_path):
    path = corpus.split_cache(examples, str(tmp_path / "split"), seed=2)
    parts = {name: {r.file_key for r in cache.read_split(spark, path, name).select("file_key").collect()}
             for name in split.NAMES}
    assert not parts["train"] & parts["val"] and not parts["train"] & parts["test"] and not parts["val"] & parts["test"]
    assert set.union(*parts.values()) == {r.file_key for r in examples.select("file_key").distinct().collect()}
    plan = cache.read_split(spark, path, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


@pytest.mark.parametrize("shuffled", [True, False])
def test_batches(examples, shuffled):
    rows = (batch.shuffled if shuffled else batch.ordered)(examples, 128, 1).collect()
    n = len(rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r.batch_id, []).append(r.row_in_batch)
    assert sorted(sizes) == list(range(math.ceil(n / 128)))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert [len(sizes[b]) for b in sorted(sizes)][:-1] == [128] * (len(sizes) - 1)


def test_padding(examples):
    for rows, group in ((batch.pad_batch(batch.shuffled(examples, 16), 9), "batch_id"),
                        (batch.pad_file(examples, 9), "file_key")):
        widths = {}
        for r in rows.collect():
            widths.setdefault(r[group], set()).add(len(r.ids))
            extra = len(r.ids) - r.n_tokens
            if extra:
                assert r.ids[-extra:] == [9] * extra and r.attention_mask[-extra:] == [False] * extra
                assert r.special_tokens_mask[-extra:] == [True] * extra and r.token_type_ids[-extra:] == [1] * extra
            assert len(r.ids) == len(r.attention_mask) == len(r.special_tokens_mask) == len(r.token_type_ids)
        assert all(len(w) == 1 for w in widths.values())


@pytest.mark.parametrize("size", [1, 16, 128, 5000])
def test_padding_in_one_shuffle_gives_the_same(examples, size):
    def rows(padded):
        return sorted((r.batch_id, r.row_in_batch, r.file_key, r.example_id, tuple(r.ids), tuple(r.attention_mask))
                      for r in padded.collect())

    for epoch in (0, 1):
        two_steps = batch.pad_batch(batch.shuffled(examples, size, 3, epoch), 9)
        assert rows(batch.shuffled_padded(examples, size, 9, 3, epoch)) == rows(two_steps)


@pytest.mark.parametrize("size", [1, 7, 128, 5000])
@pytest.mark.parametrize("bits", [1, 20])
def test_ordered_padding_in_one_shuffle_gives_the_same(examples, monkeypatch, size, bits):
    monkeypatch.setattr(index, "BLOCK_BITS", bits)

    def rows(padded):
        return sorted((r.batch_id, r.row_in_batch, r.file_key, r.example_id, tuple(r.ids), tuple(r.attention_mask))
                      for r in padded.collect())

    assert rows(batch.ordered_padded(examples, size, 9, 3)) == rows(batch.pad_batch(batch.ordered(examples, size, 3), 9))


def test_ordered_padding_moves_the_rows_once(spark, examples, capsys, tmp_path):
    def moved(rows):
        rows.explain("formatted")
        nodes = capsys.readouterr().out.split("\n\n")
        return sum(1 for n in nodes if ") Exchange" in n.split("\n")[0] and "ids#" in n)

    stored = cache.read(spark, cache.write(examples, str(tmp_path / "cache")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for rows too many to broadcast
    try:
        assert moved(batch.ordered_padded(stored, 16, 9)) == 1
        assert moved(batch.pad_batch(batch.ordered(stored, 16), 9)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ordered_padding_of_no_rows(examples):
    assert batch.ordered_padded(examples.limit(0), 16, 9).count() == 0


def test_padding_in_one_shuffle_with_few_buckets(examples, monkeypatch):
    from tokenmill.functions import draws
    monkeypatch.setattr(draws, "BUCKET_BITS", 2)
    found = batch.shuffled_padded(examples, 16, 9, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    widths = {}
    for r in found.collect():
        widths.setdefault(r.batch_id, []).append((len(r.ids), r.n_tokens))
    assert all(len({w for w, _ in rows}) == 1 and rows[0][0] == max(n for _, n in rows) for rows in widths.values())
    assert [len(widths[b]) for b in range(len(widths) - 1)] == [16] * (len(widths) - 1)
    assert "hashpartitioning(batch_id" not in plan.split("BroadcastExchange")[0]


def test_absent_type_ids_stay_null(examples):
    rows = examples.withColumn("token_type_ids", F.lit(None).cast("array<tinyint>"))
    assert {r.token_type_ids for r in batch.pad_batch(batch.shuffled(rows, 16)).collect()} == {None}


def long_rows(spark, n=400, length=200):
    ids = [2, *[7] * (length - 3), 0, 3]
    rows = [("f", i, i, None, ids, [True] * length, [True, *[False] * (length - 2), True], [0] * length, length)
            for i in range(n)]
    return spark.createDataFrame(rows, EXAMPLES)


def test_mask_statistics(spark):
    rows = masking.mlm(long_rows(spark), 0.15, 0, 4, 1000, seed=1).collect()
    eligible = chosen = masked = kept = 0
    randoms = []
    for r in rows:
        for i, (token, label, original) in enumerate(zip(r.inputs, r.labels, r.ids)):
            if original in (0, 2, 3):
                assert label == -100 and token == original
                continue
            eligible += 1
            if label == -100:
                assert token == original
                continue
            assert label == original
            chosen += 1
            masked += token == 4
            kept += token == original
            if token not in (4, original):
                randoms.append(token)

    def near(count, total, share):
        return abs(count - total * share) < 4 * math.sqrt(total * share * (1 - share))

    assert near(chosen, eligible, 0.15) and near(masked, chosen, 0.8)
    assert near(kept, chosen, 0.1) and near(len(randoms), chosen, 0.1)
    assert min(randoms) < 50 and max(randoms) > 950


def test_mask_is_drawn_anew_each_epoch(spark):
    def labels(epoch):
        return [r.labels for r in masking.mlm(long_rows(spark, 5), 0.15, 0, 4, 10, epoch=epoch).sort("example_id").collect()]
    assert labels(0) == labels(0) != labels(1)


@pytest.mark.parametrize("probability", [0.0, 1.0])
def test_extreme_probabilities(spark, probability):
    for r in masking.mlm(long_rows(spark, 3), probability, 0, 4, 10, rand_replace=False).collect():
        hits = [label != -100 for label in r.labels]
        assert hits == [probability == 1.0 and token == 7 for token in r.ids]
        assert r.inputs == [4 if h else t for h, t in zip(hits, r.ids)]


def test_row_of_specials_only(spark):
    rows = spark.createDataFrame([("f", 0, 0, None, [2, 3], [True] * 2, [True] * 2, [0, 0], 2)], EXAMPLES)
    row, = masking.mlm(rows, 1.0, 0, 4, 10).collect()
    assert (row.inputs, row.labels) == ([2, 3], [-100, -100])


def test_padding_before_or_after_does_not_move_the_mask(examples, tokenizer):
    loaded = training.loader(examples, tokenizer, 16, seed=1).collect()
    alone = {(r.file_key, r.example_id): r for r in masking.mlm(
        examples, 0.15, tokenizer.pad_id, tokenizer.mask_id, tokenizer.vocab_size, seed=1).collect()}
    for r in loaded:
        one = alone[r.file_key, r.example_id]
        n = len(one.ids)
        assert r.inputs[:n] == one.inputs and r.labels[:n] == one.labels
        assert set(r.labels[n:]) <= {-100} and set(r.inputs[n:]) <= {0}


def test_causal_labels_keep_padding(examples, tokenizer):
    for r in training.loader(examples, tokenizer, 16, mlm=False).collect():
        assert r.inputs == r.labels


def test_line_loader(files, tokenizer):
    rows = training.line_loader(files({"f": "the cat\n\nsat\n"}), tokenizer, 16, batch_size=2, shuffle=False,
                                mlm=False).sort("batch_id", "row_in_batch").collect()
    assert [(r.batch_id, r.row_in_batch, sum(r.attention_mask)) for r in rows] == [(0, 0, 4), (0, 1, 2), (1, 0, 3)]
    assert [r.inputs[:2] for r in rows][1] == [2, 3] and {r.token_type_ids for r in rows} == {None}


def test_overflow_examples_can_be_indexed(files, tokenizer):
    texts = {f"f{i}": "\n".join(["a " * 40] * 3) for i in range(4)}
    rows = segments.examples(files(texts), tokenizer, two_segments=False, max_length=16, use_overflow=True)
    block = F.shiftright("example_id", encode.CHUNK_BITS + index.BLOCK_BITS)
    found = index.file_order(rows, block=block).sort("global_idx").collect()
    assert [r.global_idx for r in found] == list(range(4 * 3 * 3))


def test_raw_lines_without_a_length_are_whole(spark, files, tokenizer):
    rows = files({"a": "x " * 9000 + "\n\ny"})
    made = training.line_loader(rows, tokenizer, None, batch_size=4, shuffle=False, mlm=False).collect()
    cut = training.line_loader(rows, tokenizer, 16, batch_size=4, shuffle=False, mlm=False).collect()
    assert sorted(sum(r.attention_mask) for r in made) == [2, 3, 9002] and {len(r.inputs) for r in made} == {9002}
    assert sorted(sum(r.attention_mask) for r in cut) == [2, 3, 16]
