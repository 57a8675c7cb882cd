"""Score tables, corruption and metrics against numpy."""

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tokenmill.functions import arrow
from tokenmill.operators import batch, corrupt, metrics, scores
from tokenmill.plans import evaluation
from tokenmill.plans.inputs import BATCH_SIZE, SEED, Inputs
from tokenmill.plans.queries import registered

SCHEMA = "file_key string, example_id long, pos int, logits array<float>, cand array<int>, label long"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        k = int(rng.integers(1, 9))
        rows.append((f"f{i % 3}", i, i % 5, [float(x) for x in np.float32(rng.normal(0, 3, k))],
                     [10 * c for c in range(k)], int(10 * rng.integers(0, k))))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def probabilities(logits):
    e = np.exp(np.array(logits, float) - max(logits))
    return e / e.sum()


def test_softmax_argmax_and_loss(table):
    rows = scores.log_loss(scores.argmax(scores.softmax(table), "cand"), "cand").collect()
    assert len(rows) == 300
    for r in rows:
        p = probabilities(r.logits)
        assert np.allclose(r.probs, p)
        assert r.token_id == r.cand[int(np.argmax(r.logits))]
        assert np.isclose(r.loss, -np.log(p[r.cand.index(r.label)]))


def test_probabilities_in_millionths_as_text_need_no_work_by_element(spark):
    rows = [("a", [0.25, 0.7500004, 0.0000005, 1.0]), ("b", [1.0]), ("c", []), ("d", None)]
    texts = (spark.createDataFrame(rows, "key string, probs array<double>").repartition(2)
             .select("key", scores.millionths("probs").alias("probs")))
    assert {r.key: r.probs for r in texts.collect()} == {"a": "250000,750000,1,1000000", "b": "1000000", "c": "", "d": None}
    plan = registered()["softmax_scores"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "lambdafunction" not in plan and "array_join" not in plan


def test_ties_go_to_the_lowest_index(spark):
    rows = spark.createDataFrame([("f", 0, 0, [1.0, 2.0, 2.0], [4, 5, 6], 4)], SCHEMA)
    assert scores.argmax(rows).collect()[0].token_id == 1


def test_a_label_that_is_not_scored_has_no_loss(spark):
    rows = spark.createDataFrame([("f", 0, 0, [1.0, 2.0], [4, 5], 9), ("f", 1, 0, [1.0, 2.0], [4, 5], 5)], SCHEMA)
    losses = {r.example_id: r.loss for r in scores.log_loss(rows, "cand").collect()}
    assert losses[0] is None and losses[1] == pytest.approx(np.log(1 + np.exp(-1)))


def test_an_empty_score_row_is_refused(spark):
    rows = spark.createDataFrame([("f", 0, 0, [], [], 9)], SCHEMA)
    with pytest.raises(Exception, match="without logits"):
        scores.softmax(rows).collect()


def test_samples_follow_the_softmax(spark):
    logits = [0.0, 1.0, 2.0, -30.0]
    rows = spark.range(20000).select(
        F.lit("f").alias("file_key"), F.col("id").alias("example_id"), F.lit(3).alias("pos"),
        F.array(*[F.lit(x) for x in logits]).cast("array<float>").alias("logits"))
    first = scores.sample(rows, seed=1).groupBy("token_id").count().collect()
    counts = np.array([{r.token_id: r["count"] for r in first}.get(i, 0) for i in range(4)])
    p = probabilities(logits)
    assert np.all(np.abs(counts - 20000 * p) <= 4 * np.sqrt(20000 * p * (1 - p)) + 1e-6)
    again = scores.sample(rows.repartition(7), seed=1).groupBy("token_id").count().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


def test_large_rows_do_not_overflow(spark):
    rows = spark.range(8).select(
        F.lit("f").alias("file_key"), F.col("id").alias("example_id"), F.lit(0).alias("pos"),
        F.array_repeat(F.lit(0.0).cast("float"), 30000).alias("logits"))
    picked = [r.token_id for r in scores.sample(rows, seed=1).select("token_id").collect()]
    assert len(set(picked)) > 5 and max(picked) > 10000 and max(picked) < 30000


def test_corruption(spark):
    masked = spark.createDataFrame(
        [("f", 0, [2, 4, 4, 9, 3], [-100, 7, 8, -100, -100]), ("f", 1, [2, 3], [-100, -100])],
        "file_key string, example_id long, inputs array<bigint>, labels array<bigint>")
    assert [(r.pos, r.label) for r in corrupt.positions(masked).sort("pos").collect()] == [(1, 7), (2, 8)]
    samples = spark.createDataFrame([("f", 0, 1, 7), ("f", 0, 2, 11)],
                                    "file_key string, example_id long, pos int, token_id int")
    rows = corrupt.corrupt(corrupt.attach(masked, samples)).sort("example_id").collect()
    assert [(r.d_inputs, r.d_labels) for r in rows] == [([2, 7, 11, 9, 3], [0, 0, 1, 0, 0]), ([2, 3], [0, 0])]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 1, 1, True, 1.0), (0, 1, 2, True, 3.0), (1, 5, 5, True, 6.0), (1, 5, 4, False, 9.0),
                                  (2, 1, 1, False, 5.0)],
                                 "batch_id long, token_id int, label long, attention_mask boolean, loss double")
    active = F.col("attention_mask")
    accuracy = {r.batch_id: (r.n_active, r.accuracy) for r in metrics.accuracy(rows, active=active).collect()}
    assert accuracy == {0: (2, 0.5), 1: (1, 1.0), 2: (0, None)}
    losses = metrics.mean_loss(rows, active=active)
    assert {r.batch_id: r.loss for r in losses.collect()} == {0: 2.0, 1: 6.0, 2: None}
    both = {r.batch_id: r.loss for r in metrics.combined(losses, losses).collect()}
    assert both[0] == 102.0 and both[1] == 306.0
    row, = metrics.epoch(losses, "loss", perplexity_of="loss").collect()
    assert (row.n_batches, row.loss) == (3, 4.0) and row.perplexity == pytest.approx(np.exp(4.0))
    assert {r.batch_id: r.perplexity for r in metrics.perplexity(losses).collect()}[0] == pytest.approx(np.exp(2.0))


def vocabulary_blocks(spark, rows, block):
    """Rows (example_id, pos, label, logits) cut into blocks of the vocabulary, shuffled."""
    cut = [("f", e, p, label, first, logits[first:first + block]) for e, p, label, logits in rows
           for first in range(0, len(logits), block)]
    schema = "file_key string, example_id long, pos int, label int, first int, logits array<float>"
    return spark.createDataFrame(cut[::-1], schema).repartition(3)


def test_vocabulary_in_blocks_equals_whole_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(e, p, int(rng.integers(50)), (rng.standard_normal(50) * 4).round(1).astype(np.float32).tolist())
            for e in range(3) for p in range(20)]
    rows += [(9, 0, None, [0.0] * 50), (9, 1, 49, [-1e30] * 49 + [1e30]), (9, 2, 0, [700.0] * 25 + [-700.0] * 25),
             (9, 3, 77, [1.0] * 50)]
    results = []
    for block in (1, 7, 50):
        found = {(r.example_id, r.pos): r for r in scores.of_vocabulary(vocabulary_blocks(spark, rows, block), 5).collect()}
        assert len(found) == len(rows)
        for e, p, label, logits in rows:
            values, r = np.array(logits, np.float32).astype(float), found[e, p]
            total = values.max() + np.log(np.exp(values - values.max()).sum())
            assert np.isclose(r.log_total, total, rtol=1e-12) and r.best == int(values.argmax()) and r.label == label
            if label is None or label >= 50:
                assert r.label_prob is None
            else:
                assert np.isclose(r.label_prob, np.exp(values[label] - total), rtol=1e-9, atol=1e-300)
        results.append({k: r.drawn for k, r in found.items()})
    assert results[0] == results[1] == results[2]
    assert results[0][9, 1] == 49 and results[0][9, 2] < 25
    assert scores.of_vocabulary(vocabulary_blocks(spark, rows, 7).limit(0)).count() == 0


def test_draws_from_blocks_follow_the_softmax(spark):
    logits = np.log(np.array([0.5, 0.25, 0.125, 0.0625, 0.0625])).astype(np.float32).tolist()
    rows = [(e, p, 0, logits) for e in range(40) for p in range(200)]
    drawn = [r.drawn for r in scores.of_vocabulary(vocabulary_blocks(spark, rows, 2), 3).collect()]
    shares = np.bincount(drawn, minlength=5) / len(drawn)
    assert np.abs(shares - np.exp(logits)).max() < 0.02
    other = [r.drawn for r in scores.of_vocabulary(vocabulary_blocks(spark, rows, 2), 4).collect()]
    assert drawn != other


def test_statistics_of_examples(spark):
    cand = [[[4, 7, 9], [5, 6]], [], [[1, 2, 3]], [[3, 8]]]
    logits = [[[0.5, 2.0, 2.0], [1.0, 3.0]], [], [[0.0, 0.0, 0.0]], [[1.0, 2.0]]]
    label = [[7, 5], [], [9], [None]]  # hit and missed, without positions, not a candidate, not counted
    rows = spark.createDataFrame(
        [("f", i, list(range(len(c))), c, s, y) for i, (c, s, y) in enumerate(zip(cand, logits, label, strict=True))],
        "file_key string, example_id long, pos array<int>, cand array<array<int>>, logits array<array<float>>, "
        "label array<int>").withColumn("draw", F.transform("pos", lambda _: F.lit(2**32 - 1)))
    found = rows.withColumn("s", scores.of_examples("logits", "label", "cand", "draw")).sort("example_id").select("s.*").collect()
    expected = np.log(np.exp([0.5, 2, 2]).sum()) - 2 + np.log(np.exp([1, 3]).sum()) - 1
    assert found[0].loss == pytest.approx(expected)
    assert [(r.n_loss, r.hits, r.n_labels) for r in found] == [(2, 1, 2), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert [r.drawn for r in found] == [[9, 6], [], [3], [8]]
    index = rows.withColumn("label", F.transform("label", lambda y: F.when(y == 7, 1).when(y == 5, 0)))
    whole = {r.example_id: r.d for r in scores.examples_judged(index, "d", "example_id").collect()}
    assert whole[0].loss == pytest.approx(expected) and (whole[0].hits, whole[0].n_labels) == (1, 2)
    assert (whole[2].n_labels, whole[3].n_loss, whole[1].drawn) == (0, 0, [])
    empty = scores.examples_judged(index.limit(0), "d", "example_id")
    assert empty.collect() == []


def test_logits_are_made_in_the_step_that_judges_them(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3], [1, 0, None]), (1, [], [])], "example_id int, noise array<long>, label array<int>")
    found = {r.example_id: r.d for r in scores.examples_judged(
        rows, "d", "example_id", made=Inputs.discriminator_logits, of="noise").collect()}
    z = np.array([[0.0, n / 10000.0 - 1.0] for n in (1, 2)], np.float32).astype(float)
    expected = sum(np.log(np.exp(x).sum()) - x[y] for x, y in zip(z, (1, 0), strict=True))
    assert found[0].loss == pytest.approx(expected) and (found[0].n_labels, found[0].hits) == (2, 1)
    assert (found[1].loss, found[1].n_labels) == (0, 0)


def test_corruption_in_the_row_equals_that_of_a_score_table(spark):
    rng = np.random.default_rng(3)
    examples = []
    for i in range(40):
        labels = [int(x) if x >= 0 else -100 for x in rng.integers(-9, 9, 12)]
        at = [p for p, y in enumerate(labels) if y != -100]
        examples.append((f"f{i % 3}", i, [4] * 12, labels, at, [labels[p] for p in at],
                         [list(range(9))] * len(at), rng.normal(size=(len(at), 9)).tolist()))
    rows = spark.createDataFrame(
        examples, "file_key string, example_id long, inputs array<bigint>, labels array<bigint>, pos array<int>, "
                  "label array<int>, cand array<array<int>>, logits array<array<float>>")
    masked = rows.select("file_key", "example_id", "inputs", "labels")
    table = rows.select("file_key", "example_id", F.inline(F.arrays_zip("pos", "label", "cand", "logits")))
    by_table = evaluation.corrupted(masked, table, "cand", 5)
    in_row = evaluation.corrupted_rows(rows, "cand", 5)
    wanted = ["file_key", "example_id", "d_inputs", "d_labels"]
    assert sorted(in_row.select(wanted).collect()) == sorted(by_table.select(wanted).collect())


def test_scores_that_the_task_makes_equal_those_of_a_table(spark, monkeypatch):
    rng = np.random.default_rng(2)
    size, tables = 50, (rng.standard_normal((7, 50)) * 4).round(1).astype(np.float32)
    tables[6] = -1e30
    tables[6, 49] = 1e30
    labels = [None if i == 5 else 77 if i == 6 else int(rng.integers(size)) for i in range(60)]
    positions = spark.createDataFrame([("f", i // 20, i % 20, y, i % 7) for i, y in enumerate(labels)],
                                      "file_key string, example_id long, pos int, label int, kind long").repartition(3)
    blocks = [(i // 20, i % 20, y, tables[i % 7].tolist()) for i, y in enumerate(labels)]
    expected = {(r.example_id, r.pos): r for r in scores.of_vocabulary(vocabulary_blocks(spark, blocks, 50), 5).collect()}
    for block, held in ((1, 1 << 17), (7, 40), (50, 1), (99, 1 << 17)):
        monkeypatch.setattr(scores, "HELD", held)
        made = scores.of_model(positions, lambda first, count, kind: tables[kind, first:first + count], ["kind"], size, block, 5)
        found = made.collect()
        assert len(found) == len(labels)
        for r in found:
            e = expected[r.example_id, r.pos]
            assert (r.label, r.best, r.drawn) == (e.label, e.best, e.drawn)
            assert r.log_total == pytest.approx(e.log_total, rel=1e-12)
            assert r.label_prob == (None if e.label_prob is None else pytest.approx(e.label_prob, rel=1e-9))
        drawn = scores.of_model(positions, lambda first, count, kind: tables[kind, first:first + count], ["kind"], size, block, 5,
                                find=("drawn",))
        assert {(r.example_id, r.pos): r.drawn for r in drawn.collect()} == {k: r.drawn for k, r in expected.items()}
    assert scores.of_model(positions.limit(0), lambda first, count, kind: tables[kind, first:first + count], ["kind"], size, 7).collect() == []


def test_dense_queries_score_in_the_task(spark):
    """No logits between tasks: exploded blocks and their groups grew with vocabulary times positions."""
    inputs = Inputs.of(spark, SF_DIR)
    table = scores.of_vocabulary(inputs.dense_scores(300).where("example_id = 0"), 7)
    rows = inputs.dense_found(*scores.FOUND).where("example_id = 0")
    assert sorted(r[:4] + r[6:] for r in table.select("file_key", "example_id", "pos", "label", "log_total", "label_prob", "best", "drawn").collect()) \
        == sorted(r[:4] + r[6:] for r in rows.collect())
    for name in ("softmax_dense", "sample_dense", "argmax_dense"):
        plan = registered()[name](spark, SF_DIR)._jdf.queryExecution().sparkPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan and "array<float>" not in plan, name


def test_epochs_are_judged_where_examples_are_stored(spark):
    """Whole masked examples were shuffled into batches and written; now only their sums are."""
    t = Inputs.of(spark, SF_DIR)
    numbers = batch.shuffled(t.cached().select("file_key", "example_id"), BATCH_SIZE, SEED).drop("row_in_batch", "global_idx")
    g = t.generator_scores(t.masked()).join(numbers, ["file_key", "example_id"])
    d = t.discriminator_scores(t.corrupted()).join(numbers, ["file_key", "example_id"])
    for judged, side, table, active in ((t.generator_judged(), "g", g, None), (t.both_judged(), "g", g, None),
                                        (t.both_judged(), "d", d, F.col("attention_mask"))):
        cand = "cand" if side == "g" else None
        assert set(judged.columns) <= {"batch_id", "g", "d"} and "array" not in str(judged.schema)
        found = {r.batch_id: r for r in metrics.of_statistics(judged, side).collect()}
        losses = metrics.mean_loss(scores.log_loss(table, cand), active=active).collect()
        hits = metrics.accuracy(scores.argmax(table, cand), active=active).collect()
        assert {r.batch_id: r.n_active for r in losses} == {b: r.n_losses for b, r in found.items()}
        assert {r.batch_id: (r.n_active, r.accuracy) for r in hits} == {b: (r.n_labels, r.accuracy) for b, r in found.items()}
        assert all(found[r.batch_id].loss == pytest.approx(r.loss, rel=1e-12) for r in losses)


def test_slices():
    assert arrow.cuts(np.array([], np.int64), 4) == [(0, 0)]
    assert arrow.cuts(np.array([1, 1, 9, 0, 1, 1]), 4) == [(0, 3), (3, 5), (5, 6)]
    sizes = []
    doubled = arrow.sliced(lambda x: sizes.append(len(x)) or pc.multiply(x, 2), 4)
    assert doubled(pa.array(range(10))).to_pylist() == list(range(0, 20, 2)) and max(sizes) == 4
    assert doubled(pa.array([], pa.int64())).to_pylist() == []


def found_in_blocks(logits, label, pick, width, find):
    firsts = np.arange(0, logits.shape[1], width)
    blocks = scores._Blocks(lambda block, rows: logits[rows, firsts[block]:firsts[block] + width], firsts, label, pick, set(find))
    for start in range(0, len(logits), 50):
        for block in range(len(firsts)):
            blocks.meet(block, slice(start, start + 50))
    return blocks.found(7)


def logits_of_many_kinds(rng, rows, size):
    kinds = [rng.uniform(0, 6, (rows, size)), rng.normal(0, 5, (rows, size)), rng.normal(0, 50, (rows, size)),
             np.zeros((rows, size)), rng.integers(0, 2, (rows, size)), rng.normal(1e6, 1, (rows, size)),
             np.full((rows, size), -1e30), rng.normal(-2030, 1, (rows, size)), rng.normal(0, 1e-6, (rows, size)),
             np.where(rng.random((rows, size)) < 0.5, -np.inf, 1.0), np.full((rows, size), -5.0)]
    kinds[-1][:, 17] = 40.0  # one token has all the probability
    kinds[-2][:, 3] = 1.0
    return np.concatenate(kinds).astype(np.float32)


def test_bounds_draw_the_tokens_that_all_exact_values_give():
    rng = np.random.default_rng(4)
    logits = logits_of_many_kinds(rng, 300, 211)
    pick, token = rng.integers(0, 2**32, len(logits)), np.arange(211)
    exact = logits - np.log(-np.log(scores.uniform(pick[:, None], token[None, :])))
    for width in (211, 53, 1):
        found = found_in_blocks(logits, np.zeros(len(logits), np.int64), pick, width, ("drawn",))
        assert np.array_equal(found["drawn"], exact.argmax(axis=1))


def test_sums_of_exponentials_are_exact():
    rng = np.random.default_rng(5)
    logits = logits_of_many_kinds(rng, 100, 211)
    values = logits.astype(np.longdouble)
    top = values.max(axis=1)
    total = np.exp(values - top[:, None]).sum(axis=1)
    for width in (211, 53, 1):
        found = found_in_blocks(logits, np.full(len(logits), 3), None, width, ("log_total", "label_prob", "best"))
        assert np.array_equal(found["best"], logits.argmax(axis=1))
        np.testing.assert_allclose(found["log_total"], (top + np.log(total)).astype(np.float64), rtol=1e-15, atol=2e-14)
        np.testing.assert_allclose(found["label_prob"], (np.exp(values[:, 3] - top) / total).astype(np.float64), rtol=1e-14)


def test_a_draw_takes_logarithms_of_few_tokens(monkeypatch):
    """Two logarithms of each token of the vocabulary took most of the time of a draw."""
    rng, seen, exact = np.random.default_rng(6), [], scores._gumbel
    monkeypatch.setattr(scores, "_gumbel", lambda logits, pick, token: seen.append(len(logits)) or exact(logits, pick, token))
    logits = rng.uniform(0, 6, (200, 2000)).astype(np.float32)
    found_in_blocks(logits, np.zeros(200, np.int64), rng.integers(0, 2**32, 200), 1000, ("drawn",))
    assert sum(seen) < logits.size / 200


def test_large_results_leave_in_slices():
    sizes = []
    tens = arrow.in_slices(lambda x, _: sizes.append(len(x)) or pc.multiply(x, 10), 4)
    batches = [(pa.array(range(10)), pa.array(range(10))), (pa.array([], pa.int64()), pa.array([], pa.int64()))]
    assert [a.to_pylist() for a in tens(iter(batches))] == [[0, 10, 20, 30], [40, 50, 60, 70], [80, 90], []] and max(sizes) == 4


def test_the_counts_of_the_vocabulary_do_not_stay_on_disk(spark):
    """The shuffles of all chunks were kept as long as the query ran, 0.8 times its input."""
    folders = [Path(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def shuffled():
        return {f.name for folder in folders for f in folder.rglob("shuffle_*.data")}

    before = shuffled()
    inputs = Inputs(spark, SF_DIR)
    assert len(inputs.vocabulary) > 2000
    for _ in range(20):  # Spark removes them in a thread of its own
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
