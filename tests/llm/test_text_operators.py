"""Operators on documents against brute force on small tables."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tokenmill.llm import brown, byte_bpe, leaks, near_dups, quality, ring, wavelet

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, key string, score int, rank int, component string, kept string, rows int"


def documents(spark, texts, partitions=3):
    """Documents with extra columns whose names operators use inside."""
    rows = [(i, t, "k", 1, 2, "c", "no", 3) for i, t in (texts if isinstance(texts, list) else texts.items())]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def prose(seed, words=60, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


# Compression classifier

def junk(seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('&$%#')}{rng.choice('&$%#')}{rng.randrange(99)}!!" for _ in range(60))


@pytest.fixture(scope="module")
def labelled(spark):
    texts = [(i, prose(i) if i % 3 else junk(i)) for i in range(240)]
    docs = documents(spark, [*texts, (240, None), (241, ""), (None, prose(5)), (5, prose(5)), (242, prose(1) * 300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(7, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_scores_held_out_documents(spark, labelled):
    docs, labels = labelled
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    empty = [r.score for r in rows if r.doc_id in (240, 241)]
    assert empty[0] == empty[1]
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_quality_keeps_the_rows_it_accepts(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    good = quality.score(docs, model).where("predicted = 1")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in good.collect())


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (3, 0)]])
def test_quality_without_two_classes_is_the_share_of_good_rows(spark, labels):
    docs = documents(spark, {1: "a b", 2: "", 3: "c"})
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = {r.score for r in quality.score(docs, quality.train(docs, marks)).collect()}
    seen = [q for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(scores) == 1 and math.isclose(scores.pop(), (sum(seen) + 0.5) / (len(seen) + 1))
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), marks)).count() == 0


# Near duplicates

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def grouped(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def mutated(text, rng, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(1)
    texts = {0: None, 1: "", 2: " \t\n", 3: "One two", 4: "one  TWO", 5: "two one", 6: "É b", 7: "é b"}
    for base in range(6):
        original = prose(100 + base, words=rng.choice([6, 40, 300]))
        for _ in range(25):
            texts[len(texts)] = mutated(original, rng, rng.randrange(8))
    texts[len(texts)] = prose(100) * 50
    for _ in range(20):
        texts[len(texts)] = texts[20]
    return texts


@pytest.mark.parametrize("block", [near_dups.BLOCK, 4])
def test_near_duplicates_equal_brute_force(spark, copies, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in
             near_dups.near_duplicates(documents(spark, copies)).collect()}
    assert found == grouped(copies)


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, [(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (4, "q"), (4, "r"), (5, "R")])
    rows = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect())
    assert rows == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("4", 4, True), ("4", 4, True), ("5", 4, False),
                    ("None", None, True)]
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dups.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]


def test_sketch_estimates_similarity():
    order, rng = near_dups._fill_order(), np.random.default_rng(3)
    for size in (3, 30, 300, 5000):
        shared = rng.integers(0, 2 ** 64, size, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2 ** 64, size // 3, dtype=np.uint64)])) for _ in "ab")
        jaccard = size / (size + 2 * (size // 3))
        agree = (near_dups.sketch(a, order) == near_dups.sketch(b, order)).mean()
        assert abs(agree - jaccard) < 5 * math.sqrt(0.25 / min(size, near_dups.REGISTERS))


# Benchmark passages

def distance_inside(item, text):
    """Fewest edits between the whole item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, char in enumerate(item, 1):
        above, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (char != other)))
    return min(row)


def plain(text):
    return leaks.normalised(text)[0].tolist()


def test_leaks_equal_brute_force_alignment(spark):
    rng = random.Random(4)
    items = {1: prose(1, 12), 2: "Short one, here!", 3: prose(2, 20), 4: "tiny", 5: None, 6: "", 7: prose(1, 12)}
    texts = {0: None, 1: "", 2: "x", 3: items[1], 4: prose(9, 30)}
    for i in range(5, 65):
        body = list(items[rng.choice([1, 2, 3])])
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(body))
            body[at:at + rng.choice([0, 1])] = rng.choice(["", "z", "q", "7"])
        texts[i] = prose(i, 10) + rng.choice([" ", "... ", "\n"]) + "".join(body).upper() + " " + prose(i + 1, 8)
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, block int")
    expected = set()
    for i, text in texts.items():
        for j, item in items.items():
            wanted = plain(item or "")
            if len(wanted) >= leaks.Q and distance_inside(wanted, plain(text or "")) <= math.floor(leaks.RATE * len(wanted)):
                expected.add((i, j))
    found = leaks.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(expected) > 20
    for r in found:
        assert distance_inside(plain(items[r.item_id]), plain(texts[r.doc_id][r.start:r.end])) == r.edits
    blocks = leaks.leaks(docs, benchmark, block_chars=60).collect()
    assert sorted(blocks) == sorted(found)
    clean = leaks.clean(docs, benchmark, block_chars=60)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {i for i, _ in expected}
    assert leaks.leaks(docs.limit(0), benchmark).count() == leaks.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_find_every_place_of_a_repeated_item(spark):
    items = {1: "abcdefgh", 2: "the cat sat on", 3: "one passage of some length here"}
    texts = {i: " ".join([item] * n) for i, (item, n) in enumerate([(x, n) for x in items.values() for n in (1, 2, 3, 7)])}
    texts[100] = "abcdefgh, Abcdefgh? the cat  sat on the cat sat on"
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = leaks.leaks(documents(spark, texts), benchmark).collect()
    for i, text in texts.items():
        for j, item in items.items():
            places = [k for k in range(len(text)) if plain(text[k:k + len(item) + 1])[:len(item)] == plain(item)
                      and plain(text[k]) and plain(text[k])[0] == plain(item)[0]]
            assert sorted(r.start for r in found if (r.doc_id, r.item_id) == (i, j)) == places, (i, j)
    assert all(r.edits == 0 for r in found)


# Byte-level BPE

def test_bpe_equals_the_library_and_decodes_to_the_text(spark):
    rng = random.Random(3)
    parts = ["a", "b", "'s", "'re", " ", "  ", "\n", " ", "1", "é", "!!", "'", "   x", "日本", "\x1c", "\x85"]
    texts = dict(enumerate("".join(rng.choice(parts) for _ in range(rng.randrange(300))) for _ in range(120)))
    texts |= {200: "a" * 500, 201: " " * 600, 202: "'" * 300 + "s" * 300, 203: "", 204: None, 205: "ab c " * 2000}
    library = byte_bpe._encoding(RANKS, PATTERN)
    for chunk, overlap in ((20, 4), (byte_bpe.CHUNK, byte_bpe.OVERLAP)):
        rows = byte_bpe.digests(documents(spark, texts), RANKS, PATTERN, "ids", chunk=chunk, overlap=overlap).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r.doc_id] or ""
            ids = np.array(library.encode_ordinary(text), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.ids == ids.tobytes()
    coded = byte_bpe.encode(documents(spark, texts), RANKS, PATTERN)
    for r in byte_bpe.decode(coded, RANKS, PATTERN).collect():
        assert r.content.decode() == (texts[r.doc_id] or "")
    odd = documents(spark, [(1, "a"), (1, "a"), (None, "b" * 50)])
    assert byte_bpe.encode(odd, RANKS, PATTERN, 20, 4).count() == 3
    assert byte_bpe.encode(odd.limit(0), RANKS, PATTERN).count() == 0


# Class bigrams

def test_brown_base_score_counts_and_gain(spark):
    rng = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(pool) for _ in range(12) for pool in (nouns, verbs)) for i in range(300)}
    texts |= {300: None, 301: "", 302: "unseen words only", 303: "N1 \t v2\n"}
    docs = documents(spark, [*texts.items(), (5, texts[5])])
    rows = brown.score(docs, rounds=4).collect()
    everything = [*texts.items(), (5, texts[5])]
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in everything}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(w for i, _ in everything if not held[i] for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(everything)
    for r in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]))
        assert r.train_tokens == total and r.score < 0
    tested = [r for r in rows if r.held_out and r.n_tokens > 5 and r.doc_id < 300]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested) + 0.15 * sum(r.n_tokens for r in tested)
    assert brown.score(docs.limit(0)).count() == 0
    alone = brown.score(documents(spark, [(None, "a")])).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known) == (False, 2, 2)


def test_brown_probabilities_sum_to_one(spark):
    docs = documents(spark, {i: prose(i, 40, 50) for i in range(60)})
    corpus, counts = brown.counted(brown.blocks(docs))
    corpus.cache()
    model = brown.fitted(corpus, counts, 3)
    words = collections.Counter(w for i in range(60) if zlib.crc32(str(i).encode()) % 10
                                for w in [*prose(i, 40, 50).split(), ""])
    assert (sum(words.values()), len(words)) == (counts.tokens, counts.distinct)
    row = corpus.select("held", "ends", "sequence", "words").toArrow()
    emitted = np.zeros(len(model.sizes))
    seen = {}
    for batch in row.to_batches():
        for n in range(batch.num_rows):
            _, totals, common, classes = brown._classes(batch, n, counts.common, model.of_common)
            for c, number, k in zip(totals, common, classes, strict=True):
                if c > 0 and number >= 0:
                    seen[number] = (k, c / model.sizes[k])
    for k, p in seen.values():
        emitted[k] += p
    used = model.sizes > 0
    assert np.allclose(emitted[used], 1)
    transitions = 10 ** model.transitions
    assert np.allclose(transitions[:, used].sum(axis=1) + transitions[:, -1], 1, atol=1e-6)


def test_brown_clusters_words_seen_once_in_a_large_corpus(spark):
    texts = {i: " ".join([*prose(i, 700, 50).split(), *(f"once{i * 100 + n}" for n in range(100))]) for i in range(200)}
    corpus, counts = brown.counted(brown.blocks(documents(spark, texts)))
    corpus.cache()
    assert counts.tokens > 1 << 17 and counts.common == counts.distinct > brown._GROUP
    names, after, before = {}, collections.Counter(), collections.Counter()
    for batch in corpus.select("held", "ends", "sequence", "words", "doc_ids").toArrow().to_batches():
        for n in range(batch.num_rows):
            sequence, totals, number, classes = brown._classes(
                batch, n, counts.common, np.arange(counts.common) % brown.CLASSES + 1)
            assert (number[totals > 0] >= 0).all() and (classes[totals > 0] <= brown.CLASSES).all()
            words = [w for i in batch.column("doc_ids")[n].as_py() for w in [*texts[i].split(), ""]]
            assert all(names.setdefault(w, k) == k for w, k in zip(words, number[sequence].tolist(), strict=True) if k >= 0)
            learned = [0, *number[brown._learned(batch, n, sequence)].tolist()]
            after.update(zip(learned[1:], learned[:-1], strict=True))
            before.update(zip(learned[1:-1], learned[2:], strict=True))
    assert names[""] == 0 and sorted(names.values()) == list(range(counts.common))
    table, _ = brown.neighbours(corpus)
    found = {"after": collections.Counter(), "before": collections.Counter()}
    for batch in table.toArrow().to_batches():
        for n in range(batch.num_rows):
            start = batch.column("group")[n].as_py() * brown._GROUP
            for side, seen in found.items():
                for word, neighbour, k in zip(*(x.tolist() for x in brown._unpacked(batch, n, side)), strict=True):
                    seen[start + word, neighbour] += k
    assert found == {"after": after, "before": before}
    model = brown.fitted(corpus, counts, 2)
    assert model.sizes.sum() == counts.tokens and set(model.of_common[1:]) <= set(range(1, 1 + brown.CLASSES))


def test_brown_neighbours_of_a_task_are_whole_and_take_little_memory():
    rng = np.random.default_rng(4)
    sequences = [np.append(rng.integers(1, 60_000, 500_000), 0).astype(np.int32) for _ in range(10)]
    batches = [pa.RecordBatch.from_pydict({
        "held": [[False]], "ends": pa.array([[len(x)]], pa.list_(pa.int64())), "sequence": [brown._shrunk(x)],
        "words": [{"placed": (np.arange(60_000) << brown._VALUE_BITS | np.arange(60_000)).tolist(), "totals": [1] * 60_000}]})
        for x in sequences]
    tracemalloc.start()
    rows = list(brown._neighbours(iter(batches)))
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 250e6
    rows.sort(key=lambda r: r.column("group")[0].as_py())
    found = {"after": collections.Counter(), "before": collections.Counter()}
    for row in brown._merged(iter(rows)):
        for side in found:
            words, others, counts = (x.astype(np.int64) for x in brown._unpacked(row, 0, side))
            words += row.column("group")[0].as_py() * brown._GROUP
            found[side].update(dict(zip(zip(words.tolist(), others.tolist(), strict=True), counts.tolist(), strict=True)))
    x = [s.tolist() for s in sequences]
    assert found["after"] == collections.Counter(pair for s in x for pair in zip(s, [0, *s[:-1]], strict=True))
    assert found["before"] == collections.Counter(pair for s in x for pair in zip(s[:-1], s[1:], strict=True))


# Wavelet matrices

def test_wavelet_queries():
    rng = np.random.default_rng(0)
    for size, kinds in ((0, 5), (1, 1), (3000, 50_000), (1500, 3), (512, 2), (700, 1)):
        ids = rng.integers(0, kinds, size)
        matrix = wavelet.Matrix(wavelet.build(ids))
        assert (matrix.all() == ids).all() and matrix.count(kinds + 70_000) == 0 == matrix.count(-1)
        for _ in range(30 if size else 0):
            at, (a, b) = int(rng.integers(size)), sorted(map(int, rng.integers(0, size + 1, 2)))
            token = int(ids[at])
            places = np.flatnonzero(ids == token)
            nth = int(rng.integers(len(places)))
            assert matrix.access(at) == token and matrix.count(token) == len(places)
            assert matrix.count(token, a, b) == ((places >= a) & (places < b)).sum()
            assert matrix.find(token, nth) == places[nth] and matrix.find(token, len(places)) == -1


def test_wavelet_shards_read_back(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = ["a", "É", "é", " ́", "'s", "'RE", "\n", " ", "\x1c", "\x85", "1", "İ", "Σ", "!!", "日本", "\t",
             "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "ﬁ", "word "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(None, "x"), (500, None), (501, ""), (7, rows[7][1]), (-3, "first"), (502, "hello<|endoftext|>world")]
    docs = documents(spark, rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in order]
    expected, start = [], 0
    for (i, _), own in zip(order, ids, strict=True):
        expected.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    tokens = wavelet.tokenize(docs, path)
    from tokenmill.sources import scratch
    files = wavelet.write(tokens, scratch.folder(spark, "shards"), parts=3, shard_tokens=500)
    assert files.count() > 5
    read = sorted(map(tuple, wavelet.contents(files).collect()), key=lambda r: r[1])
    assert read == expected
    flat = [i for own in ids for i in own]
    wanted = collections.Counter(flat).most_common(3)[1][0]
    assert wavelet.count(files, wanted) == flat.count(wanted)
    assert sorted(r.position for r in wavelet.occurrences(files, wanted).collect()) == \
        [n for n, i in enumerate(flat) if i == wanted]
    assert wavelet.round_trip(docs.limit(0), path).count() == 0


def test_words_and_marks_go_to_the_merge_model_once_a_worker(monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0xAA, 0x100)]
    words = ["Word", "ÀÉß", "l'été", "x", "", "Σας", *letters, *("aB" + c for c in letters)]
    marks = ["", *map(chr, range(33, 48)), "***", "<|", "!?'", "¿", "'s", "'Re,", "1", "_|>", "<|endoftext|>", "É́"]
    texts = [f" {w}{m} {m}{w}" for w in words for m in marks] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    calls, encoder = [], wavelet.WordEncoder(path)

    class Model:
        def tokenize(self, piece, model=encoder.model):
            calls.append(piece)
            return model.tokenize(piece)

    encoder.model = Model()
    monkeypatch.setattr(wavelet, "WordEncoder", lambda path: encoder)
    wavelet._kept.cache_clear()
    for _ in range(2):  # two tasks
        made = [ids for b in wavelet._tokenized(path, 2, 2)(iter([batch])) for ids in b.column("ids").to_pylist()]
        assert [np.frombuffer(ids, "<u2").tolist() for ids in made] == \
            [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    wavelet._kept.cache_clear()
    assert calls and len(calls) == len(set(calls))


# Ring

def placed_one_by_one(keys, shards):
    """The ring, walked row by row."""
    places = {k: int(hashlib.md5(("" if k[0] is None else str(k[0])).encode()).hexdigest()[:4], 16) for k in set(keys)}
    nodes = ring.nodes(shards)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    order = sorted(keys, key=lambda k: (places[k], k[0] is not None, k[0] or 0, k[1:]))
    found, late = collections.Counter(), []
    for key in order:
        node = max((n for n, (p, _) in enumerate(nodes) if p <= places[key]), default=len(nodes) - 1)
        if room[nodes[node][1]]:
            room[nodes[node][1]] -= 1
            found[key, nodes[node][1]] += 1
        else:
            late.append((key, node))
    for key, node in late:
        while not room[nodes[node][1]]:
            node = (node + 1) % len(nodes)
        room[nodes[node][1]] -= 1
        found[key, nodes[node][1]] += 1
    return found


def test_ring_equals_a_walk_row_by_row(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(500)] + [(7, "same")] * 90 + [(None, None), (None, ""), (900, "é")]
    result = ring.sharded(documents(spark, rows), 12).collect()
    keys = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows]
    assert collections.Counter(((r.doc_id, r.size, r.text_crc32), r.shard) for r in result) == placed_one_by_one(keys, 12)
    by_shard = collections.defaultdict(list)
    for r in result:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[s]) for s in range(12)]
    assert max(sizes) - min(sizes) <= 1 and {(r.law, r.grown_shard) for r in result} == {("rows", None)}
    assert ring.sharded(documents(spark, rows).limit(0), 12).count() == 0


def test_ring_moves_little_and_bounds_loads():
    counts = collections.Counter(int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) for i in range(40_000))

    def owners(shards, slack):
        return {(at, k): s for at, first, n, s, _ in ring.walk(counts, shards, slack) for k in range(first, first + n)}
    for slack in (0.0, 0.1):
        before, after = owners(40, slack), owners(41, slack)
        assert max(collections.Counter(before.values()).values()) <= 1000 * (1 + slack) + 2
        assert sum(before[k] != after[k] for k in before) < 0.06 * len(before)
