"""Whitening, spelling variants and piecewise fingerprints against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tokenmill.llm import piecewise, spelling, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int, x string, dims int, component string, n string"
DOCS = "doc_id long, text string, word string, n string, root int, tie string, part string, fingerprint int"


def vectors(spark, rows, partitions=3):
    """Vectors with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 1, "x", 2, "c", "n") for i, v in rows], EMBEDDINGS).repartition(partitions)


def documents(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, "w", "n", 1, "t", "p", 2) for i, t in rows], DOCS).repartition(partitions)


# Whitening

@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "identity", "repeated", "coupled", "zero", "tiny"])
def test_eigenvectors_solve_the_matrix(size, kind):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    q = np.linalg.qr(a)[0]
    matrix = {"random": a @ a.T, "identity": 3 * np.eye(size), "repeated": q @ np.diag(np.arange(size) // 3) @ q.T,
              "coupled": q @ np.diag(1 + 1e-9 * np.arange(size)) @ q.T, "zero": np.zeros((size, size)),
              "tiny": 1e-200 * (a @ a.T)}[kind]
    matrix = (matrix + matrix.T) / 2
    count = min(size, 16)
    values, found = whitening.leading_eigenvectors(matrix, count)
    norm = max(np.abs(matrix).sum(axis=1).max(), 1e-290)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:count]).max() <= 1e-13 * norm
    assert np.abs(matrix @ found - found * values).max() <= 1e-13 * norm
    assert np.abs(found.T @ found - np.eye(count)).max() <= 1e-12


def test_sturm_counts_eigenvalues_below():
    rng = np.random.default_rng(3)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    asked = np.linspace(-5, 5, 41)
    assert whitening.sturm_counts(diagonal, off, asked).tolist() == [(values < x).sum() for x in asked]


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for largest in (9, 1 << 26, 1 << 40):
        rows = rng.integers(-largest, largest, (50, 4))
        expected = [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(4)] for i in range(4)]
        assert whitening.products(rows).tolist() == expected


def brute_whitening(rows, components=16):
    """{row: values} by exact fractions and numpy's solver, for rows of one length."""
    grid = [(i, tuple(math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows]
    distinct = sorted({x for _, x in grid})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(dims)]
    cov = [[float(sum(Fraction(n * x[i] - sums[i], n) * Fraction(n * x[j] - sums[j], n) for x in distinct) / n)
            for j in range(dims)] for i in range(dims)]
    values, found = np.linalg.eigh(np.array(cov))
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    result = []
    for i, x in grid:
        apart = [n * a - s for a, s in zip(x, sums)]
        result.append((i, n, sum(a * a for a in apart), np.array([a / n for a in apart]) @ found / np.sqrt(values)))
    return result, values / np.trace(np.array(cov))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    scale = np.linspace(4, 0.5, 20)
    rows = [(i, [float(c) for c in rng.standard_normal(20) * scale]) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1])] + [(300 + i, rows[2][1]) for i in range(60)]
    bad = [(400, None), (401, []), (402, [None] + [1.0] * 19), (403, [float("nan")] * 20), (404, [float("inf")] * 20)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    expected, shares = brute_whitening(rows)
    assert len(got) == 16 * len(rows)
    by_row = collections.defaultdict(list)
    for r in got:
        by_row[r.vec_id, r.component].append(r)
    signs = None
    for i, n, deviation, values in expected:
        mine = [by_row[i, c + 1].pop() for c in range(16)]
        assert all(r.n == n and r.deviation == deviation for r in mine)
        found = np.array([r.whitened for r in mine])
        signs = np.sign(found * values) if signs is None else signs
        assert np.allclose(found, signs * values, rtol=0, atol=1e-9)
        assert np.allclose([r.explained for r in mine], shares, rtol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    distinct = np.array([v for _, _, _, v in expected[:120]])
    assert np.abs(np.cov(distinct.T, bias=True) - np.eye(16)).max() < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [0.0, 1.0, 5.0]), (2, [1.0, 1.0, 5.0]), (3, [7.0]), (4, [9.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in got) == [
        (i, 1, 2, d, 1.0, 1.0) for i, d in ((1, 4096), (2, 4096), (3, 16384), (4, 16384))]
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 2.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in huge)
    assert {r.vec_id for r in huge if r.deviation is None} == {1, 3}


def test_whitening_on_two_partitionings_is_the_same(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.standard_normal(6)]) for i in range(50)]
    one, other = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows, p)).collect()}
                  for p in (1, 7))
    assert one == other


# Spelling variants

def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    result = {}
    for word, n in kept.items():
        others = [w for w in kept if abs(len(w) - len(word)) < 2 and near(word, w)]
        best = min(others, key=lambda w: (-kept[w], w), default=None)
        result[word] = (best if best and kept[best] >= 2 * n else None, n, len(others))
    for word, (form, n, size) in result.items():
        root = word
        while result[root][0]:
            root = result[root][0]
        yield word, form, root, n, size, kept.get(form)


def spelled(seed, count=400):
    """Texts of words of a small alphabet and their misspellings."""
    rng = random.Random(seed)
    letters = "abcdeà×ÿZ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    base += ["x" * 60, "x" * 61, "x" * 59 + "y", "nolon" * 20, "solon" * 20, "nolon" * 20 + "a", "u" * 5, "u" * 6]
    for i in range(count):
        words = []
        for _ in range(rng.randrange(0, 12)):
            word = rng.choice(base[:1 + rng.randrange(len(base))])
            if rng.random() < 0.2:
                k = rng.randrange(len(word))
                word = word[:k] + rng.choice(["", rng.choice(letters), word[k] + "a"]) + word[k + 1:]
            words.append(word)
        yield i, rng.choice([" ", "-", "\n", "1"]).join(words)


@pytest.mark.parametrize("subtree", [spelling.SUBTREE, 40, 2])
def test_variants_equal_brute_force(spark, subtree):
    rows = [*spelled(1), (None, "abcde abcde"), (None, "abcde"), (7, None), (8, ""), (9, "..."), (9, "..."),
            (10, "abcde " * 50), (10, "abcde " * 50), (11, "plane " * 3 + "plano " * 8 + "plamo " * 20 + "glamo " * 50)]
    got = sorted(tuple(r) for r in spelling.variants(documents(spark, rows), subtree).collect())
    assert got == sorted(brute_variants(rows)) and any(r[1] != r[2] for r in got if r[1])


def test_variants_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "short words once here")]):
        assert spelling.variants(documents(spark, rows)).collect() == []
    alone = spelling.variants(documents(spark, [(1, "singular singular singular")])).collect()
    assert [tuple(r) for r in alone] == [("singular", None, "singular", 3, 0, None)]


def test_anagram_classes_are_dealt_to_parts(spark):
    """All words have the same letters, so the trie's last level alone can part them."""
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefg", 7)) for _ in range(300)}
    rows = [(i, f"{w} {w} {w}") for i, w in enumerate(words)] + [(1000, "abcdefgh " * 9), (1001, "bacdefg bacdefg ab")]
    got = sorted(tuple(r) for r in spelling.variants(documents(spark, rows), 16).collect())
    assert got == sorted(brute_variants(rows))


# Piecewise fingerprints

def slow_fingerprint(content: bytes) -> str:
    if not content:
        return "0:::"
    triggers = []
    for i in range(len(content)):
        total = 0
        for j in range(i - 6, i + 1):
            total = (total * 0x9E3779B1 + (content[j] if j >= 0 else 0) + 1) % (1 << 32)
        total = ((total ^ total >> 15) * 0x85EBCA6B) % (1 << 32)
        triggers.append(total ^ total >> 13)

    def ends(bits):
        found = [i + 1 for i, t in enumerate(triggers) if t % (1 << bits) == (1 << bits) - 1]
        return found if found and found[-1] == len(content) else [*found, len(content)]

    def character(piece):
        h = (sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(piece)) + len(piece)) % (1 << 64)
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
        return chr(piecewise.ALPHABET[(h ^ h >> 31) >> 58])

    bits = ((len(content) - 1) // 64).bit_length()
    while len(ends(bits)) > 128:
        bits += 1
    strings = []
    for more in range(3):
        stops = ends(bits + more)
        strings.append("".join(character(content[a:b]) for a, b in zip([0, *stops], stops)))
    return ":".join([str(bits), *strings])


@pytest.mark.parametrize("stretch", [64, piecewise.STRETCH])
def test_fingerprint_equals_the_slow_one(monkeypatch, stretch):
    monkeypatch.setattr(piecewise, "STRETCH", stretch)
    monkeypatch.setattr(piecewise, "_powers", {})
    rng = random.Random(1)
    for size in (0, 1, 5, 6, 7, 8, 63, 64, 65, 129, 700, 2000):
        for content in (bytes(rng.randrange(97, 123) for _ in range(size)), b"a" * size, b"ab" * size, b"line\n" * size):
            assert piecewise.fingerprint(content) == slow_fingerprint(content)


def test_edit_distance():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            above, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(140))) for _ in range(2))
        assert piecewise.edit_distance(a, b) == slow(a, b)


def text(seed, words=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}é" for _ in range(words))


def test_likeness_follows_the_shared_part():
    a, b = text(1), text(2)
    prints = [piecewise.fingerprint(x.encode()) for x in (a, a[:len(a) // 2] + b[len(b) // 2:], "new start " + a, b)]
    half, moved, other = (piecewise.likeness(prints[0], p) for p in prints[1:])
    assert piecewise.likeness(prints[0], prints[0]) == 1
    assert 0.3 < half < 0.7 and moved > 0.9 and other < 0.25
    doubled = piecewise.likeness(prints[0], piecewise.fingerprint((a + b).encode()))
    assert 0.3 < doubled < 0.7  # block sizes differ, and both have the coarser one
    assert piecewise.likeness(prints[0], piecewise.fingerprint(b"")) == 0


@pytest.mark.parametrize("part_bytes", [1, 2000, piecewise.PART_BYTES])
def test_followed_equals_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(piecewise, "PART_BYTES", part_bytes)
    rng = random.Random(3)
    rows = [(rng.randrange(1 << 40), text(i, rng.randrange(40))) for i in range(40)]
    rows += [(5, None), (6, ""), (None, "first"), (None, "second"), (None, None), (5, "five"), (5, "five"), (-1, "minus"),
             (1 << 41, text(99, 20000)), (rows[0][0], "same id")]
    docs = documents(spark, rows)
    ties = {(r.doc_id, r.text or ""): r.tie for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as tie").collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, ties[r]))
    expected = []
    for (doc_id, own), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(own) // 2
        changed = own[:len(own) - half] + following[:half]
        prints = [piecewise.fingerprint(x.encode()) for x in (own, changed, following)]
        expected.append((doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), *prints[:2],
                         piecewise.likeness(prints[0], prints[1]), piecewise.likeness(prints[0], prints[2])))
    got = [tuple(r) for r in piecewise.followed(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    found = {(r.doc_id, r.fingerprint) for r in piecewise.fingerprints(docs).collect()}
    assert found == {(r[0], r[3]) for r in expected}


def test_followed_by_itself_and_by_nothing(spark):
    assert piecewise.followed(documents(spark, [])).collect() == []
    [row] = piecewise.followed(documents(spark, [(1, "abcdef")])).collect()
    assert (row.n_chars, row.edited_sha256, row.near_next) == (6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)
    [row] = piecewise.followed(documents(spark, [(1, None)])).collect()
    assert (row.n_chars, row.near_edited, row.near_next) == (0, 1.0, 1.0)
