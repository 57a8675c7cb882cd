"""Operators on pages and embeddings, components, the pipeline and the registered queries."""

import base64
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.conftest import SF_DIR
from tokenmill.llm import byte_bpe, hamming, near_dups, queries, urls, warc
from tokenmill.llm.components import connected
from tokenmill.sources import scratch


def roots(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 420)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)]
    rng.shuffle(edges)
    edges = [e[::rng.choice([1, -1])] for e in edges] + edges[:20] + [(5, 5), (None, 3), (3, None)]
    found = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert found == roots({n for e in real for n in e}, real)
    names = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "y")], "a string, b string")
    assert dict(map(tuple, connected(names).collect())) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected(names.limit(0)).count() == 0


# URLs

PAGES = "page_id long, url string, html string, host string, rule string, node string, component string"

WEB = [
    (1, "http://a.com/x", '<html><LINK href="https://spam.net/y" rel="canonical">'),
    (2, "https://A.com/x#f", ""), (3, "http://b.com", "<link rel=canonical href=//a.com/x>"),
    (4, "http://c.com/p/q?z", '<meta http-equiv="refresh" content="0; url=r">'), (5, None, None),
    (6, "nourl", "<link rel='canonical' href='http://spam.net/'>"),
    (7, "http://d.com/", '<meta content="5;URL=http://spam.net/q" http-equiv=refresh>'),
    (8, "http://www.example.net/en/a", '<link rel="canonical" href="http://d.com/">'),
    (9, "http://example.com/de/1", '<link rel="canonical" href="/z">'), (10, "http://example.com/z", ""),
    (11, "http://x.net", "<a href='http://good.org/fr/'>"), (12, "http://x.org/fr/1", "<link rel=canonical>"),
    (13, "http://e.org:80?x", "<link rel=alternate href=http://spam.net/>"), (1, "http://a.com/x", ""),
    (14, "HTTP://Sub.EXAMPLE.net/en/?q", ""), (15, "http://myexample.net/en/", ""), (16, "x://y.org/fr", ""),
    (17, "http://c.com/p/r", ""), (18, "http://m.com/", "<link rel=canonical href=mailto:a@b.net>")]


def web(spark, rows=WEB):
    return spark.createDataFrame([(*r, "h", "r", "n", "c") for r in rows], PAGES)


def test_url_verdicts_spread_over_aliases(spark):
    rows = {r.page_id: tuple(r)[1:] for r in urls.verdicts(web(spark)).collect()}
    assert urls.verdicts(web(spark)).count() == len(WEB)
    assert rows[1] == rows[2] == ("a.com", "/x", None, "block")  # named spam.net
    assert rows[3] == ("b.com", "", None, "block")  # through a.com
    assert rows[4] == ("c.com", "/p/q", None, "allow") and rows[5] == rows[6] == ("", "", None, "allow")
    assert rows[7] == ("d.com", "/", None, "allow")  # blocked and allowed aliases
    assert rows[8] == ("www.example.net", "/en/a", "example.net/en/", "allow")
    assert rows[9] == ("example.com", "/de/1", "example.com/de/", "block") and rows[10][-1] == "block"
    assert rows[11] == ("x.net", "", None, "allow") and rows[12] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert rows[13] == ("e.org:80", "", None, "allow")
    assert rows[14] == ("sub.example.net", "/en/", "example.net/en/", "allow")
    assert rows[15][2:] == ("net/", "block") and rows[16] == ("y.org", "/fr", None, "allow")
    assert {(r.a, r.b) for r in urls.aliases(web(spark)).collect()} >= {("c.com/p/q?z", "c.com/p/r")}
    assert urls.verdicts(web(spark).limit(0)).count() == 0


def test_every_canonical_link_and_redirect_of_a_page_counts(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [(1, "http://a.com/x", canonical.format("http://a.com/x") + refresh.format("http://spam.net/1")),
            (2, "http://b.com/", canonical.format("http://b.com/") + canonical.format("http://spam.net/2")),
            (3, "http://c.com/", refresh.format("/self") + refresh.format("http://spam.net/3")),
            (4, "http://d.com/?a=1&b=2", refresh.format("http://spam.net/4")),
            (5, "http://e.com/", canonical.format("http://d.com/?a=1&amp;b=2")),
            (6, "http://f.com/", refresh.format("http://d.com/?a=1&#38;b=2")),
            (7, "http://g.com/", canonical.format("http://d.com&#x2F;?a&#61;1&AMP;b=2")),
            (8, "http://h.com/", canonical.format("http://d.com/?a=1&amp;amp;b=2")),
            (9, "http://i.com/", canonical.format("http://i.com/&#xe9;&#x1F600;&#xD800;&nope;&&#99999999;"))]
    edges = {(r.a, r.b) for r in urls.aliases(web(spark, rows)).collect()}
    assert edges == {("a.com/x", "spam.net/1"), ("b.com/", "spam.net/2"), ("c.com/", "c.com/self"),
                     ("c.com/", "spam.net/3"), ("d.com/?a=1&b=2", "spam.net/4"), ("e.com/", "d.com/?a=1&b=2"),
                     ("f.com/", "d.com/?a=1&b=2"), ("g.com/", "d.com/?a=1&b=2"), ("h.com/", "d.com/?a=1&amp;b=2"),
                     ("i.com/", "i.com/\u00e9\U0001f600&")}
    found = {r.page_id: r.verdict for r in urls.verdicts(web(spark, rows)).collect()}
    assert found == {**dict.fromkeys(range(1, 8), "block"), 8: "allow", 9: "allow"}


def test_only_attributes_of_the_page_itself_name_urls(spark):
    rows = [(1, "http://a.com/", '<link rel="canonical" data-href="http://b.net/q" href="http://c.com/z">'),
            (2, "http://d.com/", '<link data-rel="canonical" rel="stylesheet" href="http://b.net/q">'),
            (3, "http://e.com/", '<!-- <link rel="canonical" href="http://b.net/q"> -->'),
            (4, "http://f.com/", """<script>x = '<link rel="canonical" href="http://b.net/q">'</script>"""),
            (5, "http://g.com/", '<!-- x --><link href="http://b.net/q"rel="canonical"><!-- y -->'),
            (6, "http://h.com/", '<meta data-content="0;url=http://b.net/q" http-equiv=refresh content="0; url=/z">')]
    edges = {(r.a, r.b) for r in urls.aliases(web(spark, rows)).collect()}
    assert edges == {("a.com/", "c.com/z"), ("g.com/", "b.net/q"), ("h.com/", "h.com/z")}
    found = {r.page_id: r.verdict for r in urls.verdicts(web(spark, rows)).collect()}
    assert found == {**dict.fromkeys([1, 2, 3, 4, 6], "allow"), 5: "block"}


def duck(tables, sql):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, frame)
    result = connection.execute(sql)
    return [c[0] for c in result.description], sorted(map(str, result.fetchall()))


def test_url_sql_agrees_on_linked_pages(spark):
    columns, expected = duck({"pages": web(spark).toArrow()}, queries.statements()["op2_redirect_equivalence"])
    assert sorted(str(tuple(r)) for r in urls.verdicts(web(spark)).select(*columns).collect()) == expected


# Embeddings

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 0, "x", 1) for i, v, y in rows],
                                 "vec_id long, embedding array<float>, label int, class int, size string, n_links int")


@pytest.fixture(scope="module")
def cloud():
    rng, rows = np.random.default_rng(2), []
    for centre in rng.standard_normal((12, 24)):
        for _ in range(30):
            rows.append((centre + rng.standard_normal(24) * rng.choice([0.02, 0.12, 0.3])).astype("f4").tolist())
    rows += [rows[3]] * 25 + [(np.array(rows[3]) * 2).tolist()]
    rows = [(i, v, i % 2) for i, v in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, rows[0][1], None), (n + 3, [float("nan")] * 24, 1),
                   (n + 4, [None] + [1.0] * 23, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1),
                   (n + 8, [float("inf")] + [0.0] * 23, 1)]


def test_embedding_links_equal_brute_force(spark, cloud):
    found = {r.vec_id: (r.n_links, r.component_id, r.kept)
             for r in hamming.near_duplicates(vectors(spark, cloud)).collect()}
    unit = {i: (np.array(v, float) / np.linalg.norm(np.array(v, float)), y) for i, v, y in cloud
            if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    edges = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1]
             and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    root = roots([i for i, *_ in cloud], edges)
    degree = {i: sum(i in e for e in edges) for i in root}
    assert len(edges) > 500
    linked = sum(n for n, *_ in found.values()) / 2
    assert linked >= 0.999 * len(edges)  # recall against brute force
    assert found == {i: (degree[i], r, r == i) for i, r in root.items()}


def test_embedding_sql_agrees(spark, cloud):
    columns, expected = duck({"embeddings": vectors(spark, cloud).toArrow()}, queries.statements()["op3_itq_near_dups"])
    found = hamming.near_duplicates(vectors(spark, cloud)).select(*columns)
    assert sorted(str(tuple(r)) for r in found.collect()) == expected


def test_embeddings_without_ids_or_rows(spark):
    rows = vectors(spark, [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)])
    found = sorted(map(str, hamming.near_duplicates(rows).collect()))
    assert len(found) == 4 and sum("n_links=2" in f for f in found) == 3
    assert sorted(r.kept for r in hamming.near_duplicates(rows).collect()) == [False, True, True, True]
    assert hamming.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.8, 0.9, 0.97])
def test_embeddings_with_a_common_mean_keep_their_links(spark, common):
    rng = np.random.default_rng(4)
    own = rng.standard_normal((800, 64))
    own[:, 0] = 0
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    unit = own * np.sqrt(1 - common) + np.eye(64)[0] * np.sqrt(common)
    noise = rng.standard_normal(unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    near = unit * 0.983 + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sqrt(1 - 0.983 ** 2)
    both = np.concatenate([unit, near]).astype("f4").astype(float)
    rows = vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(both)])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    linked = (both @ both.T >= hamming.COSINE).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in hamming.near_duplicates(rows).collect()}
    assert linked.sum() >= 1600 and all(n <= linked[i] for i, n in found.items())
    assert sum(found.values()) >= 0.99 * linked.sum()


def test_long_vectors_that_differ_in_their_beginning_are_linked(spark):
    rng = np.random.default_rng(5)
    rows = [v.tolist() for v in rng.standard_normal((500, 8))]
    for _ in range(150):
        end = rng.standard_normal(56)
        rows += [[*(rng.standard_normal(8) * 0.1).tolist(), *end.tolist()] for _ in range(2)]
    rows = [(i, v, 1) for i, v in enumerate(rows)]
    found = {r.vec_id: r.n_links for r in hamming.near_duplicates(vectors(spark, rows)).collect()}
    assert all(found[i] == 1 for i in range(500, 800))


def test_plan_misses_few_pairs_at_any_size():
    for n in (0, 10, 10 ** 4, 10 ** 8, 10 ** 11):
        plan = hamming.Plan.of(n)
        differ = np.arccos(0.98) / np.pi
        meet = (1 - differ) ** plan.width + plan.width * differ * (1 - differ) ** (plan.width - 1)
        assert (1 - meet) ** plan.tables <= hamming.MISS and n <= 2 ** plan.width


# Archives

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"

ARCHIVED = [(1, "u", "abc"), (2, "u", "abc"), (3, None, None), (4, "x", ""), (5, "x", FAKE), (10, "x", "é" * 3000),
            (6, "x", "pre" + FAKE + FAKE + "post é"), (7, "x", "WARC/1.0\r\n"), (9, "a\r\nb", "WARC/1.0\r\n" * 2),
            (8, "x", "WARC/1.0\r\nContent-Length: 10\r\n\r\n" * 50), (None, "n", "abc"), (3, "again", None),
            (11, "y", "\r\n\r\n"), (12, "y", "WWARC/1.0\r\n\r\nWARC/1.0\r"),
            *((100 + i, "u", f"p{i % 37}" + FAKE * (i % 5)) for i in range(120))]


def archive_rows(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    result = []
    for page, _, html in rows:
        content = (html or "").encode()
        earlier = first.get(html or "", page)
        revisit = page is not None and page > earlier
        result.append((page, len(content), base64.b32encode(hashlib.sha1(content).digest()).decode(),
                       "revisit" if revisit else "response", earlier if revisit else None))
    return sorted(result, key=str)


def pages(spark):
    rows = [(*r, "t", 1, "o") for r in ARCHIVED]
    return spark.createDataFrame(rows, "page_id long, url string, html string, type string, n int, digest string")


def test_archives_read_back(spark):
    for least in (0, 100):
        found = warc.round_trip(pages(spark).repartition(3), least).collect()
        assert sorted((tuple(r) for r in found), key=str) == archive_rows(ARCHIVED, least)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archive_of_one_file_in_many_splits_and_segments(spark):
    folder = scratch.folder(spark, "one-file")
    warc.write(pages(spark).coalesce(1), folder)
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = warc.read(spark, folder, segment=700).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sorted((tuple(r) for r in found), key=str) == archive_rows(ARCHIVED)


# Pipeline and queries

def test_pipeline_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = scratch.table(stages[0](spark, docs, SF_DIR), "good")
    single = scratch.table(stages[1](spark, good, SF_DIR), "single")
    clean = scratch.table(stages[2](spark, single, SF_DIR), "clean")
    assert docs.columns == good.columns == single.columns == clean.columns
    groups = near_dups.near_duplicates(good)
    assert single.count() == groups.select("component_id").distinct().count() < good.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i, t in texts.items() if not any(b in t for b in items)}
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    library = byte_bpe._encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                 corpus_pipeline.public_tokenizers.PATTERN)
    assert result.keys() == {r.doc_id for r in clean.collect()}
    for i, row in result.items():
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(texts[i])
        assert row.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_pipeline_of_odd_and_no_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "", None, None, None), (2, "a b", "en", "s", 3),
                                 (2, "a b", "en", "s", 3)], docs.schema)
    for rows in (docs, odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = scratch.table(stage(spark, rows, SF_DIR), "stage")
        assert rows.count() <= 3


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    result = connection.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    found = __spark_entry__.queries()[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(str, result.fetchall()))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_no_table_of_the_search_is_broadcast(spark):
    """Files are small next to the rows that codes explode to, so a broadcast grew past the driver."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 8))
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(np.concatenate([vectors, vectors + 1e-4]))]
    classes = spark.createDataFrame(rows, "class long, label long, embedding array<double>").withColumn("size", F.lit(8))
    found = hamming.links(classes)
    assert {(r.a, r.b) for r in found.collect()} >= {(i, i + 40) for i in range(40)}
    embeddings = classes.select(F.col("class").alias("vec_id"), "label", "embedding")
    for frame in (found, hamming.near_duplicates(embeddings)):
        assert "Broadcast" not in frame._jdf.queryExecution().sparkPlan().toString()
