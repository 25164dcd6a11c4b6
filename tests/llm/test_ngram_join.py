"""The similarity join against all pairs, its forest, and large components."""

import random

import duckdb
import numpy as np
import pytest

from .test_llm import brute_similar
from tidemark.llm import common, ngram_join, queries

R = random.Random(12)


def prose(n):
    return " ".join(f"w{R.randrange(500)}" for _ in range(n))


def joined(spark, rows, **how):
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_links int").repartition(3)
    return {tuple(r) for r in ngram_join.similarity_join(d, **how).select("doc_id", "class_id", "n_links", "group_id").collect()}


def chain(n, step):
    """Texts each of which is like the next one and unlike those further on."""
    words = prose(150 + n * step).split()
    return [" ".join(words[i * step : i * step + 150]) for i in range(n)]


def test_large_components_are_compared_node_by_node(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = list(enumerate(chain(60, 6)))
    base = prose(150).split()
    rows += [(100 + i, " ".join([*base[:i], f"n{i}", *base[i + 1 :]])) for i in range(30)]
    assert joined(spark, rows) == brute_similar(rows)


def test_nodes_of_earlier_trees_are_left_out():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7])]
    nodes = np.array([[1, 9], [1, 8], [2, 8]])
    assert ngram_join.linked(sets, 0, 0.7)[0].tolist() == [2, 2, 2]
    assert ngram_join.linked(sets, 0, 0.7, nodes[:, :1])[0].tolist() == [1, 1, 2]
    assert ngram_join.linked(sets, 0, 0.7, nodes)[0].tolist() == [1, 0, 1]
    assert ngram_join.linked(sets, 1, 0.7)[0].tolist() == [2, 1, 1]


def test_prefixes_are_shortened_to_the_target():
    deep = ngram_join.shortened({0.98: 50.0, 0.99: 50.0}, 24, 12, 5, 0.9999)
    middle = ngram_join.shortened({0.9: 50.0, 0.99: 50.0}, 24, 12, 5, 0.9999)
    assert deep == 12 > middle > 5 == ngram_join.shortened({0.8: 1.0}, 24, 12, 5, 0.9999) == ngram_join.shortened({}, 24, 12, 5, 0.9999)
    assert ngram_join.recall_at(middle, 24, np.array([0.9, 0.99])).mean() >= 0.9999 > ngram_join.recall_at(middle + 1, 24, np.array([0.9, 0.99])).mean()


def test_signatures_estimate_similarity():
    rng, sign = np.random.default_rng(2), ngram_join.Signer(24, 12)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    levels = lambda s: np.concatenate([(x[:, None] >> (10 * np.arange(6))) & 1023 for x in sign(s)])
    assert abs((levels(a) == levels(b)).mean() - 3000 / 5000) < 0.09


def test_similar_links_let_prefixes_stay_long(spark, monkeypatch):
    """Many copies that differ by a word: the measured recall is reached before the shortest prefix, and all links are found."""
    rows, asked = [], []
    for k in range(120):
        w = prose(400).split()
        rows += [(k * 4 + j, " ".join([*w[: 90 * j + 40], "changed", *w[90 * j + 41 :]])) for j in range(4)]
    shortened = ngram_join.shortened
    monkeypatch.setattr(ngram_join, "shortened", lambda *a: asked.append(shortened(*a)) or asked[-1])
    assert joined(spark, rows, least_links=100) == brute_similar(rows) and asked[0] > 5


def test_links_at_the_threshold_are_found_among_many_closer_ones(spark):
    """46,800 links far above the threshold say nothing about 150 near it: a prefix that suits those would miss some of these."""
    r, rows = random.Random(5), []
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    for k in range(60):
        w = text(400)
        rows += [(k * 40 + j, " ".join([*w[: 9 * j + 10], "changed", *w[9 * j + 11 :]])) for j in range(40)]
    for k in range(150):
        w = text(200)
        rows += [(10_000 + 2 * k, " ".join(w)), (10_001 + 2 * k, " ".join([*w[:20], "x", *w[21:80], "x", *w[81:140], "x", *w[141:180], "x", *w[181:]]))]
    got = joined(spark, rows)
    assert sum(n for i, _, n, _ in got if i < 10_000) == 60 * 40 * 39
    assert [n for i, _, n, _ in got if i >= 10_000] == [1] * 300


def test_all_nodes_are_measured(spark, monkeypatch):
    """All links of all nodes, also of nodes compared by blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    w = prose(400).split()
    rows = [(j, " ".join([*w[: 9 * j + 10], "changed", *w[9 * j + 11 :]])) for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    at = spark.createDataFrame([(i, node) for i, _ in rows for node in (7, 8)], "doc_id bigint, node bigint")
    got = ngram_join.measured(docs, at, at.groupBy("node").count().withColumnRenamed("count", "n"), 5, 0.8, 5)
    assert round(sum(n * s**5 for s, n in got.items())) == 2 * 30 * 29 // 2


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b"), (None, "a b"), (2, ""), (3, "a b"), (1, "A  b"), (5, "x " * 20_000), (6, "x" * 1_000_000), (7, "x " * 20_001)]])
def test_odd_tables(spark, rows):
    got = joined(spark, rows)
    assert len(got) == len({(i, t) for i, t in rows} if rows[:1] != [(None, "a b")] else rows) - (rows[:1] == [(None, "a b")])
    if len(rows) > 2:
        assert {(1, 1, 0, 1), (3, 1, 0, 1), (2, 2, 0, 2), (5, 5, 0, 5), (7, 5, 0, 5), (6, 6, 0, 6), (None, None, 0, None)} == got


def test_every_link_of_the_table_is_found(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL["op7_ngram_join"])
    names = want.columns
    got = ngram_join.similarity_join(common.table(spark, "/root/testdata/sf0.01", "documents")).select(*names).collect()
    assert {tuple(r) for r in got} == set(want.fetchall())
