"""The conditional random field against enumeration of all labellings, and its features."""

import itertools
import math
import random

import numpy as np

from tidemark.llm import common, quality

R = random.Random(8)


def enumerated(unary, move):
    """P(bad) of each line and the log of the sum over all labellings."""
    total, bad = 0.0, np.zeros(len(unary))
    for y in itertools.product((0, 1), repeat=len(unary)):
        p = math.exp(sum(u for u, k in zip(unary, y, strict=True) if k) + sum(move[a][b] for a, b in itertools.pairwise(y)))
        total += p
        bad += p * np.array(y)
    return bad / total, math.log(total)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        unary, move = rng.normal(0, 2, n), rng.normal(0, 1, (2, 2))
        assert np.allclose(quality.marginals(unary, move), enumerated(unary, move)[0], atol=1e-12)


def test_gradient_equals_that_of_the_enumerated_likelihood():
    rng = np.random.default_rng(5)
    xs = [rng.normal(0, 1, (n, 3)) for n in (1, 8, 5, 8, 2)]
    ys = [rng.integers(0, 2, len(x)).astype(float) for x in xs]

    def loss(v):
        w, move, out = v[:3], v[3:].reshape(2, 2), 0.0
        for x, y in zip(xs, ys, strict=True):
            k = y.astype(int)
            out += enumerated(x @ w, move)[1] - (x @ w) @ y - sum(move[a][b] for a, b in itertools.pairwise(k))
        return out / sum(map(len, xs))

    v = rng.normal(0, 0.5, 7)
    by_w, by_move = quality.Chains(xs, ys).gradient(v[:3], v[3:].reshape(2, 2))
    numeric = [(loss(v + h) - loss(v - h)) / 2e-6 for h in np.eye(7) * 1e-6]
    assert np.allclose(np.concatenate([by_w, by_move.ravel()]), numeric, atol=1e-6)


def test_repeated_characters_are_counted():
    x, n = quality.line_features("aab ====== c\nplain words\n\n  \nééé")
    assert x.shape == (3, quality.WIDTH) and n.tolist() == [12, 11, 6]
    assert x[0, 10] == min(2 * 6 / 12, 1) and x[1, 10] == 0 and x[2, 10] == 1
    assert quality.line_features(None)[0].shape == quality.line_features(" \n ")[0].shape == (0, quality.WIDTH)


def test_long_documents_take_part_in_learning(spark):
    """All rows of one label have over 400 lines; a cap on lines would leave one label only."""
    line = lambda bad: "ZZZ!! QQQ!! ###" if bad else "Some plain words stand here."
    rows = [(i, "\n".join([line(i % 2)] * (900 if i % 2 else 5)), 1 - i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = quality.fit(train)
    assert np.abs(model.weights).sum() > 0
    asked = spark.createDataFrame([(1, line(1), 0.5), (1, line(0), 0.5), (None, "\n".join([line(0)] * 30_000), 0.5), (3, None, 0.5)], "doc_id bigint, text string, score double")
    got = {(r["doc_id"], r["predicted"]) for r in quality.score(asked, model).collect()}
    assert got == {(1, 0), (1, 1), (None, 1), (3, 0)}
    few = quality.fit(train, most_lines=9_000)
    assert few.weights.shape == model.weights.shape


def test_held_out_accuracy_of_the_table(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    got = quality.quality(docs, labels, common.remainder("doc_id", 3) == 1).join(labels, "doc_id").filter("held_out and quality is not null").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got) > 50
