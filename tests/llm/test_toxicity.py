"""The product machine against its transducers one by one, clause scope, both readings of a word, held-out figures."""

import math
import random

import numpy as np

from tidemark.llm import common, toxicity

R = random.Random(6)


def one_by_one(kinds):
    """Insult and threat outputs of each word, from five separate runs."""
    runs = []
    for p in toxicity.GRAMMAR:
        state, factors = 0, []
        for k in kinds:
            state, f = p.step(state, k)
            factors.append(f)
        runs.append((p.on, factors))
    return [tuple(toxicity.ACCEPT[c] * math.prod(fs[i] for on, fs in runs if on == c) if c in k else 0.0 for c in ("insult", "threat")) for i, k in enumerate(kinds)]


def test_product_machine_equals_its_parts():
    table = toxicity.compose(toxicity.GRAMMAR, toxicity.ACCEPT)
    for _ in range(300):
        kinds = [R.choice(toxicity.COMBOS) for _ in range(R.randint(1, 25))]
        state, out = 0, []
        for k in kinds:
            state, *got = table[state][toxicity.COMBOS.index(k)]
            out.append(tuple(got))
        for a, b in zip(out, one_by_one(kinds), strict=True):
            assert all(math.isclose(x, y) for x, y in zip(a, b, strict=True))


def test_reach_by_hand():
    p = toxicity.Transducer("negation", 2, "insult", 0.5)
    state, got = 0, []
    for k in ("insult", "negation", "insult", "insult", "insult"):
        state, f = p.step(state, frozenset([k]))
        got.append(f)
    assert got == [1.0, 1.0, 0.5, 0.5, 1.0]


def test_commas_and_colons_do_not_end_a_clause():
    m = toxicity.Matcher(toxicity.Model({"zonk": 4.0}))
    score = lambda t: sum(m.clauses(t)[0])
    assert math.isclose(score("he said: you are a zonk"), score("he said you are a zonk")) and score("he said: you are a zonk") < score("he said. you are a zonk")
    assert math.isclose(score("never, ever a zonk"), score("never ever a zonk")) and score("never, ever a zonk") < score("never. ever a zonk")
    assert len(m.clauses("a zonk; a zonk! a zonk\na zonk, a zonk")[0]) == 4


def test_a_learned_word_stays_a_cue():
    m = toxicity.Matcher(toxicity.Model({"zonk": 4.0, "you": 2.5, "kill": 2.5}))
    plain = toxicity.Matcher(toxicity.Model({"zonk": 4.0}))
    score = lambda x, t: sum(x.clauses(t)[0])
    assert math.isclose(score(m, "you zonk"), 2.5 + score(plain, "you zonk")) and score(plain, "you zonk") == 4.0 * 1.3
    assert math.isclose(score(m, "i will kill"), 2.5 + score(plain, "i will kill"))
    learned = toxicity.Matcher(toxicity.Model(threats={"zap": 3.0}))
    assert score(learned, "i will zap it") > score(plain, "i will hurt it") > score(plain, "i will zap it") == 0


def test_threats_are_learned_after_will(spark):
    rows = [(i, ("we will surely zap " if i % 4 == 0 else "we saw it zap ") + " ".join(f"w{R.randrange(50)}" for _ in range(20)), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    assert "zap" in model.threats and "zap" not in model.words


def test_odd_tables(spark):
    model = toxicity.Model({"zonk": 4.0})
    rows = [(1, "you zonk", 0.1), (1, "fine", 0.1), (None, "you zonk", 0.1), (2, None, 0.1), (3, "", 0.1), (4, "fine " * 20_000 + "you zonk", 0.1), (5, "x" * 1_000_000, 0.1), (1, "you zonk", 0.1)]
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string, score double"), model).collect()]
    assert len(got) == 8 and len({s for i, s in got if i in (2, 3, 5)}) == 1
    assert sorted(s for i, s in got if i == 1)[1:] == [s for i, s in got if i is None] * 2
    assert toxicity.score(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_held_out_figures_of_the_table(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels, common.remainder("doc_id", 4) == 2).join(labels, "doc_id").filter("held_out and toxic is not null").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in got)
    assert caught >= 0.9 * sum(r["predicted"] for r in got) and caught >= 0.6 * sum(r["toxic"] for r in got) > 5


def test_calibration_is_that_of_the_plain_newton_steps(spark):
    """Sums of equal rows, made in Spark, against all rows in one array."""
    rows = [(R.randrange(2), float(a := R.randrange(3)), a * 0.5 + R.randrange(2), R.random() if a else 0.0) for _ in range(400)]
    x, y, w = np.array([(1.0, *r[1:]) for r in rows]), np.array([r[0] for r in rows], float), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * w)
    found = spark.createDataFrame(rows, "label int, a double, b double, c double").groupBy("label", "a", "b", "c").count().withColumnRenamed("count", "n")
    assert np.abs(toxicity._calibrated(found) - w).max() < 1e-6
