"""The language model against a plain version of interpolated modified Kneser-Ney, at all levels of frequency."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm, packed

R = random.Random(7)
START = "<s>"


class Plain:
    """Trigrams counted and smoothed in plain Python."""

    def __init__(self, texts):
        sents = [self.tokens(t) for t in texts]
        self.uni = Counter(w for s in sents for w in s)
        padded = [[START, *s] for s in sents]
        self.tri = Counter((a, b, c) for s in padded for a, b, c in zip(s, s[1:], s[2:], strict=False))
        self.bi = Counter((b, c) for _, b, c in self.tri) + Counter((s[0], s[1]) for s in padded)
        self.before = Counter(c for _, c in self.bi)
        times = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d = {1: lm.discounts(times(self.before)), 2: lm.discounts(times(self.bi)), 3: lm.discounts(times(self.tri))}
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.follow = {}
        for g, n in [*self.bi.items(), *self.tri.items()]:
            self.follow.setdefault(g[:-1], {})[g[-1]] = n

    @staticmethod
    def tokens(t):
        return [*(t or "").lower().split(), None]

    def p(self, context, w):
        if not context:
            total = sum(self.before.values())
            left = sum(self.d[1][min(n, 3)] for n in self.before.values()) / total if total else 1.0
            own = max(self.before[w] - self.d[1][min(self.before[w], 3)], 0) / total if w in self.before else 0.0
            return own + left / (self.v + 1)
        found = self.follow.get(context)
        lower = self.p(context[1:], w)
        if not found:
            return lower
        d, n, total = self.d[len(context) + 1], found.get(w, 0), sum(found.values())
        return max(n - d[min(n, 3)], 0) / total + sum(d[min(x, 3)] for x in found.values()) / total * lower

    def score(self, t):
        s = [START, *self.tokens(t)]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))

    def base(self, t):
        return sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in self.tokens(t))


def sentence(n):
    return " ".join(R.choice(["a"] * 12 + ["b"] * 6 + "c d E f g h i".split() + [f"r{R.randrange(300)}"]) for _ in range(n))


@pytest.mark.parametrize("shards", ["2", "64"])
def test_equals_the_plain_version(spark, shards):
    rows = [(i, sentence(R.randint(0, 12))) for i in range(150)] + [(99, None), (None, "a b"), (3, "a b c"), (3, "a b c")]
    odd = [(200, "a zz b b"), (201, ""), (202, "zz yy"), (203, "c " * 20_000), (3, "a b"), (None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        model = lm.fit(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double").repartition(3))
        asked = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate([*rows, *odd])], "doc_id bigint, text string, n_tokens int").repartition(2)
        got = lm.score(asked, model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = Plain([t for _, t in rows])
    levels = set(model.often_level.tolist())
    assert levels == {1, 2} and model.tokens == plain.n and model.words == plain.v
    assert shards == "2" or (model.often_level == 2).sum() > 2
    for context in [(), ("a",), (START,), ("a", "b"), (START, "a"), ("zz", "a")]:
        assert abs(sum(plain.p(context, w) for w in [*plain.uni, "unknown"]) - 1) < 1e-9
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    want = sorted([(i, len(plain.tokens(t)), plain.score(t), plain.base(t), sum(w in plain.uni for w in plain.tokens(t))) for i, t in [*rows, *odd]], key=key)
    have = sorted([(r["doc_id"], r["n_tokens"], r["score"], r["base_score"], r["n_known"]) for r in got], key=key)
    assert len(want) == len(have)
    for w, h in zip(want, have, strict=True):
        assert w[0] == h[0] and w[1] == h[1] and w[4] == h[4]
        assert math.isclose(w[2], h[2], rel_tol=1e-9) and math.isclose(w[3], h[3], rel_tol=1e-9)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(empty, lm.fit(empty)).count() == 0
    (row,) = lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), lm.fit(empty)).collect()
    assert row["n_tokens"] == 3 and row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] == 0.0


def test_tables_find_what_they_hold(tmp_path):
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 5000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        packed.write_table(f"{tmp_path}/{n}/t", keys, n=np.arange(len(keys)) + (1 << 33 if n == 40 else 0))
        read = lambda name, kind, n=n: np.fromfile(f"{tmp_path}/{n}/t.{name}", kind)
        absent = np.setdiff1d(rng.integers(0, 1 << 64, 2000, dtype=np.uint64), keys)
        at, key = read("at", "<u4"), read("key", "<u4")
        assert (packed.places(at, key, keys) == np.arange(len(keys))).all() and (packed.places(at, key, absent) == -1).all()
        assert len(read("n", "u1")) == len(keys) * (8 if n == 40 else 4)


def test_packed_columns_come_back():
    rng = np.random.default_rng(4)
    shard = rng.integers(0, 5, 300)
    a, b = rng.integers(0, 1 << 60, 300).astype("<u8"), rng.integers(0, 9, 300).astype("<u4")
    for _, k, blob in packed.dealt("x", shard, a, b):
        x, y = packed.unpack([blob, blob], "<u8", "<u4")
        assert (x == np.tile(a[shard == k], 2)).all() and (y == np.tile(b[shard == k], 2)).all()
    assert [len(x) for x in packed.unpack([], "<u8", "<u4")] == [0, 0]


def test_a_model_of_the_corpus_knows_repeated_texts(spark):
    """Of documents held out, those that are in the training part too have clearly lower perplexity."""
    train = [(i, " ".join(f"w{R.randrange(200)}" for _ in range(60))) for i in range(300)]
    model = lm.fit(spark.createDataFrame(train, "doc_id bigint, text string"))
    new = [(1000 + i, " ".join(f"w{R.randrange(200)}" for _ in range(60))) for i in range(50)]
    got = {r["doc_id"]: r["perplexity"] for r in lm.score(spark.createDataFrame([*train[:50], *new], "doc_id bigint, text string"), model).collect()}
    assert max(got[i] for i in range(50)) < 0.2 * min(got[1000 + i] for i in range(50))


def test_word_numbers_beyond_32_bits():
    """Pairs of large numbers have different hashes, and numbers come whole through packed rows."""
    from tidemark.llm import packed

    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 45, 200_000, dtype=np.uint64)
    x = np.concatenate([x, x + (np.uint64(1) << np.uint64(32)), x & np.uint64(255)])
    y = np.concatenate([x[1:], x[:1]]) ^ (x >> np.uint64(32))
    both = np.unique(np.stack([x, y]), axis=1)
    assert len(np.unique(lm.pair(both[0], both[1]))) == both.shape[1] and lm.pair(x[:1], y[:1]) != lm.pair(y[:1], x[:1])
    assert (packed.unpack([packed.pack(x, y)], "<u8", "<u8")[1] == y).all()
