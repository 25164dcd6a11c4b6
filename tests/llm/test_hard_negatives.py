"""Hard negatives against brute force: the curve, bounds, ties, hot vectors, odd rows."""

import math
import random

import numpy as np

from tidemark.llm import hard_negatives as hn

R = random.Random(11)


def brute(rows, every=100, n_pos=5, n_neg=10):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) > hn.LARGEST for x in v):
            continue
        ok.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    one = {}
    for i, label, q in sorted(ok):
        one.setdefault(i, (label, q))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, q) in one.items():
        if a % every:
            continue
        scored = sorted((-score(q, w), i, m) for i, (m, w) in one.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            inside = [(n, -t) for t, n, m in scored if m != label and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **how):
    d = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, pack string, block int").repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(d, **how).collect())


def vector(n=8, centre=0.0):
    return [R.gauss(centre, 0.2) for _ in range(n)]


def test_curve_goes_from_cell_to_cell():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        walk = cells[sorted(range(len(cells)), key=hn.curve(cells, bits).__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    a, rows = (np.random.default_rng(1).integers(-300, 300, (20, 6)) for _ in range(2))
    low, high = hn.bounds(a, rows.min(0)[None], rows.max(0)[None])
    assert (low <= hn.product(a, rows)).all() and (hn.product(a, rows) <= high).all()
    big = np.array([[2**28 - 1, 5]])
    assert hn.product(big, big).tolist() == [[(2**28 - 1) ** 2 + 25]]


def test_against_brute_force(spark, monkeypatch):
    for name, n in (("BLOCK", 16), ("RUN", 3), ("PACK", 2)):
        monkeypatch.setattr(hn, name, n)
    centres = [vector() for _ in range(5)]
    rows = [(i, [x + c for x, c in zip(vector(), R.choice(centres), strict=True)], R.randrange(4)) for i in range(700)]
    hot = vector()
    rows += [(1000 + i, hot, 1 + i % 2) for i in range(250)]
    assert mined(spark, rows) == brute(rows) and len({r[0] for r in brute(rows)}) == 10
    assert mined(spark, rows, every=50, n_positives=2, n_negatives=3) == brute(rows, 50, 2, 3)


def test_odd_rows(spark):
    rows = [(0, vector(), 1), (100, vector(), 1), (200, [0.0] * 8, 2), (300, [], 2), (400, vector(3), 3), (500, None, 1), (600, vector(), None), (700, [1.0, None], 1), (800, [float("nan")], 1), (900, [float("inf")], 1), (None, vector(), 1)]
    rows += [(1000, [1e30, 1.0], 1), (1100, [1000.0] * 3, 1), (1101, [1000.0, 999.0], 1), (1102, [600.0] * 3, 2), (0, vector(), 1), (100, vector(), 5)]
    rows += [(i, vector(), R.randrange(3)) for i in range(1, 60)] + [(-100, vector(), 2), (-7, vector(), -1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(100, [0.5], 1)]) == [] and mined(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]) == brute([(100, [], 1), (101, [], 1), (102, [], 2)]) == [(100, 101, 1, 102, 0, 0)]
    assert hn.hard_negatives(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
