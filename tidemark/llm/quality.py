"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of the lines beside it. The weights are learned from
document labels: all lines start with their document's label, then good lines inside bad documents are relabelled by
the model and it is fitted again. Length-weighted forward-backward marginals are the document's quality.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import _logistic

_LINES = re.compile(r"[\n\r\x0b\x0c]+")
#: Characters that stand three times in a row or more.
_RUNS = re.compile(r"(.)\1{2,}")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _MARKS, _COMMON = b"0123456789", bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,'\"-"), b".,'\"-"
OWN = 12
#: Own features, the mean of both neighbours', and first and last line.
WIDTH = 2 * OWN + 2


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line that has words, and the lines' lengths."""
    lines = [x for x in _LINES.split(text or "") if x.strip()]
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    times, rows, sizes = Counter(lines), np.empty((len(lines), OWN)), np.empty(len(lines))
    for i, line in enumerate(lines):
        raw, words = line.encode(), line.split()
        n, k = len(raw), len(words)
        count = lambda chars, raw=raw, n=n: n - len(raw.translate(None, chars))
        upper, lower, marks = count(_UPPER), count(_LOWER), count(_MARKS)
        rows[i] = (
            upper / (upper + lower + 1),
            min(marks / k, 4) / 4,
            min(count(_DIGITS) / n * 4, 1),
            min(count(_COMMON) / k, 2) / 2,
            1 - len(set(words)) / k,
            (n > 2 and raw[-1] in b".!?"),
            raw[:1].isupper() or raw[0] > 127,
            min((n - k) / k, 20) / 10,
            min(k, 40) / 40,
            times[line] > 1,
            min(sum(len(m.group().encode()) for m in _RUNS.finditer(line)) / n * 2, 1),
            1.0,
        )
        sizes[i] = n
    near = np.zeros_like(rows)
    near[1:] += rows[:-1] / 2
    near[:-1] += rows[1:] / 2
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([rows, near, ends]), sizes


@dataclass
class Model:
    """Weights of the state bad against good, the transition scores, and the calibration of documents."""

    weights: np.ndarray
    move: np.ndarray
    scale: np.ndarray


def marginals(unary: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(bad) of each line of one document, by forward-backward over two states."""
    n = len(unary)
    (m00, m01), (m10, m11) = np.exp(move).tolist()
    e = np.exp(np.clip(unary, -30, 30)).tolist()
    f0, f1, ahead = 0.5, 0.5, []
    for i, x in enumerate(e):
        if i:
            a, b = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
        else:
            a, b = 1.0, 1.0
        b *= x
        s = a + b
        f0, f1 = a / s, b / s
        ahead.append((f0, f1))
    out, b0, b1 = [0.0] * n, 1.0, 1.0
    for i in range(n - 1, -1, -1):
        f0, f1 = ahead[i]
        p0, p1 = f0 * b0, f1 * b1
        out[i] = p1 / (p0 + p1)
        x = e[i] * b1
        b0, b1 = m00 * b0 + m01 * x, m10 * b0 + m11 * x
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    return np.array(out)


class Chains:
    """Labelled chains of lines, and the gradient of their negative log likelihood; all chains advance line by line together."""

    def __init__(self, xs: list[np.ndarray], ys: list[np.ndarray]):
        xs, ys = zip(*sorted(zip(xs, ys, strict=True), key=lambda p: -len(p[0])), strict=True)
        sizes = np.array([len(x) for x in xs])
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.flat, y = np.concatenate(xs), np.concatenate(ys)
        self.alive = [int((sizes > t).sum()) for t in range(sizes[0])]
        self.observed, self.pairs = self.flat.T @ y, np.zeros((2, 2))
        for yy in ys:
            np.add.at(self.pairs, (yy[:-1].astype(int), yy[1:].astype(int)), 1)

    def gradient(self, w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the weights and by the transition scores, for a line."""
        flat, start, alive, n = self.flat, self.start, self.alive, len(self.flat)
        e = np.exp(np.clip(flat @ w, -30, 30))
        t_move, fwd, bwd = np.exp(move), np.empty((n, 2)), np.empty((n, 2))
        for t, k in enumerate(alive):
            at = start[:k] + t
            a = np.ones((k, 2)) if t == 0 else fwd[at - 1] @ t_move
            a[:, 1] *= e[at]
            fwd[at] = a / a.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(alive) - 1, -1, -1):
            k, more = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
            at = start[:k] + t
            b = np.ones((k, 2))
            if more:
                nxt = at[:more] + 1
                right = bwd[nxt] * np.column_stack([np.ones(more), e[nxt]])
                b[:more] = right @ t_move.T
                joint = fwd[at[:more]][:, :, None] * t_move * right[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            bwd[at] = b / b.sum(1, keepdims=True)
        post = fwd * bwd
        p = post[:, 1] / post.sum(1)
        return (flat.T @ p - self.observed) / n, (expected - self.pairs) / n


def _fit_chain(xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood by Adam."""
    chains = Chains(xs, ys)
    w, move = np.zeros(chains.flat.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        by_w, by_move = chains.gradient(w, move)
        g = np.concatenate([by_w + ridge * w, (by_move + ridge * move).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, move = w - d[:-4], move - d[-4:].reshape(2, 2)
    return w, move


def _document(bad: np.ndarray, sizes: np.ndarray) -> tuple[float, float, float]:
    """Length-weighted share of bad, highest, and log length."""
    if not len(bad):
        return 1.0, 1.0, 0.0
    return float(bad @ sizes / sizes.sum()), float(bad.max()), float(np.log1p(sizes.sum()) / 10)


def fit(texts: DataFrame, most_lines: int = 400_000, chain: int = 400) -> Model:
    """Learn from (doc_id, text, label), on the driver, from whole documents of about ``most_lines`` lines together.

    Where the rows have more lines, a sample of rows by a hash of their text is taken, of long documents as of short
    ones. A document of more than ``chain`` lines is learned as several chains; all of its lines count. Without both
    labels a document's score is its share of good lines under zero weights.
    """
    common.ship_code(texts.sparkSession)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), r"[\n\r\x0b\x0c]+"))
    n = texts.agg(F.sum(lines)).first()[0] or 0
    if n > most_lines:
        texts = texts.filter(F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(1_000_000)) < int(1e6 * most_lines / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, xs, ns = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, n = line_features(text)
                if len(x):
                    ys.append(y)
                    xs.append(x.astype("<f4").tobytes())
                    ns.append(n.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, pa.binary()), pa.array(ns, pa.binary())], ["label", "x", "n"])

    rows = texts.select("text", "label").mapInArrow(run, "label int, x binary, n binary").toPandas()
    if rows["label"].nunique() < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.array([2.0, -4.0, 0.0, 0.0]))
    xs = [np.frombuffer(x, "<f4").reshape(-1, WIDTH).astype(float) for x in rows["x"]]
    ns = [np.frombuffer(x, "<f4").astype(float) for x in rows["n"]]
    label = rows["label"].to_numpy()
    ys = [np.full(len(x), 1.0 - y) for x, y in zip(xs, label, strict=True)]
    cut = lambda parts: [x[i : i + chain] for x in parts for i in range(0, len(x), chain)]
    for again in (False, True):
        if again:
            for i in np.flatnonzero(label == 0):
                p = marginals(xs[i] @ w, move)  # noqa: F821
                ys[i] = ((p >= min(0.4, p.max())) | (p == p.max())).astype(float)
        w, move = _fit_chain(cut(xs), cut(ys))
    docs = np.array([_document(marginals(x @ w, move), n) for x, n in zip(xs, ns, strict=True)])
    return Model(w, move, _logistic(docs, label.astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Quality of each whole text.

    In: doc_id, text. Out, a row for each input row: doc_id, score (0 to 1, higher is better), predicted, bad_share
    (length-weighted P(bad) of the lines). A text without words counts as all bad. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                x, n = line_features(text)
                got.append(_document(marginals(x @ m.weights, m.move), n))
            d = np.array(got, float).reshape(-1, 3)
            z = m.scale[0] + d @ m.scale[1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(d[:, 0])], ["doc_id", "score", "bad_share"])

    out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, score double, bad_share double")
    return out.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "bad_share")


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, *, most_labelled: int = 6_000, most_lines: int = 400_000) -> DataFrame:
    """Learn from labelled rows that are not held out, then score all: doc_id, held_out, score, predicted, bad_share.

    In: docs (doc_id, text), labels (doc_id, quality); other columns are ignored. What is learned from is bounded by
    ``most_labelled`` rows and by ``most_lines`` lines, about; labels without a doc_id or quality are left out, of several
    for one doc_id the highest counts. A null text, and one without words, counts as all bad. Each row of docs is a row
    of the result, also of several with one doc_id; equal texts have equal scores. An empty table gives no rows.
    """
    model = fit(common.labelled(docs, labels, "quality", held_out, most_labelled), most_lines)
    out = score(docs, model)
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted", "bad_share")
