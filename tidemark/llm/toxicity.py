"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult and threat words, targets, negations, reported speech; a word can be an insult and a cue at
once. Five small transducers each follow one pattern through a clause; their product is one machine that puts a weight on
each matched insult or threat, lower when negated or reported, higher when aimed at someone. Clauses, not single words,
are scored; a comma or colon doesn't end a clause, as negation and direct speech go on after it. Insult words (and word
beginnings) and threat words with their weights are learned from labelled texts, from a short list on; the grammar is
fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Cue words of the grammar, in four languages.
CUES = {
    "target": "you your yours u he she they them him her this that these those du dich dir ihr euch sie er tu te toi vous il elle ils tú te usted ustedes él ella ellos",
    "negation": "not never no isn't aren't don't doesn't nicht kein keine nie pas jamais aucun non nunca jamás ningún",
    "reported": "said says wrote quoted claimed claims called reported sagte schrieb nannte behauptet dit écrit appelé dijo escribió llamó",
    "threat": "kill hurt destroy beat shoot stab töten umbringen schlagen tuer frapper matar golpear",
    "will": "will gonna shall i'll we'll going werde werden vais allons voy vamos",
}
#: Insults that are known before anything is learned, in four languages, and their weight.
INSULTS = """idiot moron stupid dumb fool loser scum trash jerk pathetic worthless disgusting imbecile clown idioten dumm dummkopf
trottel abschaum versager widerlich erbärmlich crétin stupide imbécile ordure minable dégoûtant abruti estúpido tonto basura
imbécil asqueroso patético inútil"""
PRIOR = 3.0
#: What a word can be: nothing, an insult, a cue, or a cue and an insult.
COMBOS = [frozenset(c) for c in ((), ("insult",), *((c,) for c in CUES), *((c, "insult") for c in CUES))]
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass(frozen=True)
class Transducer:
    """A word of class ``on`` at most ``reach`` words after a ``cue`` has its weight multiplied by ``factor``.

    The state is the number of words that the cue still reaches.
    """

    cue: str
    reach: int
    on: str
    factor: float

    def step(self, state: int, kinds: frozenset[str]) -> tuple[int, float]:
        """The next state, and the factor on a matched word. A word that is matched may be the next cue itself."""
        factor = self.factor if state and self.on in kinds else 1.0
        return (self.reach if self.cue in kinds else max(state - 1, 0)), factor


#: The grammar: aimed insults weigh more, negated and reported ones less; a threat counts after "will".
GRAMMAR = [
    Transducer("target", 3, "insult", 1.3),
    Transducer("negation", 3, "insult", 0.6),
    Transducer("reported", 4, "insult", 0.7),
    Transducer("negation", 3, "threat", 0.3),
    Transducer("will", 3, "threat", 20.0),
]
ACCEPT = {"insult": 1.0, "threat": 0.05}


def compose(parts: list[Transducer], accept: dict[str, float]) -> list[list[tuple[int, float, float]]]:
    """The product machine: by state and combination of classes the next state and the output weights as insult and threat."""
    start = (0,) * len(parts)
    number, todo, table = {start: 0}, [start], []
    for state in todo:  # grows as states are found
        row = []
        for kinds in COMBOS:
            steps = [p.step(s, kinds) for p, s in zip(parts, state, strict=True)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            out = [accept[k] * math.prod(f for (_, f), p in zip(steps, parts, strict=True) if p.on == k) if k in kinds else 0.0 for k in ("insult", "threat")]
            row.append((number[nxt], *out))
        table.append(row)
    return table


@dataclass
class Model:
    """Weights of insult words, word beginnings (of ``sizes`` letters) and threat words, and the calibration of scores."""

    words: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    scale: tuple[float, ...] = (-2.0, 1.0, 0.0, 0.0)


class Matcher:
    """Follows the machine through the clauses of a text."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.table, self.most = model, compose(GRAMMAR, ACCEPT), most
        self.cues = {w: k for k, ws in CUES.items() for w in ws.split()}
        self.known: dict[str, tuple[int, float, float] | None] = {}

    def classify(self, word: str) -> tuple[int, float, float] | None:
        """The combination of classes, weight as an insult and weight as a threat; None for words outside the grammar."""
        m, insult = self.model, 0.0
        if (w := m.words.get(word)) is not None:
            insult = w
        else:
            for k in reversed(m.sizes):
                if len(word) > k and (w := m.starts.get(word[:k])) is not None:
                    insult = w
                    break
        cue = "threat" if word in m.threats else self.cues.get(word)
        kinds = frozenset(([cue] if cue else []) + ["insult"] * (insult > 0))
        return (COMBOS.index(kinds), insult, m.threats.get(word, 1.0)) if kinds else None

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Weights of the clauses that match, and the number of words."""
        known, table, out, n = self.known, self.table, [], 0
        if len(known) > self.most:
            known.clear()
        hot_from = frozenset(i for i, kinds in enumerate(COMBOS) if kinds & {"insult", "threat"})
        for clause in _CLAUSE.split(text.lower()):
            words, kinds, hot = _WORD.findall(clause), [], False
            n += len(words)
            for w in words:
                if w in known:
                    k = known[w]
                else:
                    k = known[w] = self.classify(w)
                kinds.append(k)
                if k is not None and k[0] in hot_from:
                    hot = True
            if hot:
                state, total = 0, 0.0
                for k in kinds:
                    if k is None:
                        state = table[state][0][0]
                    else:
                        state, insult, threat = table[state][k[0]]
                        total += insult * k[1] + threat * k[2]
                if total:
                    out.append(total)
        return out, n

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of the highest clause, log of the sum, and the sum for a hundred words."""
        found, n = self.clauses(text or "")
        if not found:
            return 0.0, 0.0, 0.0
        return math.log1p(max(found)), math.log1p(sum(found)), math.log1p(100 * sum(found) / n)


def _weights(texts: DataFrame, sizes: tuple[int, ...]) -> dict[str, dict[str, float]]:
    """Words, word beginnings and words after "will" that mark label 1 beyond chance, counted by document in Spark.

    Listed insults get a weight between their prior and what the documents that have them say.
    """
    texts = texts.select("label", F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}']+").alias("ws"))
    words = texts.select("label", F.explode(F.array_distinct("ws")).alias("w")).filter("w != ''")
    heads = [F.transform(F.filter(F.array_distinct("ws"), lambda w: F.char_length(w) > k), lambda w: F.substring(w, 1, k)) for k in sizes]  # noqa: B023
    starts = texts.select("label", F.explode(F.array_distinct(F.flatten(F.array(*heads)))).alias("w"))
    will, reach = F.array(*map(F.lit, CUES["will"].split())), next(p.reach for p in GRAMMAR if p.cue == "will")
    after = F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.size("ws")), lambda i: F.array_contains(will, F.get("ws", i - 1))), lambda i: F.slice("ws", i + 1, reach)))
    threats = texts.select("label", F.explode(F.array_distinct(after)).alias("w")).filter("w != ''")
    seen = words.select("label", "w", F.lit("words").alias("kind")).union(starts.select("label", "w", F.lit("starts"))).union(threats.select("label", "w", F.lit("threats")))
    counts = common.stored(seen.groupBy("kind", "w").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")), "counts")
    total = texts.agg(F.sum("label").alias("pos"), F.count("*").alias("n")).first()
    n, pos = total["n"] or 0, total["pos"] or 0
    out: dict[str, dict[str, float]] = {"words": dict.fromkeys(INSULTS.split(), PRIOR), "starts": {}, "threats": {}}
    if not pos or pos == n:
        return out
    base, features = pos / n, max(counts.count(), 2)
    a, b = F.col("pos"), F.col("neg")
    weight = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (n - pos + 1))
    x_log_x = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    gain = x_log_x(a, base) + x_log_x(b, 1 - base)
    listed = (F.col("kind") == "words") & F.col("w").isin(INSULTS.split())
    # The more features are tried, the more evidence each needs: at most a few hundredths of one is expected by chance.
    sure = (gain > math.log(features) + 3) & (F.col("weight") > 2)
    for r in counts.withColumn("weight", weight).filter(listed | sure).select("kind", "w", "weight", (a + b).alias("n")).collect():
        prior = out["words"].get(r["w"]) if r["kind"] == "words" else None
        known = r["weight"] if prior is None else (r["n"] * r["weight"] + 3 * prior) / (r["n"] + 3)
        out[r["kind"]][r["w"]] = max(known, 0.0)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights with the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrated(rows: DataFrame, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of (1, a, b, c) for the label, by Newton steps. ``rows`` stand for n texts each; each step's sums are made in Spark."""
    x = [F.lit(1.0), F.col("a"), F.col("b"), F.col("c")]
    upper = np.triu_indices(len(x))
    w = np.zeros(len(x))
    for _ in range(rounds):
        z = sum((float(v) * f for v, f in zip(w, x, strict=True)), F.lit(0.0))
        r = rows.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
        slope = [F.sum(F.col("n") * f * (F.col("label") - F.col("p"))) for f in x]
        bend = [F.sum(F.col("n") * x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i, j in zip(*upper, strict=True)]
        sums = np.array(r.agg(*slope, *bend).first(), float)
        h = np.zeros((len(x), len(x)))
        h[upper] = sums[len(x) :]
        h = h + np.triu(h, 1).T + ridge * np.eye(len(x))
        step = np.linalg.solve(h, sums[: len(x)] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)  # sums differ in the last digits with the order of tasks


def _measure(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the features a, b, c of each text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value)
        for batch in batches:
            got = np.array([match.features(t) for t in batch.column(len(keep)).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(got[:, i]) for i in range(3))], [*keep, "a", "b", "c"])

    kinds = dict(texts.dtypes)
    return texts.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "a double", "b double", "c double"]))


def fit(texts: DataFrame) -> Model:
    """Learn from all rows of (doc_id, text, label).

    Without both labels the score is the share of label 1, or 0.1.
    """
    common.ship_code(texts.sparkSession)
    texts = common.stored(texts, "labelled")
    model = Model()
    found = _weights(texts, model.sizes)
    model.words, model.starts, model.threats = found["words"], found["starts"], found["threats"]
    rows = _measure(texts, model, ["label"]).groupBy("label", "a", "b", "c").agg(F.count("*").alias("n"))
    rows = common.stored(rows, "features")
    if rows.select("label").distinct().count() < 2:
        model.scale = (-2.2, 1.0, 0.0, 0.0)
        return model
    model.scale = tuple(_calibrated(rows))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Toxicity of each whole text.

    In: doc_id, text. Out, a row for each input row: doc_id, score (0 to 1), predicted (1 from ``threshold`` on). Null
    and empty texts have the score of a text in which nothing matches. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    rows = _measure(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), model, ["doc_id"])
    w0, wa, wb, wc = map(float, model.scale)
    p = 1 / (1 + F.exp(-(w0 + wa * F.col("a") + wb * F.col("b") + wc * F.col("c"))))
    return rows.select("doc_id", p.alias("score"), F.when(p >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, *, most_labelled: int | None = None, threshold: float = 0.3) -> DataFrame:
    """Learn from labelled rows that are not held out, then score all: doc_id, held_out, score, predicted.

    In: docs (doc_id, text), labels (doc_id, toxic); other columns are ignored. All of them are
    learned from, or about ``most_labelled`` where that is given; labels without a doc_id or value are left out, of several
    for one doc_id the highest counts.
    Null and empty texts have the score of a text in which nothing matches. Each row of docs is a row of the result, also
    of several with one doc_id; equal texts have equal scores. An empty table gives no rows.
    """
    model = fit(common.labelled(docs, labels, "toxic", held_out, most_labelled))
    out = score(docs, model, threshold)
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")
