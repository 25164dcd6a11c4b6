"""Language identification by words first, backing off to character n-grams.

A known word is scored by its log frequency in each language. An unseen word falls back to the longest character
n-grams that are known, then to shorter ones. A text's score adds up its words' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Log posteriors of the languages, for words and for n-grams of each length; rows of ``scores``."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by length, longest first
    scores: np.ndarray


def _gram(k: int) -> Callable[[Column], Column]:
    """The ``k`` letters from a place on; of one argument, as Spark gives a second one the index of the place."""
    return lambda i: F.substring("w", i, F.lit(k))


def _counts(docs: DataFrame, longest: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """All words seen twice and n-grams seen three times in a language, counted in Spark."""
    words = docs.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    words = common.stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    seen = words.filter("n > 1").select("lang", "word", "n")
    marked = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    grams = []
    for k in range(1, longest + 1):
        places = F.sequence(F.lit(1), F.char_length("w") - k + 1)
        part = marked.filter(F.char_length("w") >= k).select("lang", "n", F.explode(F.transform(places, _gram(k))).alias("gram"))
        grams.append(part.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("k", F.lit(k)))
    every = grams[0]
    for g in grams[1:]:
        every = every.union(g)
    every = every.filter("n > 2").select("lang", "k", "gram", "n")
    return seen.toArrow().to_pandas(), every.toArrow().to_pandas()  # bounded by the sample


def _posteriors(found: pd.DataFrame, key: str, langs: list[str], smooth: float) -> tuple[list[str], np.ndarray]:
    """Log P(language | key) for evenly likely languages."""
    at, names = pd.factorize(found[key], sort=True)
    table = np.zeros((len(names), len(langs)))
    np.add.at(table, (at, found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)), found["n"].to_numpy(float))
    logs = np.log((table + smooth) / (table.sum(0) + smooth * len(names)))
    logs -= np.logaddexp.reduce(logs, axis=1, keepdims=True)
    return list(names), logs


def fit(docs: DataFrame, *, most_docs: int = 20_000, longest: int = 5) -> Model:
    """Learn from about ``most_docs`` rows of (doc_id, text, lang) with a language, or all if there are fewer.

    The tables hold every word and n-gram of the sample that is seen often enough in a language, so what bounds the
    model that is sent to workers is ``most_docs``. Without training rows the model knows no language and every text is
    ``und``.
    """
    common.ship_code(docs.sparkSession)
    known = common.bounded(docs.filter("lang is not null and text is not null"), "doc_id", most_docs)
    words, grams = _counts(known.select("lang", "text"), longest)
    langs = sorted(set(words["lang"]) | set(grams["lang"]))
    names, scores = _posteriors(words, "word", langs, 0.5)
    tables, blocks, at = [], [np.zeros((1, len(langs))), scores], 1 + len(names)
    lookup = dict(zip(names, range(1, at), strict=True))
    for k in range(longest, 0, -1):
        g, s = _posteriors(grams[grams["k"] == k], "gram", langs, 0.5)
        tables.append(dict(zip(g, range(at, at + len(g)), strict=True)))
        blocks.append(s)
        at += len(g)
    return Model(langs, lookup, tables, np.concatenate(blocks).astype(np.float32))


class Scorer:
    """Scores batches of texts in a worker: each distinct raw word of a batch once, then sums over texts by array.

    The scores of raw words are remembered until there are ``most`` of them.
    """

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        self.lettered = np.zeros(1024, bool)

    def vector(self, word: str) -> tuple[np.ndarray, bool]:
        """Score of a raw word, of its runs of letters, known ones or by n-grams; and whether it has letters."""
        m, total = self.model, np.zeros(len(self.model.langs), np.float32)
        parts = _LETTERS.findall(word.lower())
        for part in parts:
            if (row := m.words.get(part)) is not None:
                total += m.scores[row]
                continue
            marked = f" {part} "
            for length, table in zip(range(len(m.grams), 0, -1), m.grams, strict=True):
                found = [r for i in range(len(marked) - length + 1) if (r := table.get(marked[i : i + length])) is not None]
                if found:
                    total += m.scores[found].mean(0)
                    break
        return total, bool(parts)

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for distinct raw words."""
        if len(self.rows) > self.most:
            self.rows.clear()
        need = len(self.rows) + len(words)
        if need > len(self.table):
            more = 2 * need - len(self.table)
            self.table = np.vstack([self.table, np.zeros((more, self.table.shape[1]), np.float32)])
            self.lettered = np.concatenate([self.lettered, np.zeros(more, bool)])
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            r = self.rows.get(w)
            if r is None:
                r = self.rows[w] = len(self.rows)
                self.table[r], self.lettered[r] = self.vector(w)
            out[i] = r
        return out

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text."""
        split = pc.utf8_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code = split.flatten().dictionary_encode()
        rows, at = self.rows_of(code.dictionary.to_pylist()), code.indices.to_numpy(zero_copy_only=False)
        has = sizes > 0
        start = (np.cumsum(sizes) - sizes)[has]
        letters = np.zeros(len(sizes), bool)
        total = np.zeros((len(sizes), len(self.model.langs)))
        if len(at):
            letters[has] = np.logical_or.reduceat(self.lettered[rows][at], start)
            for k in range(total.shape[1]):
                total[has, k] = np.add.reduceat(self.table[rows, k].astype(np.float64)[at], start)
        if not self.model.langs:
            return ["und"] * len(sizes), np.zeros(len(sizes))
        p = np.exp(total - total.max(1, keepdims=True))
        best = p.argmax(1)
        names = [self.model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, 1 / p.sum(1), 0.0)  # the best one's p is 1


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Language of each whole text.

    In: doc_id, text. Out, a row for each input row: doc_id, lang_pred, score (the probability of the language among
    those known, 0 to 1). A text that is null or has no letters is ``und`` with score 0. Of equal scores the first
    language by name wins. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            names, p = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, **bounds: int) -> DataFrame:
    """Learn from the rows that are not held out, then predict all: doc_id, held_out, lang_pred, score.

    In: doc_id, text, lang; other columns are ignored, and lang and doc_id are no inputs of a prediction. A null or
    letterless text is ``und`` with score 0 and teaches nothing, as does a row without a language. Each row is a row of
    the result, also of several with one doc_id or text; equal texts have equal results. An empty table gives no rows.
    """
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"), **bounds)
    out = predict(docs, model)
    return out.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
