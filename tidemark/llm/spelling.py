"""Spelling variants: a bit-sliced index of positions and letters finds all words at one error from each other.

The vocabulary is counted over all texts. Two words with one error between them share the first or the last half of the
shorter one, so each word is dealt to blocks by its halves, and blocks hold about ``BLOCK`` words however large the
vocabulary is. A half that more words share is cut into slices, and each slice is searched against each other.

Of a block's words, a bit set for each (position, letter) says which have that letter there. All words of the block are
searched side by side: from letter to letter, a set of words without an error so far and three of words with one error
(replaced at the same position, inserted or deleted with the position shifted by one) are carried on word-parallel.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs of letters, after A-Z have become a-z.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of a block, and of a slice of a half that many words share.
BLOCK = 1024
#: Distinct words that a task counts before it hands them on.
PACK = 300_000

PART = "word string, n_near bigint, near struct<less: bigint, word: string>"


def noised(raw: bytes, doc_id: object, least: int, every: int) -> Iterator[tuple[str, int]]:
    """Distinct words of a text with at least ``least`` letters, with counts; one in ``every`` has lost a letter by its hash."""
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter([x for x in RUN.findall(raw.lower().decode("utf-8", "replace")) if len(x) >= least]).items():
        h = zlib.crc32(run.encode(), begin)
        if h % every:
            yield run, n
        elif len(run) > least:
            at = h % len(run)
            yield run[:at] + run[at + 1 :], n


def vocabulary(docs: DataFrame, least: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                for word, n in noised(raw or b"", doc_id, least, every):
                    total[word] = total.get(word, 0) + n
            if len(total) > PACK:
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                total = {}
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the index ----------------------------------------------------------------------------------


def _bits(member: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(member, axis=-1, bitorder="little")
    wide = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [*[(0, 0)] * (member.ndim - 1), (0, wide)])).view("<u8")


class Index:
    """Bit sets of a block's words by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.n, self.length = len(words), np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.letters, self.codes = np.unique(points, return_inverse=True)
        self.start = np.cumsum(self.length) - self.length
        self.by_length = {int(m): _bits(self.length == m) for m in np.unique(self.length)}
        self.none = np.zeros((len(self.letters) + 1, -(-self.n // 64)), "<u8")

    def at(self, position: int) -> np.ndarray:
        """For each letter, and one that no word has, the words that have it at ``position``."""
        if position < 0:
            return self.none
        has = np.flatnonzero(self.length > position)
        if not len(has):
            return self.none
        member = np.zeros((len(self.letters) + 1, self.n), bool)
        member[self.codes[self.start[has] + position], has] = True
        return _bits(member)

    def of_length(self, lengths: np.ndarray) -> np.ndarray:
        return np.stack([self.by_length.get(int(m), self.none[0]) for m in lengths])

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (which of ``words``, which of the index) that differ by exactly one replaced, inserted or deleted letter."""
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")
        length = length[order]
        points = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), "<u4")
        codes = np.searchsorted(self.letters, points)
        codes[self.letters[np.minimum(codes, len(self.letters) - 1)] != points] = len(self.letters)
        start = np.cumsum(length) - length
        same = np.full((len(words), self.none.shape[1]), np.uint64(2**64 - 1))
        replaced, deleted, inserted = (np.zeros_like(same) for _ in range(3))
        before, here, after = self.none, self.at(0), self.at(1)
        for i in range(int(length.max(initial=0))):
            m = np.searchsorted(-length, -i, "left")  # words with a letter at i
            code = codes[start[:m] + i]
            inserted[:m] = (inserted[:m] | same[:m]) & after[code]
            deleted[:m] = (deleted[:m] & before[code]) | same[:m]
            replaced[:m] = (replaced[:m] & here[code]) | same[:m]
            same[:m] &= here[code]
            before, here, after = here, after, self.at(i + 2)
        near = replaced & ~same & self.of_length(length) | (inserted | same) & self.of_length(length + 1) | deleted & self.of_length(length - 1)
        query, found = np.nonzero(np.unpackbits(near.view("u1"), axis=1, count=self.n, bitorder="little"))
        return order[query], found


def best(block: pa.Table) -> pa.Table:
    """Of a block's words, how many are near by the block's halves, and the one of largest count.

    A pair is counted in the block of its first half if that is the same, else in that of its last half; so just once.
    """
    index, asked = (block.filter(pa.compute.bit_wise_and(block.column("role"), bit).cast(pa.bool_())) for bit in (1, 2))
    words, queries = index.column("word").to_pylist(), asked.column("word").to_pylist()
    if not words or not queries:
        return pa.table({"word": [], "n_near": [], "near": []}, _schema())
    q, w = Index(words).near(queries)
    cols = lambda t, name: t.column(name).to_numpy()
    shorter = np.minimum([len(queries[i]) for i in q], [len(words[i]) for i in w])
    ok = (cols(asked, "half")[q] == cols(index, "half")[w]) & (cols(asked, "shorter")[q] == shorter)
    q, w = q[ok], w[ok]
    last = cols(asked, "last")[q]
    again = np.array([late and queries[i][: k // 2] == words[j][: k // 2] for late, i, j, k in zip(last, q, w, shorter[ok], strict=True)], bool)
    q, w = q[~again], w[~again]
    n = cols(index, "n")[w]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[w], -n, q))
    q, w, n = q[order], w[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    near = pa.StructArray.from_arrays([pa.array(-n[first], pa.int64()), pa.array([words[i] for i in w[first]], pa.string())], ["less", "word"])
    return pa.table([pa.array([queries[i] for i in q[first]], pa.string()), pa.array(np.diff(np.append(first, len(q))), pa.int64()), near], _schema())


def _schema() -> pa.Schema:
    return pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.struct([("less", pa.int64()), ("word", pa.string())]))])


def blocks(words: DataFrame, least: int) -> DataFrame:
    """Words by block: (block, role, half, shorter, last, word, n). Role 1: in the index, 2: searched, 3: both.

    ``shorter`` is the length of the shorter word of a pair, so a word is in blocks for its own length and for one less.
    """
    size = F.char_length("word")
    halves = words.withColumn("shorter", F.explode(F.array_distinct(F.array(size, F.greatest(size - 1, F.lit(least)))))).withColumn("last", F.explode(F.array(F.lit(False), F.lit(True))))
    width = F.floor(F.col("shorter") / 2).cast("int")
    part = F.when(F.col("last"), F.col("word").substr(size - width + 1, width)).otherwise(F.col("word").substr(F.lit(1), width))
    halves = common.stored(halves.withColumn("half", F.xxhash64("last", "shorter", part)), "halves")
    n_blocks = max(1, halves.count() // BLOCK)
    hot = common.stored(halves.groupBy("half").count().filter(F.col("count") > BLOCK).select("half", F.ceil(F.col("count") / BLOCK).cast("int").alias("slices")), "hot")
    dealt = halves.join(common.small(hot, 100_000), "half", "left")
    plain = dealt.filter("slices is null").withColumns({"block": F.pmod("half", F.lit(n_blocks)), "role": F.lit(3)})
    # a slice of a common half is in the index of its tile with each other slice, and searched there the other way round
    sliced = dealt.filter("slices is not null").withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tile = lambda i, j: -1 - F.abs(F.xxhash64("half", F.col(i), F.col(j)) % F.lit(1 << 60))
    as_index = sliced.withColumns({"block": tile("own", "other"), "role": F.when(F.col("own") == F.col("other"), F.lit(3)).otherwise(F.lit(1))})
    as_query = sliced.filter("own != other").withColumns({"block": tile("other", "own"), "role": F.lit(2)})
    cols = ["block", "role", "half", "shorter", "last", "word", "n"]
    return plain.select(cols).unionByName(as_index.select(cols)).unionByName(as_query.select(cols))


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form): (word, root), the last word that forms lead to. A form is at least twice as frequent as its word, so chains are short; each round doubles the steps taken."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = common.stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if not joined.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, least: int = 7, min_count: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """Words of the texts and the more frequent spelling that each is a variant of.

    In: doc_id, text; other columns are ignored. Out, a row for each word: word, form, root, n, n_near, form_n.

    Runs of ASCII and Latin-1 letters are lower-cased in A-Z only; where ``every`` divides the unsigned crc32 h of
    ``<doc_id>:<run>``, the letter h % length goes. Words are the results of at least ``least`` letters that occur at least
    ``min_count`` times. Near words differ by exactly one inserted, deleted or replaced letter. ``form`` is the near word of
    largest n (ties: the first in code-point order) if its n is at least ``times`` (over 1) times the word's, else null, and
    so is form_n; ``root`` follows forms to the last. Null and empty texts have no words; a null doc_id is an empty one in the
    hashed text; repeated rows count each time. No words give no rows.
    """
    if times <= 1:
        raise ValueError("forms must be more frequent than their words")
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    words = common.stored(vocabulary(docs, least, min_count, every), "words")
    parts = blocks(words, least).groupBy("block").applyInArrow(best, PART)
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    near = words.join(found, "word", "left").withColumn("is_form", F.coalesce(-F.col("near.less") >= F.lit(times) * F.col("n"), F.lit(False)))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("is_form"), F.col("near.word")).alias("form"), F.when(F.col("is_form"), -F.col("near.less")).alias("form_n"))
    near = common.stored(near, "near")
    rooted = near.join(roots(near.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
