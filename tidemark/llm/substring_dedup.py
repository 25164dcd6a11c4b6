"""Substring deduplication by level-wise doubling.

Level 1 looks at windows of 13 words, at places chosen by their hash so that any 50 consecutive words hold at least one
chosen place (the smallest hash among 38 consecutive windows). Windows that are repeated in another document are extended
to 25 words, those that are repeated again to 50, and nothing else is looked at again.

Each level is a pass over the texts. A task hands on its distinct windows with the smallest and the largest document that
has them, so a window that is in very many documents is one row of each task. Those in several documents are written as
sorted arrays to the shared folder, and the next pass looks its windows up there: places and texts don't move between
tasks. Windows of the full length are told apart by 128 bits of a cryptographic digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packed import ROW, Maps, by_small, dealt, places, rows_of, unpack, write_array, write_table

#: Windows that a task holds before it hands on packed ones.
PACK = 1_000_000
#: Bytes of text that are hashed side by side.
GROUP = 200_000
#: Bytes of text for a shard of windows.
SHARD = 12_000_000


def spans(h: np.ndarray, span: int) -> np.ndarray:
    """Of each ``span`` consecutive items, the place of the smallest (the rightmost of equal ones)."""

    def smaller(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        right = b[0] <= a[0]
        return np.where(right, b[0], a[0]), np.where(right, b[1], a[1])

    n, low, width = len(h), (h, np.arange(len(h))), 1
    while width * 2 <= span:
        low = smaller((low[0][:-width], low[1][:-width]), (low[0][width:], low[1][width:]))
        width *= 2
    if width < span:
        low = smaller((low[0][: n - span + 1], low[1][: n - span + 1]), (low[0][span - width :], low[1][span - width :]))
    return low[1]


def distinct(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct windows (a, b) in order, each with its smallest and largest document."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
    if not len(first):
        return a, b, low, high
    return a[first], b[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


@dataclass
class Levels:
    """The lengths of windows, and where the arrays of those that are repeated lie."""

    folder: str
    bits: int
    length: int
    maps: Maps = field(default_factory=Maps)

    @property
    def sizes(self) -> tuple[int, int, int]:
        half = (self.length + 1) // 2
        return (half + 1) // 2, half, self.length

    def part(self, name: str, kind: str) -> np.ndarray:
        return self.maps(f"{self.folder}/{name}", kind)

    def by_shard(self, a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Shards, and which of the hashes are theirs."""
        shard = (a & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        order = by_small(shard)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(shard)]]) if len(shard) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(shard[order[i]]), order[i:j]

    def repeated(self, level: int, a: np.ndarray) -> np.ndarray:
        """Whether windows of level 1 or 2 are in several documents."""
        out = np.zeros(len(a), bool)
        for k, mine in self.by_shard(a):
            keys = self.part(f"{level}/{k}.key", "<u4")
            if len(keys):
                out[mine] = places(self.part(f"{level}/{k}.at", "<u4"), keys, a[mine]) >= 0
        return out

    def lowest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest document of windows of the full length, the largest number where they aren't repeated."""
        out = np.full(len(a), np.iinfo(np.int64).max)
        for k, mine in self.by_shard(a):
            keys, other, low = (self.part(f"3/{k}.{name}", kind) for name, kind in (("a", "<u8"), ("b", "<u8"), ("low", "<i8")))
            if not len(keys):
                continue
            at = np.searchsorted(keys, a[mine])
            while len(mine):
                have = at < len(keys)
                have[have] = keys[at[have]] == a[mine[have]]
                mine, at = mine[have], at[have]
                same = other[at] == b[mine]
                out[mine[same]] = low[at[same]]
                mine, at = mine[~same], at[~same] + 1  # another window with the same first half
        return out


class Texts:
    """The windows of a batch of texts, level by level; each level looks at what the one before left.

    The first level is made of many texts side by side, in groups of ``GROUP`` bytes; later ones of those texts that are left.
    """

    def __init__(self, levels: Levels, ids: list[int | None], raws: list[bytes | None], hasher: common.WordHasher):
        self.levels, self.ids, self.raws = levels, ids, raws
        self.hashes: list[np.ndarray] = []
        self.starts: dict[int, np.ndarray] = {}
        self.keys: dict[int, np.ndarray] = {}
        parts, at = [], 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (end == at or size < GROUP):
                size += len(raws[end] or b"")
                end += 1
            parts.append(self._chosen(at, *hasher(raws[at:end])))
            at = end
        #: Of chosen windows: which text of the batch, the place in it, and the hash.
        self.text, self.place, self.first = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
        self.which: list[int] = []

    def _chosen(self, base: int, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, _, length = self.levels.sizes
        ends = np.cumsum(counts)
        self.hashes += np.split(h, ends[:-1])
        if len(h) < length:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        has = np.array([self.ids[base + i] is not None for i in range(len(counts))])
        inside = np.arange(len(h)) + length <= np.repeat(np.where(has, ends, 0), counts)  # where a window of the full length fits
        w = common.windows(h, first, 1)
        at = spans(w, length - first + 1)[inside[: len(h) - length + 1]]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        text = np.searchsorted(ends, at, "right")
        return text + base, at - (ends - counts)[text], w[at]

    def first_docs(self) -> np.ndarray:
        """The document of each chosen window."""
        return np.array([-1 if i is None else i for i in self.ids], np.int64)[self.text]

    def words(self, i: int) -> list[bytes]:
        return (self.raws[i] or b"").split()

    def joined(self, of: dict[int, np.ndarray]) -> np.ndarray:
        return np.concatenate([of[i] for i in self.which]) if self.which else np.empty(0, np.uint64)

    def docs(self) -> np.ndarray:
        """The document of each window."""
        return np.repeat(np.array([self.ids[i] for i in self.which], np.int64), [len(self.starts[i]) for i in self.which])

    def kept(self) -> None:
        """Leave out the windows of level 2 that aren't repeated, and the texts that have none left."""
        ok, at = self.levels.repeated(2, self.joined(self.keys)), 0
        for i in list(self.which):
            n = len(self.starts[i])
            self.starts[i] = self.starts[i][ok[at : at + n]]
            at += n
        self.which = [i for i in self.which if len(self.starts[i])]

    def second(self) -> None:
        """From chosen places that are repeated: all windows of half the length in any window of the full length around them."""
        first, half, length = self.levels.sizes
        ok = self.levels.repeated(1, self.first)
        text, place = self.text[ok], self.place[ok]
        cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
        self.which = text[cuts].tolist()
        for i, at in zip(self.which, np.split(place, cuts[1:]), strict=True) if self.which else ():
            n = len(self.hashes[i]) - half + 1
            edge = np.zeros(n + 1, np.int64)
            lo, hi = np.maximum(at - (length - first), 0), np.minimum(at + length - half, n - 1)
            good = lo <= hi
            np.add.at(edge, lo[good], 1)
            np.add.at(edge, hi[good] + 1, -1)
            self.starts[i] = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            self.keys[i] = common.windows(self.hashes[i], half, 1)[self.starts[i]]
        self.which = [i for i in self.which if len(self.starts[i])]

    def third(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the full length that begin and end with a repeated one: both halves of their digests."""
        self.kept()
        _, half, length = self.levels.sizes
        parts = []
        for i in self.which:
            at = self.starts[i]
            self.starts[i] = at = at[np.isin(at + length - half, at, assume_unique=True)]
            words = self.words(i) if len(at) else []
            parts += [hashlib.blake2b(b" ".join(words[s : s + length]), digest_size=16).digest() for s in at.tolist()]
        self.which = [i for i in self.which if len(self.starts[i])]
        got = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        return got[:, 0].copy(), got[:, 1].copy()


def counted(docs: DataFrame, levels: Levels, level: int) -> None:
    """One pass: the windows of a level that are in several documents go to the shared folder."""
    spark, bits, folder = docs.sparkSession, levels.bits, levels.folder
    shared = spark.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = common.WordHasher(), [], 0

        def out() -> pa.RecordBatch:
            a, b, low, high = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            order = np.lexsort((a, low))  # documents side by side pack better
            a, b, low, high = a[order], b[order], low[order], high[order]
            return rows_of(dealt("window", (a & np.uint64((1 << bits) - 1)).astype(np.int64), a, *([b] if level == 3 else []), low, (high - low)))

        for batch in batches:
            texts = Texts(shared.value, batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), hasher)
            if level > 1:
                texts.second()
            a, b = texts.third() if level == 3 else (texts.first if level == 1 else texts.joined(texts.keys), None)
            if len(a):
                doc = texts.first_docs() if level == 1 else texts.docs()
                parts.append((a, np.zeros(len(a), np.uint64) if b is None else b, doc, doc))
                held += len(a)
            if held > PACK:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        k, blobs = group.column("shard")[0].as_py(), group.column("blob").to_pylist()
        a, *b, low, more = unpack(blobs, "<u8", *(["<u8"] if level == 3 else []), "<i8", "<i8")
        a, b, low, high = distinct(a, b[0] if b else np.zeros(len(a), np.uint64), low, low + more)
        several = low != high
        if level < 3:
            write_table(f"{folder}/{level}/{k}", a[several])
        else:
            for name, column in (("b", b), ("low", low), ("a", a)):
                write_array(f"{folder}/3/{k}.{name}", column[several])
        return pa.table({"n": [int(several.sum())]})

    docs.mapInArrow(run, ROW).groupBy("shard").applyInArrow(merge, "n bigint").agg(F.sum("n")).collect()


def repeated_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove passages of ``length`` words or more that also start in a document with a smaller doc_id.

    In: doc_id, text; other columns are ignored. Out, a row for each input row: doc_id, n_words, n_removed, kept_sha256
    (kept words joined by one space) and kept_text, null where nothing was removed. Words are runs of other than ASCII white
    space; null text has none. A document without a doc_id keeps all its words and is no source for others; rows with one
    doc_id are no sources for each other. Windows are judged on the input. Repeats inside one document stay. The shared
    folder has to be mounted, as workers map arrays that lie there.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD)) - 1).bit_length())
    levels = Levels(common.posix(common.new_path(spark, "windows")), bits, length)
    for level in (1, 2, 3):
        counted(docs, levels, level)
    shared = spark.sparkContext.broadcast(levels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.WordHasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = Texts(shared.value, ids, common.as_bytes(batch.column(1)), hasher)
            texts.second()
            lower = shared.value.lowest(*texts.third()) < texts.docs()
            removed, kept, at = [0] * len(ids), [None] * len(ids), 0
            for i in texts.which:
                start = texts.starts[i][lower[at : at + len(texts.starts[i])]]
                at += len(texts.starts[i])
                if len(start):
                    words = texts.words(i)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    removed[i] = len(words) - int(keep.sum())
                    kept[i] = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
            sha = [hashlib.sha256(b" ".join(texts.words(i)) if k is None else k).hexdigest() for i, k in enumerate(kept)]
            columns = [pa.array([len(h) for h in texts.hashes], pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([k if k is None else k.decode() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.mapInArrow(clean, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
