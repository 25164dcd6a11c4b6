"""Language-model scoring by interpolated modified Kneser-Ney trigrams.

Counts are made in Spark. A word's number is its rank among the words of its shard, times the number of shards, plus the
shard, so frequent words have small numbers. An n-gram is a 64-bit hash of its words' numbers. The arrays of sorted hashes
lie in the shared folder, a part for each shard, and workers map them into memory: no worker holds the model, and what is
read is what is looked up.

A trigram is counted in the shard of its middle word: all trigrams of a context (two words) and all those of an end (two
words) share it, so that both are added up where the trigrams are. Frequent middle words are dealt out by the first word too,
very frequent ones by all three words; what was dealt out is added up once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .packed import ROW, Maps, by_small, dealt, grouped, pack, places, rows_of, unpack, write_array, write_table

#: No word has a space in it.
END = b" end"
#: Tokens that a task counts before it hands on packed counts.
FLUSH = 2_000_000
#: Bytes of text for a shard.
SHARD = 12_000_000
#: Words in a part of the arrays by number, at least.
PART = 32_768
STATS = ["total", "n1", "n2", "n3"]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


def scramble(key: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64-bit keys."""
    x = (key ^ (key >> _32)) * _A
    x = (x ^ (x >> _32)) * _B
    return x ^ (x >> _32)


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two word numbers, of up to 64 bits each."""
    return scramble(scramble(x.astype(np.uint64)) ^ y.astype(np.uint64))


def triple(xy: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of a pair's hash and a word number."""
    return scramble(xy + (z.astype(np.uint64) + np.uint64(1)) * _A)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order, first = grouped(keys)
    return keys[order[first]], np.add.reduceat(n[order], first) if len(first) else n


# --- the model ------------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays are, and the totals; the arrays are mapped when a worker first reads them.

    Shard and table of an n-gram depend on how frequent a word of it is (``level`` 0, 1, 2). What grows with the input here
    are the words that are frequent for the size of a shard, a few for each shard.
    """

    folder: str
    bits: int
    words: int = 0
    tokens: int = 0
    limit: int = 0  # above all word numbers; itself stands for the start of a text
    span_bits: int = 0  # there are 2^span_bits parts of the arrays by number
    often: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # numbers of levels 1 and 2, in order
    often_level: np.ndarray = field(default_factory=lambda: np.empty(0, np.int8))
    often_stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    discount: np.ndarray = field(default_factory=lambda: np.zeros((4, 4)))  # by order
    pairs: int = 0
    left_over: float = 1.0

    def __post_init__(self) -> None:
        self._maps = Maps()

    @property
    def kind(self) -> str:
        """Of word numbers between tasks: four bytes while all of them fit, else eight."""
        return "<u4" if self.limit + 2 < 1 << 32 else "<u8"

    def part(self, name: str, kind: str) -> np.ndarray:
        return self._maps(f"{self.folder}/{name}", kind)

    def counts(self, name: str, n: int) -> np.ndarray:
        """An array of ``n`` counts, of four bytes each where they fit."""
        raw = self.part(name, "u1")
        return raw.view("<u4" if len(raw) == 4 * n else "<i8")

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and training counts of sorted distinct word hashes; number ``limit`` + 1 and count 0 if unknown."""
        number, count = np.full(len(h), self.limit + 1, np.uint64), np.zeros(len(h), np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for k in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, (k, k + 1))
            keys = self.part(f"word/{k}.key", "<u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
                ok = keys[at] == h[a:b]
                rank = self.part(f"word/{k}.rank", "<u4")[at[ok]].astype(np.uint64)
                number[a:b][ok] = (rank << np.uint64(self.bits)) + np.uint64(k)
                count[a:b][ok] = self.part(f"word/{k}.n", "<i8")[at[ok]]
        return number, count

    def level(self, x: np.ndarray) -> np.ndarray:
        """0, 1 for frequent and 2 for very frequent words and the start of a text."""
        if not len(self.often):
            return np.zeros(len(x), np.int8)
        at = np.minimum(np.searchsorted(self.often, x), len(self.often) - 1)
        return np.where(self.often[at] == x, self.often_level[at], 0).astype(np.int8)

    def dealt(self, h: np.ndarray) -> np.ndarray:
        """The shard of a hash: its last bits, as the tables tell keys apart by the first."""
        return (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The shard of a word number."""
        return (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, family: str, file: np.ndarray, h: np.ndarray, columns: list[str]) -> np.ndarray:
        """Values of distinct hashes, sorted: those seen once are ones in the first two columns, those unseen zeros."""
        out = np.zeros((len(h), len(columns)), np.int64)
        order = by_small(file)
        sorted_file = file[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_file)) + 1, [len(file)]]) if len(file) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k, ask = int(sorted_file[a]), order[a:b]
            name = f"{family}/{k}" if k < 1 << self.bits else f"{family}/dealt-{k - (1 << self.bits)}"
            for table in ("more", "once"):
                keys = self.part(f"{name}.{table}.key", "<u4")
                if not len(keys) or not len(ask):
                    continue
                at = places(self.part(f"{name}.{table}.at", "<u4"), keys, h[ask])
                ok = at >= 0
                if table == "once":
                    out[ask[ok], :2] = 1
                else:
                    for i, c in enumerate(columns):
                        out[ask[ok], i] = self.counts(f"{name}.{table}.{c}", len(keys))[at[ok]]
                    ask = ask[~ok]
        return out

    def contexts(self, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        """total, n1, n2, n3 of pairs as the context of a third word."""
        level, shard = self.level(y), self.dealt(h)
        return self.find("context", np.where(level == 0, self.own(y), np.where(level == 1, shard, shard + (1 << self.bits))), h, STATS)

    def ends(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """After how many different words a pair stands (after the start of a text: how often)."""
        return self.find("end", np.where(self.level(x) == 0, self.own(x), self.dealt(h) + (1 << self.bits)), h, ["n"])[:, 0]

    def trigrams(self, y: np.ndarray, xy: np.ndarray, xyz: np.ndarray) -> np.ndarray:
        """Training counts of trigrams, by the middle word, the hash of the first two and that of all."""
        level = self.level(y)
        return self.find("trigram", np.where(level == 0, self.own(y), np.where(level == 1, self.dealt(xy), self.dealt(xyz))), xyz, ["n"])[:, 0]

    def by_part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part of the arrays by number, and place in it."""
        return (ids & np.uint64((1 << self.span_bits) - 1)).astype(np.int64), (ids >> np.uint64(self.span_bits)).astype(np.int64)

    def low(self, ids: np.ndarray) -> np.ndarray:
        """Probability of words by how many different words they follow, and evenly for what is left over."""
        out = np.full(len(ids), self.left_over / (self.words + 1))
        known = np.flatnonzero(ids < self.limit)
        if self.pairs and len(known):
            part, at = self.by_part(ids[known])
            d = self.discount[1]
            for k in np.unique(part).tolist():
                here = part == k
                n = self.part(f"before/{k}", "<u4")[at[here]].astype(np.int64)
                out[known[here]] += np.maximum(n - d[np.minimum(n, 3)], 0) / self.pairs
        return out

    def single_contexts(self, ids: np.ndarray) -> np.ndarray:
        """total, n1, n2, n3 of words as the context of a second word."""
        out = np.zeros((len(ids), 4))
        level = self.level(ids)
        if len(self.often):
            out[level > 0] = self.often_stats[np.searchsorted(self.often, ids[level > 0])]
        rest = np.flatnonzero((level == 0) & (ids < self.limit))
        shard = self.own(ids[rest])
        for k in np.unique(shard).tolist():
            here = rest[shard == k]
            got = self.part(f"single/{k}", "<u4").reshape(-1, 4)
            if len(got):
                out[here] = got[(ids[here] >> np.uint64(self.bits)).astype(np.int64)]
        return out

    def back(self, stats: np.ndarray, order: int) -> np.ndarray:
        """What the discounts of a context's n-grams leave to the next lower order."""
        total = stats[:, 0].astype(float)
        return np.divide(stats[:, 1:4] @ self.discount[order][1:], total, out=np.ones(len(stats)), where=total > 0)


def tokenised(raw: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*(raw or b"").lower().split(), END]


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams were counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))])


def times(n: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


def spread(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of runs of counts: total, and how many are 1, 2 and 3 or more."""
    if not len(first):
        return np.zeros((0, 4), np.int64)
    return np.column_stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)])


def fit(docs: DataFrame) -> Model:
    """Count (doc_id, text) and lay the arrays down. A null text counts as an empty one; no rows give an even model."""
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    folder = common.posix(common.new_path(spark, "lm"))
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD)) - 1).bit_length())
    model = Model(folder, bits)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, parts, held = common.HashCache(), [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            return rows_of(dealt("word", (keys >> np.uint64(64 - bits)).astype(np.int64), keys, n.astype("<u4")))

        for batch in batches:
            for raw in common.as_bytes(batch.column(0)):
                parts.append(common.hashes(tokenised(raw), cache))
                held += len(parts[-1])
            if held > FLUSH:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    def merge_words(group: pa.Table) -> pa.Table:
        keys, n = unpack(group.column("blob").to_pylist(), "<u8", "<u4")
        keys, n = summed(keys, n.astype(np.int64))
        k, order = group.column("shard")[0].as_py(), np.argsort(-n, kind="stable")
        rank = np.empty(len(n), "<u4")
        rank[order] = np.arange(len(n))
        for name, column in (("rank", rank), ("n", n), ("key", keys)):
            write_array(f"{folder}/word/{k}.{name}", column)
        top = n[order[:64]].tolist()  # in order of rank, to find the words that are frequent for a shard
        return pa.table({"shard": pa.array([k], pa.int32()), "words": [len(keys)], "tokens": [int(n.sum())], "top": [top]})

    found = texts.mapInArrow(count_words, ROW).groupBy("shard").applyInArrow(merge_words, "shard int, words bigint, tokens bigint, top array<bigint>")
    found = found.collect()  # a row for each shard
    model.words, model.tokens = sum(r["words"] for r in found), sum(r["tokens"] for r in found)
    model.limit = max((r["words"] for r in found), default=0) << bits
    share = model.tokens / (1 << bits)
    often = {model.limit: 2} | {(i << bits) + r["shard"]: 1 + (n > 4 * share) for r in found for i, n in enumerate(r["top"]) if n > share / 4}
    model.often = np.array(sorted(often), np.uint64)
    model.often_level = np.array([often[x] for x in sorted(often)], np.int8)
    model.often_stats = np.zeros((len(often), 4))
    model.span_bits = max(0, min(bits, (model.limit // PART).bit_length() - 1))
    _count(texts, model)
    return model


def numbered(raws: list[bytes | None], model: Model, cache: common.HashCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: the distinct words' numbers and training counts, which each token is, and where texts begin."""
    lists = [common.hashes(tokenised(r), cache) for r in raws]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]]).astype(np.int64)
    u, at = np.unique(np.concatenate(lists), return_inverse=True)
    return *model.numbers(u), at, begin


def _count(texts: DataFrame, model: Model) -> None:
    """Second pass: trigrams, then what was dealt out of contexts and ends, then by word how many different words it follows."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    bits, folder, start = model.bits, model.folder, np.uint64(model.limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache, parts, held = shared.value, common.HashCache(), [], 0

        def out() -> pa.RecordBatch:
            a, b, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            xy = pair(a, b)
            xyz = triple(xy, c)
            order, first = grouped(xyz)
            n, pick = np.diff(np.append(first, len(order))).astype("<u4"), order[first]
            a, b, c, xy, xyz = a[pick], b[pick], c[pick], xy[pick], xyz[pick]
            level = m.level(b)
            shard = np.where(level == 0, m.own(b), np.where(level == 1, m.dealt(xy), m.dealt(xyz)))
            order = np.argsort((b.astype(np.uint64) << _32) ^ a)  # words side by side pack better
            return rows_of(dealt("trigram", shard[order], b[order], a[order], c[order], n[order]))

        for batch in batches:
            if not batch.num_rows:
                continue
            number, _, at, begin = numbered(common.as_bytes(batch.column(0)), m, cache)
            c = number[at]
            b, a = np.empty_like(c), np.empty_like(c)
            b[1:] = c[:-1]
            b[begin] = start
            a[1:] = b[:-1]
            a[begin] = start
            parts.append([x.astype(m.kind) for x in (a, b, c)])
            held += len(c)
            if held > FLUSH:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    def write(family: str, k: int | str, keys: np.ndarray, **columns: np.ndarray) -> None:
        """Sorted hashes that were seen once, and the others with their columns."""
        values = list(columns.values())
        once = values[0] == 1
        write_table(f"{folder}/{family}/{k}.once", keys[once])
        write_table(f"{folder}/{family}/{k}.more", keys[~once], **{name: v[~once] for name, v in columns.items()})

    def write_contexts(k: int | str, keys: np.ndarray, stats: np.ndarray) -> None:
        write("context", k, keys, total=stats[:, 0], **{s: stats[:, i + 1] for i, s in enumerate(STATS[1:])})

    def ends_out(m: Model, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> list[tuple[str, int, bytes]]:
        """Rows of complete ends: how many there are of each count, and the words that they have as second ones."""
        second, follows = np.unique(c, return_counts=True)
        return [("times", 2, pack(times(n))), *dealt("before", m.by_part(second)[0], second.astype(m.kind), follows.astype("<u4"))]

    def merge(group: pa.Table) -> pa.Table:
        m, k = shared.value, group.column("shard")[0].as_py()
        b, a, c, n = unpack(group.column("blob").to_pylist(), *[m.kind] * 3, "<u4")
        b, a, c, n = b.astype(np.uint64), a.astype(np.uint64), c.astype(np.uint64), n.astype(np.int64)
        xy = pair(a, b)
        xyz = triple(xy, c)
        order, first = grouped(xyz)
        n, pick = np.add.reduceat(n[order], first), order[first]
        a, b, c, xy, xyz = a[pick], b[pick], c[pick], xy[pick], xyz[pick]
        level, begins = m.level(b), b == start
        whole = ~begins  # a first word of a text has a context of one word only
        write("trigram", k, xyz[whole], n=n[whole])
        rows = [("times", 3, pack(times(n[whole])))]
        # Contexts: complete here unless the middle word is very frequent.
        order, first = grouped(xy[whole])
        stats, keys, very = spread(n[whole][order], first), xy[whole][order[first]], level[whole][order[first]] == 2
        write_contexts(k, keys[~very], stats[~very])
        rows += dealt("context", m.dealt(keys[very]), keys[very], *stats[very].T.astype("<i8"))
        # Ends: complete here unless the middle word is frequent.
        yz = pair(b, c)
        order, first = grouped(yz)
        if len(first):
            n_end = np.add.reduceat(np.where(begins, n, 1)[order], first)
            yz, b, c = (x[order[first]] for x in (yz, b, c))
            here = m.level(b) == 0
            write("end", k, yz[here], n=n_end[here])
            rows += ends_out(m, b[here], c[here], n_end[here])
            o, f = grouped(b[here])
            single = np.zeros((m.limit >> bits, 4), "<u4")
            single[(b[here][o[f]] >> np.uint64(bits)).astype(np.int64)] = spread(n_end[here][o], f)
            write_array(f"{folder}/single/{k}", single)
            rows += dealt("end", m.dealt(yz[~here]), yz[~here], b[~here].astype(m.kind), c[~here].astype(m.kind), n_end[~here].astype("<i8"))
        return pa.Table.from_batches([rows_of(rows)])

    def merge_dealt(group: pa.Table) -> pa.Table:
        m, k, blobs = shared.value, group.column("shard")[0].as_py(), group.column("blob").to_pylist()
        if group.column("kind")[0].as_py() == "context":
            keys, *stats = unpack(blobs, "<u8", *["<i8"] * 4)
            order, first = grouped(keys)
            # Shards have few very frequent words, so these tables lie beside those of complete contexts.
            write_contexts(f"dealt-{k}", keys[order[first]], np.column_stack([np.add.reduceat(s[order], first) for s in stats]))
            return pa.Table.from_batches([rows_of([])])
        yz, b, c, n = unpack(blobs, "<u8", m.kind, m.kind, "<i8")
        order, first = grouped(yz)
        n, yz, b, c = np.add.reduceat(n[order], first), yz[order[first]], b[order[first]].astype(np.uint64), c[order[first]].astype(np.uint64)
        write("end", f"dealt-{k}", yz, n=n)
        o, f = grouped(b)
        rows = [("single", 0, pack(b[o[f]], *spread(n[o], f).T.astype("<i8"))), *ends_out(m, b, c, n)]
        return pa.Table.from_batches([rows_of(rows)])

    def by_number(group: pa.Table) -> pa.Table:
        m, k = shared.value, group.column("shard")[0].as_py()
        ids, follows = unpack(group.column("blob").to_pylist(), m.kind, "<u4")
        before = np.zeros((m.limit >> m.span_bits) + 1, np.int64)
        np.add.at(before, m.by_part(ids)[1], follows.astype(np.int64))
        write_array(f"{folder}/before/{k}", before.astype("<u4"))
        n = before[before > 0]
        return pa.table({"pairs": [int(n.sum())], "times": [times(n).tolist()], "more": [int((n > 2).sum())]})

    made = common.stored(texts.mapInArrow(count, ROW).groupBy("shard").applyInArrow(merge, ROW), "trigrams")
    again = common.stored(made.filter("kind in ('context', 'end')").groupBy("kind", "shard").applyInArrow(merge_dealt, ROW), "dealt")
    both = made.select("kind", "shard", "blob").union(again)
    # A row or two for each shard.
    for r in both.filter("kind in ('times', 'single')").groupBy("kind", "shard").agg(F.collect_list("blob").alias("blobs")).collect():
        if r["kind"] == "times":
            (got,) = unpack(list(map(bytes, r["blobs"])), "<i8")
            model.discount[r["shard"]] = discounts(got.reshape(-1, 4).sum(0))
        else:
            b, *stats = unpack(list(map(bytes, r["blobs"])), "<u8", *["<i8"] * 4)
            np.add.at(model.often_stats, np.searchsorted(model.often, b), np.column_stack(stats))
    parts = both.filter("kind = 'before'").groupBy("shard").applyInArrow(by_number, "pairs bigint, times array<bigint>, more bigint").collect()  # a row for each part
    model.pairs = sum(r["pairs"] for r in parts)
    n = np.sum([r["times"] for r in parts], axis=0) if parts else np.zeros(4)
    model.discount[1] = e = discounts(n)
    if model.pairs:
        model.left_over = float((e[1] * n[0] + e[2] * n[1] + e[3] * sum(r["more"] for r in parts)) / model.pairs)
    common.discard(made, again)


def log10s(model: Model, raws: list[bytes | None], cache: common.HashCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of texts one after the other: log10 of P(token | two before), of its smoothed frequency, training count; and
    where texts begin."""
    number, count, at, begin = numbered(raws, model, cache)
    start = len(number)  # the place of the start of a text among the distinct words
    number = np.append(number, np.uint64(model.limit))
    low, single = model.low(number), model.single_contexts(number)
    back = model.back(single, 2)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[begin] = start
    # Distinct pairs, each as the end of a trigram and as the context of the next.
    h = pair(number[before], number[at])
    order, first = grouped(h)
    which = np.empty(len(h), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    pick = order[first]
    w, b, key = at[pick], before[pick], h[pick]
    n, context = model.ends(number[b], key), model.contexts(number[w], key)
    total, d = single[b, 0], model.discount[2]
    p2 = np.divide(np.maximum(n - d[np.minimum(n, 3)], 0), total, out=np.zeros(len(n)), where=total > 0) + back[b] * low[w]
    p = p2[which]
    # Trigrams, where the context is known; where the end isn't, the trigram isn't either.
    inner = np.ones(len(at), bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    c, e = which[inner - 1], which[inner]
    known = context[c, 0] > 0
    inner, c, e = inner[known], c[known], e[known]
    n3, look = np.zeros(len(inner), np.int64), np.flatnonzero(n[e] > 0)
    if len(look):
        xy = key[c[look]]
        xyz = triple(xy, number[at[inner[look]]])
        order, first = grouped(xyz)
        pick = order[first]
        got = model.trigrams(number[before[inner[look[pick]]]], xy[pick], xyz[pick])
        n3[look[order]] = np.repeat(got, np.diff(np.append(first, len(order))))
    d = model.discount[3]
    p[inner] = np.maximum(n3 - d[np.minimum(n3, 3)], 0) / context[c, 0] + model.back(context, 3)[c] * p2[e]
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    return np.log10(p), base[at], count[at], begin


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of whole texts.

    In: doc_id, text. Out, a row for each input row: doc_id, n_tokens (words and the end), n_known (tokens seen in
    training), train_tokens, base_score (smoothed unigrams), score (the model), perplexity. A null text is an empty one: its one
    token is the end. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.quiet_arrow(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, common.HashCache()
        for batch in batches:
            if not batch.num_rows:
                continue
            full, base, count, begin = log10s(m, common.as_bytes(batch.column(1)), cache)
            sizes = np.diff(np.append(begin, len(full)))
            known = np.add.reduceat((count > 0).astype(np.int64), begin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(known), pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(full, begin))], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("bigint")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def language_model(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that are not held out, score all, and say which were held out.

    In: doc_id, text; other columns are ignored. A null text is an empty one. Each row is counted and is a row of the
    result, also of several with one doc_id or text; equal texts have equal scores. An empty table gives no rows.
    """
    model = fit(docs.filter(~held_out).select("doc_id", "text"))
    return score(docs, model).withColumn("held_out", held_out)
