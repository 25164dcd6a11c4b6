"""Hard-negative mining: rows along a Hilbert curve in blocks with zone maps, and interval arithmetic on what to read.

Rows are sorted by label and place on a Hilbert curve through all dimensions and packed into blocks of ``BLOCK`` rows, stored
as Parquet with the smallest and the largest value of each dimension. Anchors are packed the same way. For an anchor, a
block's zone map bounds all its scores: the sum over dimensions of the smaller and of the larger of (anchor x smallest,
anchor x largest).

Anchors are a stated query set that meets all rows in tiles of one pack of anchors and one run of blocks. First the tiles are
chosen from zone maps alone, by thresholds that a first look at few blocks gave; only the blocks of chosen tiles are read, and
inside a tile each anchor skips what its own bounds rule out. A tile hands on no more than the best few rows of each anchor
or window, so nothing grows with the rows of a label or of a hot vector.

Nothing is cut: a block is left out only where its bounds show that no row of it can be among the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block, blocks of a run, anchors of a pack.
BLOCK, RUN, PACK = 1024, 16, 256
#: Bits of a dimension on the curve.
BITS = 4
#: Components beyond this count as non-finite, so that scores of up to 128 dimensions are exact in 64-bit integers.
LARGEST = 2.0**20
#: Below it sums of products are exact in doubles.
EXACT = 2**53

PACKED = "part int, seq bigint, ids binary, labels binary, width int, vectors binary, low binary, high binary, label_low bigint, label_high bigint"
LEAST = np.iinfo(np.int64).min


def curve(x: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points with coordinates below 2^bits, as big-endian keys.

    From the highest bit down, each dimension with that bit set reflects the lower bits of the first one, and else swaps
    them with its own; then bits are turned into a Gray code across dimensions and interleaved.
    """
    x = x.astype(np.int64).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(dims):
            up = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & lower)
            x[:, 0] ^= np.where(up, lower, swap)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0) if dims else 0
    x ^= turn[:, None]
    flags = np.stack([x >> b & 1 for b in range(bits - 1, -1, -1)], axis=1).reshape(n, -1).astype(bool) if dims else np.zeros((n, 0), bool)
    return [row.tobytes() for row in np.packbits(flags, axis=1)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(length.max(initial=0))), np.int64)
    flat = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    out[np.repeat(np.arange(len(lists)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows of ``a`` and ``b``; missing components are zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = _fit(a, width), _fit(b, width)
    top = width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < EXACT else a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible scores of each anchor with any row of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


# --- blocks and packs -----------------------------------------------------------------------------


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows that take part, with labels turned and components as integers; one row for each vec_id."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(LARGEST)))
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    out = rows.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform(x, lambda v: F.floor(v * 256).cast("int")).alias("q"), good.alias("good"))
    out = common.stored(out.filter("good and vec_id is not null and label is not null").drop("good"), "vectors")
    twice = common.stored(out.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "twice")
    if twice.limit(1).count():
        first = out.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
        out = common.stored(out.join(twice, "vec_id", "left_anti").unionByName(first), "vectors")
    return out


def spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each dimension over all rows: a row of each task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            m = _matrix(batch.column(0))
            if len(m):
                width = max(len(low), m.shape[1])
                m = _fit(m, width)
                low, high = np.minimum(_fit(low[None], width)[0], m.min(0)), np.maximum(_fit(high[None], width)[0], m.max(0))
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], ["low", "high"])

    parts = rows.select("q").mapInArrow(run, "low array<bigint>, high array<bigint>").collect()
    width = max((len(p["low"]) for p in parts), default=0)
    side = lambda k, f: f([np.array(p[k] + [0] * (width - len(p[k])), np.int64) for p in parts], axis=0) if parts else np.zeros(0, np.int64)
    return side("low", np.min), side("high", np.max)


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their place on the curve, wide dimensions first."""
    low, high = spread(rows)
    order = np.argsort(low - high, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _fit(_matrix(batch.column(2)), len(low))
            cell = (m - low) * (1 << BITS) // (high - low + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve(cell[:, order], BITS), pa.binary())], ["vec_id", "label", "q", "place"])

    return common.stored(rows.select("vec_id", "label", "q").mapInArrow(run, "vec_id bigint, label bigint, q array<int>, place binary"), "placed")


def ordered(rows: DataFrame, per: int, wide: bool = False) -> DataFrame:
    """Rows sorted by label and place over partitions of about ``per`` rows, ``wide``: as many as shuffles have at least. Equal vectors are told apart by vec_id, so they fill as many partitions as they need."""
    keys = ["label", "place", "vec_id"]
    n = max(-(-rows.count() // per), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if wide else 1)
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def packs(rows: DataFrame, size: int) -> DataFrame:
    """Consecutive rows in packs of at most ``size``, each with its zone map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        kept: list[pa.RecordBatch] = []
        held = 0
        for batch in [*batches, None]:
            if batch is not None and len(batch):
                kept.append(batch)
                held += len(batch)
            if not held or batch is not None and held < size:
                continue
            table = pa.Table.from_batches(kept)
            end = held if batch is None else held - held % size
            for at in range(0, end, size):
                own = table.slice(at, min(size, end - at))
                m, label = _matrix(own.column("q")), own.column("label").to_numpy()
                row = [part, seq, own.column("vec_id").to_numpy().astype("<i8").tobytes(), label.astype("<i8").tobytes(), m.shape[1], m.astype("<i4").tobytes(), m.min(0).astype("<i4").tobytes(), m.max(0).astype("<i4").tobytes(), int(label.min()), int(label.max())]
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], SCHEMA)
                seq += 1
            kept, held = table.slice(end).to_batches(), held - end

    return rows.select("vec_id", "label", "q").mapInArrow(run, PACKED)


NAMES = [x.split()[0] for x in PACKED.split(", ")]
SCHEMA = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(NAMES, PACKED.split(", "), strict=True)])


def numbered(packed: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Packs with a number from 0 on in their order, and how many there are. The driver sees a count for each partition."""
    packed = common.stored(packed, name)
    counts = sorted((r["part"], r["count"]) for r in packed.groupBy("part").count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    first = packed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before[:-1], strict=True)], "part int, first bigint")
    return packed.join(F.broadcast(first), "part").withColumn(name, F.col("first") + F.col("seq")), before[-1]


class Pack:
    """The rows of a pack or block as arrays."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(self.ids), row["width"]).astype(np.int64)


def zone(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several blocks: smallest and largest values, smallest and largest labels."""
    width = max(r["width"] for r in rows)
    low, high = (np.stack([_fit(np.frombuffer(r[k], "<i4").astype(np.int64)[None], width)[0] for r in rows]) for k in ("low", "high"))
    return low, high, np.array([r["label_low"] for r in rows]), np.array([r["label_high"] for r in rows])


# --- positives ----------------------------------------------------------------------------------------


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The first rows by (higher score, smaller id) of those that are ``ok``, as (score, id)."""
    at = np.flatnonzero(ok)
    if len(at) > most:  # only what can be among the first is sorted
        cut = -np.partition(-score[at], most - 1)[most - 1]
        at = at[score[at] >= cut]
    order = np.lexsort((ids[at], -score[at]))[:most]
    return list(zip(score[at][order].tolist(), ids[at][order].tolist(), strict=True))


class Positives:
    """An anchor's first other rows of its label; its mark is the score below which a row can't be among them."""

    schema = "anchor bigint, score bigint, vec_id bigint"
    keys = ["anchor"]

    def __init__(self, most: int):
        self.most = most

    def marks(self, pack: Pack, known: list[dict]) -> np.ndarray:
        mark = {k["anchor"]: k["mark"] for k in known}
        return np.array([mark.get(i, LEAST) for i in pack.ids.tolist()], np.int64)

    def may(self, pack: Pack, marks: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which anchors have to read which blocks."""
        _, top = bounds(pack.vectors, low, high)
        label = pack.labels[:, None]
        return (first <= label) & (label <= last) & (top >= marks[:, None])

    def take(self, pack: Pack, marks: np.ndarray, best: dict, i: int, block: Pack, score: np.ndarray) -> None:
        ok = (block.labels == pack.labels[i]) & (block.ids != pack.ids[i]) & (score >= marks[i])
        got = sorted(best.get(i, []) + _best(score, block.ids, ok, self.most), key=lambda x: (-x[0], x[1]))[: self.most]
        best[i] = got
        if len(got) == self.most:
            marks[i] = max(marks[i], got[-1][0])

    def rows(self, pack: Pack, best: dict) -> Iterator[tuple]:
        for i, got in best.items():
            yield from ((int(pack.ids[i]), s, v) for s, v in got)


class Negatives:
    """A window's first rows of other labels; marks are lists of (low, high, score below which a row can't be among them) by anchor."""

    schema = "anchor bigint, positive_id bigint, positive_score bigint, score bigint, vec_id bigint"
    keys = ["anchor", "positive_id", "positive_score"]

    def __init__(self, most: int, lower: int, upper: int):
        self.most, self.lower, self.upper = most, lower, upper

    def marks(self, pack: Pack, known: list[dict]) -> list[list[list[int]]]:
        by: dict[int, list] = {}
        for k in known:
            s = k["positive_score"]
            low, high = -(-self.lower * s // 100), self.upper * s // 100
            if low <= high:
                by.setdefault(k["anchor"], []).append([max(low, k["mark"]), high, k["positive_id"], s])
        return [by.get(i, []) for i in pack.ids.tolist()]

    def may(self, pack: Pack, marks: list, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        bottom, top = bounds(pack.vectors, low, high)
        out = np.zeros(top.shape, bool)
        for i, windows in enumerate(marks):
            for lo, hi, *_ in windows:
                out[i] |= (top[i] >= lo) & (bottom[i] <= hi)
        label = pack.labels[:, None]
        return out & ~((first == label) & (last == label))

    def take(self, pack: Pack, marks: list, best: dict, i: int, block: Pack, score: np.ndarray) -> None:
        other = block.labels != pack.labels[i]
        for window in marks[i]:
            lo, hi, p, s = window
            ok = other & (score >= lo) & (score <= hi)
            if ok.any():
                got = sorted(best.get((i, p, s), []) + _best(score, block.ids, ok, self.most), key=lambda x: (-x[0], x[1]))[: self.most]
                best[i, p, s] = got
                if len(got) == self.most:
                    window[0] = max(lo, got[-1][0])

    def rows(self, pack: Pack, best: dict) -> Iterator[tuple]:
        for (i, p, s), got in best.items():
            yield from ((int(pack.ids[i]), p, s, x, v) for x, v in got)


# --- tiles --------------------------------------------------------------------------------------------


def chosen(anchors: DataFrame, blocks: DataFrame, known: DataFrame, tiles: DataFrame, what: Positives | Negatives) -> DataFrame:
    """From tiles (pack, block_run): the blocks (pack, block, block_run) that some anchor of the pack has to read, by zone maps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                low, high, first, last = zone(row["zones"])
                any_of = what.may(pack, what.marks(pack, row["known"]), low, high, first, last).any(0)
                blocks = [z["block"] for z, ok in zip(row["zones"], any_of, strict=True) if ok]
                yield pa.RecordBatch.from_pydict({"pack": pa.array([row["pack"]] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()), "block_run": pa.array([row["block_run"]] * len(blocks), pa.int64())})

    runs = blocks.groupBy("block_run").agg(F.collect_list(F.struct("block", "width", "low", "high", "label_low", "label_high")).alias("zones"))
    full = tiles.join(runs, "block_run").join(anchors.select("pack", "ids", "labels", "width", "vectors"), "pack").join(known, "pack")
    return full.repartition("pack", "block_run").mapInArrow(run, "pack bigint, block bigint, block_run bigint")


def read(anchors: DataFrame, blocks: DataFrame, known: DataFrame, pairs: DataFrame, what: Positives | Negatives) -> DataFrame:
    """The best rows of each anchor or window in each tile of a pack and the chosen blocks of a run."""
    kinds = [{"bigint": pa.int64()}[x.split()[1]] for x in what.schema.split(", ")]
    names = [x.split()[0] for x in what.schema.split(", ")]

    def tile(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        mine = next((r for r in rows if r["known"] is not None), None)
        out: list[tuple] = []
        if mine is not None:
            pack, best = Pack(mine), {}
            marks = what.marks(pack, mine["known"])
            for r in sorted((r for r in rows if r["known"] is None), key=lambda r: r["block"]):
                who = np.flatnonzero(what.may(pack, marks, *zone([r]))[:, 0])
                if len(who):
                    block = Pack(r)
                    for i, score in zip(who.tolist(), product(pack.vectors[who], block.vectors), strict=True):
                        what.take(pack, marks, best, i, block, score)
            out = list(what.rows(pack, best))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[] for _ in kinds], kinds, strict=True)], names)

    cols = ["pack", "block_run", "block", "ids", "labels", "width", "vectors", "low", "high", "label_low", "label_high", "known"]
    none = F.lit(None).cast(known.schema["known"].dataType)
    left = pairs.select("pack", "block_run").distinct().join(anchors.select("pack", "ids", "labels", "width", "vectors", "low", "high", "label_low", "label_high"), "pack").join(known, "pack").withColumn("block", F.lit(-1).cast("bigint"))
    right = pairs.join(blocks.drop("block_run"), "block").withColumn("known", none)
    return left.select(cols).unionByName(right.select(cols)).groupBy("pack", "block_run").applyInArrow(tile, what.schema)


class Search:
    """Anchors and blocks, and the search for the best rows of anchors or windows among all blocks."""

    def __init__(self, anchors: DataFrame, blocks: DataFrame, n_packs: int, n_runs: int):
        self.anchors, self.blocks, self.n_packs, self.n_runs = anchors, blocks, n_packs, n_runs

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))), pa.array(np.concatenate(ids) if ids else [], pa.int64())], ["pack", "anchor"])

        self.members = common.stored(anchors.select("pack", "ids").mapInArrow(members, "pack bigint, anchor bigint"), "members")

    def known(self, what: Positives | Negatives, given: DataFrame | None, found: DataFrame | None) -> DataFrame:
        """By pack, what is known of its anchors or windows: (pack, known), with the mark that rows found so far set."""
        of = self.members if given is None else self.members.join(given, "anchor")
        if found is None:
            of = of.withColumn("mark", F.lit(LEAST))
        else:
            mark = found.groupBy(*what.keys).agg(F.count("*").alias("n"), F.min("score").alias("mark")).filter(F.col("n") >= what.most).drop("n")
            of = of.join(mark, what.keys, "left").withColumn("mark", F.coalesce("mark", F.lit(LEAST)))
        return common.stored(of.groupBy("pack").agg(F.collect_list(F.struct(*what.keys, "mark")).alias("known")), "known")

    def best(self, what: Positives | Negatives, given: DataFrame | None) -> DataFrame:
        """The first rows of each anchor or window (of ``given``) over all blocks, with their rank.

        The first look takes one run for each pack: for positives the one at the pack's own share of the order, which has its
        neighbours on the curve. What it finds sets the marks for all other tiles.
        """
        spark, n = self.anchors.sparkSession, max(1, self.n_runs)
        aside = 0 if given is None else n // 2
        near = F.expr(f"(((2 * pack + 1) * {n}) div (2 * {max(1, self.n_packs)}) + {aside}) % {n}")
        tiles = spark.range(self.n_packs * self.n_runs).select(F.expr(f"id div {n}").alias("pack"), (F.col("id") % n).alias("block_run")).withColumn("look", F.col("block_run") == near)
        before = None
        for look in (True, False):
            known = self.known(what, given, before)
            pairs = common.stored(chosen(self.anchors, self.blocks, known, tiles.filter(F.col("look") == look).drop("look"), what), "pairs")
            found = common.stored(read(self.anchors, self.blocks, known, pairs, what), "found")
            before = found if before is None else before.unionByName(found)
        return before.withColumn("rank", F.row_number().over(Window.partitionBy(*what.keys).orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= what.most)


def hard_negatives(rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, lower: int = 30, upper: int = 90) -> DataFrame:
    """For each anchor and positive, the first rows of other labels whose score lies between two shares of the positive's.

    In: vec_id, embedding (array of numbers), label; other columns are ignored. Out: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, or with a null or non-finite component (or one beyond 2^20), take no part. Where
    7 divides vec_id the label becomes (label + 1) % 10. Components become floor(256 x); a score is the integer inner product,
    and components that only one of two vectors has count as zero, so an empty vector scores 0. Higher scores come first, ties
    by smaller vec_id. A vec_id names one row: of several, the one with the smallest (label, components) stays. Anchors are
    the rows whose vec_id is divisible by ``every``, their positives the first ``n_positives`` other rows of their label, all
    where there are fewer. Positives of negative score have an empty window. An empty table gives no rows.
    """
    spark = rows.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    inputs = placed(prepared(rows))
    blocks, n_blocks = numbered(packs(ordered(inputs, BLOCK * RUN, True), BLOCK), "block")
    blocks = blocks.withColumn("block_run", F.expr(f"block div {RUN}"))
    anchors, n_packs = numbered(packs(ordered(inputs.filter(F.col("vec_id") % every == 0), PACK), PACK), "pack")
    search = Search(anchors, blocks, n_packs, -(-n_blocks // RUN))

    positives = search.best(Positives(n_positives), None)
    positives = common.stored(positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    found = search.best(Negatives(n_negatives, lower, upper), positives)
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
