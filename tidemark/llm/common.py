"""Shared helpers: inputs, shared scratch space, bounded samples, word hashing."""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the Parquet tables below ``sf_dir``."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Put this package on the path of local Python workers; on a cluster the package is installed."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _REPO not in have.split(":"):
        env["PYTHONPATH"] = f"{_REPO}:{have}".rstrip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new local one only where that is unset and Spark runs locally."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_tidemark_dir", None)
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        given = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc._tidemark_dir = given
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (made := getattr(spark.sparkContext, "_tidemark_made", None)) is not None:
        made.append(path)
    return out


def swept(stage: Callable) -> Callable:
    """A stage (spark, docs, ...) that, as it begins, deletes what the stage before it stored for itself.

    That stage's result has been written and read again by then; where ``docs`` still reads its tables, they stay.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, *more: object) -> DataFrame:
        sc = spark.sparkContext
        before, sc._tidemark_made = getattr(sc, "_tidemark_before", []), []
        read = docs.inputFiles() if before else []
        for path in before:
            name = path.rpartition("/")[2]
            if not any(f"/{name}/" in f for f in read):
                _delete(spark, path)
        try:
            return stage(spark, docs, *more)
        finally:
            sc._tidemark_before, sc._tidemark_made = sc._tidemark_made, None

    return run


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*stored_before: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in stored_before:
        _delete(df.sparkSession, df._stored_at)


def remainder(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """A sample of about ``most`` rows, dealt by a hash of ``key``; all rows where there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < int(1e6 * most / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int | None = None) -> DataFrame:
    """Texts of labelled rows outside the held-out part, at most about ``most`` where that is given: (doc_id, text, label).

    Label rows are cut to the bound before the join, so that then the broadcast side has a fixed size.
    """
    want = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    want = want.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    want = small(want, 1_000_000) if most is None else F.broadcast(bounded(want, "doc_id", most))
    return docs.select("doc_id", "text").join(want, "doc_id")


def shards(spark: SparkSession, rows: int, per_shard: int = 4000) -> int:
    """Number of hash shards, growing with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_shard))


# --- hashing of words, in tasks -------------------------------------------------------------

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32, _S31, _S33 = np.uint64(29), np.uint64(32), np.uint64(31), np.uint64(33)


class HashCache(dict):
    """Word (bytes) -> 64-bit hash; forgets everything when it holds ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes], cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class WordHasher:
    """Hashes of all words of a text at once, without a look-up of each.

    A word's bytes are drawn from a table of random numbers and summed with the powers of an odd number by place; the sum of
    all bytes so far gives that of each word by a difference, moved to place 0. Words are runs of other than ASCII white space.
    Texts are taken in pieces, cut between words, so that the table of powers stays short.
    """

    _SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, piece: int = 1 << 20, seed: int = 99):
        self.piece, self.drawn = piece, np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            powers = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]))
            self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def __call__(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts one after the other, and how many each text has."""
        raw = b"\n".join([r or b"" for r in raws])
        begin = np.cumsum([0, *(len(r or b"") + 1 for r in raws)])
        out, starts, at = [], [], 0
        while at < len(raw):
            end = min(at + self.piece, len(raw))
            while end < len(raw) and not self._SPACE[raw[end]]:
                end += 1
            h, start = self._piece(np.frombuffer(raw, np.uint8, end - at, at))
            out.append(h)
            starts.append(start + at)
            at = end
        if not out:
            return np.empty(0, np.uint64), np.zeros(len(raws), np.int64)
        return np.concatenate(out), np.diff(np.searchsorted(np.concatenate(starts), begin))

    def _piece(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._grow(len(b) + 1)
        edge = np.diff(np.concatenate([[True], self._SPACE[b], [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.drawn[b] * self.power[: len(b)], out=total[1:])
        x = (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> _S32)) * _K1
        return x ^ (x >> _S29), start


def mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """An ordered 64-bit hash of two hashes."""
    x = a * _K1 + ((b << _S31) | (b >> _S33)) * _K2 + np.uint64(seed)
    x ^= x >> _S29
    x *= _K3
    x ^= x >> _S32
    return x


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all ``n`` consecutive items, built by doubling."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    total, out, have, power, width = len(h) - n + 1, None, 0, h, 1
    while True:
        if n & width:
            part = power[have : have + total]
            out = part.copy() if out is None else mix(out, part, seed + width)
            have += width
        if width * 2 > n:
            return out
        power = mix(power[:-width], power[width:], seed)
        width *= 2


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist()


def quiet_arrow(spark: SparkSession) -> None:
    """Smaller Arrow batches, as single texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def small(df: DataFrame, most: int = 300_000) -> DataFrame:
    """Marked for broadcast where it has at most ``most`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; a short id list is broadcast so that texts stay where they are."""
    return docs.join(small(ids.select("doc_id").distinct(), 1_000_000), "doc_id", "left_semi")


def posix(uri: str) -> str:
    """The path of a shared folder that is mounted on all machines."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder (file://...), not {uri}")
    return "/" + uri.removeprefix("file:").lstrip("/")
