"""SHA-256 of large files, piece by piece.

Each block's state needs the one before, so a file's pieces are read in turn, each by a task of its own that goes on from
the state in which the last one ended. All files go on at once, and only states (112 bytes) pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import SparkSession

#: Bytes of a file that one task reads at most.
PIECE = 64 << 20
#: In how many small pieces the end of a file is read, instead of one.
PARTS = 16
#: Bytes of a record that a piece is read in; a number with many divisors, as the last piece needs one of the file's size.
RECORD = 60_060


def escaped(path: str) -> str:
    """A path that Hadoop takes as it is, not as a pattern."""
    return "".join(f"\\{c}" if c in "\\{}[]*?^" else c for c in path)


def splittable(spark: SparkSession, path: str) -> bool:
    """Hadoop's readers of records would unpack a file that is named like a packed one."""
    hadoop = spark._jvm.org.apache.hadoop
    return hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hadoop.fs.Path(path)) is None


def small_piece(size: int) -> int:
    """The size of small pieces that leaves a short last one, which isn't made of whole records and is read in smaller ones.

    Hadoop adds a rest of up to a tenth to the piece before, so the last has a little more than that.
    """
    most = PIECE // PARTS
    sizes = range(most // RECORD * RECORD, most // 2, -RECORD)
    return min((s for s in sizes if size % s > 0.101 * s), key=lambda s: size % s, default=sizes[0])


def _records(spark: SparkSession, path: str, piece: int, record: int) -> RDD:
    """(offset, bytes) of a file's records, a partition for each piece."""
    kind = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
    name = escaped(path).replace("\\", "\\\\").replace(",", "\\,")
    split = "mapreduce.input.fileinputformat.split"
    conf = {"mapreduce.input.fileinputformat.inputdir": name, f"{split}.minsize": str(piece), f"{split}.maxsize": str(piece), "fixedlengthinputformat.record.length": str(record)}
    return spark.sparkContext.newAPIHadoopRDD(kind, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)


def sha256(spark: SparkSession, sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 (lowercase hex) by path, of files of more than ``PIECE`` bytes that are ``splittable``."""
    sc, rdds, steps, at = spark.sparkContext, [], {}, 0
    for path, size in sizes.items():
        small, done, steps[path] = small_piece(size), 0, []
        # Pieces, then small ones from where the last piece begins, then the last small one in records that end with the file.
        for piece, record in ((small * PARTS, RECORD), (small, RECORD), (small, math.gcd(size, RECORD))):
            rdds.append(_records(spark, path, piece, record))
            n = rdds[-1].getNumPartitions()
            steps[path] += [(at + i, piece) for i in range(done // piece, n - 1)]
            done, at = (n - 1) * piece, at + n
        steps[path].append((at - 1, size - done))
    state: dict[str, bytes | None] = dict.fromkeys(sizes)
    for k in range(max(map(len, steps.values()), default=0)):
        now = {steps[p][k][0]: (p, state[p], steps[p][k][1], k + 1 == len(steps[p])) for p in sizes if k < len(steps[p])}
        state |= dict(sc.runJob(sc.union(rdds).mapPartitionsWithIndex(_step(now)), list, list(now)))
    return {p: s.hex() for p, s in state.items()}


def _step(now: dict[int, tuple[str, bytes | None, int, bool]]):
    """Of the pieces in ``now``, by partition: path and the state after the piece, or the digest where it is the last."""

    def run(index: int, records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[str, bytes]]:
        import _hashlib
        import ctypes
        from itertools import batched

        path, before, size, last = now[index]
        # The library below hashlib, as hashlib's own objects can't be handed on.
        crypto = ctypes.CDLL(_hashlib.__file__)
        state = ctypes.create_string_buffer(before, 112) if before else ctypes.create_string_buffer(112)
        if not before:
            crypto.SHA256_Init(state)
        n = 0
        for some in batched((r for _, r in records), 64):
            raw = b"".join(some)
            crypto.SHA256_Update(state, raw, ctypes.c_size_t(len(raw)))
            n += len(raw)
        if n != size:
            raise ValueError(f"{path}: a piece has {n} bytes, not {size}")
        digest = ctypes.create_string_buffer(32)
        if last:
            crypto.SHA256_Final(digest, state)
        yield path, (digest if last else state).raw

    return run
