"""Line deduplication: lines become keys and hashes, documents are counted by hash, and texts are put together again by position.

Texts are read twice. The first pass hands on a row for each line that is long enough: a 128-bit hash of its key, its
document, its text's own hash and its place. Lines found in several documents are joined back to the places, those of the
very frequent ones by a broadcast of bounded size, so that a line which is in a third of all documents makes no large task.
The second pass leaves the places out. Only hashes and places are sorted, each text moves once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space at a line's ends that its key doesn't have.
SPACE = b" \t\n\x0b\x0c\r"
#: A line is hot if more than one in so many of all rows have it; so there are fewer hot lines than this.
HOT = 2000
#: Lines that a task holds before it hands them on.
PACK = 200_000

LINE = "a bigint, b bigint, doc bigint, k1 bigint, k2 bigint, pos int"


def key_of(line: bytes) -> bytes:
    """A line's key: without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """Whether a key has at least ``least`` code points."""
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """From doc, text, k1, k2: a row (a, b, doc, k1, k2, pos) for each line whose key has at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), ">i8").astype("<i8").reshape(-1, 2)
            docs, k1, k2 = (pa.concat_arrays([x[i] for x in ids]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), docs, k1, k2, pa.array(np.array(places, "<i4"))], ["a", "b", "doc", "k1", "k2", "pos"])

        digests: list[bytes] = []
        places: list[int] = []
        ids: list[list[pa.Array]] = []
        for batch in batches:
            counts = []
            for raw in common.as_bytes(batch.column(1)):
                before = len(places)
                for at, line in enumerate((raw or b"").split(b"\n")):
                    key = key_of(line)
                    if long_enough(key, least):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(at)
                counts.append(len(places) - before)
            which = pa.array(np.repeat(np.arange(len(counts)), counts))
            ids.append([batch.column(i).take(which) for i in (0, 2, 3)])
            if len(places) > PACK:
                yield out()
                digests, places, ids = [], [], []
        if places:
            yield out()

    return docs.select("doc", "text", "k1", "k2").mapInArrow(run, LINE)


def repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines of several documents: (a, b, low, n), the smallest document and the number of rows that hold the line."""
    each = lines.groupBy("a", "b", "doc").agg(F.count("*").alias("n"))
    return each.groupBy("a", "b").agg(F.min("doc").alias("low"), F.count("*").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs).select("a", "b", "low", "n")


def dropped_places(lines: DataFrame, again: DataFrame) -> DataFrame:
    """Places to leave out, by text: (k1, k2, places)."""
    most = max(1, lines.count() // HOT)
    hot = F.broadcast(again.filter(F.col("n") > most).select("a", "b", F.col("low").alias("hot_low"), F.lit(True).alias("hot")))
    marked = lines.join(hot, ["a", "b"], "left")
    rest = marked.filter("hot is null").drop("hot", "hot_low").join(again.filter(F.col("n") <= most).select("a", "b", "low"), ["a", "b"])
    gone = marked.filter("hot and not (doc <=> hot_low)").select("k1", "k2", "pos").unionByName(rest.filter("not (doc <=> low)").select("k1", "k2", "pos"))
    return gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("places"))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, sha, kept = [], [], [], []
        for raw, places in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            text = raw or b""
            if not places:
                n.append(text.count(b"\n") + 1)
                kept.append(None)
            else:
                lines, out = text.split(b"\n"), set(places)
                text = b"\n".join([x for i, x in enumerate(lines) if i not in out])
                n.append(len(lines))
                kept.append(text.decode())
            dropped.append(len(places or ()))
            sha.append(hashlib.sha256(text).hexdigest())
        columns = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that are in at least ``min_docs`` documents, except in the one with the smallest doc_id.

    In: doc_id, text; other columns are ignored. Out, a row for each input row: doc_id, n_lines (before dropping), n_dropped,
    kept_sha256 (of the lines that stay, joined by a line feed) and kept_text, null where nothing was dropped.

    Lines are told apart by their keys: without ASCII white space at both ends, A-Z lower-cased. Lines whose key is shorter
    than ``min_chars`` code points stay. A null text is one empty line. Rows with one doc_id are one document, so their lines
    don't count twice and all of them stay where that id is the smallest; all rows without a doc_id are one document that
    comes last. Repeats of a line inside the smallest document stay. Keys are compared by 128-bit hashes.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    # rows with the same id and text lose the same lines, so this hash names the row
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("doc", "text"), "k2": F.xxhash64(F.lit(12), "text", "doc")})
    lines = common.stored(hashed_lines(docs, min_chars), "lines")
    again = common.stored(repeated(lines, min_docs), "again")
    gone = common.stored(dropped_places(lines, again), "gone")
    both = docs.join(gone.hint("merge"), ["k1", "k2"], "left").select("doc", "text", "places")  # one way at all sizes
    return both.mapInArrow(_clean, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string")
