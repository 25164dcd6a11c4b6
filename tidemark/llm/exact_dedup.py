"""Exact deduplication by content-defined chunk recipes.

A text is cut into chunks where a rolling hash of its bytes says so, and its recipe is the ordered list of chunk
digests. Recipes, not texts, are shuffled. Where a recipe occurs more than once, the chunks of those texts are
compared byte by byte, once for each distinct chunk, so that an identifier stands for one chunk; equal ordered lists
of verified identifiers are equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalise(raw: bytes) -> bytes:
    """Each run of space, tab, line feed, vertical tab, form feed and return becomes one space."""
    raw = raw.translate(_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def cut(data: bytes, least: int = 1024, mask_bits: int = 11, most: int = 16384) -> list[bytes]:
    """Chunks of ``data``, with borders where a hash of the last 32 bytes ends in zeros."""
    n = len(data)
    if n <= least:
        return [data]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    borders = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    out, at, i = [], 0, 0
    borders = borders.tolist()
    while n - at > least:
        while i < len(borders) and borders[i] < at + least:
            i += 1
        end = min(borders[i] if i < len(borders) else n, at + most, n)
        out.append(data[at:end])
        at = end
    if at < n:
        out.append(data[at:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 (normalised text), recipe (joined chunk digests), n_chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for raw in common.as_bytes(batch.column(1)):
                data = normalise(raw or b"")
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(map(digest, cut(data))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, text_sha256 string, recipe binary")


def chunks(docs: DataFrame) -> DataFrame:
    """The chunks of each text: doc_id, text_sha256 (of the whole text), place, digest, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sha, place, dig, data = [], [], [], [], []
            for i, raw in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                text = normalise(raw or b"")
                parts = cut(text)
                ids += [i] * len(parts)
                sha += [hashlib.sha256(text).hexdigest()] * len(parts)
                place += range(len(parts))
                dig += map(digest, parts)
                data += parts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sha, pa.string()), pa.array(place, pa.int32()), pa.array(dig, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "text_sha256", "place", "digest", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text_sha256 string, place int, digest binary, bytes binary")


def collided(parts: DataFrame) -> DataFrame:
    """Digests that stand for several different chunks; the bytes of a chunk move once from each task."""
    seen = parts.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return seen.filter("low != high").select("digest")


def verified(parts: DataFrame, same_digest: DataFrame) -> DataFrame:
    """Recipes of texts that hold a collided digest, with the chunk's rank among the bytes of that digest put after it.

    A text is known by its doc_id and the digest of the whole of it, as several rows may have one doc_id or none.
    """
    hit = parts.join(common.small(same_digest), "digest", "left_semi")
    rank = hit.select("digest", "bytes").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("bytes")))
    parts = parts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text_sha256", "place", "digest", "bytes").distinct()
    of = parts.join(common.small(same_digest), "digest", "left_semi").select("_id", "text_sha256").distinct()
    named = parts.join(of, ["_id", "text_sha256"], "left_semi").join(rank, ["digest", "bytes"], "left")
    named = named.withColumn("id", F.concat("digest", F.encode(F.coalesce(F.col("nth"), F.lit(0)).cast("string"), "utf-8")))
    return named.groupBy("_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids")).select(
        "_id", "text_sha256", F.encode(F.array_join(F.transform("ids", lambda x: F.hex(x["id"])), ","), "utf-8").alias("checked")
    )


def grouped(made: DataFrame) -> DataFrame:
    """Recipes that several texts share: recipe, keep_id, group_size."""
    return made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts.

    In: doc_id (unique), text. Out, a row for each input row: doc_id, keep_id (smallest doc_id of its group),
    group_size, kept, text_sha256. Null text counts as empty; texts are equal when identical after each run of white
    space is replaced by one space. A null doc_id sorts after all others: it is kept only where its group has no
    other. Rows with the same doc_id and text are members of one group and are all marked as kept.
    """
    spark = docs.sparkSession
    common.ship_code(spark)
    common.quiet_arrow(spark)
    made = common.stored(recipes(docs), "recipes")
    groups = common.stored(grouped(made), "groups")
    suspects = common.stored(made.join(groups.select("recipe"), "recipe", "left_semi").select("doc_id"), "suspects")
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    parts = common.of_ids(texts, suspects)
    if not suspects.filter("doc_id is null").isEmpty():  # these can't be told apart by id
        parts = parts.union(texts.filter("doc_id is null"))
    parts = chunks(parts)
    same_digest = common.stored(collided(parts), "collided")
    if not same_digest.isEmpty():
        made = made.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(verified(parts, same_digest), ["_id", "text_sha256"], "left").withColumn("recipe", F.coalesce("checked", "recipe")).drop("checked", "_id")
        groups = common.stored(grouped(made), "groups")
    out = made.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("bigint"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
