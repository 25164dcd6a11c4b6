"""Files: tolerant reads, run logs, binary indexes, exports with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digests
from .versions import exists


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a folder; a corrupt one counts as absent, not as an error."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def read_dataset(spark: SparkSession, folder: str, name: str, schema: str) -> tuple[DataFrame, str]:
    """A dataset of a folder and how it was found: ``name.parquet``, else ``name.csv`` (with a header), else an empty frame of the schema (none)."""
    for kind in ("parquet", "csv"):
        path = f"{folder.rstrip('/')}/{name}.{kind}"
        if exists(spark, path):
            reader = spark.read.schema(schema)
            return (reader.parquet(path) if kind == "parquet" else reader.option("header", "true").option("enforceSchema", "false").csv(path)), kind
    return spark.createDataFrame([], schema), "none"


def read_log(spark: SparkSession, path: str, schema: str, newest: str, most: int = 20) -> DataFrame:
    """The newest valid lines of JSON-lines logs; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(newest)).limit(most)


def index_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size and SHA-256 of the content of each file below a folder.

    Files of more than ``digests.PIECE`` bytes are read piece by piece, each piece by another task. Only one that is named
    like a packed file (``.gz``) is read by one task whatever its size, and has at most 2 GB.
    """
    read = lambda: spark.read.format("binaryFile")
    found = read().option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    large = {r["path"]: r["length"] for r in found.filter(F.col("length") > digests.PIECE).select("path", "length").collect()}
    pieces = {p: n for p, n in large.items() if digests.splittable(spark, p)}
    whole = found.filter(F.col("length") <= digests.PIECE)
    if len(pieces) < len(large):
        whole = whole.union(read().load([digests.escaped(p) for p in large if p not in pieces]))
    out = whole.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    if pieces:
        rows = [(p, pieces[p], digest) for p, digest in digests.sha256(spark, pieces).items()]
        out = out.union(spark.createDataFrame(rows, "path string, size bigint, sha256 string"))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("member"), "size", "sha256")


def export(table: DataFrame, path: str, name: str) -> DataFrame:
    """Write a table as CSV below ``path`` and its manifest as JSON; returns the manifest, one row."""
    target = f"{path}/{name}.csv"
    table.write.mode("overwrite").option("header", "true").csv(target)
    written = table.sparkSession.read.option("header", "true").schema(table.schema).csv(target)
    manifest = written.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), F.lit(target).alias("output"), "row_count", F.lit(",".join(table.columns)).alias("columns"))
    manifest.write.mode("overwrite").json(f"{path}/{name}.manifest")
    return manifest
