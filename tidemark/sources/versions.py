"""Tables that change in whole steps: every state is a version, and a version is one small pointer file.

A writer lays new files beside the old ones and then puts down the pointer of the next version, by a rename that doesn't
replace. Until then readers see the state before; a job that dies leaves files that no pointer names. A second writer that
began from the same version finds its pointer taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import pit


class Conflict(RuntimeError):
    """Another writer has put down the version."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Versions:
    """The pointers below ``path``: JSON objects by version number, from 1 on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The newest version, 0 where there is none."""
        p, fs = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def get(self, version: int) -> dict:
        p, fs = self._fs(f"{self.path}/versions/{version:012d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, version: int, pointer: dict) -> None:
        """Make ``pointer`` the version, all at once; ``Conflict`` where that version is there."""
        jvm = self.spark._jvm
        target, fs = self._fs(f"{self.path}/versions/{version:012d}")
        new = jvm.org.apache.hadoop.fs.Path(f"{self.path}/new/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        stream = fs.create(new, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if fs.exists(target):
            raise Conflict(f"version {version} of {self.path} was written by another")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(new, target, options)  # fails where the target is there
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"version {version} of {self.path} was written by another") from e
            raise


class Store:
    """Rows in Parquet files by year of ``day`` and by a bucket of the other keys, listed in a manifest with the range of each file.

    The manifest is a table itself (year, bucket, path, first and last day, smallest and largest of the first key, rows), so the
    driver sees only the paths that a read needs. Rows without a day lie in year 0.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], day: str = "trade_date", buckets: int = 4):
        self.spark, self.path, self.keys, self.day, self.buckets = spark, path.rstrip("/"), keys, day, buckets
        self.name = next(k for k in keys if k != day)
        self.versions = Versions(spark, path)

    # --- reading

    def manifest(self, version: int | None = None) -> tuple[int, DataFrame, StructType]:
        """A version (the newest), its files and the schema of their rows."""
        version = version or self.versions.last()
        pointer = self.versions.get(version)
        return version, self.spark.read.schema(FILE).parquet(f"{self.path}/{pointer['manifest']}"), StructType.fromJson(pointer["schema"])

    def _rows(self, files: DataFrame, schema: StructType) -> DataFrame:
        paths = sorted(f"{self.path}/{r['path']}" for r in files.select("path").collect())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        _, files, schema = self.manifest(version)
        return self._rows(files, schema)

    def between(self, start: str, end: str, version: int | None = None) -> DataFrame:
        """Rows from ``start`` to ``end``, both included, from the files whose range meets it."""
        _, files, schema = self.manifest(version)
        first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
        return self._rows(files.filter((F.col("last_day") >= first) & (F.col("first_day") <= last)), schema).filter(F.col(self.day).between(first, last))

    # --- writing

    def _placed(self, rows: DataFrame) -> DataFrame:
        others = [k for k in self.keys if k != self.day]
        return rows.withColumns({"_year": F.coalesce(F.year(self.day), F.lit(0)), "_bucket": F.pmod(F.xxhash64(*others), F.lit(self.buckets)).cast("int")})

    def _laid_down(self, rows: DataFrame) -> DataFrame:
        """Write rows as new files; their entries for the manifest."""
        folder = f"files/{uuid.uuid4().hex}"
        base = f"{self.path}/{folder}"
        self._placed(rows).repartition("_year", "_bucket").sortWithinPartitions("_year", "_bucket", *self.keys).write.partitionBy("_year", "_bucket").parquet(base)
        name = F.regexp_extract(F.input_file_name(), f"({folder}/.*)$", 1)
        there = self.spark.read.schema(StructType([*rows.schema.fields, *StructType.fromDDL("_year int, _bucket int").fields])).parquet(base)
        day, key = F.col(self.day).cast("date"), F.col(self.name).cast("string")
        return there.groupBy(F.col("_year").alias("year"), F.col("_bucket").alias("bucket"), F.url_decode(name).alias("path")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))

    def _swap(self, before: int, files: DataFrame, schema: StructType) -> int:
        """Write the manifest of the next version, then its pointer."""
        name = f"manifests/{uuid.uuid4().hex}"
        files.select(*[f.split()[0] for f in FILE.split(", ")]).coalesce(1).write.parquet(f"{self.path}/{name}")
        self.versions.put(before + 1, {"manifest": name, "schema": schema.jsonValue()})
        return before + 1

    def write(self, rows: DataFrame) -> Store:
        """Lay down a new store."""
        self._swap(0, self._laid_down(rows), rows.schema)
        return self

    def touched(self, files: DataFrame, rows: DataFrame, by_range: bool) -> DataFrame:
        """Files of the years and buckets of ``rows``; ``by_range``: only those whose range of days and of the first key can hold some of them."""
        own = self._placed(rows).groupBy(F.col("_year").alias("year"), F.col("_bucket").alias("bucket")).agg(F.min(F.col(self.day).cast("date")).alias("_from"), F.max(F.col(self.day).cast("date")).alias("_to"), F.min(F.col(self.name).cast("string")).alias("_low"), F.max(F.col(self.name).cast("string")).alias("_high"))
        met = files.join(own, ["year", "bucket"])
        if by_range:
            apart = (F.col("last_day") < F.col("_from")) | (F.col("first_day") > F.col("_to")) | (F.col("last_key") < F.col("_low")) | (F.col("first_key") > F.col("_high"))
            met = met.filter(~F.coalesce(apart, F.lit(False)))
        return met.select(*files.columns)

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> int:
        """Add rows; of a key the new row wins, of several new ones the first by ``order``. Only the years and buckets that the rows touch are rewritten. Returns the version."""
        before, files, schema = self.manifest()
        new = pit.keep_first(rows, self.keys, order or [F.desc(self.day)])
        old = self.touched(files, rows, False)
        merged = pit.upsert(self._rows(old, schema), new, self.keys).select(*schema.names)
        return self._swap(before, files.join(old.select("path"), "path", "left_anti").unionByName(self._laid_down(merged)), schema)

    def append_new(self, rows: DataFrame) -> int:
        """Add the rows that the store doesn't have, each once; all versions of a key stay. Only files that can hold one of the rows are read. Returns the version."""
        before, files, schema = self.manifest()
        batch = rows.select(*schema.names).distinct()
        have = self._rows(self.touched(files, batch, True), schema)
        fresh = pit.unlike(batch, have, self.keys)
        return self._swap(before, files.unionByName(self._laid_down(fresh)), schema)


FILE = "year int, bucket int, path string, first_day date, last_day date, first_key string, last_key string, n bigint"


class Markers:
    """How far each (symbol, dataset) is covered and when that was last written, merged monotonically from version to version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def read(self) -> DataFrame:
        last = self.versions.last()
        schema = "symbol string, dataset string, earliest_date date, latest_date date, updated_at timestamp"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.versions.get(last)['rows']}") if last else self.spark.createDataFrame([], schema)

    def merge(self, marks: DataFrame) -> int:
        """Add marks (symbol, dataset, earliest_date, latest_date, updated_at): a range never shrinks, the time is that of the newest write."""
        last, name = self.versions.last(), f"rows/{uuid.uuid4().hex}"
        pit.merged_markers(self.read(), marks).write.parquet(f"{self.path}/{name}")
        self.versions.put(last + 1, {"rows": name})
        return last + 1
