"""Paths in the folder that all machines share, and tables that are written there and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``); a local one only where Spark runs locally."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_tidemark_dir", None)
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        given = sc._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what several branches of a plan read: it is computed once, and a lost executor loses nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
