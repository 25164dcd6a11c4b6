"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, tables: str, keys: str, doubles: str = "", sql: str | None = None, digits: int = 4) -> Callable:
    """Register a function of the named tables. Rows are the ``keys`` and the rounded ``doubles``, in both engines.

    Halves are common in the data, so rounding goes up from a little below them: the engines' last bits don't matter then.
    """
    ks, ds, scale = keys.split(), doubles.split(), float(10**digits)

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            out = f(*(view(spark, sf_dir, t, made) for t in tables.split()))
            return out.select(*ks, *[(F.floor(F.col(d).cast("double") * scale + 0.5003).cast("double") / scale + 0.0).alias(d) for d in ds])

        QUERIES[name] = run
        if sql:
            cols = ", ".join([*ks, *[f"floor(CAST({d} AS DOUBLE) * {scale:.1f}e0 + 0.5003e0) / {scale:.1f}e0 + 0.0 AS {d}" for d in ds]])
            ORACLE_SQL[name] = with_views(f"WITH body__ AS ({with_views(sql)}) SELECT {cols} FROM body__")
        return f

    return register
