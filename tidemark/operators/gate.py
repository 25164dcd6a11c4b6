"""The deterministic gate before an analysis: checks of the inputs by symbol, then pass, degraded or block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pit

PRICES = ["open", "high", "low", "close", "volume"]
ADJUSTMENTS, QUALITIES = ["none", "qfq", "hfq"], ["ok", "partial", "stale", "invalid"]
#: By the worst check: the gate and the cap on confidence.
OUTCOMES = {"fail": ("block", 0), "warn": ("degraded", 60), "pass": ("pass", 80)}


def _listed(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows of (symbol, check_id, status); a status of null means that the check doesn't apply."""
    items = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in checks.items()])
    return frame.select("symbol", F.inline(items)).filter("status is not null")


def _market(requests: DataFrame, bars: DataFrame, adjustment: str) -> DataFrame:
    c, gone = F.col, [k for k in ["trade_date", *PRICES] if k not in bars.columns]
    if gone:
        return _listed(requests, {"request.date": F.when(c("requested").isNull(), "fail"), "daily.required": F.lit("fail"), "daily.adjustment": F.lit("pass" if adjustment in ADJUSTMENTS else "fail")})
    value = {k: c(k).try_cast("double") for k in PRICES}
    odd = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in value.values()])
    body = [value["open"], value["close"]]
    outside = (value["high"] < F.greatest(*body)) | (value["low"] > F.least(*body)) | (F.least(*[value[k] for k in PRICES[:4]]) <= 0) | (value["volume"] < 0)
    day = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(c("trade_date").isNull()).alias("undated"), F.max("trade_date").alias("last"), F.count_if(odd).alias("odd"), F.count_if(outside).alias("outside"))
    f = requests.join(day, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    have, dated = c("n") > 0, (c("n") > 0) & (c("undated") == 0)
    return _listed(f, {
        "request.date": F.when(c("requested").isNull(), "fail"),
        "daily.required": F.when(have, "pass").otherwise("fail"),
        "daily.date": F.when(have & ~dated, "fail").when(have & (c("last") > c("requested")), "fail").when(have & (c("last") < c("requested")), "warn").when(have, "pass"),
        "calendar.request_date": F.when(dated & (F.weekday("requested") >= 5), "warn"),
        "daily.finite": F.when(have, F.when(c("odd") > 0, "fail").otherwise("pass")),
        "daily.range": F.when(have & (c("odd") == 0), F.when(c("outside") > 0, "fail").otherwise("pass")),
        "daily.adjustment": F.lit("pass" if adjustment in ADJUSTMENTS else "fail"),
    })


def _statements(requests: DataFrame, name: str, frame: DataFrame, quality: DataFrame) -> DataFrame:
    c = F.col
    f = requests.join(frame.withColumn("_announced", pit.announced(frame)).withColumn("_row", F.lit(1)), "symbol", "left")
    f = f.groupBy("symbol", "requested").agg(
        F.count("_row").alias("n"), F.count_if(c("_row").isNotNull() & c("end_date").isNull()).alias("undated"), F.max("end_date").alias("last"), F.count_distinct("end_date").alias("periods"), F.count("end_date").alias("dated"),
        F.count_if(c("_announced") > c("requested")).alias("early"),
    )
    f = f.join(quality.filter(c("dataset") == name).select("symbol", "quality"), "symbol", "left")
    have = (c("n") > 0) & c("requested").isNotNull()
    return _listed(f, {
        f"financial.{name}.missing": F.when((c("n") == 0) & ~c("quality").eqNullSafe("invalid"), "warn"),
        f"financial.{name}.period": F.when(have & ((c("undated") > 0) | (c("last") > c("requested"))), "fail"),
        f"financial.{name}.revision": F.when(have & (c("dated") > c("periods")), "warn"),
        f"financial.{name}.announcement": F.when(have & (c("early") > 0), "fail"),
    })


def checks(requests: DataFrame, bars: DataFrame, datasets: dict[str, DataFrame], quality: DataFrame, gaps: DataFrame, adjustment: str = "none") -> DataFrame:
    """Checks of each request (symbol, requested: text of a day): symbol, check_id, status (pass, warn or fail).

    bars are those of the market, datasets the statements by name, quality has (symbol, dataset, quality), gaps (symbol,
    gap). Missing statements degrade, unusable prices and what was known later only block.
    """
    asked = requests.select("symbol", F.expr("try_to_timestamp(requested, 'yyyy-MM-dd')").cast("date").alias("requested")).distinct()
    q = F.col("quality")
    stated = quality.join(asked.select("symbol"), "symbol", "left_semi").select("symbol", F.concat(F.lit("quality."), "dataset").alias("check_id"), F.when(~F.coalesce(q.isin(QUALITIES), F.lit(False)) | (q == "invalid"), "fail").when(q != "ok", "warn").alias("status")).filter("status is not null")
    lacking = gaps.join(asked.select("symbol"), "symbol", "left_semi").select("symbol", F.lit("data.gaps").alias("check_id"), F.lit("warn").alias("status")).distinct()
    parts = [_market(asked, bars, adjustment), *[_statements(asked, k, f, quality) for k, f in datasets.items()], stated, lacking]
    return reduce(DataFrame.unionByName, parts)


def gate(checked: DataFrame) -> DataFrame:
    """One row a symbol: checks, warnings, failures, the gate and the cap on confidence."""
    f = checked.groupBy("symbol").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "fail").alias("failures"))
    worst = F.when(F.col("failures") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass")
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[i])])[worst]
    return f.withColumns({"gate": pick(0), "cap": pick(1)})
