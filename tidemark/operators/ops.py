"""Runs, calls, descriptors, hashes, audit records, redaction, parameter checks, and the parts of a package that signals ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What marks a field's name as secret, and what its value is replaced by.
SECRET, REDACTED = "key|token|password|secret", "<redacted>"
# Dimensions that each mode always asks for.
MODES = {"quick": [], "deep": ["trend", "technical_risk", "risk_control"], "value": ["peg_strategy", "risk_control"], "trade": ["trend", "support_resistance", "risk_control"]}


def run_stats(runs: DataFrame, top: int = 10) -> DataFrame:
    """Rows (kind, name, runs, tokens, cost): the total, each mode, and the tickers with the most runs; ties go by name."""
    sets = runs.groupingSets([[], ["mode"], ["ticker"]], "mode", "ticker").agg(F.grouping("mode").alias("_m"), F.grouping("ticker").alias("_t"), F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    kind = F.when(F.col("_m") == 0, "mode").when(F.col("_t") == 0, "ticker").otherwise("total")
    f = sets.withColumn("kind", kind).withColumn("name", F.when(F.col("kind") == "mode", F.col("mode")).when(F.col("kind") == "ticker", F.col("ticker")).otherwise(""))
    rest, tickers = f.filter("kind != 'ticker'"), f.filter("kind = 'ticker'").orderBy(F.desc("runs"), "name").limit(top)
    return rest.unionByName(tickers).select("kind", "name", "runs", "tokens", "cost")


def call_stats(calls: DataFrame) -> DataFrame:
    """Rows (name, calls, errors, seconds) for each method and, with an empty name, for all."""
    bad = F.count_if(F.coalesce("error", F.lit("")) != "")
    f = calls.rollup("method").agg(F.grouping("method").alias("_all"), F.count("*").alias("calls"), bad.alias("errors"), F.round(F.sum("elapsed"), 2).alias("seconds"))
    return f.select(F.when(F.col("_all") == 1, "").otherwise(F.col("method")).alias("name"), "calls", "errors", "seconds")


def descriptor(symbols: DataFrame, dataset: str, frame: DataFrame, day: Column, quality: DataFrame | None = None) -> DataFrame:
    """What each symbol has of a dataset: rows, the last day, and its quality: as it is given, else ok with rows and partial without."""
    have = frame.groupBy("symbol").agg(F.count("*").alias("row_count"), F.max(day).alias("as_of"))
    f = symbols.select("symbol").distinct().join(have, "symbol", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    default = F.when(F.col("row_count") > 0, "ok").otherwise("partial")
    if quality is not None:
        f = f.join(quality.filter(F.col("dataset") == dataset).select("symbol", F.col("quality").alias("_q")), "symbol", "left").withColumn("quality", F.coalesce("_q", default)).drop("_q")
    else:
        f = f.withColumn("quality", default)
    return f.select("symbol", F.lit(dataset).alias("dataset"), "row_count", "as_of", "quality")


def data_hash(bars: DataFrame, digits: int = 4) -> DataFrame:
    """SHA-256 of each symbol's bars as a tree: of its years in order, those of their days' digests in order.

    A day's digest is of day, open, high, low, close and volume, prices as whole numbers of the last digit. So no task holds
    more than the digests of a year's days or of a symbol's years.
    """
    whole = lambda c: F.floor(F.col(c) * 10**digits + 0.5003).cast("bigint").cast("string")
    row = F.concat_ws(" ", F.col("trade_date").cast("string"), *[F.coalesce(whole(c), F.lit("-")) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume").cast("bigint").cast("string"), F.lit("-")))
    node = lambda key, digest: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), digest.alias("d")))), lambda x: x["d"]), ","), 256)
    days = bars.select("symbol", F.year("trade_date").alias("y"), F.col("trade_date").alias("day"), F.sha2(row, 256).alias("digest"))
    years = days.groupBy("symbol", "y").agg(node(F.col("day"), F.col("digest")).alias("digest"))
    return years.groupBy("symbol").agg(node(F.col("y"), F.col("digest")).alias("data_hash"))


def audit_record(requests: DataFrame, bars: DataFrame, results: DataFrame, strategy: str, adjustment: str, keys: list[str]) -> DataFrame:
    """One row for each run: digests of its request, of the bars and of its results, with versions; no curve and no prices.

    requests and results are keyed by symbol and ``keys``; a run's result rows are put in order before they are digested.
    """
    by = ["symbol", *keys]
    asked = requests.select(*by, F.sha2(F.to_json(F.struct(*requests.columns)), 256).alias("request_fingerprint"))
    rest = [c for c in results.columns if c not in by]
    done = results.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))), 256).alias("result_digest"))
    fixed = {"strategy_version": strategy, "adjustment": adjustment, "audit_schema_version": "backtest-run-v1", "determinism": "deterministic_no_random_state"}
    return asked.join(done, by).join(data_hash(bars), "symbol").withColumns({k: F.lit(v) for k, v in fixed.items()})


def redacted(kind: T.DataType, value: Column) -> Column:
    """A nested value with all fields of secret-like names replaced, in structs, maps and arrays at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_hidden(f.name, f.dataType, value[f.name]).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redacted(kind.elementType, x))
    if isinstance(kind, T.MapType):
        inner = lambda k, v: redacted(kind.valueType, v)
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(F.lower(k).rlike(SECRET), REDACTED).otherwise(v))
        # a value that isn't text can't be replaced by a mark: the key stays, its value is null
        return F.transform_values(value, lambda k, v: F.when(~F.coalesce(F.lower(k).rlike(SECRET), F.lit(False)), inner(k, v)))
    return value


def _hidden(name: str, kind: T.DataType, value: Column) -> Column:
    if any(mark in name.lower() for mark in SECRET.split("|")):
        return F.lit(REDACTED)
    return redacted(kind, value)


def redact(frame: DataFrame) -> DataFrame:
    """A table with all secret-like columns and nested fields replaced; secret-like keys of maps whose values aren't text go."""
    return frame.select(*[_hidden(f.name, f.dataType, F.col(f.name)).alias(f.name) for f in frame.schema.fields])


POSITIVE = ["rsi_period", "macd_fast", "macd_slow", "macd_signal", "bollinger_period", "kdj_n", "kdj_m1", "kdj_m2"]


def check_parameters(rows: DataFrame) -> DataFrame:
    """Adds ``reason``, why a row of parameters is rejected: the first that holds, null where the row is valid.

    Means: at least one period, positive, none twice. Other periods and the width are positive. Fast below slow, cash
    positive, a known adjustment. Columns that the table lacks aren't checked.
    """
    have = set(rows.columns)
    no = lambda c: ~F.coalesce(F.col(c) > 0, F.lit(False))
    rules: list[tuple[str, Column]] = []
    if "ma_periods" in have:
        ma = F.coalesce("ma_periods", F.array().cast("array<int>"))
        rules += [("ma_periods", (F.size(ma) == 0) | F.exists(ma, lambda x: F.coalesce(x <= 0, F.lit(True)))), ("ma_repeated", F.size(F.array_distinct(ma)) < F.size(ma))]
    rules += [(c, no(c)) for c in [*POSITIVE, "bollinger_std", "ma_fast", "ma_slow"] if c in have]
    if {"ma_fast", "ma_slow"} <= have:
        rules.append(("order", F.col("ma_fast") >= F.col("ma_slow")))
    rules += [("initial_cash", no("initial_cash"))] if "initial_cash" in have else []
    rules += [("adjustment", ~F.coalesce(F.col("adjustment").isin("none", "qfq", "hfq"), F.lit(False)))] if "adjustment" in have else []
    reason = F.coalesce(*[F.when(cond, name) for name, cond in rules], F.lit(None).cast("string"))
    return rows.withColumn("reason", reason)


def context_tags(signals: DataFrame) -> DataFrame:
    """Adds ``tags``, the dimensions that a mode and the current signals ask for, each once, in order of first mention.

    signals: mode, trend, macd_cross, rsi_state, kdj_state, boll_state, volume_ratio, supports, resistances (counts),
    buy_confidence, sell_confidence, risk_level, valuation_level, quality, gaps (a count). Nulls ask for nothing.
    """
    c = F.col
    tag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    always = F.coalesce(*[F.when(c("mode") == m, F.array(*map(F.lit, names)).cast("array<string>")) for m, names in MODES.items()], F.array().cast("array<string>"))
    edge = ["overbought", "oversold"]
    high = c("risk_level").isin("high", "medium_high")
    found = F.array(
        tag(c("trend").isNotNull(), "trend"), tag(c("macd_cross").isin("golden", "death"), "macd"), tag(c("rsi_state").isin(edge), "rsi"), tag(c("kdj_state").isin(edge), "kdj"), tag(c("boll_state") != "inside", "bollinger"),
        tag((c("volume_ratio") > 1.5) | (c("volume_ratio") < 0.7), "volume"), tag((c("supports") > 0) | (c("resistances") > 0), "support_resistance"), tag(c("buy_confidence") >= 50, "buy_signal"), tag(c("sell_confidence") >= 50, "sell_signal"),
        tag(c("risk_level").isNotNull(), "risk_analysis"), tag(high, "risk_control"), tag(c("valuation_level").isNotNull(), "market_patterns"),
        tag(c("mode").isin("value", "trade") & c("valuation_level").isin("low", "very_low"), "investment_cases"), tag((F.coalesce("quality", F.lit("ok")) != "ok") | (c("gaps") > 0), "risk_control"),
    )
    return signals.withColumn("tags", F.array_distinct(F.concat(always, F.array_compact(found))))
