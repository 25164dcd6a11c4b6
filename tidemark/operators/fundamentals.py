"""Ratios, growth, scores and data-quality rules over statements and bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import annualization, clip, safe_ratio
from . import pit
from .indicators import W


def _last(df: DataFrame) -> DataFrame:
    return pit.keep_first(df, ["symbol"], [F.desc("end_date")])


def ratios(statements: DataFrame) -> DataFrame:
    """Annualized ROA and ROE on mean balances; without an opening balance the ratio is missing, never replaced."""
    f = pit.opening(statements, ["total_assets", "shareholders_equity"])
    profit, year = F.coalesce("net_profit_attributable", "net_profit"), annualization(F.col("end_date"))
    mean = lambda c: (F.col(c) + F.col(f"open_{c}")) / 2
    roa, roe = safe_ratio(F.col("net_profit") * year, mean("total_assets")), safe_ratio(profit * year, mean("shareholders_equity"))
    return f.select("symbol", "end_date", roa["value"].alias("roa"), roa["status"].alias("roa_status"), roe["value"].alias("roe"), roe["status"].alias("roe_status"))


def ratio_compare(derived: DataFrame, provider: DataFrame) -> DataFrame:
    """Latest derived ROE against the provider's: within max(0.1, 5 %) they are close."""
    f = _last(derived.filter("roe is not null")).join(provider.select("symbol", "end_date", F.col("roe").alias("provider_roe")), ["symbol", "end_date"], "left")
    near = F.abs(F.col("roe") - F.col("provider_roe")) <= F.greatest(F.lit(0.1), F.abs("provider_roe") * 0.05)
    return f.withColumn("status", F.when(F.col("provider_roe").isNull(), "provider_missing").when(near, "close").otherwise("definition_difference"))


def snapshot_ratios(statements: DataFrame) -> DataFrame:
    """Both ratios of a row with calculated or partial and the names of those that are missing."""
    f = ratios(statements)
    gone = F.concat_ws(",", F.when(F.col("roa").isNull(), "roa"), F.when(F.col("roe").isNull(), "roe"))
    return f.withColumn("missing", gone).withColumn("status", F.when(F.col("missing") == "", "calculated").otherwise("partial"))


def above(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that x is above."""
    out = F.lit(rest)
    for c, name in reversed(cuts):
        out = F.when(x > c, name).otherwise(out)
    return F.when(x.isNotNull(), out).otherwise("insufficient")


def revenue_trend(statements: DataFrame) -> DataFrame:
    """Latest revenue, the last growth over a year and the mean growth over all periods that have one."""
    f = pit.year_ago(statements.filter("revenue is not null"), "revenue")
    dated = F.when(F.col("growth").isNotNull(), F.col("end_date"))
    f = f.groupBy("symbol").agg(F.max_by("revenue", "end_date").alias("latest"), F.max_by("growth", dated).alias("growth"), F.avg("growth").alias("mean_growth"), F.count("*").alias("periods"))
    return f.withColumn("status", above(F.col("growth"), [(20, "fast"), (10, "steady"), (0, "slow"), (-10, "slipping")], "falling"))


def profitability(statements: DataFrame, provider: DataFrame | None = None, derived: bool = True) -> DataFrame:
    """Latest ROE: the derived one, else the provider's, and which it was; without ``derived`` the provider's only."""
    f = _last(ratios(statements))
    f = f if derived else f.withColumn("roe", F.lit(None).cast("double"))
    f = f.join(_last(provider).select("symbol", F.col("roe").alias("provider_roe")), "symbol", "left") if provider is not None else f.withColumn("provider_roe", F.lit(None).cast("double"))
    f = f.withColumn("source", F.when(F.col("roe").isNotNull(), "derived").when(F.col("provider_roe").isNotNull(), "provider").otherwise("none"))
    f = f.withColumn("roe", F.coalesce("roe", "provider_roe"))
    return f.withColumn("status", above(F.col("roe"), [(20, "excellent"), (15, "good"), (10, "fair"), (0, "weak")], "loss"))


def profit_quality(income: DataFrame, cash: DataFrame) -> DataFrame:
    """Operating cash flow by net profit at the latest common period; a loss has none."""
    f = _last(income.select("symbol", "end_date", "net_profit").join(cash.select("symbol", "end_date", "operating_cf"), ["symbol", "end_date"]))
    f = f.withColumn("quality", F.when(F.col("net_profit") > 0, F.col("operating_cf") / F.col("net_profit")))
    return f.withColumn("status", F.when(F.col("net_profit") <= 0, "not_applicable").otherwise(above(F.col("quality"), [(1, "excellent"), (0.5, "good"), (0, "fair")], "poor")))


def solvency(balance: DataFrame) -> DataFrame:
    """Latest debt ratio in percent, the provider's where there is one: low below 30, medium below 60."""
    given = F.col("debt_to_assets") if "debt_to_assets" in balance.columns else F.lit(None).cast("double")
    f = _last(balance).withColumn("debt_ratio", F.coalesce(given, F.try_divide(F.col("total_liabilities"), F.col("total_assets")) * 100))
    c = F.col("debt_ratio")
    return f.withColumn("status", F.when(c.isNull(), "insufficient").when(c < 30, "low").when(c < 60, "medium").otherwise("high"))


def profit_growth(statements: DataFrame) -> DataFrame:
    """The last growth of net profit over a year."""
    f = pit.year_ago(statements.filter("net_profit is not null"), "net_profit")
    f = statements.select("symbol").distinct().join(_last(f.filter("growth is not null")), "symbol", "left")
    return f.withColumn("status", above(F.col("growth"), [(30, "fast"), (10, "steady"), (0, "slow")], "falling"))


#: Points by status. A section counts as evidence where its status is known; revenue only where it moves the score.
SCORE_POINTS = {
    "revenue": {"fast": 15, "steady": 10, "falling": -15},
    "roe": {"excellent": 15, "good": 10, "fair": 5, "loss": -15},
    "cash": {"excellent": 10, "good": 5, "poor": -10},
    "debt": {"high": -10},
}


def score(statements: DataFrame, provider: DataFrame | None = None, derived: bool = True) -> DataFrame:
    """50, moved by revenue growth, ROE, cash and debt, within 0 to 100, with the number of sections that are evidence."""
    parts = {"revenue": revenue_trend(statements), "roe": profitability(statements, provider, derived), "cash": profit_quality(statements, statements), "debt": solvency(statements)}
    out = statements.select("symbol").distinct()
    for name, f in parts.items():
        out = out.join(f.select("symbol", F.col("status").alias(name)), "symbol", "left")
    points = [F.coalesce(F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[F.col(n)], F.lit(0)) for n, m in SCORE_POINTS.items()]
    unknown = {n: F.col(n).isNull() | F.col(n).isin("insufficient", "not_applicable") for n in parts} | {"revenue": ~F.coalesce(F.col("revenue").isin(*SCORE_POINTS["revenue"]), F.lit(False))}
    out = out.withColumns({"fundamental_score": clip((reduce(lambda a, b: a + b, points) + 50).cast("double"), 0.0, 100.0), "evidence": reduce(lambda a, b: a + b, [(~x).cast("int") for x in unknown.values()])})
    c = F.col("fundamental_score")
    return out.withColumn("label", F.when(F.col("evidence") == 0, "insufficient").when(c >= 70, "excellent").when(c >= 55, "good").when(c >= 40, "fair").otherwise("poor"))


def score_impact(statements: DataFrame, provider: DataFrame) -> DataFrame:
    """Scores with the provider's ROE only, and with the derived one first, and what that changes."""
    before, after = score(statements, provider, derived=False), score(statements, provider)
    f = before.select("symbol", F.col("fundamental_score").alias("provider_score"), F.col("label").alias("provider_label")).join(after.select("symbol", "fundamental_score", "label"), "symbol")
    return f.withColumns({"change": F.col("fundamental_score") - F.col("provider_score"), "label_changed": F.col("label") != F.col("provider_label")})


def _issues(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each symbol and rule that is broken, with the count."""
    f = df.groupBy("symbol").agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return f.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("symbol", "x.rule", "x.n").filter("n > 0")


def check_bars(bars: DataFrame) -> DataFrame:
    """Missing values by column, jumps of more than 11 %, highs and lows that the body leaves, days without volume."""
    f = bars.withColumn("jump", F.abs(F.try_divide(F.col("close"), F.lag("close").over(W())) - 1) > 0.11)
    c = F.col
    nulls = {f"null_{k}": c(k).isNull() for k in ("open", "high", "low", "close", "volume")}
    return _issues(f, nulls | {"jump": c("jump"), "high_below_body": c("high") < F.greatest("open", "close"), "low_above_body": c("low") > F.least("open", "close"), "zero_volume": c("volume") == 0})


def check_statements(df: DataFrame, never_negative: tuple[str, ...] = ("total_assets", "revenue")) -> DataFrame:
    """Columns more than half of which is missing, periods more than 200 days apart, negative values where there are none."""
    gap = F.datediff("end_date", F.lag("end_date").over(Window.partitionBy("symbol").orderBy("end_date"))) > 200
    fields = [k for k in df.columns if k not in ("symbol", "end_date")]
    out = _issues(df.withColumn("gap", gap), {"period_gap": F.col("gap"), **{f"negative_{k}": F.col(k) < 0 for k in never_negative}})
    share = null_ratios(df, fields).filter("ratio > 0.5").select("symbol", F.concat(F.lit("null_"), "field").alias("rule"), F.lit(1).cast("bigint").alias("n"))
    return out.unionByName(share)


def null_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    f = df.groupBy("symbol").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return f.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("ratio")) for c in columns])).alias("x")).select("symbol", "x.*")


def factor_coverage(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Whether the factors' dates contain the bars'."""
    b = bars.groupBy("symbol").agg(F.min("trade_date").alias("b0"), F.max("trade_date").alias("b1"))
    f = factors.groupBy("symbol").agg(F.min("trade_date").alias("f0"), F.max("trade_date").alias("f1"))
    return b.join(f, "symbol", "left").select("symbol", F.coalesce((F.col("f0") <= F.col("b0")) & (F.col("f1") >= F.col("b1")), F.lit(False)).alias("covered"))


def report(symbols: DataFrame, *rules: DataFrame) -> DataFrame:
    """One row a symbol: whether it is valid, the number of issues of all rule tables, and their names."""
    every = reduce(DataFrame.unionByName, rules).groupBy("symbol").agg(F.count("*").alias("warnings"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("details"))
    f = symbols.select("symbol").distinct().join(every, "symbol", "left")
    return f.withColumns({"warnings": F.coalesce("warnings", F.lit(0)), "details": F.coalesce("details", F.lit("")), "valid": F.col("warnings").isNull()})


def bar_contract(bars: DataFrame) -> DataFrame:
    """Violations of what strategies need, by symbol: valid unique dates and finite positive prices. A column that isn't there or a table without rows is an error."""
    gone = [c for c in ("trade_date", "open", "close") if c not in bars.columns]
    if gone:
        raise ValueError(f"bars lack {', '.join(gone)}")
    if bars.isEmpty():
        raise ValueError("no bars")
    f = bars.withColumn("k", F.count("*").over(Window.partitionBy("symbol", "trade_date")))
    ok = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) != float("inf")), F.lit(False))
    return f.groupBy("symbol").agg(F.count_if(F.col("trade_date").isNull() | (F.col("k") > 1)).alias("bad_dates"), F.count_if(~ok("open") | ~ok("close")).alias("bad_prices"))
