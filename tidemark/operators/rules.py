"""Signal rules that users can register, confidence of price levels, invalidation conditions, packages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.store import stored
from . import indicators, risk
from .indicators import latest

Params = dict[str, float]


@dataclass(frozen=True)
class Rule:
    """A rule: defaults of its parameters, helper columns that need windows of their own, and the 0/1 signal."""

    name: str
    description: str
    signal: Callable[[Params, WindowSpec], Column]
    defaults: Params = field(default_factory=dict)
    helpers: Callable[[Params, WindowSpec], dict[str, Column]] = lambda p, w: {}


RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    """Make a rule known by its name; a name can be taken once."""
    if not rule.name or rule.name in RULES:
        raise ValueError(f"rule name {rule.name!r} is empty or taken")
    RULES[rule.name] = rule
    return rule


def effective(rule: Rule, given: Params | None = None) -> Params:
    """Defaults, overridden by what is given; a parameter that the rule doesn't have is an error."""
    if unknown := set(given or {}) - set(rule.defaults):
        raise ValueError(f"{rule.name} has no {sorted(unknown)}")
    return {**rule.defaults, **(given or {})}


def _mean(column: str, n: int, w: WindowSpec) -> Column:
    span = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(span) == n, F.avg(column).over(span))


def _cross(p: Params, w: WindowSpec) -> Column:
    return F.coalesce(_mean("close", int(p["ma_fast"]), w) > _mean("close", int(p["ma_slow"]), w), F.lit(False))


def _moves(p: Params, w: WindowSpec) -> dict[str, Column]:
    move = F.col("close") - F.lag("close").over(w)
    return {"_up": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_dn": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))}


def _cross_and_rsi(p: Params, w: WindowSpec) -> Column:
    n = int(p["rsi_period"])
    value = 100 - 100 / (1 + F.try_divide(_mean("_up", n, w), _mean("_dn", n, w)))
    return _cross(p, w) & (F.coalesce(value, F.lit(0.0)) < p["rsi_floor"])


register(Rule("ma_cross", "fast mean above slow mean", lambda p, w: _cross(p, w).cast("int"), {"ma_fast": 20, "ma_slow": 60}))
register(Rule("ma_cross_rsi", "means cross while the RSI is low; an unknown RSI counts as 0", lambda p, w: _cross_and_rsi(p, w).cast("int"), {"ma_fast": 10, "ma_slow": 30, "rsi_period": 14, "rsi_floor": 40}, _moves))


def apply_rule(bars: DataFrame, name: str, given: Params | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with ``signal``; windows begin anew in each group of ``by``, such as a slice."""
    rule, w = RULES[name], Window.partitionBy(*by).orderBy("trade_date")
    p = effective(rule, given)
    helpers = rule.helpers(p, w)
    return bars.withColumns(helpers).withColumn("signal", rule.signal(p, w)).drop(*helpers) if helpers else bars.withColumn("signal", rule.signal(p, w))


def apply_python(bars: DataFrame, compute: Callable[[pd.DataFrame, Params], pd.Series], params: Params, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A rule in Python over each group's frame, for what columns can't express.

    A group is one symbol's bars (of a slice), bounded by its trading days. Values other than 0 and 1 are an error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trade_date", ignore_index=True)
        found = pd.Series(compute(frame, params)).astype(int)
        if len(found) != len(frame) or not found.isin([0, 1]).all():
            raise ValueError("a rule gives one 0 or 1 for each bar")
        return frame.assign(signal=found.to_numpy())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema)
    return bars.groupBy(*by).applyInPandas(run, f"{schema}, signal int")


def levels_frame(bars: DataFrame) -> DataFrame:
    """One row a symbol, from one pass over the bars: last indicators, levels, targets, trend, and buy and sell confidence."""
    f = risk.with_trend(risk.frame(indicators.all_indicators(bars), with_means=True))
    f = f.withColumns({k: risk.level_list(k) for k in risk.SIDES} | {"buy_targets": risk.target_list("supports"), "sell_targets": risk.target_list("resistances")})
    c, pts = F.col, lambda *cases: F.coalesce(F.coalesce(*[F.when(k, F.lit(v)) for k, v in cases]), F.lit(0.0))
    below, above = F.get("supports", F.lit(0))["distance"], F.get("resistances", F.lit(0))["distance"]
    buy = pts(((c("alignment") == "bullish") & (c("trend_score") >= 45), 1.0), ((c("alignment") == "mixed") & (c("trend_score") >= 50), 0.5)) + pts((c("macd") > c("macd_signal"), 1.0))
    buy = buy + pts((c("rsi_14") < 30, 1.5), (c("rsi_14") <= 60, 1.0)) + pts((below < 10, 1.0)) + pts((c("volume_ratio") < 0.7, 0.5))
    sell = pts((c("alignment") == "bearish", 1.0)) + pts((c("macd") < c("macd_signal"), 1.0)) + pts((c("rsi_14") > 70, 1.5), (c("rsi_14") > 60, 0.5)) + pts((above < 5, 1.5)) + pts((c("trend_score") < 40, 1.0))
    f = f.withColumns({k: F.least(F.round(v * 20), F.lit(100.0)) for k, v in (("buy_confidence", buy), ("sell_confidence", sell))})
    label = lambda k: F.when(c(k) >= 70, "high").when(c(k) >= 50, "medium").when(c(k) >= 30, "low").otherwise("very_low")
    return f.withColumns({"buy_label": label("buy_confidence"), "sell_label": label("sell_confidence")})


def confidence(bars: DataFrame) -> DataFrame:
    """Buy and sell confidence, 0 to 100, of five signals each: trend, MACD, RSI, nearest level, and volume or weakness."""
    near = {"below": F.get("supports", F.lit(0))["distance"], "above": F.get("resistances", F.lit(0))["distance"]}
    return levels_frame(bars).withColumns(near).select("symbol", "alignment", "trend_score", "macd", "macd_signal", "below", "above", "buy_confidence", "buy_label", "sell_confidence", "sell_label")


def level_bundle(bars: DataFrame) -> DataFrame:
    """One row a symbol: lists of supports, resistances and targets with the trend and the confidence."""
    return levels_frame(bars).select("symbol", "close", "alignment", "trend_score", "label", "supports", "resistances", "buy_targets", "sell_targets", "buy_confidence", "sell_confidence", "buy_label", "sell_label")


def comparison(bars: DataFrame, valuation: DataFrame) -> DataFrame:
    """Symbols side by side: last indicators, valuation (symbol, pe_ttm, pb), confidence, and the two nearest levels of each side."""
    f = levels_frame(bars).join(valuation.select("symbol", "pe_ttm", "pb"), "symbol", "left")
    cross = F.when(F.coalesce(F.col("macd") > F.col("macd_signal"), F.lit(False)), "golden").otherwise("death")
    near = lambda k: F.transform(F.slice(k, 1, 2), lambda x: x["price"])
    return f.select("symbol", F.round("close", 2).alias("close"), F.col("direction").alias("trend"), F.round("rsi_14", 1).alias("rsi"), cross.alias("macd_status"), "pe_ttm", "pb", "buy_confidence", "sell_confidence", near("supports").alias("supports"), near("resistances").alias("resistances"))


def rankings(compared: DataFrame, most: int = 3) -> DataFrame:
    """Lowest PE, strongest RSI and highest buy confidence: ranking, rank, symbol, value; ties go by symbol.

    Each ranking is a bounded top list, which Spark takes from each partition first.
    """
    each = [("pe_lowest", "pe_ttm", True), ("rsi_strongest", "rsi", False), ("buy_confidence_highest", "buy_confidence", False)]
    compared = stored(compared, "compared")  # all rankings read it
    tops = [risk.top_of(compared, column, most, ascending).select(F.lit(name).alias("ranking"), "symbol", F.col(column).cast("double").alias("value"), F.lit(1 if ascending else -1).alias("_s")) for name, column, ascending in each]
    w = Window.partitionBy("ranking").orderBy(F.col("value") * F.col("_s"), "symbol")
    return reduce(DataFrame.union, tops).withColumn("rank", F.row_number().over(w)).drop("_s")


def invalidations(levels: DataFrame, exclude: str = "") -> DataFrame:
    """Conditions that end a view, from (symbol, support, resistance, risk_level, gate); ``exclude`` is support or resistance."""
    c = F.col
    item = lambda cond, name, severity, price=None: F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"), (price if price is not None else F.lit(None)).cast("double").alias("price")))
    every = [
        item(c("support").isNotNull(), "price.break_support", "high", c("support")), item(c("resistance").isNotNull(), "price.break_resistance_context", "medium", c("resistance")), item(c("support").isNull() & c("resistance").isNull(), "price.levels_missing", "medium"),
        item(c("risk_level").isin("high", "medium_high"), "risk.reassessment", "high"), item(F.coalesce(c("gate"), F.lit("pass")) != "pass", "data.quality_change", "high"),
    ]
    dropped = {"support": "price.break_support", "resistance": "price.break_resistance_context"}.get(exclude, "")
    return levels.select("symbol", F.posexplode(F.filter(F.array_compact(F.array(*every)), lambda x: x["id"] != dropped)).alias("n", "x")).select("symbol", "n", "x.*")


def package(sections: dict[str, DataFrame], as_of: str) -> DataFrame:
    """One row a symbol: the sections (one row a symbol each) as JSON, with gaps, size in bytes and SHA-256."""
    out, names = None, list(sections)
    for name, f in sections.items():
        part = f.select("symbol", F.struct(*[c for c in f.columns if c != "symbol"]).alias(name))
        out = part if out is None else out.join(part, "symbol", "full")
    gaps = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in names]))
    body = F.to_json(F.struct("symbol", F.lit(as_of).alias("as_of"), *names))
    return out.select("symbol", gaps.alias("gaps"), body.alias("package")).withColumns({"size": F.octet_length("package"), "digest": F.sha2("package", 256)})
