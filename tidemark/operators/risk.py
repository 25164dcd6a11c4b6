"""Risk, valuation percentiles, price levels, trend strength and confidence, one row per symbol (or level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clip
from .indicators import W, bollinger, full, latest, moving_average, rows


def BACK() -> WindowSpec:  # noqa: N802
    """A symbol's rows from the last one."""
    return Window.partitionBy("symbol").orderBy(F.desc("trade_date"))


def bands(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that x is above."""
    out = F.lit(rest)
    for cut, name in reversed(cuts):
        out = F.when(x > cut, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def returns(bars: DataFrame) -> DataFrame:
    """``ret``, the simple return from the bar before, and ``back``, 1 for the last bar."""
    return bars.withColumns({"ret": F.try_divide(F.col("close"), F.lag("close").over(W())) - 1, "back": F.row_number().over(BACK())})


def volatility(bars: DataFrame) -> DataFrame:
    """Annual volatility in percent (population, 250 days), of all returns and of the last 20, or of all where there are fewer."""
    f = returns(bars).groupBy("symbol").agg(F.count("close").alias("n"), F.stddev_pop("ret").alias("s"), F.stddev_pop(F.when(F.col("back") <= 20, F.col("ret"))).alias("r"), F.count("ret").alias("k"))
    year = lambda c: F.round(F.col(c) * F.sqrt(F.lit(250.0)) * 100, 1)
    f = f.filter("n >= 5").select("symbol", year("s").alias("volatility"), F.when(F.col("k") >= 20, year("r")).otherwise(year("s")).alias("recent_volatility"))
    return f.withColumn("level", bands(F.col("volatility"), [(50, "very_high"), (35, "high"), (20, "medium")], "low"))


def drawdown(bars: DataFrame) -> DataFrame:
    """Largest and current fall from the running high, in percent without sign."""
    f = bars.withColumn("dd", F.try_divide(F.col("close"), F.max("close").over(W().rowsBetween(Window.unboundedPreceding, 0))) - 1)
    f = f.groupBy("symbol").agg(F.count("close").alias("n"), F.min("dd").alias("m"), F.max_by("dd", "trade_date").alias("c")).filter("n >= 5")
    level = bands(-F.col("m") * 100, [(40, "very_high"), (25, "high"), (15, "medium")], "low")
    return f.select("symbol", F.round(F.abs("m") * 100, 1).alias("max_drawdown"), F.round(F.abs("c") * 100, 1).alias("current_drawdown"), level.alias("level"))


def liquidity(bars: DataFrame, unit: float = 1e5) -> DataFrame:
    """Mean volume and amount of the last 20 bars; the level is by amount in ``unit``."""
    f = bars.withColumn("back", F.row_number().over(BACK())).filter("back <= 20").groupBy("symbol").agg(F.avg("volume").alias("avg_volume"), F.avg("amount").alias("avg_amount"))
    return f.withColumn("level", bands(F.col("avg_amount") / unit, [(10, "high"), (3, "medium"), (1, "low")], "very_low"))


#: Points by level: the more risk, the lower the score.
RISK_POINTS = {"volatility": {"very_high": -20, "high": -10, "low": 10}, "drawdown": {"very_high": -20, "high": -10}, "liquidity": {"very_low": -10, "high": 5}}


def risk(bars: DataFrame) -> DataFrame:
    """A score of 50, moved by the levels of volatility, drawdown and liquidity, within 0 to 100; from 70 on the risk is low."""
    parts = {"volatility": volatility(bars), "drawdown": drawdown(bars), "liquidity": liquidity(bars)}
    out, score = None, F.lit(50)
    for name, f in parts.items():
        f = f.withColumnRenamed("level", f"{name}_level")
        out = f if out is None else out.join(f, "symbol", "full")
        points = F.create_map(*[F.lit(x) for kv in RISK_POINTS[name].items() for x in kv])
        score = score + F.coalesce(points[F.col(f"{name}_level")], F.lit(0))
    out = out.withColumn("risk_score", clip(score.cast("double"), 0.0, 100.0))
    c = F.col("risk_score")
    return out.withColumn("risk_level", F.when(c >= 70, "low").when(c >= 50, "medium").when(c >= 30, "medium_high").otherwise("high"))


def price_percentiles(bars: DataFrame, spans: tuple[int, ...] = (250, 750, 1250)) -> DataFrame:
    """Share of the last closes that are not above the current one, with at least 20 of them."""
    f = bars.withColumns({"back": F.row_number().over(BACK()), "now": F.first("close").over(BACK())})
    share = lambda n: F.when(F.count(F.when(F.col("back") <= n, F.col("close"))) >= 20, F.avg(F.when(F.col("back") <= n, (F.col("close") <= F.col("now")).cast("double"))) * 100)
    f = f.groupBy("symbol").agg(*[share(n).alias(f"pct_{n}") for n in spans])
    return f.withColumn("level", bands(F.col(f"pct_{spans[0]}"), [(80, "very_high"), (60, "high"), (40, "medium"), (20, "low")], "very_low"))


def valuation_summary(daily: DataFrame) -> DataFrame:
    """Latest pe_ttm and pb with their bands: PE above 50, 20 and 0, PB above 5 and 1."""
    pe = F.when(F.col("pe_ttm") > 50, "high").when(F.col("pe_ttm") > 20, "fair").when(F.col("pe_ttm") > 0, "low").when(F.col("pe_ttm").isNotNull(), "loss")
    pb = F.when(F.col("pb") > 5, "high").when(F.col("pb") > 1, "fair").when(F.col("pb").isNotNull(), "low")
    return latest(daily).withColumn("summary", F.concat_ws(";", F.concat(F.lit("pe:"), pe), F.concat(F.lit("pb:"), pb)))


def frame(bars: DataFrame, with_means: bool = False) -> DataFrame:
    """Each symbol's last bar with all that levels, targets and trend are made of; ``with_means`` where the means are there already."""
    f = bars if with_means else bollinger(moving_average(bars))
    f = f.withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(W())) - 1)
    spans = {f"{k}_{n}": full(k, n, (F.min if k == "low" else F.max)(k).over(rows(n))) for k in ("low", "high") for n in (20, 60)}
    change = lambda n: F.coalesce((F.try_divide(F.col("close"), F.lag("close", n - 1).over(W())) - 1) * 100, F.lit(0.0))
    f = f.withColumns(spans | {"change_5": change(5), "change_20": change(20), "_dev": F.stddev_pop("_ret").over(rows(60)), "_top": F.max("high").over(rows(60))})
    return latest(f).drop("_ret")


#: Candidates for levels below and above the close; those over 60 bars are strong.
SUPPORTS, RESISTANCES = ["ma_20", "ma_60", "low_20", "low_60", "boll_lower"], ["ma_20", "ma_60", "ma_5", "high_20", "high_60", "boll_upper"]
SIDES = {"supports": (SUPPORTS, -1), "resistances": (RESISTANCES, 1)}


def level_list(side: str, most: int = 5) -> Column:
    """The levels of one side of a row of ``frame``, by their distance from the close in percent, rounded; ties in listed order."""
    candidates, sign = SIDES[side]

    def item(i: int, c: str) -> Column:
        distance = F.round(F.abs(F.col(c) / F.col("close") - 1) * 100, 1)
        level = F.struct(distance.alias("distance"), F.lit(i).alias("i"), F.lit(c).alias("kind"), F.round(c, 2).cast("double").alias("price"), F.lit("strong" if c.endswith("60") else "medium").alias("strength"))
        return F.when((F.col(c) - F.col("close")) * sign > 0, level)

    return F.slice(F.array_sort(F.array_compact(F.array(*[item(i, c) for i, c in enumerate(candidates)]))), 1, most)


def target_list(side: str, most: int = 3) -> Column:
    """Targets of one side: the nearest levels; a strong one near enough has high confidence.

    Without a level, to buy at the close less two deviations of the last 60 returns, or to sell at the 60-day high.
    """
    reach, spare, sure = (10, F.col("close") * (1 - 2 * F.col("_dev")), "low") if side == "supports" else (15, F.col("_top"), "medium")
    one = lambda price, kind, confidence: F.struct(price.cast("double").alias("price"), kind.alias("kind"), confidence.alias("confidence"))
    near = F.transform(F.slice(level_list(side), 1, most), lambda x: one(x["price"], x["kind"], F.when((x["strength"] == "strong") & (x["distance"] < reach), "high").otherwise("medium")))
    other = one(F.round(spare, 2), F.lit("deviation" if side == "supports" else "high_60"), F.lit(sure))
    return F.when(F.size(near) > 0, near).otherwise(F.array(other))


def with_trend(f: DataFrame) -> DataFrame:
    """50, moved by the order of the means, by a change over 20 bars beyond 5 % and by the sign of that over 5, within 0 to 100."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    up, down = yes((F.col("ma_5") > F.col("ma_20")) & (F.col("ma_20") > F.col("ma_60"))), yes((F.col("ma_5") < F.col("ma_20")) & (F.col("ma_20") < F.col("ma_60")))
    score = 50 + F.when(up, 20).when(down, -20).otherwise(0) + F.when(F.col("change_20") > 5, 10).when(F.col("change_20") < -5, -10).otherwise(0) + F.when(F.col("change_5") > 0, 5).otherwise(-5)
    f = f.withColumns({"alignment": F.when(up, "bullish").when(down, "bearish").otherwise("mixed"), "direction": F.when(up, "up").when(down, "down").otherwise("sideways"), "trend_score": clip(score.cast("double"), 0.0, 100.0)})
    f = f.withColumn("ma60_distance", F.coalesce((F.try_divide(F.col("close"), F.col("ma_60")) - 1) * 100, F.lit(0.0)))
    c = F.col("trend_score")
    return f.withColumn("label", F.when(c >= 70, "strong").when(c >= 55, "rather_strong").when(c >= 45, "neutral").when(c >= 30, "rather_weak").otherwise("weak"))


def _levels(bars: DataFrame, side: str, most: int) -> DataFrame:
    found = frame(bars).select("symbol", F.posexplode(level_list(side, most)).alias("rank", "x"))
    return found.select("symbol", (F.col("rank") + 1).alias("rank"), "x.kind", "x.price", "x.distance", "x.strength")


def supports(bars: DataFrame, most: int = 5) -> DataFrame:
    return _levels(bars, "supports", most)


def resistances(bars: DataFrame, most: int = 5) -> DataFrame:
    return _levels(bars, "resistances", most)


def targets(bars: DataFrame) -> DataFrame:
    """Up to three targets of each side, with their confidence."""

    def of(side: str, k: str) -> Column:
        return F.transform(target_list(k), lambda t, i: F.struct(F.lit(side).alias("side"), (i + 1).alias("rank"), t["price"].alias("price"), t["kind"].alias("kind"), t["confidence"].alias("confidence")))

    return frame(bars).select("symbol", F.inline(F.concat(of("buy", "supports"), of("sell", "resistances"))))


def trend_strength(bars: DataFrame) -> DataFrame:
    """The trend of each symbol's last bar."""
    return with_trend(frame(bars))


def top_of(frame: DataFrame, column: str, n: int = 3, ascending: bool = False) -> DataFrame:
    """The n symbols with the highest (or lowest) value; nulls take no part, ties go by symbol."""
    order = F.asc(column) if ascending else F.desc(column)
    return frame.filter(F.col(column).isNotNull()).orderBy(order, "symbol").limit(n)
