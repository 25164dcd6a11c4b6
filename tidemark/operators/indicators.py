"""Technical indicators of all symbols over one window specification."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

By = Callable[[], WindowSpec]


def W() -> WindowSpec:  # noqa: N802
    """A symbol's rows in order of date."""
    return Window.partitionBy("symbol").orderBy("trade_date")


def blocked_order() -> WindowSpec:
    """The same order over rows that ``blocked`` has dealt to blocks: windows in blocks and over all of them share one sort."""
    return Window.partitionBy("symbol").orderBy("_b", "trade_date")


def rows(n: int, by: By = W) -> WindowSpec:
    return by().rowsBetween(-(n - 1), 0)


def full(column: str, n: int, value: Column, by: By = W) -> Column:
    """``value`` only where the last n rows all have the column."""
    return F.when(F.count(column).over(rows(n, by)) == n, value)


def moving_average(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60), column: str = "close", by: By = W) -> DataFrame:
    return bars.withColumns({f"ma_{p}": full(column, p, F.avg(column).over(rows(p, by)), by) for p in periods})


def blocked(bars: DataFrame, block: int = 500) -> DataFrame:
    """Row number ``_i`` of each symbol from 0, and its block ``_b``."""
    return bars.withColumn("_i", F.row_number().over(W()) - 1).withColumn("_b", F.floor(F.col("_i") / block))


def ewms(frame: DataFrame, means: dict[str, tuple[str, float]], block: int = 500) -> DataFrame:
    """Exponential means, by name of column and alpha, of ``blocked`` rows, with adjusted weights; nulls have no weight and keep the
    mean so far.

    Sums in a block are relative to its start, so that weights don't overflow. A block's whole sums are on its last row; they
    enter later blocks by their distance as long as they count. All means go through the same windows.
    """
    inside = Window.partitionBy("symbol", "_b").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    before = blocked_order().rowsBetween(Window.unboundedPreceding, -1)
    f, made = frame.withColumn("_k", F.col("_i") - F.col("_b") * block), []
    terms, sums = {}, {}
    for out, (column, alpha) in means.items():
        weight = F.pow(F.lit(1 / (1 - alpha)), F.col("_k"))
        terms |= {f"_n_{out}": F.when(F.col(column).isNotNull(), weight * F.col(column)).otherwise(0.0), f"_d_{out}": F.when(F.col(column).isNotNull(), weight).otherwise(0.0)}
    sums = {c: F.sum(c).over(inside) for c in terms}
    f, names = f.withColumns(terms).withColumns(sums), list(terms)
    back = {out: max(1, math.ceil(math.log(1e-18) / math.log(1 - alpha) / block)) for out, (_, alpha) in means.items()}
    last = F.col("_k") == block - 1
    for k in range(1, max(back.values()) + 1):
        # The sums at the end of the k-th block before: of the block before where k is 1, then what that block's last row has of its own.
        source = {c: F.col(c) if k == 1 else F.col(f"{c}_{k - 1}") for c in names}
        f = f.withColumns({f"{c}_{k}": F.last(F.when(last, source[c]), ignorenulls=True).over(before) for c in names})
        made += [f"{c}_{k}" for c in names]
    out_columns = {}
    for out, (_, alpha) in means.items():
        carried = lambda c, out=out, alpha=alpha: sum((F.coalesce(f"{c}_{k}", F.lit(0.0)) * (1 - alpha) ** (k * block) for k in range(1, back[out] + 1)), F.col(c))
        top, below = carried(f"_n_{out}"), carried(f"_d_{out}")
        out_columns[out] = F.when(below > 0, F.try_divide(top, below))
    return f.withColumns(out_columns).drop("_k", *names, *made)


def ewm(frame: DataFrame, column: str, out: str, alpha: float, block: int = 500) -> DataFrame:
    """One exponential mean."""
    return ewms(blocked(frame, block), {out: (column, alpha)}, block).drop("_i", "_b")


def ema(bars: DataFrame, periods: tuple[int, ...] = (12, 26)) -> DataFrame:
    return ewms(blocked(bars), {f"ema_{p}": ("close", 2 / (p + 1)) for p in periods}).drop("_i", "_b")


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0, by: By = W) -> DataFrame:
    mid, dev = F.avg("close").over(rows(period, by)), F.stddev_samp("close").over(rows(period, by))
    f = bars.withColumns({"boll_mid": full("close", period, mid, by), "_dev": full("close", period, dev, by)})
    f = f.withColumns({"boll_upper": F.col("boll_mid") + width * F.col("_dev"), "boll_lower": F.col("boll_mid") - width * F.col("_dev")})
    span = F.col("boll_upper") - F.col("boll_lower")
    return f.withColumns({"boll_width": F.try_divide(span, F.col("boll_mid")), "boll_pct": F.try_divide(F.col("close") - F.col("boll_lower"), span)}).drop("_dev")


def rsi(bars: DataFrame, period: int = 14, by: By = W) -> DataFrame:
    """Plain rolling means; no loss with a gain is 100, neither is null; the first change counts as none."""
    move = F.coalesce(F.col("close") - F.lag("close").over(by()), F.lit(0.0))
    f = bars.withColumn("_m", move).withColumns({"_up": F.greatest("_m", F.lit(0.0)), "_dn": F.greatest(-F.col("_m"), F.lit(0.0))})
    f = f.withColumns({"_g": full("_up", period, F.avg("_up").over(rows(period, by)), by), "_l": full("_dn", period, F.avg("_dn").over(rows(period, by)), by)})
    value = F.when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0).when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return f.withColumn(f"rsi_{period}", value).drop("_m", "_up", "_dn", "_g", "_l")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    f = ewms(blocked(bars), {"_f": ("close", 2 / (fast + 1)), "_s": ("close", 2 / (slow + 1))})
    f = ewms(f.withColumn("macd", F.col("_f") - F.col("_s")), {"macd_signal": ("macd", 2 / (signal + 1))})
    return f.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s", "_i", "_b")


def raw_stochastic(bars: DataFrame, n: int, by: By = W) -> DataFrame:
    """``_rsv``, where the close lies between the low and the high of n rows, in percent."""
    low, high = F.min("low").over(rows(n, by)), F.max("high").over(rows(n, by))
    return bars.withColumn("_rsv", full("close", n, F.when(high > low, (F.col("close") - low) / (high - low) * 100), by))


def kdj(bars: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    f = ewms(raw_stochastic(blocked(bars), n, blocked_order), {"kdj_k": ("_rsv", 1 / m1)})
    f = ewms(f, {"kdj_d": ("kdj_k", 1 / m2)})
    return f.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("_rsv", "_i", "_b")


def cci(bars: DataFrame, period: int = 20, by: By = W) -> DataFrame:
    f = bars.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    f = f.withColumns({"_sma": full("_tp", period, F.avg("_tp").over(rows(period, by)), by), "_list": F.collect_list("_tp").over(rows(period, by))})
    mad = F.aggregate("_list", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_sma"))) / period
    return f.withColumn("cci", F.try_divide(F.col("_tp") - F.col("_sma"), 0.015 * mad)).drop("_tp", "_sma", "_list")


def williams_r(bars: DataFrame, period: int = 14, by: By = W) -> DataFrame:
    high, low = F.max("high").over(rows(period, by)), F.min("low").over(rows(period, by))
    return bars.withColumn("williams_r", full("close", period, F.try_divide(high - F.col("close"), high - low) * -100, by))


def obv(bars: DataFrame, period: int = 20, by: By = W) -> DataFrame:
    move = F.signum(F.col("close") - F.lag("close").over(by())) * F.col("volume")
    f = bars.withColumn("_s", F.coalesce(move, F.col("volume")))
    f = f.withColumn("obv", F.sum("_s").over(by().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return f.withColumn("obv_ma", full("obv", period, F.avg("obv").over(rows(period, by)), by))


def volume_ratio(bars: DataFrame, period: int = 20, by: By = W) -> DataFrame:
    return bars.withColumn("volume_ratio", F.try_divide(F.col("volume"), full("volume", period, F.avg("volume").over(rows(period, by)), by)))


def all_indicators(bars: DataFrame, boll: int = 20, rsi_period: int = 14) -> DataFrame:
    """All of them in one shuffle and two sorts: the rows are dealt to blocks first, and every later window keeps that order.

    The exponential means take two passes: EMA and K, then the MACD signal and D, which are means of those.
    """
    by = blocked_order
    f = raw_stochastic(moving_average(blocked(bars), by=by), 9, by)
    f = ewms(f, {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27), "kdj_k": ("_rsv", 1 / 3)})
    f = ewms(f.withColumn("macd", F.col("ema_12") - F.col("ema_26")), {"macd_signal": ("macd", 0.2), "kdj_d": ("kdj_k", 1 / 3)})
    f = f.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")}).drop("_rsv")
    f = rsi(bollinger(f, boll, by=by), rsi_period, by)
    return volume_ratio(obv(williams_r(cci(f, boll, by), rsi_period, by), by=by), boll, by).drop("_i", "_b")


def latest(frame: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    last = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return frame.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def summary(indicators: DataFrame) -> DataFrame:
    """Latest state of each symbol: trend, MACD, RSI, KDJ and Bollinger position, where missing values fall to the last case."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    up = yes((c("ma_5") > c("ma_20")) & (c("ma_20") > c("ma_60")))
    down = yes((c("ma_5") < c("ma_20")) & (c("ma_20") < c("ma_60")))
    return latest(indicators).select(
        "symbol", "trade_date", "close",
        F.when(up, "up").when(down, "down").otherwise("sideways").alias("trend"),
        F.when(yes(c("macd") > c("macd_signal")), "golden").otherwise("death").alias("macd_cross"),
        F.when(yes(c("rsi_14") > 70), "overbought").when(yes(c("rsi_14") < 30), "oversold").otherwise("neutral").alias("rsi_state"),
        F.when(yes((c("kdj_k") > 80) & (c("kdj_d") > 80)), "overbought").when(yes((c("kdj_k") < 20) & (c("kdj_d") < 20)), "oversold").otherwise("neutral").alias("kdj_state"),
        F.when(yes(c("close") > c("boll_upper")), "above_upper").when(yes(c("close") < c("boll_lower")), "below_lower").otherwise("inside").alias("boll_state"),
        "rsi_14", "macd", "macd_signal", "kdj_k", "kdj_d", "volume_ratio", "cci",
    )


def rebased(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rebased", F.try_divide(F.col("close"), F.first("close").over(W())) * 100)


def colors(macd_bars: DataFrame) -> DataFrame:
    """Up or down bar, and sign of the histogram."""
    return macd_bars.withColumns({"bar": F.when(F.col("close") >= F.col("open"), "up").otherwise("down"), "hist": F.when(F.col("macd_hist") >= 0, "up").otherwise("down")})
