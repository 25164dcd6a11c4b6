"""Queries of the indicators."""

from __future__ import annotations

from ..operators import indicators as I
from .base import query

K = "symbol trade_date"
W = "PARTITION BY symbol ORDER BY trade_date"


def roll(f: str, n: int, col: str) -> str:
    """A DuckDB rolling value, null until n rows have the column."""
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {over} = {n} THEN {f} {over} END"


def ewm_cte(source: str, col: str, out: str, alpha: str, name: str) -> str:
    """A recursive-free exponential mean: weights relative to each row, by a self join over the rows that still count."""
    return f"""{name} AS (SELECT a.*, (SELECT sum(b.{col} * power(1 - {alpha}, a.i - b.i)) / sum(CASE WHEN b.{col} IS NOT NULL THEN power(1 - {alpha}, a.i - b.i) END)
        FROM {source} b WHERE b.symbol = a.symbol AND b.i <= a.i AND b.i > a.i - 600) AS {out} FROM {source} a)"""


NUM = f"n0 AS (SELECT *, row_number() OVER ({W}) AS i FROM bars)"
MACD = f"WITH {NUM}, {ewm_cte('n0', 'close', 'e12', '(2.0/13)', 'n1')}, {ewm_cte('n1', 'close', 'e26', '(2.0/27)', 'n2')}, n3 AS (SELECT *, e12 - e26 AS macd FROM n2), {ewm_cte('n3', 'macd', 'macd_signal', '0.2', 'n4')}"
RSV = f"""r0 AS (SELECT *, CASE WHEN hh > ll AND k = 9 THEN (close - ll) / (hh - ll) * 100 END AS rsv FROM (SELECT *, max(high) OVER v AS hh, min(low) OVER v AS ll, count(close) OVER v AS k
    FROM n0 WINDOW v AS ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)))"""
KDJ = f"WITH {NUM}, {RSV}, {ewm_cte('r0', 'rsv', 'kdj_k', '(1.0/3)', 'k1')}, {ewm_cte('k1', 'kdj_k', 'kdj_d', '(1.0/3)', 'k2')}"
RSI = f"""(SELECT *, CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi_14 FROM (SELECT *, {roll('avg(greatest(m, 0))', 14, 'm')} AS g, {roll('avg(greatest(-m, 0))', 14, 'm')} AS l
    FROM (SELECT *, coalesce(close - lag(close) OVER ({W}), 0) AS m FROM bars)))"""

query("w01_ma", "bars", K, "ma_5 ma_10 ma_20 ma_60", f"SELECT symbol, trade_date, {', '.join(f'{roll("avg(close)", p, "close")} AS ma_{p}' for p in (5, 10, 20, 60))} FROM bars")(I.moving_average)
query("w02_ema", "bars", K, "ema_12 ema_26", f"WITH {NUM}, {ewm_cte('n0', 'close', 'ema_12', '(2.0/13)', 'n1')}, {ewm_cte('n1', 'close', 'ema_26', '(2.0/27)', 'n2')} SELECT * FROM n2")(I.ema)
query("w03_bollinger", "bars", K, "boll_mid boll_upper boll_lower boll_width boll_pct", f"""
    SELECT *, (boll_upper - boll_lower) / nullif(boll_mid, 0) AS boll_width, (close - boll_lower) / nullif(boll_upper - boll_lower, 0) AS boll_pct FROM (
      SELECT *, m AS boll_mid, m + 2 * d AS boll_upper, m - 2 * d AS boll_lower FROM (SELECT *, {roll('avg(close)', 20, 'close')} AS m, {roll('stddev_samp(close)', 20, 'close')} AS d FROM bars))""")(I.bollinger)
query("w04_rsi", "bars", K, "rsi_14", f"SELECT * FROM {RSI}")(I.rsi)
query("w05_macd", "bars", K, "macd macd_signal macd_hist", f"{MACD} SELECT *, macd - macd_signal AS macd_hist FROM n4")(I.macd)
query("w06_kdj", "bars", K, "kdj_k kdj_d kdj_j", f"{KDJ} SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM k2")(I.kdj)
CCI = f"""
    SELECT symbol, trade_date, (tp - sma) / nullif(0.015 * list_sum(list_transform(x, lambda v: abs(v - sma))) / 20, 0) AS cci FROM (
      SELECT *, {roll('avg(tp)', 20, 'tp')} AS sma, list(tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))"""
query("w07_cci", "bars", K, "cci", CCI, digits=3)(I.cci)
WILLIAMS = f"SELECT symbol, trade_date, CASE WHEN hh IS NOT NULL THEN (hh - close) / nullif(hh - ll, 0) * -100 END AS williams_r FROM (SELECT *, {roll('max(high)', 14, 'close')} AS hh, {roll('min(low)', 14, 'close')} AS ll FROM bars)"
query("w08_williams", "bars", K, "williams_r", WILLIAMS)(I.williams_r)
OBV = f"""
    SELECT *, {roll('avg(obv)', 20, 'obv')} AS obv_ma FROM (SELECT symbol, trade_date, sum(s) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM (
      SELECT *, coalesce(sign(close - lag(close) OVER ({W})) * volume, volume) AS s FROM bars))"""
query("w09_obv", "bars", K, "obv obv_ma", OBV, digits=3)(I.obv)
VOLUME = f"SELECT symbol, trade_date, volume / {roll('avg(volume)', 20, 'volume')} AS volume_ratio FROM bars"
query("w10_volume_ratio", "bars", K, "volume_ratio", VOLUME)(I.volume_ratio)
ALL = "ma_5 ma_10 ma_20 ma_60 ema_12 ema_26 macd macd_signal macd_hist boll_mid boll_upper boll_lower rsi_14 kdj_k kdj_d kdj_j cci williams_r obv obv_ma volume_ratio"
#: The single indicators' SQL, side by side.
PARTS = {
    "w01": f"SELECT symbol, trade_date, {', '.join(f'{roll("avg(close)", p, "close")} AS ma_{p}' for p in (5, 10, 20, 60))} FROM bars",
    "w05": f"{MACD} SELECT *, e12 AS ema_12, e26 AS ema_26, macd - macd_signal AS macd_hist FROM n4",
    "w03": f"SELECT symbol, trade_date, m AS boll_mid, m + 2 * d AS boll_upper, m - 2 * d AS boll_lower FROM (SELECT *, {roll('avg(close)', 20, 'close')} AS m, {roll('stddev_samp(close)', 20, 'close')} AS d FROM bars)",
    "w04": f"SELECT symbol, trade_date, rsi_14 FROM {RSI}",
    "w06": f"{KDJ} SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM k2",
    "w07": CCI, "w08": WILLIAMS, "w09": OBV, "w10": VOLUME,
}
COLUMNS = {"w01": "ma_5 ma_10 ma_20 ma_60", "w05": "ema_12 ema_26 macd macd_signal macd_hist", "w03": "boll_mid boll_upper boll_lower", "w04": "rsi_14", "w06": "kdj_k kdj_d kdj_j", "w07": "cci", "w08": "williams_r", "w09": "obv obv_ma", "w10": "volume_ratio"}
ALL_SQL = "SELECT * FROM " + " JOIN ".join(f"(SELECT symbol, trade_date, {', '.join(COLUMNS[k].split())} FROM ({sql}))" + (" USING (symbol, trade_date)" if i else "") for i, (k, sql) in enumerate(PARTS.items()))
query("w11_all_indicators", "bars", K, ALL, ALL_SQL, digits=3)(I.all_indicators)
query("w12_summary", "bars", "symbol trade_date trend macd_cross rsi_state kdj_state boll_state", "close rsi_14 macd macd_signal kdj_k kdj_d", f"""
    {MACD}, {RSV}, {ewm_cte('r0', 'rsv', 'kdj_k', '(1.0/3)', 'k0')}, {ewm_cte('k0', 'kdj_k', 'kdj_d', '(1.0/3)', 'k1')}, rs AS (SELECT symbol, trade_date, rsi_14 FROM {RSI}),
    m AS (SELECT n4.*, rs.rsi_14, k1.kdj_k, k1.kdj_d, {roll('avg(n4.close)', 5, 'n4.close').replace('symbol', 'n4.symbol').replace('trade_date', 'n4.trade_date')} AS ma_5, {roll('avg(n4.close)', 20, 'n4.close').replace('symbol', 'n4.symbol').replace('trade_date', 'n4.trade_date')} AS ma_20,
      {roll('avg(n4.close)', 60, 'n4.close').replace('symbol', 'n4.symbol').replace('trade_date', 'n4.trade_date')} AS ma_60, {roll('stddev_samp(n4.close)', 20, 'n4.close').replace('symbol', 'n4.symbol').replace('trade_date', 'n4.trade_date')} AS sd,
      row_number() OVER (PARTITION BY n4.symbol ORDER BY n4.trade_date DESC) AS last
      FROM n4 JOIN k1 USING (symbol, trade_date) JOIN rs USING (symbol, trade_date))
    SELECT *, CASE WHEN ma_5 > ma_20 AND ma_20 > ma_60 THEN 'up' WHEN ma_5 < ma_20 AND ma_20 < ma_60 THEN 'down' ELSE 'sideways' END AS trend,
      CASE WHEN macd > macd_signal THEN 'golden' ELSE 'death' END AS macd_cross, CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state,
      CASE WHEN kdj_k > 80 AND kdj_d > 80 THEN 'overbought' WHEN kdj_k < 20 AND kdj_d < 20 THEN 'oversold' ELSE 'neutral' END AS kdj_state,
      CASE WHEN close > ma_20 + 2 * sd THEN 'above_upper' WHEN close < ma_20 - 2 * sd THEN 'below_lower' ELSE 'inside' END AS boll_state FROM m WHERE last = 1""")(lambda bars: I.summary(I.all_indicators(bars)))
query("w19_rebased", "bars", K, "rebased", f"SELECT symbol, trade_date, close / first_value(close) OVER ({W}) * 100 AS rebased FROM bars")(I.rebased)
query("w22_colors", "bars", K + " bar hist", "", f"{MACD} SELECT *, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS bar, CASE WHEN macd - macd_signal >= 0 THEN 'up' ELSE 'down' END AS hist FROM n4")(lambda b: I.colors(I.macd(b)))
