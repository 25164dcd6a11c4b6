"""Further queries: parameters, checklists, optimizer summaries, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import fundamentals as fu
from ..operators import indicators, recon, rules
from .analysis import BC, FIELDS
from .base import query
from .indicators import PARTS
from .market import RES, SUP, TARGETS, TREND


def listed(column: str, *fields: str) -> Column:
    """A list of levels as text: the named fields of each."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ",")


query("p11_rounded", "customer", "c_custkey", "x", "SELECT c_custkey, round(c_acctbal, 1) AS x FROM customer", digits=2)(lambda c: c.select("c_custkey", fn.rounded(F.col("c_acctbal"), 1).alias("x")))
query("j13_key_sets", "fin_base fin_right", "symbol end_date side", "", "SELECT symbol, end_date, 'missing' AS side FROM (SELECT symbol, end_date FROM fin_base EXCEPT SELECT symbol, end_date FROM fin_right) UNION ALL SELECT symbol, end_date, 'extra' FROM (SELECT symbol, end_date FROM fin_right EXCEPT SELECT symbol, end_date FROM fin_base)")(
    lambda a, b: a.join(b, recon.KEY, "left_anti").select(*recon.KEY, F.lit("missing").alias("side")).union(b.join(a, recon.KEY, "left_anti").select(*recon.KEY, F.lit("extra").alias("side"))))
query("j16_checklist", "supplier fin_base", "s_suppkey end_date", "", "SELECT s_suppkey, end_date FROM supplier CROSS JOIN (SELECT DISTINCT end_date FROM fin_base WHERE y = 1997)")(lambda s, f: s.select("s_suppkey").crossJoin(F.broadcast(f.filter("y = 1997").select("end_date").distinct())))


@query("t09_mismatches", "fin_base fin_right", "symbol end_date field total", "", f"SELECT symbol, end_date, field, (SELECT count(*) FROM {BC} WHERE NOT matches) AS total FROM {BC} WHERE NOT matches ORDER BY symbol, end_date, field LIMIT 100")
def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first 100 mismatches and the count of all."""
    bad = recon.compared(a, b, FIELDS).filter(~F.col("matches"))
    return bad.orderBy("symbol", "end_date", "field").limit(100).crossJoin(bad.agg(F.count("*").alias("total")))


# Levels, confidence and comparison: last indicators, levels, trend.
LAST_SQL = " JOIN ".join(f"(SELECT symbol, {', '.join(f'arg_max({c}, trade_date) AS {c}' for c in cols.split())} FROM ({PARTS[k]}) GROUP BY symbol)" + (" USING (symbol)" if k != "w05" else "") for k, cols in (("w05", "macd macd_signal"), ("w04", "rsi_14"), ("w10", "volume_ratio")))
CONFIDENCE = f"""(WITH j AS (SELECT t.*, i.* EXCLUDE (symbol), s.distance AS below, r.distance AS above FROM ({TREND}) t JOIN (SELECT * FROM {LAST_SQL}) i USING (symbol)
      LEFT JOIN (SELECT symbol, distance FROM ({SUP}) WHERE rank = 1) s USING (symbol) LEFT JOIN (SELECT symbol, distance FROM ({RES}) WHERE rank = 1) r USING (symbol)),
    c AS (SELECT *, least(100, round(20 * (CASE WHEN alignment = 'bullish' AND trend_score >= 45 THEN 1 WHEN alignment = 'mixed' AND trend_score >= 50 THEN 0.5 ELSE 0 END + CASE WHEN macd > macd_signal THEN 1 ELSE 0 END
        + CASE WHEN rsi_14 < 30 THEN 1.5 WHEN rsi_14 <= 60 THEN 1 ELSE 0 END + CASE WHEN below < 10 THEN 1 ELSE 0 END + CASE WHEN volume_ratio < 0.7 THEN 0.5 ELSE 0 END))) AS buy_confidence,
      least(100, round(20 * (CASE WHEN alignment = 'bearish' THEN 1 ELSE 0 END + CASE WHEN macd < macd_signal THEN 1 ELSE 0 END + CASE WHEN rsi_14 > 70 THEN 1.5 WHEN rsi_14 > 60 THEN 0.5 ELSE 0 END
        + CASE WHEN above < 5 THEN 1.5 ELSE 0 END + CASE WHEN trend_score < 40 THEN 1 ELSE 0 END))) AS sell_confidence FROM j)
    SELECT *, {', '.join(f"CASE WHEN {k}_confidence >= 70 THEN 'high' WHEN {k}_confidence >= 50 THEN 'medium' WHEN {k}_confidence >= 30 THEN 'low' ELSE 'very_low' END AS {k}_label" for k in ('buy', 'sell'))} FROM c)"""
KINDS = lambda sql, by="kind": f"(SELECT symbol, string_agg({by}, ',' ORDER BY rank) AS x, max(price) FILTER (rank = 1) AS p1, max(price) FILTER (rank = 2) AS p2 FROM ({sql}) GROUP BY symbol)"
AIMS = f"(SELECT symbol, side, string_agg(kind || ':' || confidence, ',' ORDER BY rank) AS x FROM ({TARGETS}) GROUP BY symbol, side)"
query("t05_confidence", "bars", "symbol buy_label sell_label", "buy_confidence sell_confidence", f"SELECT * FROM {CONFIDENCE}")(rules.confidence)
query("t06_level_bundle", "bars", "symbol alignment label buy_label sell_label below above buy sell", "trend_score buy_confidence sell_confidence", f"""
    SELECT c.* EXCLUDE (below, above), coalesce(s.x, '') AS below, coalesce(r.x, '') AS above, b.x AS buy, e.x AS sell FROM {CONFIDENCE} c LEFT JOIN {KINDS(SUP)} s USING (symbol) LEFT JOIN {KINDS(RES)} r USING (symbol)
    JOIN {AIMS} b ON b.symbol = c.symbol AND b.side = 'buy' JOIN {AIMS} e ON e.symbol = c.symbol AND e.side = 'sell'""")(
    lambda b: rules.level_bundle(b).withColumns({"below": listed("supports", "kind"), "above": listed("resistances", "kind"), "buy": listed("buy_targets", "kind", "confidence"), "sell": listed("sell_targets", "kind", "confidence")}))
VALUED = lambda b: indicators.latest(b).select("symbol", (F.col("close") / 50 - 5).alias("pe_ttm"), (F.col("volume") / 20).alias("pb"))
COMPARED = f"""(SELECT c.symbol, close, CASE alignment WHEN 'bullish' THEN 'up' WHEN 'bearish' THEN 'down' ELSE 'sideways' END AS trend, rsi_14 AS rsi, CASE WHEN macd > macd_signal THEN 'golden' ELSE 'death' END AS macd_status,
    close / 50 - 5 AS pe_ttm, volume / 20 AS pb, buy_confidence, sell_confidence, s.p1 AS s1, s.p2 AS s2, r.p1 AS r1, r.p2 AS r2
    FROM {CONFIDENCE} c JOIN (SELECT symbol, arg_max(volume, trade_date) AS volume FROM bars GROUP BY symbol) USING (symbol) LEFT JOIN {KINDS(SUP)} s USING (symbol) LEFT JOIN {KINDS(RES)} r USING (symbol))"""
PRICES = {f"{side[0]}{i + 1}": (side, i) for side in ("supports", "resistances") for i in (0, 1)}
query("t07_comparison", "bars", "symbol trend macd_status", "close rsi pe_ttm pb buy_confidence sell_confidence s1 s2 r1 r2", f"SELECT * REPLACE (round(close, 2) AS close, round(rsi, 1) AS rsi) FROM {COMPARED}", digits=1)(
    lambda b: rules.comparison(b, VALUED(b)).withColumns({k: F.get(side, F.lit(i)) for k, (side, i) in PRICES.items()}))
RANK = lambda name, column, order: f"SELECT '{name}' AS ranking, symbol, {column} AS value, row_number() OVER (ORDER BY {column} {order}, symbol) AS rank FROM (SELECT * REPLACE (round(rsi, 1) AS rsi) FROM {COMPARED}) WHERE {column} IS NOT NULL QUALIFY rank <= 3"
query("t08_rankings", "bars", "ranking symbol rank", "value", " UNION ALL ".join([RANK("pe_lowest", "pe_ttm", "ASC"), RANK("rsi_strongest", "rsi", "DESC"), RANK("buy_confidence_highest", "buy_confidence", "DESC")]), digits=1)(lambda b: rules.rankings(rules.comparison(b, VALUED(b))))
