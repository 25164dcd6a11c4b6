"""Queries of storage, joins, risk, valuation and levels (S, J, A1-A6, T, U, W13-W18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pit, risk
from ..operators.medians import group_medians
from ..sources.store import stored
from .base import query

W = "PARTITION BY symbol ORDER BY trade_date"
D = "DATE '1997-06-30'"
query("s10_provider_label", "run_log", "symbol provider", "", """SELECT ticker AS symbol, CASE count(DISTINCT nullif(mode, 'user')) WHEN 0 THEN 'cache' WHEN 1 THEN max(nullif(mode, 'user')) ELSE 'mixed' END AS provider FROM run_log GROUP BY ticker""")(
    lambda r: pit.provider_label(r.select(F.col("ticker").alias("symbol"), F.when(F.col("mode") == "user", "cache").otherwise(F.col("mode")).alias("provider"))))
query("s11_data_gaps", "run_log", "symbol gaps", "", """SELECT ticker AS symbol, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) FILTER (tokens < 200), '') AS gaps FROM run_log GROUP BY ticker""")(
    lambda r: pit.data_gaps(r.select(F.col("ticker").alias("symbol"), F.col("turn").cast("string").alias("dataset"), F.when(F.col("tokens") < 200, "partial").otherwise("ok").alias("quality"))))
query("s12_conform", "bars", "symbol trade_date", "vol missing", "SELECT symbol, trade_date, volume AS vol, NULL::DOUBLE AS missing FROM bars")(lambda b: pit.conform(b, {"symbol": "symbol", "trade_date": "trade_date", "vol": "volume", "missing": None}))
query("s13_compact_date", "orders", "o_orderkey d", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")(
    lambda o: o.select("o_orderkey", F.expr("to_date(try_to_timestamp(if(o_orderkey % 7 > 0, date_format(o_orderdate, 'yyyyMMdd'), 'x'), 'yyyyMMdd'))").alias("d")))
ADJ = "SELECT symbol, trade_date, arg_max(adj_factor, load_seq) AS f FROM adj_factor WHERE adj_factor IS NOT NULL GROUP BY symbol, trade_date"
query("j01_adjust", "bars adj_factor", "symbol trade_date missing_factor", "open close volume", f"""
    WITH f AS ({ADJ}), b AS (SELECT symbol, arg_max(f, trade_date) AS base FROM f GROUP BY symbol)
    SELECT symbol, trade_date, f IS NULL AS missing_factor, open * f / base AS open, close * f / base AS close, volume FROM bars LEFT JOIN f USING (symbol, trade_date) LEFT JOIN b USING (symbol)""")(pit.adjust)
query("j02_factors", "adj_factor", "symbol trade_date", "adj_factor", f"SELECT symbol, trade_date, f AS adj_factor FROM ({ADJ})")(pit.normalize_factors)
query("j03_opening", "fin_base", "symbol end_date", "total_assets open_total_assets", "SELECT a.symbol, a.end_date, a.total_assets, o.total_assets AS open_total_assets FROM fin_base a LEFT JOIN fin_base o ON a.symbol = o.symbol AND o.end_date = make_date(CAST(a.y - 1 AS INT), 12, 31)", digits=2)(lambda f: pit.opening(f, ["total_assets"]))
query("j04_year_ago", "fin_base", "symbol end_date", "prior growth", "SELECT a.symbol, a.end_date, b.revenue AS prior, (a.revenue - b.revenue) / abs(b.revenue) * 100 AS growth FROM fin_base a LEFT JOIN fin_base b ON a.symbol = b.symbol AND b.y = a.y - 1 AND b.qn = a.qn", digits=3)(lambda f: pit.year_ago(f, "revenue"))
query("j19_is_trading_day", "orders trade_cal", "o_orderkey open", "", "SELECT o_orderkey, coalesce(is_open = 1, false) AS open FROM orders LEFT JOIN trade_cal ON cal_date = CAST(o_orderdate AS DATE)")(
    lambda o, c: o.join(c, o.o_orderdate.cast("date") == c.cal_date, "left").select("o_orderkey", F.coalesce(F.col("is_open") == 1, F.lit(False)).alias("open")))
query("j20_neighbours", "trade_cal", "cal_date is_open next_open prev_open", "", """
    SELECT cal_date, is_open, CASE WHEN n - cal_date <= 44 THEN n END AS next_open, CASE WHEN cal_date - p <= 44 THEN p END AS prev_open FROM (
      SELECT c.*, (SELECT list(o.cal_date ORDER BY o.cal_date)[2] FROM trade_cal o WHERE o.is_open = 1 AND o.cal_date > c.cal_date) AS n,
        (SELECT list(o.cal_date ORDER BY o.cal_date DESC)[2] FROM trade_cal o WHERE o.is_open = 1 AND o.cal_date < c.cal_date) AS p FROM trade_cal c)""")(lambda c: pit.neighbours(c, 2))
query("j21_calendar_range", "trade_cal", "exchange days latest need_update", "", "SELECT exchange, count(*) FILTER (is_open = 1 AND cal_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31') AS days, max(cal_date) FILTER (is_open = 1 AND cal_date <= DATE '1997-01-01') AS latest, max(cal_date) < DATE '2010-01-01' AS need_update FROM trade_cal GROUP BY exchange")(
    lambda c: c.groupBy("exchange").agg(F.count_if((F.col("is_open") == 1) & F.col("cal_date").between("1996-01-01", "1996-03-31")).alias("days"), F.max(F.when((F.col("is_open") == 1) & (F.col("cal_date") <= "1997-01-01"), F.col("cal_date"))).alias("latest"), (F.max("cal_date") < "2010-01-01").alias("need_update")))
NB = f"SELECT symbol, trade_date, close, row_number() OVER ({W}) AS i FROM bars"
query("j17_event_bars", "official_events bars", "symbol item_id before from_bar", "", f"""
    WITH nb AS ({NB}) SELECT e.symbol, e.item_id, (SELECT max(i) FROM nb WHERE nb.symbol = e.symbol AND nb.trade_date < e.published) AS before, (SELECT min(i) FROM nb WHERE nb.symbol = e.symbol AND nb.trade_date >= e.published) AS from_bar
    FROM official_events e""")(lambda e, b: pit.event_bars(e, b).withColumn("before", F.col("before").cast("bigint")).withColumn("from_bar", F.col("from_bar").cast("bigint")))
ER = f"""WITH nb AS ({NB}), e AS (SELECT e.*, (SELECT max(i) FROM nb WHERE nb.symbol = e.symbol AND nb.trade_date < e.published) AS b FROM official_events e)
    SELECT e.symbol, e.item_id, e.polarity, e.event_type, h AS horizon, (y.close / x.close - 1) * 100 AS ret FROM e JOIN nb x ON x.symbol = e.symbol AND x.i = e.b CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) hs LEFT JOIN nb y ON y.symbol = e.symbol AND y.i = e.b + h"""
query("e15_event_returns", "official_events bars", "symbol item_id horizon", "ret", ER)(pit.event_returns)


@query("a11_reaction_stats", "official_events bars", "grouped name horizon n", "mean median positive", f"""
    WITH r AS (SELECT * FROM ({ER}) WHERE ret IS NOT NULL), k AS (SELECT 'all' AS grouped, 'all' AS name, horizon, ret FROM r UNION ALL SELECT 'polarity', polarity, horizon, ret FROM r UNION ALL SELECT 'type', event_type, horizon, ret FROM r)
    SELECT grouped, name, horizon, count(*) AS n, avg(ret) AS mean, median(ret) AS median, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS positive FROM k GROUP BY ALL""", digits=3)
def reaction_stats(events, bars):  # noqa: ANN001, ANN201
    """Event returns by horizon, for all, each polarity and each type."""
    r = pit.event_returns(events, bars).filter("ret is not null").join(events.select("item_id", "polarity", "event_type"), "item_id")
    kinds = F.inline(F.array(*[F.struct(F.lit(g).alias("grouped"), name.alias("name")) for g, name in (("all", F.lit("all")), ("polarity", F.col("polarity")), ("type", F.col("event_type")))]))
    each, by = stored(r.select("horizon", "ret", kinds), "returns"), ["grouped", "name", "horizon"]
    stats = each.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"))
    return stats.join(group_medians(each, by, "ret"), by)


RET = f"(SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars)"
VOL = f"SELECT symbol, round(stddev_pop(ret) * sqrt(250) * 100, 1) AS volatility, CASE WHEN count(ret) >= 20 THEN round(stddev_pop(ret) FILTER (back <= 20) * sqrt(250) * 100, 1) ELSE round(stddev_pop(ret) * sqrt(250) * 100, 1) END AS recent_volatility FROM {RET} GROUP BY symbol HAVING count(close) >= 5"
LV = "CASE WHEN volatility > 50 THEN 'very_high' WHEN volatility > 35 THEN 'high' WHEN volatility > 20 THEN 'medium' ELSE 'low' END"
query("a01_volatility", "bars", "symbol level", "volatility recent_volatility", f"SELECT *, {LV} AS level FROM ({VOL})")(risk.volatility)
DD = f"""SELECT symbol, min(dd) AS deepest, round(abs(min(dd)) * 100, 1) AS max_drawdown, round(abs(arg_max(dd, trade_date)) * 100, 1) AS current_drawdown
    FROM (SELECT *, close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) GROUP BY symbol HAVING count(close) >= 5"""
LD = "CASE WHEN deepest * 100 < -40 THEN 'very_high' WHEN deepest * 100 < -25 THEN 'high' WHEN deepest * 100 < -15 THEN 'medium' ELSE 'low' END"
query("a02_drawdown", "bars", "symbol level", "max_drawdown current_drawdown", f"SELECT *, {LD} AS level FROM ({DD})")(risk.drawdown)
LIQ = f"SELECT symbol, avg(volume) AS avg_volume, avg(amount) AS avg_amount FROM {RET} WHERE back <= 20 GROUP BY symbol"
LL = "CASE WHEN avg_amount > 1e6 THEN 'high' WHEN avg_amount > 3e5 THEN 'medium' WHEN avg_amount > 1e5 THEN 'low' ELSE 'very_low' END"
query("a03_liquidity", "bars", "symbol level", "avg_volume avg_amount", f"SELECT *, {LL} AS level FROM ({LIQ})")(risk.liquidity)
RISK = f"""SELECT symbol, s AS risk_score, CASE WHEN s >= 70 THEN 'low' WHEN s >= 50 THEN 'medium' WHEN s >= 30 THEN 'medium_high' ELSE 'high' END AS risk_level FROM (
      SELECT symbol, greatest(0, least(100, 50 + CASE {LV} WHEN 'very_high' THEN -20 WHEN 'high' THEN -10 WHEN 'low' THEN 10 ELSE 0 END
        + CASE {LD} WHEN 'very_high' THEN -20 WHEN 'high' THEN -10 ELSE 0 END + CASE {LL} WHEN 'very_low' THEN -10 WHEN 'high' THEN 5 ELSE 0 END)) AS s
      FROM ({VOL}) v JOIN ({DD}) d USING (symbol) JOIN ({LIQ}) l USING (symbol))"""
query("a04_risk", "bars", "symbol risk_level", "risk_score", RISK)(risk.risk)
query("a05_price_percentiles", "bars", "symbol level", "pct_250 pct_750 pct_1250", f"""
    SELECT *, CASE WHEN pct_250 > 80 THEN 'very_high' WHEN pct_250 > 60 THEN 'high' WHEN pct_250 > 40 THEN 'medium' WHEN pct_250 > 20 THEN 'low' ELSE 'very_low' END AS level FROM (SELECT symbol, {', '.join(f'CASE WHEN count(*) FILTER (back <= {n}) >= 20 THEN avg(CASE WHEN close <= cur THEN 100.0 ELSE 0 END) FILTER (back <= {n}) END AS pct_{n}' for n in (250, 750, 1250))}
    FROM (SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS cur FROM {RET}) GROUP BY symbol)""")(risk.price_percentiles)
query("a06_valuation", "bars", "symbol summary", "", """SELECT symbol, 'pe:' || CASE WHEN pe > 50 THEN 'high' WHEN pe > 20 THEN 'fair' WHEN pe > 0 THEN 'low' ELSE 'loss' END || ';pb:' || CASE WHEN pb > 5 THEN 'high' WHEN pb > 1 THEN 'fair' ELSE 'low' END AS summary
    FROM (SELECT symbol, arg_max(close, trade_date) / 50 - 5 AS pe, arg_max(volume, trade_date) / 20 AS pb FROM bars GROUP BY symbol)""")(lambda b: risk.valuation_summary(b.withColumns({"pe_ttm": F.col("close") / 50 - 5, "pb": F.col("volume") / 20})))
R = lambda f, n: f"{f} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
LAST = f"""WITH l AS (SELECT *, {R('avg(close)', 5)} AS ma_5, {R('avg(close)', 20)} AS ma_20, {R('avg(close)', 60)} AS ma_60, {R('stddev_samp(close)', 20)} AS sd, {R('min(low)', 20)} AS low_20, {R('min(low)', 60)} AS low_60,
    {R('max(high)', 20)} AS high_20, {R('max(high)', 60)} AS high_60, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back, lag(close, 4) OVER ({W}) AS c4, lag(close, 19) OVER ({W}) AS c19 FROM bars)"""


def level_sql(names: list[str], side: str) -> str:
    """DuckDB rows of the levels on one side."""
    price = {"boll_lower": "ma_20 - 2 * sd", "boll_upper": "ma_20 + 2 * sd"}
    each = " UNION ALL ".join(f"SELECT symbol, {i} AS i, '{n}' AS kind, {price.get(n, n)} AS p, close FROM l WHERE back = 1" for i, n in enumerate(names))
    return f"""{LAST}, c AS ({each}), d AS (SELECT symbol, kind, i, round(p, 2) AS price, round(abs(p / close - 1) * 100, 1) AS distance, CASE WHEN kind LIKE '%60' THEN 'strong' ELSE 'medium' END AS strength FROM c WHERE p {side} close)
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY distance, i) AS rank FROM d QUALIFY rank <= 5"""


SUP, RES = level_sql(["ma_20", "ma_60", "low_20", "low_60", "boll_lower"], "<"), level_sql(["ma_20", "ma_60", "ma_5", "high_20", "high_60", "boll_upper"], ">")
query("t01_supports", "bars", "symbol rank kind strength", "price distance", SUP)(risk.supports)
query("t02_resistances", "bars", "symbol rank kind strength", "price distance", RES)(risk.resistances)
TARGETS = f"""
    WITH s AS ({SUP}), r AS ({RES}),
    b AS (SELECT symbol, 'buy' AS side, rank, price, kind, CASE WHEN strength = 'strong' AND distance < 10 THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE rank <= 3
      UNION ALL SELECT symbol, 'sell', rank, price, kind, CASE WHEN strength = 'strong' AND distance < 15 THEN 'high' ELSE 'medium' END FROM r WHERE rank <= 3),
    x AS (SELECT symbol, arg_max(close, trade_date) * (1 - 2 * stddev_pop(ret)) AS lo, max(high) AS hi FROM {RET} WHERE back <= 60 GROUP BY symbol),
    y AS (SELECT symbol, 'buy' AS side, round(lo, 2) AS price, 'deviation' AS kind, 'low' AS confidence FROM x UNION ALL SELECT symbol, 'sell', round(hi, 2), 'high_60', 'medium' FROM x)
    SELECT symbol, side, rank, price, kind, confidence FROM b UNION ALL SELECT symbol, side, 1, price, kind, confidence FROM y ANTI JOIN b USING (symbol, side)"""
query("t03_targets", "bars", "symbol side rank kind confidence", "price", TARGETS)(risk.targets)
TREND = f"""
    {LAST}, t AS (SELECT symbol, close, CASE WHEN ma_5 > ma_20 AND ma_20 > ma_60 THEN 'bullish' WHEN ma_5 < ma_20 AND ma_20 < ma_60 THEN 'bearish' ELSE 'mixed' END AS alignment,
      (close / ma_60 - 1) * 100 AS ma60_distance, coalesce((close / c4 - 1) * 100, 0) AS change_5, coalesce((close / c19 - 1) * 100, 0) AS change_20 FROM l WHERE back = 1),
    u AS (SELECT *, greatest(0, least(100, 50 + CASE alignment WHEN 'bullish' THEN 20 WHEN 'bearish' THEN -20 ELSE 0 END + CASE WHEN change_20 > 5 THEN 10 WHEN change_20 < -5 THEN -10 ELSE 0 END + CASE WHEN change_5 > 0 THEN 5 ELSE -5 END)) AS trend_score FROM t)
    SELECT *, CASE WHEN trend_score >= 70 THEN 'strong' WHEN trend_score >= 55 THEN 'rather_strong' WHEN trend_score >= 45 THEN 'neutral' WHEN trend_score >= 30 THEN 'rather_weak' ELSE 'weak' END AS label FROM u"""
query("t04_trend", "bars", "symbol alignment label", "trend_score ma60_distance change_5 change_20", TREND)(risk.trend_strength)
query("t11_history", "run_log", "conv_id turn", "", "SELECT conv_id, turn FROM run_log ORDER BY conv_id DESC, turn DESC LIMIT 200")(lambda r: r.orderBy(F.desc("conv_id"), F.desc("turn")).limit(200))
REV = "SELECT * FROM fin_rev WHERE {f} QUALIFY row_number() OVER (PARTITION BY symbol, end_date ORDER BY ann_date DESC NULLS LAST, update_flag DESC, load_seq DESC) = 1"
query("p06_as_of", "fin_rev", "symbol end_date load_seq", "", f"SELECT * FROM fin_rev WHERE end_date <= {D} AND ann_date <= {D}")(lambda f: pit.as_of(f, "1997-06-30"))
query("p07_future_rows", "fin_rev", "symbol future_rows", "", f"SELECT symbol, count(*) FILTER (end_date > {D} OR ann_date > {D}) AS future_rows FROM fin_rev GROUP BY symbol")(lambda f: pit.future_rows(f, "1997-06-30"))
query("w13_latest_revision", "fin_rev", "symbol end_date load_seq", "revenue", REV.format(f="true"), digits=2)(pit.latest_revision)
query("w14_pit_view", "fin_rev", "symbol end_date load_seq", "revenue", REV.format(f=f"end_date <= {D} AND ann_date <= {D}"), digits=2)(lambda f: pit.pit_view(f, "1997-06-30"))
query("w15_ratio_revision", "fin_rev", "symbol end_date load_seq", "", REV.format(f="true"))(lambda f: pit.latest_revision(f, with_report_type=False))
query("w16_money_flow", "moneyflow_raw", "symbol trade_date version", "net_mf_amount", f"SELECT * FROM moneyflow_raw WHERE trade_date <= {D} QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY version DESC) = 1", digits=2)(lambda m: pit.money_flow(m, "1997-06-30"))
query("w17_jumps", "bars", "symbol trade_date", "ret", f"SELECT * FROM {RET} WHERE abs(ret) > 0.11")(lambda b: risk.returns(b).filter("abs(ret) > 0.11"))
query("w18_period_gaps", "fin_base", "symbol end_date gap", "", "SELECT * FROM (SELECT symbol, end_date, end_date - lag(end_date) OVER (PARTITION BY symbol ORDER BY end_date) AS gap FROM fin_base WHERE mod(sk + qn + y, 5) <> 0 AND mod(y + qn, 4) > 0) WHERE gap > 200")(
    lambda f: f.filter("mod(sk + qn + y, 5) <> 0 and mod(y + qn, 4) > 0").selectExpr("symbol", "end_date", "datediff(end_date, lag(end_date) over (partition by symbol order by end_date)) as gap").filter("gap > 200"))
