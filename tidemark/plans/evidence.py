"""Queries of events, evidence, decisions, scenarios, packages, page text and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import fundamentals as fu
from ..operators import gate, indicators, ops, pit, risk, rules, textfields
from ..operators import strategy as st
from . import strategy as sp
from .analysis import LASTQ, SCORE, given, thin
from .audit import BRANDS, TESTED, branded, gate_checks
from .base import ORACLE_SQL, query
from .market import RISK, TARGETS
from .more import CONFIDENCE

AS_OF = "1999-01-20"
W = "PARTITION BY symbol ORDER BY trade_date"
#: Titles of disclosures: some name several events, some none, and one is empty.
TITLES = [
    "关于公司股票存在终止上市风险的提示", "收到行政处罚决定书", "关于对年报问询函的回复", "涉及重大仲裁的公告", "股东减持计划预披露", "生产线停产检修", "特别风险公告", "年度预计亏损", "半年度预告下降", "业绩快报：净利润下降", "一季度预计增长",
    "业绩快报：收入增长", "签订战略合作协议", "订单金额披露", "项目中标通知", "回购进展情况", "控股股东增持股份", "年度现金分红方案", "董事会会议决议", " ", "业绩快报", "风险提示：重大诉讼与减持股份",
]
TITLE = "CASE mod(item_id, 22) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
FIELDS = {
    "source": "CASE mod(item_id, 9) WHEN 0 THEN 'CNINFO.com.cn' WHEN 1 THEN 'blog' WHEN 2 THEN '' ELSE 'sse' END", "item_id": "mod(item_id, 300)", "published": "published", "title": TITLE,
    "event_type": "CASE WHEN mod(item_id, 5) = 0 THEN '分红' END", "strength": "CASE mod(item_id, 7) WHEN 0 THEN 1.5E0 WHEN 1 THEN NULL ELSE CAST(strength AS DOUBLE) END",
    "reliability": "CASE WHEN mod(item_id, 11) = 0 THEN 0.4E0 END", "quality": "CASE WHEN mod(item_id, 13) = 0 THEN 0.3E0 END",
}
RECORDS = f"(SELECT symbol, {', '.join(f'{sql} AS {c}' for c, sql in FIELDS.items())} FROM official_events)"


def records(events: DataFrame) -> DataFrame:
    return events.selectExpr("symbol", *[f"{sql} as {c}" for c, sql in FIELDS.items()])


def OFFICIAL(events: DataFrame) -> DataFrame:  # noqa: N802
    return ev.accepted(ev.official(records(events)), AS_OF)


KIND = "CASE " + " ".join(f"WHEN {(' AND ' if every else ' OR ').join(f"contains(trim(title), '{w}')" for w in words)} THEN '{kind}'" for kind, words, every in ev.EVENT_RULES) + " ELSE 'unknown' END"
QUOTED = {side: ", ".join(f"'{x}'" for x in kinds) for side, kinds in ev.POLARITY.items()}
OFFICIAL_SQL = f"""(SELECT symbol, 'official_event.' || item_id AS evidence_id, 'official_event' AS dimension, polarity, source, published, coalesce(strength, CASE WHEN polarity = 'neutral' THEN 0.1 ELSE 0.55 END) AS strength,
      coalesce(reliability, 0.85) AS reliability, coalesce(quality, 0.85) AS quality, 'official_disclosure:' || source AS independence_group
    FROM (SELECT *, CASE WHEN kind IN ({QUOTED['positive']}) THEN 'positive' WHEN kind IN ({QUOTED['negative']}) THEN 'negative' ELSE 'neutral' END AS polarity FROM (SELECT *, coalesce(event_type, {KIND}) AS kind FROM {RECORDS} WHERE trim(title) <> '' AND source IN ('sse', 'CNINFO.com.cn'))))"""
ACCEPTED = f"""(SELECT * EXCLUDE (n, why), CASE WHEN why IS NULL AND n > 1 THEN 'duplicate' ELSE why END AS reject FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, source, evidence_id ORDER BY why IS NOT NULL, published, strength, reliability, quality, polarity) AS n FROM (
      SELECT *, CASE WHEN published > DATE '{AS_OF}' THEN 'future' WHEN strength NOT BETWEEN 0 AND 1 THEN 'range' END AS why FROM {OFFICIAL_SQL})))"""
EVIDENCE_ROW = "symbol evidence_id polarity source published"
query("e01_classify", "official_events", "symbol kind n", "", f"SELECT symbol, kind, count(*) AS n FROM (SELECT *, {KIND} AS kind FROM {RECORDS}) GROUP BY ALL")(
    lambda e: records(e).groupBy("symbol", ev.classify(F.trim("title")).alias("kind")).agg(F.count("*").alias("n")))
query("e03_polarity", "official_events", f"{EVIDENCE_ROW} independence_group", "strength reliability quality", f"SELECT * FROM {OFFICIAL_SQL}")(lambda e: ev.official(records(e)))
query("e04_accepted", "official_events", f"{EVIDENCE_ROW} reject", "strength", f"SELECT * FROM {ACCEPTED}")(OFFICIAL)
query("a21_coverage", "official_events", "symbol status accepted rejected source_count listed first_day last_day freshness_days", "quality_min quality_mean mean_strength", f"""
    SELECT *, CASE WHEN accepted > 0 THEN 'ok' ELSE 'insufficient' END AS status, DATE '{AS_OF}' - last_day AS freshness_days FROM (
      SELECT symbol, count(*) FILTER (reject IS NULL) AS accepted, count(reject) AS rejected, CAST(count(DISTINCT source) FILTER (reject IS NULL) AS INT) AS source_count, coalesce(string_agg(DISTINCT independence_group, ',' ORDER BY independence_group) FILTER (reject IS NULL), '') AS listed,
        min(published) FILTER (reject IS NULL) AS first_day, max(published) FILTER (reject IS NULL) AS last_day, min(quality) FILTER (reject IS NULL) AS quality_min, avg(quality) FILTER (reject IS NULL) AS quality_mean, avg(strength) FILTER (reject IS NULL) AS mean_strength
      FROM {ACCEPTED} GROUP BY symbol)""")(lambda e: ev.coverage(OFFICIAL(e), AS_OF).withColumn("listed", F.array_join("groups", ",")))
SENTIMENT = f"""(SELECT *, greatest(0, least(100, 50 + greatest(-20, least(20, ret_19 * 100)) + coalesce(greatest(-10, least(10, (vol_ratio - 1) * 10)), 0))) AS sentiment_score FROM (
    SELECT *, stddev_pop(r) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) AS volatility FROM (
      SELECT *, close / lag(close, 19) OVER ({W}) - 1 AS ret_19, close / lag(close) OVER ({W}) - 1 AS r, volume / avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol_ratio, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM bars)) WHERE back = 1)"""
query("e05_sentiment", "bars", "symbol status", "ret_19 vol_ratio volatility sentiment_score", f"SELECT *, 'ok' AS status FROM {SENTIMENT}")(ev.sentiment)
FLOW = """(SELECT symbol, sum(v) AS net_5d, max(trade_date) AS trade_date, CASE WHEN sum(v) > 0 THEN 'positive' WHEN sum(v) < 0 THEN 'negative' ELSE 'neutral' END AS polarity FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS back FROM (SELECT symbol, trade_date, net_mf_amount AS v FROM moneyflow_raw WHERE mod(CAST(symbol[7:] AS INT), 2) = 0 QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY version DESC) = 1)) WHERE back <= 5 GROUP BY symbol)"""


def FLOWS(money: DataFrame) -> DataFrame:  # noqa: N802
    """Flows of every second brand; as volume, so that the amount's column isn't there."""
    return ev.flow(pit.money_flow(money.filter("cast(substring(symbol, 7) as int) % 2 = 0"), "2100-01-01").withColumnRenamed("net_mf_amount", "net_mf_vol"))


query("a22_money_flow", "moneyflow_raw", "symbol polarity unit trade_date", "net_5d", f"SELECT *, 'net_mf_vol' AS unit FROM {FLOW}")(FLOWS)
SENTIMENT_ROWS = f"""
    SELECT symbol, 'sentiment.momentum.' || CASE WHEN ret_19 > 0 THEN 'positive' ELSE 'negative' END AS evidence_id, 'sentiment' AS dimension, CASE WHEN ret_19 > 0 THEN 'positive' ELSE 'negative' END AS polarity, 'price_volume_proxy-v1' AS source, trade_date AS published,
      least(1, abs(ret_19) * 5) AS strength, 0.4 AS reliability, 0.55 AS quality, 'price_volume_proxy' AS independence_group FROM {SENTIMENT} WHERE ret_19 <> 0
    UNION ALL SELECT symbol, 'sentiment.activity.' || CASE WHEN ret_19 >= 0 THEN 'positive' ELSE 'negative' END, 'sentiment', CASE WHEN ret_19 >= 0 THEN 'positive' ELSE 'negative' END, 'price_volume_proxy-v1', trade_date, least(1, (vol_ratio - 1) / 1.5), 0.35, 0.55, 'price_volume_proxy' FROM {SENTIMENT} WHERE vol_ratio > 1.2"""
FLOW_ROWS = f"SELECT symbol, 'sentiment.moneyflow.net_5d', 'market_behavior', polarity, 'tushare_moneyflow-v1', trade_date, CASE WHEN polarity = 'neutral' THEN 0.25 ELSE 0.5 END, 0.55, 0.65, 'tushare_moneyflow' FROM {FLOW}"
query("e06_sentiment_bundle", "bars moneyflow_raw official_events", "symbol own flow_rows outside status", "sentiment_score", f"""
    SELECT s.symbol, sentiment_score, coalesce(o.n, 0) AS own, CASE WHEN f.symbol IS NULL THEN 0 ELSE 1 END AS flow_rows, coalesce(a.n, 0) AS outside, CASE WHEN coalesce(o.n, 0) + coalesce(a.n, 0) > 0 OR f.symbol IS NOT NULL THEN 'ok' ELSE 'neutral' END AS status
    FROM {SENTIMENT} s LEFT JOIN (SELECT symbol, count(*) AS n FROM ({SENTIMENT_ROWS}) GROUP BY symbol) o USING (symbol) LEFT JOIN {FLOW} f USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM {ACCEPTED} WHERE reject IS NULL GROUP BY symbol) a USING (symbol)
    """)(lambda b, m, e: ev.sentiment_bundle(ev.sentiment(b), FLOWS(m), OFFICIAL(e)))
#: The scores of the suppliers whose numbers are the brands' places.
BRAND_SCORE = f"(SELECT s.symbol, fundamental_score, evidence FROM {SCORE} q JOIN {BRANDS} s ON CAST(q.symbol AS INT) = s.n)"


def SCORES(bars: DataFrame, base: DataFrame) -> DataFrame:  # noqa: N802
    return branded(bars, fu.score(thin(base), given(base)).withColumn("sk", F.col("symbol").cast("int"))).select("symbol", "fundamental_score", "evidence")


LAST_DAY = f"(SELECT c.*, d.day FROM {CONFIDENCE} c JOIN (SELECT symbol, max(trade_date) AS day FROM bars GROUP BY symbol) d USING (symbol))"
TECHNICAL = "'local_technical_analysis-v1', day"
LOCAL_ROWS = f"""
    SELECT symbol, 'fundamental.score', 'fundamental', CASE WHEN fundamental_score > 55 THEN 'positive' ELSE 'negative' END, 'local_fundamental_analysis-v2', day, least(1, abs(fundamental_score - 50) / 30), 0.75, 0.9, 'fundamental_local' FROM {LAST_DAY} JOIN {BRAND_SCORE} USING (symbol) WHERE evidence > 0 AND (fundamental_score > 55 OR fundamental_score < 45)
    UNION ALL SELECT symbol, 'technical.trend', 'technical', CASE alignment WHEN 'bullish' THEN 'positive' ELSE 'negative' END, {TECHNICAL}, 0.45, 0.65, 0.85, 'technical_local' FROM {LAST_DAY} WHERE alignment <> 'mixed'
    UNION ALL SELECT symbol, 'technical.macd', 'technical', CASE WHEN macd > macd_signal THEN 'positive' ELSE 'negative' END, {TECHNICAL}, 0.3, 0.6, 0.85, 'technical_local' FROM {LAST_DAY}
    UNION ALL SELECT symbol, 'technical.rsi.overbought', 'technical', 'negative', {TECHNICAL}, 0.35, 0.55, 0.85, 'technical_local' FROM {LAST_DAY} WHERE rsi_14 > 80
    UNION ALL SELECT symbol, 'technical.rsi.oversold', 'technical', 'positive', {TECHNICAL}, 0.25, 0.45, 0.85, 'technical_local' FROM {LAST_DAY} WHERE rsi_14 < 20"""
NAMES = "(symbol, evidence_id, dimension, polarity, source, published, strength, reliability, quality, independence_group)"
LOCAL = lambda b, f: ev.analysis_evidence(indicators.summary(indicators.all_indicators(b)), SCORES(b, f))
query("e07_analysis_evidence", "bars fin_base", f"{EVIDENCE_ROW} dimension independence_group", "strength reliability quality", f"WITH x{NAMES} AS ({LOCAL_ROWS}) SELECT * FROM x")(LOCAL)


def decision(bars: DataFrame, base: DataFrame, money: DataFrame, events: DataFrame) -> DataFrame:
    """All evidence of each brand: local, sentiment, money flow, and accepted disclosures."""
    parts = [LOCAL(bars, base), ev.sentiment_evidence(ev.sentiment(bars)), ev.flow_evidence(FLOWS(money)), OFFICIAL(events).filter("reject is null").select(*ev.ROW)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ev.adjudicate(every)


query("e08_adjudicate", "bars fin_base moneyflow_raw official_events", "symbol state evidence_count listed", "pos neg net conflict quality_min quality_mean confidence", f"""
    WITH x{NAMES} AS ({LOCAL_ROWS} UNION ALL {SENTIMENT_ROWS} UNION ALL {FLOW_ROWS} UNION ALL SELECT * EXCLUDE (reject) FROM {ACCEPTED} WHERE reject IS NULL),
    s AS (SELECT symbol, coalesce(sum(strength * reliability) FILTER (polarity = 'positive'), 0) AS pos, coalesce(sum(strength * reliability) FILTER (polarity = 'negative'), 0) AS neg, count(*) AS evidence_count, round(min(quality), 4) AS quality_min, round(avg(quality), 4) AS quality_mean,
      string_agg(DISTINCT independence_group, ',' ORDER BY independence_group) AS listed FROM x GROUP BY symbol),
    n AS (SELECT *, pos + neg AS total, (pos - neg) / nullif(pos + neg, 0) AS net, least(pos, neg) / nullif(pos + neg, 0) AS conflict FROM s)
    SELECT *, CASE WHEN total = 0 THEN 'insufficient' WHEN conflict >= 0.3 AND abs(net) < 0.25 THEN 'conflicted' WHEN net >= 0.25 THEN 'conditional_positive' WHEN net <= -0.25 THEN 'conditional_negative' ELSE 'neutral' END AS state,
      CASE WHEN total > 0 THEN round_even(least(80, abs(net) * 100 * least(1, total / 1.5)) * quality_mean, 0) ELSE 0 END AS confidence FROM n
    """, digits=3)(lambda b, f, m, e: decision(b, f, m, e).withColumn("listed", F.array_join("groups", ",")))
VALUED = lambda b: risk.valuation_summary(b.withColumns({"pe_ttm": F.col("close") / 50 - 5, "pb": F.col("volume") / 20}))
GATES = f"(SELECT symbol, CASE WHEN bool_or(status = 'fail') THEN 'block' WHEN bool_or(status = 'warn') THEN 'degraded' ELSE 'pass' END AS gate FROM {TESTED} GROUP BY symbol)"
AIM = lambda side: f"(SELECT symbol, price FROM ({TARGETS}) WHERE side = '{side}' AND rank = 1)"
query("e09_scenarios", "bars fin_rev", "symbol scenario way gate cap named", "reference_price", f"""
    WITH v AS (SELECT * FROM ({ORACLE_SQL['a06_valuation']})), j AS (SELECT c.symbol, c.close, c.label, CASE alignment WHEN 'bullish' THEN 'up' WHEN 'bearish' THEN 'down' ELSE 'sideways' END AS direction, g.gate, CASE g.gate WHEN 'block' THEN 0 WHEN 'degraded' THEN 60 ELSE 80 END AS cap,
        k.risk_level, v.summary, u.price AS upper, l.price AS lower FROM {CONFIDENCE} c JOIN {GATES} g USING (symbol) JOIN ({RISK}) k USING (symbol) JOIN v USING (symbol) JOIN {AIM('sell')} u USING (symbol) JOIN {AIM('buy')} l USING (symbol)),
    t AS (SELECT *, 'trend:' || direction || '/' || label || ';valuation:' || summary || ';risk:' || risk_level AS named FROM j)
    SELECT symbol, 'optimistic' AS scenario, 'up' AS way, gate, cap, named, upper AS reference_price FROM t UNION ALL SELECT symbol, 'base', direction, gate, cap, named, CASE WHEN direction = 'up' THEN upper ELSE lower END FROM t
    UNION ALL SELECT symbol, 'pessimistic', 'down', gate, cap, 'risk:' || risk_level, lower FROM t""", digits=2)(
    lambda b, f: ev.scenarios(rules.level_bundle(b), gate.gate(gate_checks(b, f)), risk.risk(b), VALUED(b)).withColumn("named", F.array_join("drivers", ";")))
#: Packages with nested sections, of this and the last snapshot; run ids differ and don't count.
NESTED = lambda f, run: f.selectExpr("symbol", "end_date", f"'{run}' as run_id", "named_struct('income', named_struct('revenue', revenue, 'net_profit', net_profit), 'generated_at', '{0}', 'tags', array('a', string(qn))) as statements".format(run), "qn as quarter")
query("e11_snapshot_diff", "fin_right fin_right_prev", "symbol end_date path rank", "", """
    SELECT r.symbol, r.end_date, 'statements.income.revenue' AS path, 1 AS rank FROM fin_right r JOIN fin_right_prev p USING (symbol, end_date) WHERE r.revenue IS DISTINCT FROM p.revenue
    """)(lambda a, b: ev.snapshot_diff(NESTED(b, "one"), NESTED(a, "two"), ["symbol", "end_date"]))


def signals(bars: DataFrame) -> DataFrame:
    """What packages of all modes say of each symbol; modes, quality and gaps follow from the symbol's number."""
    f = rules.levels_frame(bars)
    s = indicators.summary(indicators.all_indicators(bars)).select("symbol", "trend", "macd_cross", "rsi_state", "kdj_state", "boll_state")
    f = f.select("symbol", "volume_ratio", F.size("supports").alias("supports"), F.size("resistances").alias("resistances"), "buy_confidence", "sell_confidence").join(s, "symbol").join(risk.risk(bars).select("symbol", "risk_level"), "symbol")
    f = f.join(risk.price_percentiles(bars).select("symbol", F.col("level").alias("valuation_level")), "symbol").withColumn("k", F.expr("cast(substring(symbol, 7) as int)"))
    return f.selectExpr("*", "element_at(array('quick', 'deep', 'value', 'trade', 'other'), k % 5 + 1) as mode", "if(k % 4 = 0, 'partial', 'ok') as quality", "k % 3 as gaps")


W12, LEVELS6, A5 = ORACLE_SQL["w12_summary"], ORACLE_SQL["t06_level_bundle"], ORACLE_SQL["a05_price_percentiles"]
TAGS = {
    "trend": "true", "macd": "true", "rsi": "rsi_state <> 'neutral'", "kdj": "kdj_state <> 'neutral'", "bollinger": "boll_state <> 'inside'", "volume": "volume_ratio > 1.5 OR volume_ratio < 0.7", "support_resistance": "below <> '' OR above <> ''", "buy_signal": "buy_confidence >= 50",
    "sell_signal": "sell_confidence >= 50", "risk_analysis": "true", "risk_control": "risk_level IN ('high', 'medium_high')", "market_patterns": "true", "investment_cases": "k % 5 IN (2, 3) AND valuation_level IN ('low', 'very_low')", "risk_control#": "k % 4 = 0 OR k % 3 > 0",
}
BASE = "CASE k % 5 WHEN 1 THEN ['trend', 'technical_risk', 'risk_control'] WHEN 2 THEN ['peg_strategy', 'risk_control'] WHEN 3 THEN ['trend', 'support_resistance', 'risk_control'] ELSE [] END"
query("e12_context_tags", "bars", "symbol listed", "", f"""
    WITH j AS (SELECT w.*, l.below, l.above, l.buy_confidence, l.sell_confidence, r.risk_level, a.level AS valuation_level, v.volume_ratio, CAST(w.symbol[7:] AS INT) AS k FROM ({W12}) w JOIN ({LEVELS6}) l USING (symbol) JOIN ({RISK}) r USING (symbol) JOIN ({A5}) a USING (symbol)
      JOIN (SELECT symbol, volume_ratio FROM {CONFIDENCE}) v USING (symbol)),
    t AS (SELECT symbol, list_concat({BASE}, list_filter([{', '.join(f"CASE WHEN {cond} THEN '{name.rstrip('#')}' END" for name, cond in TAGS.items())}], lambda x: x IS NOT NULL)) AS x FROM j)
    SELECT symbol, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') AS listed FROM t""")(lambda b: ops.context_tags(signals(b)).withColumn("listed", F.array_join("tags", ",")))


def described(bars: DataFrame, base: DataFrame) -> DataFrame:
    """Descriptors of bars and of the brands' statements; some brands have no statements or a quality of their own."""
    quality = bars.select("symbol").distinct().filter("substring(symbol, -1) = '1'").selectExpr("symbol", "'bars' as dataset", "'stale' as quality")
    return ops.descriptor(bars, "bars", bars, F.col("trade_date"), quality).unionByName(ops.descriptor(bars, "statements", branded(bars, base), F.col("end_date")))


DESCRIBED = f"""(SELECT symbol, 'bars' AS dataset, count(*) AS row_count, max(trade_date) AS as_of, CASE WHEN symbol LIKE '%1' THEN 'stale' ELSE 'ok' END AS quality FROM bars GROUP BY symbol
    UNION ALL SELECT s.symbol, 'statements', count(f.sk), max(f.end_date), CASE WHEN count(f.sk) > 0 THEN 'ok' ELSE 'partial' END FROM {BRANDS} s LEFT JOIN fin_base f ON f.sk = s.n GROUP BY s.symbol)"""
query("a18_descriptor", "bars fin_base", "symbol dataset row_count as_of quality", "", f"SELECT * FROM {DESCRIBED}")(described)


def packaged(bars: DataFrame, base: DataFrame) -> DataFrame:
    """A package of each brand: what its datasets are, and its last levels."""
    wide = described(bars, base).groupBy("symbol").pivot("dataset", ["bars", "statements"]).agg(F.first(F.struct("row_count", F.col("as_of").cast("string").alias("as_of"), "quality")))
    scored = SCORES(bars, base).select("symbol", F.col("evidence").cast("int").alias("evidence"))
    return rules.package({"datasets": wide, "fundamental": scored}, AS_OF)


PACKAGE = f"""(SELECT b.symbol, CASE WHEN q.symbol IS NULL THEN 'fundamental' ELSE '' END AS missing, '{{"symbol":"' || b.symbol || '","as_of":"{AS_OF}","datasets":{{"bars":{{"row_count":' || b.row_count || ',"as_of":"' || b.as_of || '","quality":"' || b.quality || '"}},"statements":{{"row_count":' || s.row_count
      || CASE WHEN s.as_of IS NULL THEN '' ELSE ',"as_of":"' || s.as_of || '"' END || ',"quality":"' || s.quality || '"}}}}' || CASE WHEN q.symbol IS NULL THEN '' ELSE ',"fundamental":{{"evidence":' || q.evidence || '}}' END || '}}' AS body
    FROM (SELECT * FROM {DESCRIBED} WHERE dataset = 'bars') b JOIN (SELECT * FROM {DESCRIBED} WHERE dataset = 'statements') s USING (symbol) LEFT JOIN {BRAND_SCORE} q USING (symbol))"""
query("e13_package", "bars fin_base", "symbol missing digest", "", f"SELECT *, sha256(body) AS digest FROM {PACKAGE}")(lambda b, f: packaged(b, f).withColumn("missing", F.array_join("gaps", ",")))
query("e14_package_size", "bars fin_base", "symbol size", "", f"SELECT symbol, strlen(body) AS size FROM {PACKAGE}")(packaged)

# --- page text ------------------------------------------------------------------------------------

AMOUNT = lambda x: f"if({x} < 0, concat(if(sk % 2 = 0, '(', '（'), format_number(-({x}), 2), if(sk % 2 = 0, ')', '）')), format_number({x}, 2))"
LINES = [
    "'合并利润表\n单位：万元 币种：人民币\n'", "'营业收入增长率 5.2%\n'", f"concat(if(qn = 3, '', '营业总收入'), if(qn = 2, '（12） ', ' '), if(qn = 3, '', {AMOUNT('(floor(revenue / 10000) + 0.25D)')}), '\n')", f"concat('营业收入 ', {AMOUNT('(floor(revenue / 20000) + 0.25D)')}, '\n')",
    f"concat('归属于母公司股东的净利润 ', {AMOUNT('(floor(net_profit_attributable / 10000) + 0.25D)')}, '\n')", f"if(qn = 1 and sk % 3 = 0, '', concat('净利润\n', {AMOUNT('(floor(net_profit / 10000) + 0.25D)')}, ' 900\n'))", f"concat('经营活动现金流量净额（百万元） ', {AMOUNT('(floor(operating_cf / 1000000) + 0.25D)')}, '\n')", "'基本每股收益（元/股） 0.35'",
]
PAGE_FIELDS = {"revenue": textfields.Labels(("营业总收入", "营业收入")), "profit": textfields.Labels(("净利润",), reject=("归属于",)), "cash": textfields.Labels(("经营活动现金流量净额",)), "eps": textfields.Labels(("基本每股收益",), scaled=False)}
query("e16_labelled_amounts", "fin_base", "symbol end_date status", "revenue profit cash eps", """
    SELECT symbol, end_date, CASE WHEN qn = 1 AND sk % 3 = 0 THEN 'partial' ELSE 'parsed' END AS status, (floor(CASE WHEN qn = 3 THEN revenue / 20000 ELSE revenue / 10000 END) + 0.25) * 10000 AS revenue,
      CASE WHEN qn = 1 AND sk % 3 = 0 THEN NULL ELSE (floor(net_profit / 10000) + 0.25) * 10000 END AS profit, (floor(operating_cf / 1000000) + 0.25) * 1000000 AS cash, 0.35 AS eps FROM fin_base
    """, digits=2)(lambda f: textfields.labelled_amounts(f.selectExpr("symbol", "end_date", f"concat({', '.join(LINES)}) as text"), PAGE_FIELDS))

# --- operations -----------------------------------------------------------------------------------

query("a16_run_stats", "run_log", "kind name runs tokens", "cost", """
    WITH r AS (SELECT mode, CAST(mod(conv_id, 40) AS VARCHAR) AS ticker, tokens, tokens * 0.001 AS cost FROM run_log),
    k AS (SELECT 'ticker' AS kind, ticker AS name, count(*) AS runs, sum(tokens) AS tokens, round(sum(cost), 4) AS cost FROM r GROUP BY ticker ORDER BY runs DESC, name LIMIT 10)
    SELECT 'total' AS kind, '' AS name, count(*) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM r UNION ALL SELECT 'mode', mode, count(*), CAST(sum(tokens) AS BIGINT), round(sum(cost), 4) FROM r GROUP BY mode UNION ALL SELECT kind, name, runs, CAST(tokens AS BIGINT), cost FROM k
    """, digits=3)(lambda r: ops.run_stats(r.selectExpr("mode", "cast(mod(conv_id, 40) as string) as ticker", "cast(tokens as bigint) as tokens", "tokens * 0.001D as cost")))
query("a17_call_stats", "run_log", "name calls errors", "seconds", """
    WITH r AS (SELECT mode AS method, tokens * 0.01 AS elapsed, tokens > 1000 AS bad FROM run_log)
    SELECT '' AS name, count(*) AS calls, count(*) FILTER (bad) AS errors, round(sum(elapsed), 2) AS seconds FROM r UNION ALL SELECT method, count(*), count(*) FILTER (bad), round(sum(elapsed), 2) FROM r GROUP BY method
    """, digits=2)(lambda r: ops.call_stats(r.selectExpr("mode as method", "tokens * 0.01D as elapsed", "if(tokens > 1000, 'too long', '') as error")))
WHOLE = lambda c: f"CAST(CAST(floor({c} * 10000 + 0.5003) AS BIGINT) AS VARCHAR)"
DAYS = f"SELECT symbol, trade_date, sha256(concat_ws(' ', CAST(trade_date AS VARCHAR), {', '.join(map(WHOLE, ('open', 'high', 'low', 'close')))}, CAST(CAST(volume AS BIGINT) AS VARCHAR))) AS d FROM bars"
YEARS = f"SELECT symbol, year(trade_date) AS y, sha256(string_agg(d, ',' ORDER BY trade_date, d)) AS d FROM ({DAYS}) GROUP BY ALL"
HASH = f"(SELECT symbol, sha256(string_agg(d, ',' ORDER BY y)) AS data_hash FROM ({YEARS}) GROUP BY symbol)"
query("a19_data_hash", "bars", "symbol data_hash", "", f"SELECT * FROM {HASH}")(ops.data_hash)
query("b19_audit_record", "bars", "symbol run_id request_fingerprint data_hash result_digest strategy_version adjustment audit_schema_version determinism", "", f"""
    {sp.SPLIT}, r AS (SELECT symbol, run_id, fast, slow, sha256('[' || string_agg('{{"slice":"' || slice || '","trades":' || trades || '}}', ',' ORDER BY slice) || ']') AS result_digest FROM met GROUP BY ALL)
    SELECT symbol, run_id, sha256('{{"symbol":"' || symbol || '","run_id":' || run_id || ',"fast":' || fast || ',"slow":' || slow || '}}') AS request_fingerprint, data_hash, result_digest, 'ma-cross-v1' AS strategy_version, 'none' AS adjustment,
      'backtest-run-v1' AS audit_schema_version, 'deterministic_no_random_state' AS determinism FROM r JOIN {HASH} USING (symbol)
    """)(lambda b: ops.audit_record(b.select("symbol").distinct().crossJoin(F.broadcast(sp.GRID(b))), b, st.metrics(sp.HELD(b), sp.CASH).select("symbol", "run_id", "slice", "trades"), "ma-cross-v1", "none", ["run_id"]))
query("p17_redact_map", "run_log", "conv_id turn api_key mode inner_token inner_text listed", "", "SELECT conv_id, turn, '<redacted>' AS api_key, mode, '<redacted>' AS inner_token, ticker AS inner_text, '<redacted>' AS listed FROM run_log")(
    lambda r: ops.redact(r.selectExpr("conv_id", "turn", "ticker as api_key", "mode", "named_struct('Token', ticker, 'text', ticker, 'list', array(named_struct('password', ticker))) as request")).select("conv_id", "turn", "api_key", "mode", F.col("request.Token").alias("inner_token"), F.col("request.text").alias("inner_text"), F.col("request.list")[0]["password"].alias("listed")))
query("p22_parameters", "orders", "o_orderkey reason", "", """
    SELECT o_orderkey, CASE WHEN a <= 0 OR b <= 0 THEN 'ma_periods' WHEN a = b THEN 'ma_repeated' WHEN r <= 0 THEN 'rsi_period' WHEN s <= 0 THEN 'bollinger_std' WHEN f <= 0 THEN 'ma_fast' WHEN w <= 0 THEN 'ma_slow' WHEN f >= w THEN 'order' WHEN o_totalprice <= 1000 THEN 'initial_cash' WHEN j NOT IN ('none', 'qfq', 'hfq') THEN 'adjustment' END AS reason
    FROM (SELECT *, o_orderkey % 7 AS a, o_orderkey % 5 AS b, o_orderkey % 13 AS r, o_orderkey % 17 AS s, o_orderkey % 11 AS f, o_orderkey % 19 AS w, CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE 'qfq' END AS j FROM orders)
    """)(lambda o: ops.check_parameters(o.selectExpr("o_orderkey", "array(cast(o_orderkey % 7 as int), cast(o_orderkey % 5 as int)) as ma_periods", "o_orderkey % 13 as rsi_period", "o_orderkey % 17 as bollinger_std", "o_orderkey % 11 as ma_fast", "o_orderkey % 19 as ma_slow", "o_totalprice - 1000 as initial_cash", "if(o_orderkey % 23 = 0, 'x', 'qfq') as adjustment")))
