"""Queries of fundamentals, quality, reconciliation, evidence, scalars and strategy (F, D, R, U, E, P, A7-A22, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import evidence as ev
from ..operators import fundamentals as fu
from ..operators import indicators, pit, recon, risk
from .base import query

W = "PARTITION BY symbol ORDER BY trade_date"
RAT = """SELECT a.symbol, a.end_date, a.y, a.qn, n * CASE qn WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 4.0 / 3 ELSE 1 END / nullif((a.total_assets + oa) / 2, 0) * 100 AS roa, p * CASE qn WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 4.0 / 3 ELSE 1 END / nullif((a.shareholders_equity + oe) / 2, 0) * 100 AS roe
    FROM (SELECT *, net_profit AS n, net_profit_attributable AS p FROM fin_base) a LEFT JOIN (SELECT symbol, y + 1 AS y, total_assets AS oa, shareholders_equity AS oe FROM fin_base WHERE qn = 4) o USING (symbol, y)"""
query("f01_ratios", "fin_base", "symbol end_date roa_status roe_status", "roa roe", f"SELECT *, CASE WHEN roa IS NULL THEN 'missing' ELSE 'calculated' END AS roa_status, CASE WHEN roe IS NULL THEN 'missing' ELSE 'calculated' END AS roe_status FROM ({RAT})", digits=3)(fu.ratios)
query("f02_ratio_compare", "fin_base", "symbol end_date status", "roe", f"""SELECT symbol, end_date, roe, CASE WHEN mod(CAST(symbol AS INT), 3) = 0 THEN 'provider_missing' WHEN mod(CAST(symbol AS INT), 3) = 1 THEN 'close' ELSE 'definition_difference' END AS status FROM ({RAT}) WHERE roe IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY end_date DESC) = 1""", digits=3)(
    lambda f: fu.ratio_compare(fu.ratios(f), fu.ratios(f).filter("symbol % 3 > 0").withColumn("roe", F.expr("roe * if(symbol % 3 = 1, 1.01D, 1.5D) + if(symbol % 3 = 1, 0D, 1D) * signum(roe)"))))
query("f03_snapshot_ratios", "fin_base", "symbol end_date missing status", "", f"SELECT symbol, end_date, CASE WHEN roa IS NULL THEN 'roa,roe' ELSE '' END AS missing, CASE WHEN roa IS NULL THEN 'partial' ELSE 'calculated' END AS status FROM ({RAT})")(fu.snapshot_ratios)
YA = lambda c: f"(SELECT a.symbol, a.end_date, a.{c}, (a.{c} - b.{c}) / abs(nullif(b.{c}, 0)) * 100 AS growth FROM fin_base a LEFT JOIN fin_base b ON a.symbol = b.symbol AND b.y = a.y - 1 AND b.qn = a.qn)"
BAND = lambda x, cuts, rest: "CASE WHEN " + x + " IS NULL THEN 'insufficient' " + " ".join(f"WHEN {x} > {c} THEN '{n}'" for c, n in cuts) + f" ELSE '{rest}' END"
REVENUE = f"SELECT symbol, last_revenue AS latest, growth, mean_growth, periods, {BAND('growth', [(20, 'fast'), (10, 'steady'), (0, 'slow'), (-10, 'slipping')], 'falling')} AS status FROM (SELECT symbol, arg_max(revenue, end_date) AS last_revenue, arg_max(growth, end_date) AS growth, avg(growth) AS mean_growth, count(*) AS periods FROM {YA('revenue')} GROUP BY symbol)"
query("f04_revenue_trend", "fin_base", "symbol periods status", "latest growth mean_growth", REVENUE, digits=2)(fu.revenue_trend)
LASTQ = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY end_date DESC) = 1"
#: Symbols without an opening balance have no derived ROE, and of those some have a provider's.
THIN = "(mod(sk, 7) = 0 AND y > 1992)"
RAT_THIN = RAT.replace("FROM fin_base) a", f"FROM fin_base WHERE NOT {THIN}) a")
GIVEN = "(SELECT symbol, end_date, CAST(mod(sk, 30) - 4 AS DOUBLE) AS roe FROM fin_base WHERE mod(sk, 2) = 0)"
PROFIT = f"""SELECT symbol, end_date, coalesce(d.roe, p.roe) AS roe, CASE WHEN d.roe IS NOT NULL THEN 'derived' WHEN p.roe IS NOT NULL THEN 'provider' ELSE 'none' END AS source, {BAND('coalesce(d.roe, p.roe)', [(20, 'excellent'), (15, 'good'), (10, 'fair'), (0, 'weak')], 'loss')} AS status
    FROM (SELECT * FROM ({RAT_THIN}) {LASTQ}) d LEFT JOIN (SELECT symbol, roe FROM {GIVEN} {LASTQ}) p USING (symbol)"""
thin = lambda f: f.filter("not (mod(sk, 7) = 0 and y > 1992)")
given = lambda f: f.filter("mod(sk, 2) = 0").selectExpr("symbol", "end_date", "cast(mod(sk, 30) - 4 as double) as roe")
query("f05_profitability", "fin_base", "symbol end_date source status", "roe", PROFIT, digits=3)(lambda f: fu.profitability(thin(f), given(f)))
CASH = f"SELECT symbol, end_date, CASE WHEN net_profit > 0 THEN operating_cf / net_profit END AS quality, CASE WHEN net_profit <= 0 THEN 'not_applicable' ELSE {BAND('operating_cf / net_profit', [(1, 'excellent'), (0.5, 'good'), (0, 'fair')], 'poor')} END AS status FROM fin_base {LASTQ}"
query("f06_profit_quality", "fin_base", "symbol end_date status", "quality", CASH)(lambda f: fu.profit_quality(f, f))
DEBT = f"SELECT symbol, end_date, total_liabilities / total_assets * 100 AS debt_ratio, CASE WHEN total_liabilities / total_assets * 100 < 30 THEN 'low' WHEN total_liabilities / total_assets * 100 < 60 THEN 'medium' ELSE 'high' END AS status FROM fin_base {LASTQ}"
query("f07_solvency", "fin_base", "symbol end_date status", "debt_ratio", DEBT)(fu.solvency)
GROW = f"SELECT symbol, end_date, growth, {BAND('growth', [(30, 'fast'), (10, 'steady'), (0, 'slow')], 'falling')} AS status FROM (SELECT DISTINCT symbol FROM fin_base) LEFT JOIN (SELECT * FROM {YA('net_profit')} WHERE growth IS NOT NULL {LASTQ}) USING (symbol)"
query("f08_profit_growth", "fin_base", "symbol end_date status", "growth", GROW, digits=3)(fu.profit_growth)
PTS = lambda c, m: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " ELSE 0 END"


def score_sql(profit: str, source: str) -> str:
    """50, moved by revenue growth (15, 10, -15), ROE (15, 10, 5, -15), cash (10, 5, -10) and high debt (-10)."""
    of = lambda sql: sql.replace("fin_base", source)
    return f"""(WITH j AS (SELECT r.symbol, r.status AS a, p.status AS b, c.status AS c, d.status AS d FROM ({of(REVENUE)}) r JOIN ({profit}) p USING (symbol) JOIN ({of(CASH)}) c USING (symbol) JOIN ({of(DEBT)}) d USING (symbol)),
    s AS (SELECT symbol, greatest(0, least(100, 50 + {PTS('a', {'fast': 15, 'steady': 10, 'falling': -15})} + {PTS('b', {'excellent': 15, 'good': 10, 'fair': 5, 'loss': -15})} + {PTS('c', {'excellent': 10, 'good': 5, 'poor': -10})} + {PTS('d', {'high': -10})})) AS fundamental_score,
      (a IN ('fast', 'steady', 'falling'))::INT + (b <> 'insufficient')::INT + (c NOT IN ('insufficient', 'not_applicable'))::INT + (d <> 'insufficient')::INT AS evidence FROM j)
    SELECT *, CASE WHEN evidence = 0 THEN 'insufficient' WHEN fundamental_score >= 70 THEN 'excellent' WHEN fundamental_score >= 55 THEN 'good' WHEN fundamental_score >= 40 THEN 'fair' ELSE 'poor' END AS label FROM s)"""


THIN_BASE = f"(SELECT * FROM fin_base WHERE NOT {THIN})"
PROVIDER_ONLY = f"SELECT symbol, {BAND('p.roe', [(20, 'excellent'), (15, 'good'), (10, 'fair'), (0, 'weak')], 'loss')} AS status FROM (SELECT DISTINCT symbol FROM fin_base) LEFT JOIN (SELECT symbol, roe FROM {GIVEN} {LASTQ}) p USING (symbol)"
SCORE = score_sql(PROFIT, THIN_BASE)
query("f09_score", "fin_base", "symbol evidence label", "fundamental_score", f"SELECT * FROM {SCORE}")(lambda f: fu.score(thin(f), given(f)))
query("f10_score_impact", "fin_base", "symbol label provider_label label_changed", "fundamental_score provider_score change", f"""
    SELECT symbol, a.label, b.label AS provider_label, a.label <> b.label AS label_changed, a.fundamental_score, b.fundamental_score AS provider_score, a.fundamental_score - b.fundamental_score AS change
    FROM {SCORE} a JOIN {score_sql(PROVIDER_ONLY, THIN_BASE)} b USING (symbol)""")(lambda f: fu.score_impact(thin(f), given(f)))
query("d03_factor_coverage", "bars adj_factor", "symbol covered", "", "SELECT symbol, f0 <= b0 AND f1 >= b1 AS covered FROM (SELECT symbol, min(trade_date) AS b0, max(trade_date) AS b1 FROM bars GROUP BY symbol) JOIN (SELECT symbol, min(trade_date) AS f0, max(trade_date) AS f1 FROM adj_factor GROUP BY symbol) USING (symbol)")(fu.factor_coverage)
#: Bars of which some come twice, with another open, and some have no date.
REPEATED = "SELECT symbol, trade_date, open, close FROM {0} UNION ALL SELECT symbol, CASE WHEN day(trade_date) > 1 THEN trade_date END, CASE WHEN mod(day(trade_date), 2) = 0 THEN -open END, close FROM {0} WHERE day(trade_date) <= 3"
query("d06_bar_contract", "bars", "symbol bad_dates bad_prices", "", f"""
    SELECT symbol, count(*) FILTER (trade_date IS NULL OR k > 1) AS bad_dates, count(*) FILTER (open IS NULL OR open <= 0 OR close <= 0) AS bad_prices
    FROM (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) AS k FROM ({REPEATED.format('bars')})) GROUP BY symbol""")(lambda b: fu.bar_contract(b.sparkSession.sql(REPEATED.format("{b}"), b=b)))
query("a07_null_ratio", "fin_right", "symbol field", "ratio", "SELECT symbol, 'revenue' AS field, avg(CASE WHEN revenue IS NULL THEN 1.0 ELSE 0 END) AS ratio FROM fin_right GROUP BY symbol")(lambda f: fu.null_ratios(f, ["revenue"]))
query("a08_revisions", "fin_rev", "n keys revisions", "", "SELECT count(*) AS n, count(DISTINCT symbol || '/' || end_date) AS keys, count(*) - count(DISTINCT symbol || '/' || end_date) AS revisions FROM fin_rev")(lambda f: f.agg(F.count("*").alias("n"), F.countDistinct("symbol", "end_date").alias("keys")).withColumn("revisions", F.col("n") - F.col("keys")))
query("a09_value_counts", "official_events", "event_type polarity n", "", "SELECT event_type, polarity, count(*) AS n FROM official_events GROUP BY ALL")(lambda e: e.groupBy("event_type", "polarity").agg(F.count("*").alias("n")))
query("a10_missing_counts", "fin_base", "field n", "", f"SELECT 'roa' AS field, count(*) FILTER (roa IS NULL) AS n FROM ({RAT}) UNION ALL SELECT 'roe', count(*) FILTER (roe IS NULL) FROM ({RAT})")(lambda f: fu.snapshot_ratios(f).select(F.explode(F.split("missing", ",")).alias("field")).filter("field != ''").groupBy("field").agg(F.count("*").alias("n")))
CELLS = """(SELECT l.symbol, l.end_date, f.field, CASE f.field WHEN 'revenue' THEN l.revenue ELSE l.net_profit END AS lv, CASE f.field WHEN 'revenue' THEN r.revenue ELSE r.net_profit END AS rv
    FROM fin_base l JOIN fin_right r ON l.symbol = r.symbol AND l.end_date = r.end_date CROSS JOIN (SELECT unnest(['revenue', 'net_profit']) AS field) f)"""
SAME = lambda a, b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false ELSE abs({a} - {b}) <= 1e-6 + 1e-4 * greatest(abs({a}), abs({b}), 1) END"
BUCKET = f"CASE WHEN lv IS NULL AND rv IS NULL THEN 'missing_both' WHEN lv IS NULL THEN 'missing_left' WHEN rv IS NULL THEN 'missing_right' WHEN {SAME('lv', 'rv')} THEN 'exact' WHEN d < 0.01 THEN 'under_1pct' WHEN d < 0.1 THEN '1_to_10pct' WHEN d < 0.5 THEN '10_to_50pct' ELSE 'over_50pct' END"
BC = f"(SELECT *, {SAME('lv', 'rv')} AS matches, {BUCKET} AS bucket FROM (SELECT *, abs(lv - rv) / greatest(abs(lv), abs(rv), 1e-12) AS d FROM {CELLS}))"
FIELDS = ["revenue", "net_profit"]
query("j05_common_period", "fin_base fin_right", "symbol end_date", "", "SELECT symbol, max(end_date) AS end_date FROM fin_base JOIN fin_right USING (symbol, end_date) GROUP BY symbol")(lambda a, b: a.join(b, ["symbol", "end_date"]).groupBy("symbol").agg(F.max("end_date").alias("end_date")))
query("j06_alignment", "fin_base fin_right", "symbol end_date side", "", "SELECT l.symbol, l.end_date, CASE WHEN r.symbol IS NULL THEN 'left_only' ELSE 'matched' END AS side FROM fin_base l LEFT JOIN fin_right r ON l.symbol = r.symbol AND l.end_date = r.end_date")(recon.alignment)
query("r01_tolerant_equal", "fin_base fin_right", "symbol end_date field matches", "", f"SELECT * FROM {BC}")(lambda a, b: recon.compared(a, b, FIELDS))
query("r02_bucket", "fin_base fin_right", "symbol end_date field bucket", "", f"SELECT * FROM {BC}")(lambda a, b: recon.compared(a, b, FIELDS))
query("a12_field_profile", "fin_base fin_right", "field cells comparable mismatches sign_flips", "median_rel max_rel", f"SELECT field, count(*) AS cells, count(lv - rv) AS comparable, count(*) FILTER (NOT matches) AS mismatches, count(*) FILTER (lv * rv < 0) AS sign_flips, median(d) AS median_rel, max(d) AS max_rel FROM {BC} GROUP BY field")(lambda a, b: recon.field_profile(recon.compared(a, b, FIELDS)))
query("a13_security_profile", "fin_base fin_right", "symbol field b_exact b_under_1pct b_over_50pct b_missing_right mismatches", "", f"SELECT symbol, field, {', '.join(f"count(*) FILTER (bucket = '{b}') AS b_{b}" for b in ('exact', 'under_1pct', 'over_50pct', 'missing_right'))}, count(*) FILTER (NOT matches) AS mismatches FROM {BC} GROUP BY ALL")(lambda a, b: recon.security_profile(recon.compared(a, b, FIELDS)))
query("u01_patch_merge", "fin_base fin_right", "symbol end_date", "revenue", "SELECT l.symbol, l.end_date, CASE WHEN r.symbol IS NULL THEN l.revenue ELSE r.revenue END AS revenue FROM fin_base l LEFT JOIN fin_right r ON l.symbol = r.symbol AND l.end_date = r.end_date", digits=2)(lambda a, b: recon.patched(a.select(*recon.KEY, "revenue"), [b.select(*recon.KEY, "revenue")], recon.KEY))
query("u02_keep_first", "official_events", "symbol item_id", "", "SELECT symbol, min(item_id) AS item_id FROM official_events GROUP BY symbol, published")(lambda e: pit.keep_first(e, ["symbol", "published"], ["item_id"]))
query("u03_key_difference", "fin_base fin_right", "symbol end_date", "", "SELECT symbol, end_date FROM fin_base EXCEPT SELECT symbol, end_date FROM fin_right")(lambda a, b: a.select(*recon.KEY).exceptAll(b.select(*recon.KEY)))
CODE = "lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0')"
query("p01_normalize_symbol", "customer", "c_custkey symbol error", "", f"SELECT c_custkey, CASE WHEN mod(c_custkey, 10) = 0 THEN NULL ELSE d || '.' || x END AS symbol, CASE WHEN mod(c_custkey, 10) = 0 THEN 'format' END AS error FROM (SELECT c_custkey, d, CASE WHEN d LIKE '4%' OR d LIKE '8%' OR d LIKE '920%' THEN 'BJ' WHEN d[1] IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END AS x FROM (SELECT c_custkey, {CODE} AS d FROM customer))")(
    lambda c: c.select("c_custkey", fn.normalize_symbol(F.expr("concat(if(c_custkey % 10 = 0, 'x', ' '), lpad(cast(c_custkey * 7919 % 1000000 as string), 6, '0'))")).alias("x")).select("c_custkey", "x.symbol", "x.error"))
query("p02_announcement_symbol", "customer", "c_custkey code market", "", f"SELECT c_custkey, d AS code, CASE WHEN d[1] IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END AS market FROM (SELECT c_custkey, {CODE} AS d FROM customer)")(
    lambda c: c.select("c_custkey", fn.announcement_symbol(F.expr("lpad(cast(c_custkey * 7919 % 1000000 as string), 6, '0')")).alias("x")).select("c_custkey", "x.code", "x.market"))
query("p03_number", "customer", "c_custkey", "x", "SELECT c_custkey, CASE WHEN mod(c_custkey, 3) = 0 THEN c_acctbal END AS x FROM customer")(lambda c: c.select("c_custkey", fn.number(F.expr("case c_custkey % 3 when 0 then cast(c_acctbal as string) when 1 then 'n/a' else 'NaN' end")).alias("x")))
query("p04_first_named", "fin_right", "symbol end_date name", "value", "SELECT symbol, end_date, CASE WHEN revenue IS NOT NULL THEN 'revenue' ELSE 'net_profit' END AS name, coalesce(revenue, net_profit) AS value FROM fin_right", digits=2)(lambda f: f.select("symbol", "end_date", fn.first_named(["revenue", "net_profit"]).alias("x")).select("symbol", "end_date", "x.*"))
query("p05_announced", "fin_rev", "symbol end_date load_seq d", "", "SELECT symbol, end_date, load_seq, ann_date AS d FROM fin_rev")(lambda f: f.withColumn("d", pit.announced(f)))
query("p08_report_type", "fin_base", "symbol end_date kind", "", "SELECT symbol, end_date, CASE qn WHEN 1 THEN 'q1' WHEN 2 THEN 'semiannual' WHEN 3 THEN 'q3' ELSE 'annual' END AS kind FROM fin_base")(lambda f: f.withColumn("kind", fn.report_type(F.col("end_date"))))
query("p09_annualization", "fin_base", "symbol end_date", "k", "SELECT symbol, end_date, CASE qn WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 4.0 / 3 ELSE 1 END AS k FROM fin_base")(lambda f: f.withColumn("k", fn.annualization(F.col("end_date"))))
query("p10_safe_ratio", "orders", "o_orderkey status", "value", "SELECT o_orderkey, CASE WHEN mod(o_orderkey, 5) = 0 THEN 'division_by_zero' ELSE 'calculated' END AS status, o_totalprice / nullif(mod(o_orderkey, 5), 0) * 100 AS value FROM orders", digits=2)(lambda o: o.select("o_orderkey", fn.safe_ratio(F.col("o_totalprice"), F.expr("o_orderkey % 5")).alias("x")).select("o_orderkey", "x.*"))
query("p12_clip", "customer", "c_custkey", "x", "SELECT c_custkey, greatest(least(c_acctbal, 5000), 0) AS x FROM customer")(lambda c: c.select("c_custkey", fn.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("x")))
query("p13_suspended", "orders", "o_orderkey x", "", "SELECT o_orderkey, mod(o_orderkey, 4) < 2 AS x FROM orders")(lambda o: o.select("o_orderkey", fn.is_suspended(F.expr("element_at(array(' YES', '停牌', 'no', null), cast(o_orderkey % 4 + 1 as int))")).alias("x")))
query("p14_executable", "bars", "symbol trade_date buy sell", "", "SELECT symbol, trade_date, open < 9000 AS buy, open > 1000 AS sell FROM bars")(lambda b: b.select("symbol", "trade_date", *[fn.executable(s, F.col("open"), F.lit(False), F.lit(9000.0), F.lit(1000.0)).alias(s) for s in ("buy", "sell")]))
query("p15_fees", "bars", "symbol trade_date", "buy sell", "SELECT symbol, trade_date, greatest(5, amount * 0.0003) + amount * 0.00001 AS buy, greatest(5, amount * 0.0003) + amount * 0.00051 AS sell FROM bars")(lambda b: b.select("symbol", "trade_date", *[fn.fee(F.col("amount"), s).alias(s) for s in ("buy", "sell")]))
query("p16_run_cost", "run_log", "conv_id turn", "cost", "SELECT conv_id, turn, tokens * 2e-6 + turn * 8e-6 AS cost FROM run_log", digits=6)(lambda r: r.select("conv_id", "turn", fn.run_cost(F.col("tokens"), F.col("turn")).alias("cost")))
query("p18_redact_text", "documents", "doc_id x", "", r"SELECT doc_id, substring(regexp_replace(text, '(?i)([\w-]*(?:key|token|password|secret)[\w-]*)\s*[:=]\s*\S+', '\1=***', 'g'), 1, 500) AS x FROM documents")(lambda d: d.select("doc_id", fn.redact_text(F.col("text")).alias("x")))
query("p19_has_secret", "documents", "doc_id x", "", r"""SELECT doc_id, regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '(?i)(api_?key|token|secret|password)\s*[:=]\s*["''][A-Za-z0-9_\-]{16,}["'']') OR regexp_matches(text, '\bsk-[A-Za-z0-9]{16,}') AS x FROM documents""")(lambda d: d.select("doc_id", fn.has_secret(F.col("text")).alias("x")))
query("p20_units", "bars", "symbol trade_date", "amount_100k volume_10k", "SELECT symbol, trade_date, amount / 1e5 AS amount_100k, volume / 1e4 AS volume_10k FROM bars")(lambda b: b.select("symbol", "trade_date", (F.col("amount") / 1e5).alias("amount_100k"), (F.col("volume") / 1e4).alias("volume_10k")))
query("p21_fingerprint", "supplier", "s_suppkey x", "", """SELECT s_suppkey, sha256('{"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}')[1:16] AS x FROM supplier""")(lambda s: s.select("s_suppkey", fn.fingerprint("s_suppkey", "s_nationkey").alias("x")))
