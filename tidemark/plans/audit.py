"""Queries of reconciliation at a date, the audit queue, data checks and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..operators import gate, ledger, recon
from .analysis import SAME
from .base import query

AS_OF = "1997-06-30"
T3 = "fin_rev fin_right fin_right_prev"
W = "PARTITION BY symbol ORDER BY trade_date"
#: What the indicators of the test data are made of, by side: the other source's EPS and ROE differ for some symbols, its ROA is missing for some.
INDICATOR = {
    "left": ["net_profit / 1000 AS eps", "net_profit / 500 AS roe", "net_profit / 2000 AS roa"],
    "right": ["net_profit / 1000 * CASE WHEN mod(sk, 5) = 2 THEN 1.2E0 ELSE 1.0E0 END AS eps", "net_profit / 500 * CASE WHEN mod(sk, 5) = 3 THEN 1.6E0 ELSE 1.0E0 END AS roe", "CASE WHEN mod(sk, 4) > 0 THEN net_profit / 2000 END AS roa"],
    "prev": ["net_profit / 1000 * CASE WHEN mod(sk + 1, 5) = 2 THEN 1.2E0 ELSE 1.0E0 END AS eps", "net_profit / 500 * CASE WHEN mod(sk, 5) = 3 THEN 1.6E0 ELSE 1.0E0 END AS roe", "CASE WHEN mod(sk, 3) > 0 THEN net_profit / 2000 END AS roa"],
}
FIELDS = {"income": ["revenue", "net_profit"], "fina_indicator": ["eps", "roe", "roa"]}
SOURCES = {"left": "fin_rev", "right": "fin_right", "prev": "fin_right_prev"}
REVISION = ["ann_date", "update_flag", "report_type", "load_seq"]


def dated(frame: DataFrame) -> DataFrame:
    """The other source announces each period once, after 45 days."""
    return frame.selectExpr("*", "cast(end_date + interval 45 days as date) as ann_date", "'0' as update_flag", "'1' as report_type", "1 as load_seq")


def sets(left: DataFrame, right: DataFrame, before: DataFrame) -> dict[str, tuple[DataFrame, DataFrame, DataFrame, list[str]]]:
    sides = {"left": left, "right": dated(right), "prev": dated(before)}
    of = lambda k: sides[k].selectExpr("symbol", "end_date", *REVISION, *INDICATOR[k])
    return {"income": (*sides.values(), FIELDS["income"]), "fina_indicator": (*map(of, sides), FIELDS["fina_indicator"])}


def reports(right: DataFrame) -> DataFrame:
    """Parsed reports with the names of what couldn't be read; those of every ninth symbol miss nine fields in one quarter."""
    return recon.unreadable_reports(right.selectExpr("symbol", "end_date", "if(mod(sk, 9) = 0 and qn = 2, 'a,b,c,d,e,f,g,h,i', if(mod(sk, 9) = 1, 'a,b', null)) as missing"))


def decisions(left: DataFrame) -> DataFrame:
    return left.filter("mod(sk, 17) = 0 and load_seq = 1").selectExpr("'income' as dataset", "symbol", "end_date", "'revenue' as field", "if(qn = 4, ' ', ' keep ') as decision")


def QUEUE(left: DataFrame, right: DataFrame, before: DataFrame) -> DataFrame:  # noqa: N802
    return recon.audit_rows(sets(left, right, before), AS_OF, reports(right), decisions(left))


# --- the same in DuckDB --------------------------------------------------------------------------

KNOWN = f"end_date <= DATE '{AS_OF}' AND ann_date <= DATE '{AS_OF}'"
DATED = {"left": "fin_rev", "right": "(SELECT *, CAST(end_date + INTERVAL 45 DAYS AS DATE) AS ann_date, '0' AS update_flag, 1 AS load_seq FROM fin_right)", "prev": "(SELECT *, CAST(end_date + INTERVAL 45 DAYS AS DATE) AS ann_date, '0' AS update_flag, 1 AS load_seq FROM fin_right_prev)"}
ONE = f"WHERE {KNOWN} QUALIFY row_number() OVER (PARTITION BY symbol, end_date ORDER BY ann_date DESC, update_flag DESC, load_seq DESC) = 1"


def cells_sql(side: str, rows: str) -> str:
    """Long form of all fields of a side."""
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dataset, symbol, end_date, qn, sk, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM (SELECT symbol, sk, qn, end_date, revenue, net_profit, {', '.join(INDICATOR[side])} FROM ({rows}))" for d, fs in FIELDS.items() for f in fs)


def bucket_sql(a: str, b: str) -> str:
    share = f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-12)"
    return f"""CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'missing_both' WHEN {a} IS NULL THEN 'missing_left' WHEN {b} IS NULL THEN 'missing_right' WHEN {SAME(a, b)} THEN 'exact'
      WHEN {share} < 0.01 THEN 'under_1pct' WHEN {share} < 0.1 THEN '1_to_10pct' WHEN {share} < 0.5 THEN '10_to_50pct' ELSE 'over_50pct' END"""


POINTS = "CASE bucket WHEN 'over_50pct' THEN 90 WHEN '10_to_50pct' THEN 70 WHEN 'missing_left' THEN 65 WHEN 'missing_right' THEN 60 WHEN '1_to_10pct' THEN 35 WHEN 'under_1pct' THEN 15 ELSE 0 END + CASE state WHEN 'new' THEN 25 WHEN 'changed' THEN 20 ELSE 0 END"
KEYS = "dataset, symbol, end_date, field"
STATES = f"""
    l AS ({cells_sql('left', f"SELECT * FROM {DATED['left']} {ONE}")}), r AS ({cells_sql('right', f"SELECT * FROM {DATED['right']} {ONE}")}), p AS ({cells_sql('prev', f"SELECT * FROM {DATED['prev']} {ONE}")}),
    every AS ({cells_sql('left', f"SELECT * FROM fin_rev WHERE {KNOWN}")}),
    cells AS (SELECT l.*, r.v AS rv, p.v AS pv, {bucket_sql('l.v', 'r.v')} AS bucket, {bucket_sql('l.v', 'p.v')} AS previous_bucket FROM l JOIN r USING ({KEYS}) LEFT JOIN p USING ({KEYS})),
    states AS (SELECT * FROM (SELECT *, CASE WHEN bucket = 'exact' AND previous_bucket NOT IN ('exact', 'missing_both') THEN 'resolved' WHEN bucket IN ('exact', 'missing_both') THEN NULL WHEN previous_bucket IN ('exact', 'missing_both') THEN 'new'
      WHEN {bucket_sql('rv', 'pv')} = 'exact' THEN 'carried_forward' ELSE 'changed' END AS state FROM cells) WHERE state IS NOT NULL)"""
SCORED = f"""{STATES},
    scored AS (SELECT *, CASE WHEN state = 'resolved' THEN 'resolved_regression' WHEN dataset = 'fina_indicator' AND field = 'roa' AND bucket = 'missing_right' THEN 'formula_coverage' WHEN dataset = 'fina_indicator' AND field IN ('roe', 'eps') THEN 'derived_indicator' ELSE 'base_financial' END AS role,
      CASE WHEN state = 'resolved' OR dataset = 'fina_indicator' AND field = 'roa' AND bucket = 'missing_right' THEN 0 ELSE {POINTS} - CASE WHEN dataset = 'fina_indicator' AND field IN ('roe', 'eps') THEN 20 ELSE 0 END END AS priority FROM states),
    revised AS (SELECT s.*, EXISTS (SELECT 1 FROM every e WHERE e.dataset = s.dataset AND e.symbol = s.symbol AND e.end_date = s.end_date AND e.field = s.field AND e.v IS NOT NULL AND s.rv IS NOT NULL AND {SAME('s.rv', 'e.v')}) AND state <> 'resolved' AS rev FROM scored s)"""
QUEUED = f"""{SCORED},
    roles AS (SELECT * EXCLUDE (role, priority), CASE WHEN manual THEN 'manual_decision' WHEN bad THEN 'source_unreadable' WHEN rev THEN 'provider_revision' ELSE role END AS role, CASE WHEN manual OR bad THEN 0 WHEN rev THEN 5 ELSE priority END AS priority
      FROM (SELECT *, mod(sk, 9) = 0 AND qn = 2 AND state <> 'resolved' AS bad, mod(sk, 17) = 0 AND qn <> 4 AND dataset = 'income' AND field = 'revenue' AS manual FROM revised)),
    queue AS (SELECT *, dataset || '.' || field || '.' || CASE WHEN state = 'resolved' THEN previous_bucket ELSE bucket END || '.' || CASE qn WHEN 1 THEN 'q1' WHEN 2 THEN 'semiannual' WHEN 3 THEN 'q3' ELSE 'annual' END AS cluster,
      role NOT IN ('formula_coverage', 'derived_indicator', 'provider_revision', 'source_unreadable', 'manual_decision') AS eligible, state <> 'resolved' AS is_open FROM roles),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY priority DESC, symbol, end_date) AS cluster_rank FROM queue),
    picked AS (SELECT * FROM ranked WHERE cluster_rank <= 3 AND eligible AND is_open ORDER BY priority DESC, cluster, symbol, end_date LIMIT 30)"""
ROW = "dataset symbol end_date field"

query("j07_three_way", T3, f"{ROW} bucket previous_bucket state", "", f"WITH {STATES} SELECT * FROM states")(lambda a, b, c: QUEUE(a, b, c))
query("r06_states", T3, "state bucket n", "", f"WITH {STATES} SELECT state, bucket, count(*) AS n FROM states GROUP BY ALL")(lambda a, b, c: QUEUE(a, b, c).groupBy("state", "bucket").agg(F.count("*").alias("n")))
query("r07_priority", T3, f"{ROW} priority role", "", f"WITH {SCORED} SELECT * FROM scored")(
    lambda a, b, c: recon.prioritized(_states(a, b, c)))
query("j08_any_revision", T3, ROW, "", f"WITH {SCORED} SELECT * FROM revised WHERE rev")(lambda a, b, c: recon.audit_rows(sets(a, b, c), AS_OF).filter("role = 'provider_revision'"))
query("j09_decisions", T3, f"{ROW} priority", "", f"WITH {QUEUED} SELECT * FROM queue WHERE role = 'manual_decision'")(lambda a, b, c: QUEUE(a, b, c).filter("role = 'manual_decision'"))
query("r08_overrides", T3, f"{ROW} priority role", "", f"WITH {QUEUED} SELECT * FROM queue")(QUEUE)
query("w20_cluster_rank", T3, f"{ROW} cluster cluster_rank", "", f"WITH {QUEUED} SELECT * FROM ranked")(lambda a, b, c: recon.cluster_ranked(QUEUE(a, b, c)))
query("t10_audit_batch", T3, f"{ROW} cluster priority cluster_rank", "", f"WITH {QUEUED} SELECT * FROM picked")(lambda a, b, c: recon.selected(QUEUE(a, b, c)))
query("r09_audit_queue", T3, f"{ROW} state role priority cluster selected", "", f"""
    WITH {QUEUED} SELECT q.*, k.field IS NOT NULL AS selected FROM queue q LEFT JOIN picked k ON q.dataset = k.dataset AND q.symbol = k.symbol AND q.end_date = k.end_date AND q.field = k.field
    """)(lambda a, b, c: _tables(QUEUE(a, b, c)))
SUMMARY = ["open_candidates", "resolved_since_previous", "carried_forward", "new_or_changed", *[f"excluded_{r}" for r in recon.EXPLAINED], "actionable_open_candidates", "selected_candidates", "selected_reports", "max_per_cluster", "max_candidates"]
query("r10_queue_summary", T3, " ".join(SUMMARY), "", f"""
    WITH {QUEUED} SELECT count(*) FILTER (is_open) AS open_candidates, count(*) FILTER (NOT is_open) AS resolved_since_previous, count(*) FILTER (state = 'carried_forward') AS carried_forward, count(*) FILTER (state IN ('new', 'changed')) AS new_or_changed,
      {', '.join(f"count(*) FILTER (is_open AND role = '{r}') AS excluded_{r}" for r in recon.EXPLAINED)}, count(*) FILTER (is_open AND eligible) AS actionable_open_candidates,
      (SELECT count(*) FROM picked) AS selected_candidates, (SELECT count(DISTINCT (symbol, end_date)) FROM picked) AS selected_reports, 3 AS max_per_cluster, 30 AS max_candidates FROM queue
    """)(lambda a, b, c: recon.queue_summary(QUEUE(a, b, c)))


def _states(left: DataFrame, right: DataFrame, before: DataFrame) -> DataFrame:
    """Differences of both datasets with their states, before scores."""
    parts = [recon.three_way(recon.known(a, AS_OF), recon.known(b, AS_OF), recon.known(c, AS_OF), fields).withColumn("dataset", F.lit(name)) for name, (a, b, c, fields) in sets(left, right, before).items()]
    return parts[0].unionByName(parts[1])


def _tables(queue: DataFrame) -> DataFrame:
    """The open table with its flag, and the resolved one."""
    listed, _, resolved = recon.audit_tables(queue)
    return listed.unionByName(resolved.withColumn("selected", F.lit(False)))


RECONCILED = "dataset left_rows right_rows left_revisions right_revisions left_future right_future matched left_only right_only cells mismatches status"
FUTURE = f"(end_date > DATE '{AS_OF}' OR ann_date > DATE '{AS_OF}')"


def reconcile_sql(dataset: str) -> str:
    of = lambda side: f"(SELECT count(*) FILTER (NOT {FUTURE}) AS {side}_rows, count(*) FILTER ({FUTURE}) AS {side}_future, count(*) FILTER (NOT {FUTURE}) - count(DISTINCT (symbol, end_date)) FILTER (NOT {FUTURE}) AS {side}_revisions FROM {DATED[side]})"
    key = lambda side: f"SELECT DISTINCT symbol, end_date FROM {DATED[side]} WHERE {KNOWN}"
    return f"""SELECT '{dataset}' AS dataset, a.*, b.*, k.*, c.*, CASE WHEN k.left_only = 0 AND k.right_only = 0 AND mismatches = 0 THEN 'pass' ELSE 'partial' END AS status FROM {of('left')} a, {of('right')} b,
      (SELECT count(*) FILTER (x.symbol IS NOT NULL AND y.symbol IS NOT NULL) AS matched, count(*) FILTER (y.symbol IS NULL) AS left_only, count(*) FILTER (x.symbol IS NULL) AS right_only FROM ({key('left')}) x FULL JOIN ({key('right')}) y ON x.symbol = y.symbol AND x.end_date = y.end_date) k,
      (SELECT count(*) AS cells, count(*) FILTER (NOT {SAME('v', 'rv')}) AS mismatches FROM cells WHERE dataset = '{dataset}') c"""


BOTH = f"WITH {STATES}, reconciled AS ({reconcile_sql('income')} UNION ALL {reconcile_sql('fina_indicator')})"


def reconciled(left: DataFrame, right: DataFrame, before: DataFrame) -> DataFrame:
    parts = [recon.reconcile(a, b, fields, name, AS_OF) for name, (a, b, _, fields) in sets(left, right, before).items()]
    return parts[0].unionByName(parts[1])


query("r03_reconcile", T3, RECONCILED, "", f"{BOTH} SELECT * FROM reconciled")(reconciled)
query("r04_reconcile_sets", T3, "datasets mismatches status", "", f"{BOTH} SELECT count(*) AS datasets, CAST(sum(mismatches) AS BIGINT) AS mismatches, CASE WHEN bool_or(status = 'insufficient') THEN 'insufficient' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'pass' END AS status FROM reconciled")(
    lambda a, b, c: recon.overall(reconciled(a, b, c)))
#: Numbers as text and a column that is never a number on the right.
MIXED = lambda f, tag: f.selectExpr("symbol", "end_date", "revenue", "cast(net_profit as string) as net_profit", f"{tag} as note", "cast(null as double) as gap")
query("u04_shared_numeric", "fin_base fin_right", "field left_numbers right_numbers", "", """
    SELECT 'revenue' AS field, (SELECT count(revenue) FROM fin_base) AS left_numbers, (SELECT count(revenue) FROM fin_right) AS right_numbers
    UNION ALL SELECT 'net_profit', (SELECT count(net_profit) FROM fin_base), (SELECT count(net_profit) FROM fin_right)
    UNION ALL SELECT 'note', (SELECT count(*) FROM fin_base WHERE mod(sk, 2) = 0), 0
    """)(lambda a, b: recon.shared_numeric(MIXED(a, "if(mod(sk, 2) = 0, '12', 'x')"), MIXED(b, "'x'")))
query("j10_ledger_join", "fin_base fin_rev", "symbol end_date versions unique_key", "", """
    SELECT b.symbol, b.end_date, coalesce(n, 0) AS versions, coalesce(n, 0) <= 1 AS unique_key FROM fin_base b LEFT JOIN (SELECT symbol, end_date, count(*) AS n FROM fin_rev GROUP BY ALL) r USING (symbol, end_date)
    """)(lambda a, b: ledger.key_counts(a, b))
query("j10_joined", "fin_base fin_rev", "symbol end_date load_seq", "net_profit corrected", "SELECT b.symbol, b.end_date, load_seq, b.net_profit, r.revenue AS corrected FROM fin_base b LEFT JOIN (SELECT * FROM fin_rev WHERE load_seq = 2) r USING (symbol, end_date)", digits=2)(
    lambda a, b: ledger.ledger_join(a.select("symbol", "end_date", "net_profit"), b.filter("load_seq = 2").select("symbol", "end_date", "load_seq", F.col("revenue").alias("corrected")), ["symbol", "end_date"]))

# --- data checks and the gate --------------------------------------------------------------------

#: Bars with gaps: some values are missing, some highs and lows lie inside the body.
BROKEN = {"high": "CASE WHEN mod(CAST(floor(volume) AS BIGINT), 97) = 0 THEN NULL WHEN mod(CAST(floor(volume) AS BIGINT), 89) = 0 THEN open - 1 ELSE high END", "low": "CASE WHEN mod(CAST(floor(volume) AS BIGINT), 83) = 0 THEN close + 1 ELSE low END", "volume": "CASE WHEN mod(CAST(floor(amount) AS BIGINT), 101) = 0 THEN 0 ELSE volume END"}
broken = lambda b: b.selectExpr("symbol", "trade_date", "open", "close", *[f"{sql} AS {c}" for c, sql in BROKEN.items()])
BARS = f"(SELECT symbol, trade_date, open, close, {', '.join(f'{sql} AS {c}' for c, sql in BROKEN.items())} FROM bars)"
BAR_RULES = {"null_open": "open IS NULL", "null_high": "high IS NULL", "null_low": "low IS NULL", "null_close": "close IS NULL", "null_volume": "volume IS NULL", "jump": "jump", "high_below_body": "high < greatest(open, close)", "low_above_body": "low > least(open, close)", "zero_volume": "volume = 0"}
CHECKED = f"""(SELECT symbol, x.rule AS rule, x.n AS n FROM (SELECT symbol, unnest([{', '.join(f"struct_pack(rule := '{k}', n := count(*) FILTER ({v}))" for k, v in BAR_RULES.items())}]) AS x FROM (SELECT *, abs(close / lag(close) OVER ({W}) - 1) > 0.11 AS jump FROM {BARS}) GROUP BY symbol) WHERE x.n > 0)"""
query("d01_check_bars", "bars", "symbol rule n", "", f"SELECT * FROM {CHECKED}")(lambda b: fu.check_bars(broken(b)))
#: Statements with all kinds of faults: quarters that are left out, negative revenue, a column that is mostly missing.
FAULTY = "SELECT symbol, end_date, CASE WHEN mod(sk + qn, 7) = 0 THEN -revenue ELSE revenue END AS revenue, total_assets, CASE WHEN mod(sk, 3) = 0 AND mod(qn, 4) > 0 THEN NULL ELSE net_profit END AS net_profit FROM {} WHERE NOT (mod(sk, 4) = 0 AND qn IN (2, 3))"
NEGATIVE = ("revenue", "total_assets")
FAULTS = f"""(WITH s AS ({FAULTY.format('fin_base')}), g AS (SELECT *, end_date - lag(end_date) OVER (PARTITION BY symbol ORDER BY end_date) > 200 AS gap FROM s)
    SELECT symbol, 'period_gap' AS rule, count(*) AS n FROM g WHERE gap GROUP BY symbol UNION ALL SELECT symbol, 'negative_revenue', count(*) FROM g WHERE revenue < 0 GROUP BY symbol
    UNION ALL SELECT symbol, 'null_net_profit', 1 FROM g GROUP BY symbol HAVING avg((net_profit IS NULL)::INT) > 0.5)"""
faulty = lambda f: f.sparkSession.sql(FAULTY.format("{f}"), f=f)
query("d02_check_statements", "fin_base", "symbol rule n", "", f"SELECT * FROM {FAULTS}")(lambda f: fu.check_statements(faulty(f), NEGATIVE))
#: Every brand has the statements of one supplier, but for the first.
BRANDS = "(SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS n FROM (SELECT DISTINCT symbol FROM bars))"
branded = lambda bars, f: f.join(bars.select("symbol").distinct().selectExpr("symbol as brand", "row_number() over (order by symbol) - 1 as n"), F.expr("sk = n")).drop("symbol").withColumnRenamed("brand", "symbol")
query("d04_report", "bars fin_base", "symbol valid warnings details", "", f"""
    WITH s AS (SELECT symbol, n FROM {BRANDS}), f AS (SELECT s.symbol, rule FROM {FAULTS} q JOIN s ON CAST(q.symbol AS INT) = s.n),
    c AS (SELECT symbol, CASE WHEN mod(n, 5) = 0 THEN false ELSE true END AS covered FROM s),
    every AS (SELECT symbol, rule FROM {CHECKED} UNION ALL SELECT * FROM f UNION ALL SELECT symbol, 'factor_coverage' FROM c WHERE NOT covered)
    SELECT s.symbol, count(rule) = 0 AS valid, count(rule) AS warnings, coalesce(string_agg(rule, ',' ORDER BY rule), '') AS details FROM s LEFT JOIN every USING (symbol) GROUP BY s.symbol
    """)(lambda b, f: _report(b, f))


def _report(bars: DataFrame, base: DataFrame) -> DataFrame:
    """Bars, statements and factors of each brand; every fifth brand's factors begin a day late."""
    numbered = bars.select("symbol").distinct().selectExpr("symbol", "row_number() over (order by symbol) - 1 as n")
    factors = bars.join(numbered, "symbol").groupBy("symbol", "n").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).selectExpr("symbol", "explode(array(date_add(a, if(mod(n, 5) = 0, 1, 0)), b)) as trade_date")
    bare = fu.factor_coverage(bars, factors).filter("not covered").select("symbol", F.lit("factor_coverage").alias("rule"), F.lit(1).cast("bigint").alias("n"))
    statements = branded(bars, fu.check_statements(faulty(base), NEGATIVE).withColumn("sk", F.col("symbol").cast("int")).withColumnRenamed("n", "times")).select("symbol", "rule", F.col("times").alias("n"))
    return fu.report(bars, fu.check_bars(broken(bars)), statements, bare)


#: Requests: the last day of each brand's bars, for some brands a bad day, an earlier or a later one, or a weekend.
DAY = "CASE mod(n, 6) WHEN 1 THEN '1998-13-01' WHEN 2 THEN CAST(CAST(last - INTERVAL 10 DAYS AS DATE) AS VARCHAR(20)) WHEN 3 THEN '2001-01-06' ELSE CAST(last AS VARCHAR(20)) END"
QUALITY = "CASE mod(n, 7) WHEN 1 THEN 'partial' WHEN 2 THEN 'invalid' WHEN 3 THEN 'odd' ELSE 'ok' END"
SOUND = "mod(n, 4) = 1"
TESTED = f"""(WITH s AS (SELECT * FROM {BRANDS}), d AS (SELECT symbol, count(*) AS rows, max(trade_date) AS last, count(*) FILTER (high IS NULL) AS odd, count(*) FILTER (high < greatest(open, close) OR low > least(open, close) OR least(open, high, low, close) <= 0 OR volume < 0) AS outside
      FROM (SELECT b.symbol, b.trade_date, b.open, b.close, b.volume, CASE WHEN {SOUND} THEN o.high ELSE b.high END AS high, CASE WHEN {SOUND} THEN o.low ELSE b.low END AS low FROM {BARS} b JOIN bars o ON o.symbol = b.symbol AND o.trade_date = b.trade_date JOIN s ON s.symbol = b.symbol) GROUP BY symbol),
    r AS (SELECT s.*, d.rows, d.odd, d.outside, d.last, try_cast({DAY} AS DATE) AS requested, {QUALITY} AS quality FROM s JOIN d USING (symbol)),
    f AS (SELECT r.symbol, r.requested, r.quality, count(v.sk) AS k, max(v.end_date) AS newest, count(v.end_date) AS dated, count(DISTINCT v.end_date) AS periods, count(*) FILTER (v.ann_date > r.requested) AS early FROM r LEFT JOIN fin_rev v ON v.sk = r.n GROUP BY ALL),
    c AS (SELECT symbol, 'request.date' AS check_id, CASE WHEN requested IS NULL THEN 'fail' END AS status FROM r
      UNION ALL SELECT symbol, 'daily.required', 'pass' FROM r
      UNION ALL SELECT symbol, 'daily.date', CASE WHEN last > requested THEN 'fail' WHEN last < requested THEN 'warn' ELSE 'pass' END FROM r
      UNION ALL SELECT symbol, 'calendar.request_date', CASE WHEN isodow(requested) >= 6 THEN 'warn' END FROM r
      UNION ALL SELECT symbol, 'daily.finite', CASE WHEN odd > 0 THEN 'fail' ELSE 'pass' END FROM r
      UNION ALL SELECT symbol, 'daily.range', CASE WHEN odd = 0 THEN CASE WHEN outside > 0 THEN 'fail' ELSE 'pass' END END FROM r
      UNION ALL SELECT symbol, 'daily.adjustment', 'pass' FROM r
      UNION ALL SELECT symbol, 'quality.income', CASE quality WHEN 'partial' THEN 'warn' WHEN 'ok' THEN NULL ELSE 'fail' END FROM r
      UNION ALL SELECT symbol, 'data.gaps', CASE WHEN mod(n, 8) = 5 THEN 'warn' END FROM r
      UNION ALL SELECT symbol, 'financial.income.missing', CASE WHEN k = 0 AND quality <> 'invalid' THEN 'warn' END FROM f
      UNION ALL SELECT symbol, 'financial.income.period', CASE WHEN k > 0 AND newest > requested THEN 'fail' END FROM f
      UNION ALL SELECT symbol, 'financial.income.revision', CASE WHEN k > 0 AND requested IS NOT NULL AND dated > periods THEN 'warn' END FROM f
      UNION ALL SELECT symbol, 'financial.income.announcement', CASE WHEN k > 0 AND early > 0 THEN 'fail' END FROM f)
    SELECT * FROM c WHERE status IS NOT NULL)"""


def gate_checks(bars: DataFrame, statements: DataFrame) -> DataFrame:
    """Checks of every brand; bars of some brands have faults."""
    numbered = bars.groupBy("symbol").agg(F.max("trade_date").alias("last")).selectExpr("*", "row_number() over (order by symbol) - 1 as n")
    sound = numbered.filter(SOUND).select("symbol")
    cols = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
    zeros = broken(bars).select("symbol", "trade_date", "volume")
    mixed = broken(bars).join(sound, "symbol", "left_anti").select(cols).union(bars.drop("volume").join(sound, "symbol", "left_semi").join(zeros, ["symbol", "trade_date"]).select(cols))
    requests = numbered.selectExpr("symbol", f"{DAY} as requested")
    quality, gaps = numbered.selectExpr("symbol", "'income' as dataset", f"{QUALITY} as quality"), numbered.filter("mod(n, 8) = 5").selectExpr("symbol", "'statements' as gap")
    return gate.checks(requests, mixed, {"income": branded(bars, statements)}, quality, gaps)


query("d05_gate_checks", "bars fin_rev", "symbol check_id status", "", f"SELECT * FROM {TESTED}")(gate_checks)
query("d05_gate", "bars fin_rev", "symbol checks warnings failures gate cap", "", f"""
    SELECT *, CASE WHEN failures > 0 THEN 'block' WHEN warnings > 0 THEN 'degraded' ELSE 'pass' END AS gate, CASE WHEN failures > 0 THEN 0 WHEN warnings > 0 THEN 60 ELSE 80 END AS cap
    FROM (SELECT symbol, count(*) AS checks, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail') AS failures FROM {TESTED} GROUP BY symbol)""")(lambda b, f: gate.gate(gate_checks(b, f)))
