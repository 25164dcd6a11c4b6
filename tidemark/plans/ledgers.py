"""Queries of audit ledgers, rules, bundles and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import evidence as ev
from ..operators import fundamentals as fu
from ..operators import ledger, pit, recon, risk, rules, textfields
from ..operators import strategy as st
from ..sources import files
from ..sources.store import stored
from . import market  # noqa: F401  (its SQL is reused)
from .analysis import BC, FIELDS, RAT, W
from .base import ORACLE_SQL, QUERIES, query

# Audit rows made from the statements: the provider's value is off by 0, 0.15 or 0.3, the reported one by 0 or 2.5.
SK = "CAST(symbol AS INT)"
ATTR = f"""(SELECT symbol, end_date, field, CASE WHEN field = 'eps' THEN 'manual_eps_share_count_review' WHEN f IS NULL THEN 'unresolved_missing_formula' WHEN mod({SK}, 7) = 0 THEN 'unresolved_provider_missing' WHEN mod({SK}, 3) < 2 THEN 'resolved_formula_matches_annualized_provider'
    WHEN mod({SK}, 2) = 0 THEN 'definition_review_nonannualized_candidate' ELSE 'manual_definition_review' END AS resolution FROM (SELECT symbol, end_date, field, CASE field WHEN 'roa' THEN roa WHEN 'roe' THEN roe END AS f FROM ({RAT}) CROSS JOIN (SELECT unnest(['roa', 'roe', 'eps']) AS field)))"""


def _attributed(f: DataFrame) -> DataFrame:
    r = fu.ratios(f).withColumn("factor", fn.annualization(F.col("end_date"))).select("symbol", "end_date", "roa", "roe", "factor")
    sk = F.col("symbol").cast("int")
    provider = r.filter(sk % 7 != 0).select("symbol", "end_date", F.lit(1).alias("ann_date"), *[(F.col(c) + sk % 3 * 0.15).alias(f"{c}_yearly") for c in ("roa", "roe")])
    cells = r.select("symbol", "end_date", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) / F.col("factor") + sk % 2 * 2.5).alias("right_value")) for c in ("roa", "roe")], F.struct(F.lit("eps").alias("field"), F.lit(1.0).alias("right_value")))).alias("x"))
    return ledger.attributed(cells.select("symbol", "end_date", "x.*"), r, provider)


query("r11_attribution", "fin_base", "symbol end_date field resolution", "", f"SELECT * FROM {ATTR}")(_attributed)
query("j11_attribution_counts", "fin_base", "resolution n", "", f"SELECT resolution, count(*) AS n FROM {ATTR} GROUP BY resolution")(lambda f: _attributed(f).groupBy("resolution").agg(F.count("*").alias("n")))
ROLES = ["manual_decision", "provider_revision", "derived_indicator", "formula_coverage", "source_unreadable", "value"]
ROLE = f"CASE mod({SK}, 6) " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"
DISP = f"""(SELECT *, CASE WHEN role = 'manual_decision' THEN 'manual_decision_recorded' WHEN role = 'provider_revision' THEN 'provider_revision_explained' WHEN resolution LIKE 'resolved%' THEN 'formula_crosscheck_resolved' WHEN resolution = 'unresolved_missing_formula' THEN 'formula_insufficient_opening_balance'
    WHEN resolution LIKE '%review%' THEN resolution WHEN role = 'formula_coverage' THEN 'formula_coverage_explained' WHEN role = 'derived_indicator' THEN 'derived_indicator_explained' WHEN role = 'source_unreadable' THEN 'source_unreadable' ELSE 'unclassified' END AS disposition FROM (SELECT *, {ROLE} AS role FROM {ATTR}))"""
ACT = "CASE WHEN disposition = 'manual_decision_recorded' OR disposition LIKE '%review%' THEN 'policy_required' WHEN disposition = 'source_unreadable' THEN 'evidence_required' WHEN disposition = 'unclassified' THEN 'review_required' ELSE 'none' END"


def _disposed(a: DataFrame) -> DataFrame:
    audit = a.select("symbol", "end_date", "field", F.array(*map(F.lit, ROLES))[F.col("symbol").cast("int") % 6].alias("role"), F.lit("").alias("manual_decision"))
    return ledger.disposed(audit, a)


query("r12_disposition", "fin_base", "symbol end_date field disposition actionability", "", f"SELECT *, {ACT} AS actionability FROM {DISP}")(lambda f: _disposed(stored(_attributed(f), "attributed")))
#: Two sources: one that covers all that is expected and has nothing left to act on, and one that doesn't.
GATES = {"good": ("0", "(SELECT count(*) FROM fin_right)", "actionability NOT IN ('evidence_required', 'review_required') AND disposition <> 'unclassified'"), "bad": ("(SELECT count(*) FROM fin_base WHERE mod(sk, 11) = 0)", "(SELECT count(*) FROM fin_right)", "true")}


def _gates(a: DataFrame, b: DataFrame) -> DataFrame:
    """The gate over summaries; a sound source's snapshot has no broken rules, and only explained differences are left. Both sources share resolutions, dispositions and datasets."""
    resolved = stored(_attributed(a), "attributed")
    every = stored(_disposed(resolved), "disposed")
    sets = stored(recon.reconcile(a, b, FIELDS, "income").unionByName(recon.reconcile(a, b, ["net_profit"], "balance")), "reconciled")
    expected, found = b.count(), []
    for name, rows, left in (("good", a, every.filter("actionability not in ('evidence_required', 'review_required') and disposition != 'unclassified'")), ("bad", b, every)):
        snapshot = rows.select("symbol", "end_date", F.lit("parsed").alias("status"), F.lit("").alias("missing"))
        found.append(ledger.source_gate(ledger.validate_snapshot(snapshot, a), sets, left, resolved, expected).withColumn("source", F.lit(name)))
    return found[0].unionByName(found[1])


HARD = f"(SELECT count(*) AS hard FROM {BC} WHERE field = 'net_profit' AND NOT matches) h"
query("r13_source_gate", "fin_base fin_right", "source broken_rules datasets least_matched hard_mismatches actionable unclassified reservations derived_resolved status", "", " UNION ALL ".join(f"""
    SELECT *, CASE WHEN broken_rules = 0 AND actionable = 0 AND unclassified = 0 AND hard_mismatches = 0 THEN 'pass_with_reservations' ELSE 'fail' END AS status FROM (
      SELECT '{k}' AS source, CASE WHEN any_value(g.gone) > 0 THEN 1 ELSE 0 END AS broken_rules, 2 AS datasets, any_value(m.matched) AS least_matched, any_value(h.hard) AS hard_mismatches,
        count(*) FILTER (disposition IN ('source_unreadable', 'unclassified')) AS actionable, count(*) FILTER (disposition = 'unclassified') AS unclassified, count(*) FILTER (actionability = 'policy_required') AS reservations, any_value(r.solved) AS derived_resolved
      FROM (SELECT *, {ACT} AS actionability FROM {DISP}), (SELECT {gone} AS gone) g, (SELECT {matched} AS matched) m, {HARD}, (SELECT count(*) FILTER (resolution LIKE 'resolved%') AS solved FROM {ATTR}) r WHERE {kept})""" for k, (gone, matched, kept) in GATES.items()))(_gates)
query("r05_difference_profile", "fin_base fin_right", "field bucket n", "", f"SELECT field, bucket, count(*) AS n FROM {BC} GROUP BY ALL")(lambda a, b: recon.compared(a, b, FIELDS).groupBy("field", "bucket").agg(F.count("*").alias("n")))
query("j12_wide_normalized", "fin_base fin_right", "symbol end_date field equal", "", """SELECT symbol, end_date, field, CASE WHEN v IS NULL OR w IS NULL THEN v IS NULL AND w IS NULL ELSE abs(v - w) <= 1e-9 * greatest(abs(v), 1) END AS equal FROM (
    SELECT l.symbol, l.end_date, f.field, CASE f.field WHEN 'revenue' THEN l.revenue ELSE l.net_profit END AS v, CASE f.field WHEN 'revenue' THEN r.revenue ELSE r.net_profit END AS w FROM fin_base l LEFT JOIN fin_right r ON l.symbol = r.symbol AND l.end_date = r.end_date CROSS JOIN (SELECT unnest(['revenue', 'net_profit']) AS field) f) x""")(
    lambda a, b: ledger.wide_matches(a, recon.long(b, FIELDS, "amount").withColumnsRenamed({"symbol": "ts_code", "end_date": "period_end"}), FIELDS))
query("j14_lineage", "supplier", "s_suppkey member lineage", "", "SELECT s_suppkey, s_name AS member, CASE WHEN mod(s_suppkey, 7) = 0 THEN 'unknown' WHEN mod(s_suppkey, 5) = 0 THEN 'hash' ELSE 'ok' END AS lineage FROM supplier")(
    lambda s: ledger.lineage(s.select("s_suppkey", F.concat(F.lit("a.zip!b!"), "s_name").alias("local_path"), F.sha2(F.expr("concat(s_name, if(s_suppkey % 5 = 0, '-', ''))"), 256).alias("sha256")), s.filter("s_suppkey % 7 > 0").select(F.col("s_name").alias("member"), F.sha2("s_name", 256).alias("sha256"))))


def _reports(f: DataFrame) -> DataFrame:
    return f.select("symbol", "end_date", "sk", "y", "qn", fn.report_type(F.col("end_date")).alias("report_type"), F.concat(F.lit("Co"), "symbol").alias("name"))


def _checked(a: DataFrame, b: DataFrame) -> DataFrame:
    members = _reports(b).select(F.concat_ws("_", "symbol", F.col("end_date").cast("string"), "report_type", F.lit("original.pdf")).alias("member"))
    return ledger.checklist_status(_reports(a), members, a.filter("mod(sk, 17) = 0").select("symbol", "end_date", F.lit(None).cast("string").alias("status")))


query("j15_checklist_status", "fin_base fin_right", "symbol end_date status", "", "SELECT symbol, end_date, CASE WHEN mod(sk, 17) = 0 THEN 'structural_missing' WHEN mod(sk, 11) <> 0 THEN 'provided' ELSE 'missing' END AS status FROM fin_base")(_checked)
MARKS = {"q1": "年第一季度报告", "semiannual": "年半年度报告", "q3": "年第三季度报告", "annual": "年年度报告"}


def _announcements(v: DataFrame) -> DataFrame:
    """Titles of all revisions, every ninth of (sk + qn) a summary, which never counts."""
    tail = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[fn.report_type(F.col("end_date"))]
    title = F.concat(F.lit("Co"), "symbol", F.col("y").cast("string"), tail, F.expr("if(mod(sk + qn, 9) = 0, '摘要', '')"))
    return v.select("symbol", F.concat_ws("-", "symbol", F.col("end_date").cast("string"), "load_seq").alias("item_id"), F.col("ann_date").alias("published"), title.alias("title"))


REPORTS = "(SELECT symbol, end_date, CASE WHEN mod(sk + qn, 9) = 0 THEN 'missing' WHEN count(*) = 1 THEN 'exact' ELSE 'earliest_original_candidate' END AS match, CASE WHEN mod(sk + qn, 9) = 0 THEN 0 ELSE count(*) END AS candidates, CASE WHEN mod(sk + qn, 9) <> 0 THEN min(ann_date) END AS announce_date FROM fin_rev GROUP BY symbol, sk, qn, end_date)"
query("r14_report_dates", "fin_base fin_rev", "symbol end_date match candidates announce_date", "", f"SELECT * FROM {REPORTS}")(lambda f, v: ledger.match_reports(_reports(f), _announcements(v)))
query("j18_title_matches", "fin_base fin_rev", "match n", "", f"SELECT match, count(*) AS n FROM {REPORTS} GROUP BY match")(lambda f, v: ledger.match_reports(_reports(f), _announcements(v)).groupBy("match").agg(F.count("*").alias("n")))
#: A parsed snapshot with faults of every kind: keys that are missing, one that is there twice, claims that don't hold, files that the index doesn't know, and cells that differ from the normalized table.
SNAPSHOT = """(SELECT symbol, end_date, sk, qn, revenue, CASE WHEN mod(sk, 5) = 0 THEN NULL ELSE net_profit END AS net_profit, 'parsed' AS status, CASE WHEN revenue IS NULL THEN 'revenue' ELSE '' END AS missing, CASE WHEN mod(sk, 7) = 0 THEN 'gone' ELSE symbol END AS member FROM fin_right)"""


def _snapshot(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = b.selectExpr("symbol", "end_date", "revenue", "if(mod(sk, 5) = 0, null, net_profit) as net_profit", "'parsed' as status", "if(revenue is null, 'revenue', '') as missing", "concat('a.zip!', if(mod(sk, 7) = 0, 'gone', symbol)) as local_path", "symbol as sha256")
    rows = rows.union(rows.filter("symbol = '1'").limit(1))
    index = b.selectExpr("symbol as member", "if(mod(sk, 6) = 1, 'other', symbol) as sha256").distinct()
    normalized = recon.long(b, FIELDS, "amount").withColumnsRenamed({"symbol": "ts_code", "end_date": "period_end"})
    return ledger.validate_snapshot(rows, a, required=("symbol", "end_date", "unit"), index=index, normalized=normalized, fields=FIELDS)


query("d07_snapshot", "fin_base fin_right", "rule n", "", f"""
    WITH s AS {SNAPSHOT}, d AS (SELECT * FROM s UNION ALL (SELECT * FROM s WHERE symbol = '1' LIMIT 1))
    SELECT * FROM (SELECT 'missing_key' AS rule, count(*) AS n FROM fin_base WHERE mod(sk, 11) = 0 UNION ALL SELECT 'duplicate_key', count(DISTINCT symbol) FROM s WHERE symbol = '1' UNION ALL SELECT 'status', count(*) FROM d WHERE revenue IS NULL UNION ALL SELECT 'column_unit', 1
      UNION ALL SELECT 'lineage', count(*) FROM d WHERE member = 'gone' OR mod(sk, 6) = 1 UNION ALL SELECT 'normalized', count(*) FROM d JOIN fin_right r USING (symbol, end_date) WHERE (d.net_profit IS NULL) <> (r.net_profit IS NULL)) WHERE n > 0""")(_snapshot)
query("d08_event_profile", "official_events", "rows symbols invalid_dates duplicates missing_titles missing_urls recognized status first_day last_day", "rate", """
    SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (mod(item_id, 31) = 0) AS invalid_dates, count(*) - count(DISTINCT mod(item_id, 500)) AS duplicates, count(*) FILTER (mod(item_id, 17) = 0) AS missing_titles, count(*) FILTER (mod(item_id, 19) = 0) AS missing_urls,
      count(*) FILTER (event_type IN ('signup', 'error')) AS recognized, 'fail' AS status, min(published) FILTER (mod(item_id, 31) > 0) AS first_day, max(published) FILTER (mod(item_id, 31) > 0) AS last_day, avg((event_type IN ('signup', 'error'))::INT) AS rate FROM official_events""")(
    lambda e: ledger.event_profile(e.selectExpr("source", "symbol", "event_type", "mod(item_id, 500) as item_id", "if(mod(item_id, 31) = 0, null, published) as published", "if(mod(item_id, 17) = 0, ' ', event_type) as title", "if(mod(item_id, 19) = 0, '', 'u') as url"), ["signup", "error"]))
#: Announcements with other codes, titles and addresses of all kinds, times in milliseconds and as text.
RAW = """
    SELECT right(concat('00000', CAST(mod(item_id, 40) AS {s})), 6) AS symbol, CASE mod(item_id, 8) WHEN 0 THEN '999' WHEN 1 THEN NULL ELSE CAST(mod(item_id, 40) AS {s}) END AS sec_code,
      CASE mod(item_id, 9) WHEN 0 THEN concat('H股公告', event_type) WHEN 1 THEN concat(event_type, ' H股公告-') WHEN 2 THEN concat(event_type, ' H股') WHEN 3 THEN '  ' ELSE concat(' ', event_type) END AS title,
      CASE mod(item_id, 4) WHEN 0 THEN concat(CAST(published AS {s}), ' 10:30:00') WHEN 1 THEN CAST(published AS {s}) WHEN 2 THEN CAST(CAST(datediff({diff}) AS BIGINT) * 86400000 + 3600000 AS {s}) ELSE CASE WHEN mod(item_id, 3) > 0 THEN concat(CAST(CAST(datediff({diff}) AS BIGINT) * 86400000 AS {s}), '.0') ELSE 'soon' END END AS announced,
      CASE WHEN mod(item_id, 5) > 0 THEN CAST(item_id AS {s}) ELSE ' ' END AS item_id, CASE mod(item_id, 6) WHEN 0 THEN 'http://x.example/a.pdf' WHEN 1 THEN '//docs/b.pdf' ELSE '' END AS adjunct_url, 'p' AS plate, 'o' AS org_id, published AS day
    FROM {events}"""
raw_announcements = lambda e: e.sparkSession.sql(RAW.format(s="STRING", diff="published, DATE '1970-01-01'", events="{e}"), e=e)
query("e02_announcements", "official_events", "symbol announcement_id item_id title published source_url", "", f"""
    WITH r AS ({RAW.format(s='VARCHAR', diff="'day', DATE '1970-01-01', published", events='official_events')}),
    k AS (SELECT symbol, trim(title) AS title, day AS published, trim(item_id) AS id,
        CASE adjunct_url WHEN '' THEN 'https://pages.example/detail?plate=p&orgId=o&stockCode=' || symbol || '&announcementId=' || trim(item_id) WHEN '//docs/b.pdf' THEN 'https://files.example/docs/b.pdf' ELSE adjunct_url END AS source_url
      FROM r WHERE coalesce(sec_code <> '999', true) AND trim(title) <> '' AND announced <> 'soon' AND NOT starts_with(trim(title), 'H股公告') AND NOT contains(title, 'H股公告-')),
    n AS (SELECT *, CASE WHEN id <> '' THEN id ELSE sha1(symbol || '|' || CAST(published AS VARCHAR) || '|' || title || '|' || source_url)[1:16] END AS announcement_id FROM k)
    SELECT *, 'official:' || symbol || ':' || announcement_id AS item_id FROM n""")(lambda e: ledger.normalize_announcements(raw_announcements(e)))
query("e17_normalize_text", "documents", "doc_id x", "", r"SELECT doc_id, sha256(replace(replace(regexp_replace(text, '([\x{4e00}-\x{9fa5}])[ \t]*\n[ \t]*([\x{4e00}-\x{9fa5}])', '\1\2', 'g'), ' the ', ' a '), '—', '-')) AS x FROM documents")(lambda d: d.select("doc_id", F.sha2(ledger.normalize_text(F.col("text"), {" the ": " a ", "—": "-"}), 256).alias("x")))


@query("e18_statements", "fin_base", "dataset symbol end_date field", "value", "".join(f"{' UNION ALL ' if i else ''}SELECT '{t}' AS dataset, symbol, end_date, '{dst}' AS field, {src if src != 'debt_to_assets' else 'NULL'} AS value FROM fin_base" for i, (t, dst, src) in enumerate((t, d, s) for t, cols in ledger.STATEMENTS.items() for d, s in cols.items())), digits=2)
def normalized_rows(wide: DataFrame) -> DataFrame:
    """All four tables in long form."""
    out = None
    for name, f in ledger.statements(wide).items():
        part = recon.long(f, [c for c in f.columns if c not in recon.KEY]).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


SUPS, RESS, RISK = ORACLE_SQL["t01_supports"], ORACLE_SQL["t02_resistances"], ORACLE_SQL["a04_risk"]


def _ends(b: DataFrame) -> DataFrame:
    first = lambda f, c: f.filter("rank = 1").select("symbol", F.col("price").alias(c))
    return risk.risk(b).select("symbol", "risk_level").join(first(risk.supports(b), "support"), "symbol", "left").join(first(risk.resistances(b), "resistance"), "symbol", "left").withColumn("gate", F.lit("degraded"))


query("e10_invalidations", "bars", "symbol id severity", "price", f"""WITH l AS (SELECT k.symbol, k.risk_level, s.price AS a, r.price AS b FROM ({RISK}) k LEFT JOIN (SELECT * FROM ({SUPS}) WHERE rank = 1) s USING (symbol) LEFT JOIN (SELECT * FROM ({RESS}) WHERE rank = 1) r USING (symbol))
    SELECT symbol, 'price.break_support' AS id, 'high' AS severity, a AS price FROM l WHERE a IS NOT NULL UNION ALL SELECT symbol, 'price.break_resistance_context', 'medium', b FROM l WHERE b IS NOT NULL UNION ALL SELECT symbol, 'price.levels_missing', 'medium', NULL FROM l WHERE a IS NULL AND b IS NULL
    UNION ALL SELECT symbol, 'risk.reassessment', 'high', NULL FROM l WHERE risk_level IN ('high', 'medium_high') UNION ALL SELECT symbol, 'data.quality_change', 'high', NULL FROM l""")(lambda b: rules.invalidations(_ends(b)))
query("a20_descriptor_hash", "bars", "symbol x", "", """SELECT symbol, sha256('{"dataset":"daily","rows":' || count(*) || ',"as_of":"' || max(trade_date) || '"}') AS x FROM bars GROUP BY symbol""")(
    lambda b: b.groupBy("symbol").agg(F.count("*").alias("rows"), F.max("trade_date").cast("string").alias("as_of")).select("symbol", F.sha2(F.to_json(F.struct(F.lit("daily").alias("dataset"), "rows", "as_of")), 256).alias("x")))
MEANS = lambda a, b: f"CASE WHEN k >= {b} THEN avg(close) OVER ({W} ROWS BETWEEN {a - 1} PRECEDING AND CURRENT ROW) > avg(close) OVER ({W} ROWS BETWEEN {b - 1} PRECEDING AND CURRENT ROW) ELSE false END"
NUMBERED = f"(SELECT *, row_number() OVER ({W}) AS k, close - lag(close) OVER ({W}) AS m FROM bars)"
SPAN = f"OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
query("b02_ma_rsi_signal", "bars", "symbol trade_date signal", "", f"""SELECT symbol, trade_date, CAST(x AND coalesce(CASE WHEN k >= 15 AND dn > 0 THEN 100 - 100 / (1 + up / dn) END, 0) < 40 AS INT) AS signal FROM (
    SELECT symbol, trade_date, k, {MEANS(10, 30)} AS x, avg(greatest(m, 0)) {SPAN} AS up, avg(greatest(-m, 0)) {SPAN} AS dn FROM {NUMBERED})""")(lambda b: rules.apply_rule(b, "ma_cross_rsi"))
CROSS = f"SELECT symbol, trade_date, CAST({MEANS(20, 60)} AS INT) AS signal FROM {NUMBERED}"
query("y01_registered_rule", "bars", "symbol trade_date signal", "", CROSS)(lambda b: rules.apply_rule(b, "ma_cross"))


def _python_cross(frame: pd.DataFrame, p: rules.Params) -> pd.Series:
    fast, slow = (frame["close"].rolling(int(p[k])).mean() for k in ("ma_fast", "ma_slow"))
    return (fast > slow).astype(int)


query("y02_python_rule", "bars", "symbol trade_date signal", "", CROSS)(lambda b: rules.apply_python(b, _python_cross, rules.effective(rules.RULES["ma_cross"])))
query("y03_parameters", "bars", "symbol on_bars", "", f"SELECT symbol, CAST(sum(signal) AS BIGINT) AS on_bars FROM ({CROSS.replace('BETWEEN 19 ', 'BETWEEN 4 ')}) GROUP BY symbol")(
    lambda b: rules.apply_rule(b, "ma_cross", {"ma_fast": 5}).groupBy("symbol").agg(F.sum("signal").alias("on_bars")))
