"""Market-shaped views over the test tables; the SQL runs unchanged in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.store import stored

VIEWS = {
    "bars": """
        WITH t AS (
          SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS trade_date, l.l_extendedprice / l.l_quantity AS price, l.l_quantity AS qty,
            l.l_extendedprice AS amt, l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS k3, l.l_suppkey AS k4
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        ), r AS (
          SELECT t.*, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY k1, k2, k3, k4, amt, qty) AS rn_first,
            row_number() OVER (PARTITION BY symbol, trade_date ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, amt DESC, qty DESC) AS rn_last FROM t
        )
        SELECT symbol, trade_date, max(CASE WHEN rn_first = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
          max(CASE WHEN rn_last = 1 THEN price END) AS close, sum(qty) AS volume, sum(amt) AS amount
        FROM r GROUP BY symbol, trade_date""",
    "limit_bars": """
        SELECT symbol, trade_date, open, high, low, close, volume, amount, CASE WHEN mod(n, 17) = 5 THEN ' Yes' WHEN mod(n, 17) = 9 THEN '0' END AS is_suspended,
          CASE WHEN mod(n, 11) <> 3 THEN before * 1.3E0 END AS up_limit, CASE WHEN mod(n, 13) <> 4 THEN before * 0.7E0 END AS down_limit
        FROM (SELECT b.*, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS before FROM bars b) x""",
    "adj_factor": """
        WITH f AS (SELECT DISTINCT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS trade_date, 1.0E0 + 0.1E0 * (year(l.l_shipdate) - 1995) AS adj_factor
          FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
        SELECT symbol, trade_date, CASE WHEN day(trade_date) = 7 THEN NULL ELSE adj_factor END AS adj_factor, 1 AS load_seq FROM f
        UNION ALL SELECT symbol, trade_date, adj_factor * CASE WHEN mod(day(trade_date), 2) = 0 THEN 0.98E0 ELSE 1.02E0 END, 2 FROM f WHERE mod(day(trade_date), 5) = 0""",
    "moneyflow_raw": """
        SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS trade_date, l.l_linestatus AS version,
          sum(CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END) AS net_mf_amount
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, CAST(l.l_shipdate AS DATE), l.l_linestatus""",
    "fin_base": """
        WITH q AS (
          SELECT l_suppkey AS sk, year(l_shipdate) AS y, quarter(l_shipdate) AS qn, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5003E0) / 100 AS rev,
            floor(sum(l_extendedprice * (0.3E0 - l_discount)) * 100 + 0.5003E0) / 100 AS np, floor(sum(l_extendedprice * (0.25E0 - l_tax)) * 100 + 0.5003E0) / 100 AS ocf, floor(sum(l_extendedprice) * 100 + 0.5003E0) / 100 AS gross
          FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)
        )
        SELECT CAST(sk AS VARCHAR(20)) AS symbol, sk, y, qn, last_day(make_date(CAST(y AS INT), CAST(qn * 3 AS INT), 1)) AS end_date,
          sum(rev) OVER w AS revenue, sum(np) OVER w AS net_profit, 0.95E0 * sum(np) OVER w AS net_profit_attributable,
          sum(ocf) OVER w AS operating_cf, 4 * gross AS total_assets, 1.5E0 * gross AS total_liabilities, 2.5E0 * gross AS shareholders_equity
        FROM q WINDOW w AS (PARTITION BY sk, y ORDER BY qn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fin_rev": """
        SELECT b.*, CAST(end_date + INTERVAL 30 DAYS AS DATE) AS ann_date, '0' AS update_flag, '1' AS report_type, 1 AS load_seq FROM fin_base b
        UNION ALL
        SELECT symbol, sk, y, qn, end_date, revenue * 1.01E0, net_profit, net_profit_attributable, operating_cf, total_assets, total_liabilities, shareholders_equity,
          CAST(end_date + INTERVAL 90 DAYS AS DATE), '1', '1', 2 FROM fin_base WHERE mod(sk + qn, 3) = 0""",
    "fin_right": """
        SELECT symbol, sk, y, qn, end_date,
          CASE WHEN mod(sk + qn, 13) = 0 THEN NULL ELSE revenue * CASE mod(sk, 5) WHEN 1 THEN 1.005E0 WHEN 2 THEN 1.05E0 WHEN 3 THEN 1.3E0 WHEN 4 THEN 2.0E0 ELSE 1.0E0 END END AS revenue, net_profit
        FROM fin_base WHERE mod(sk, 11) <> 0""",
    "fin_right_prev": """
        SELECT symbol, sk, y, qn, end_date,
          CASE WHEN mod(sk + qn, 13) = 0 THEN NULL ELSE revenue * CASE mod(sk + 1, 5) WHEN 1 THEN 1.005E0 WHEN 2 THEN 1.05E0 WHEN 3 THEN 1.3E0 WHEN 4 THEN 2.0E0 ELSE 1.0E0 END END AS revenue, net_profit
        FROM fin_base WHERE mod(sk, 11) <> 0""",
    "trade_cal": """
        SELECT 'X' AS exchange, d AS cal_date, CASE WHEN mod(datediff('day', DATE '1990-01-01', d), 7) < 5 THEN 1 ELSE 0 END AS is_open
        FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) t""",
    "official_events": """
        WITH s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS n FROM (SELECT DISTINCT p_brand AS symbol FROM part) b)
        SELECT 'sse' AS source, e.event_id AS item_id, s.symbol, CAST(e.ts - INTERVAL 25 YEARS AS DATE) AS published, e.event_type,
          CASE WHEN e.event_type IN ('signup', 'purchase') THEN 'positive' WHEN e.event_type = 'error' THEN 'negative' ELSE 'neutral' END AS polarity,
          least(e.value / 500, 1.0E0) AS strength
        FROM events e JOIN s ON mod(e.user_id, 25) = s.n""",
    "run_log": """
        SELECT conv_id, turn, role AS mode, CAST(conv_id AS VARCHAR(20)) AS ticker, length(text) AS tokens, text FROM conversations""",
}
_NAME = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")
#: Where the engines' spelling differs.
_SPARK = [(re.compile(r"datediff\('day', DATE '1990-01-01', d\)"), "datediff(d, DATE '1990-01-01')")]


def needed(sql: str) -> list[str]:
    """Views that a text reads, those they read first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return out


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views it reads put before it."""
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    if not views:
        return sql
    head = sql.lstrip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if head.startswith(word):
            return f"{word}{views}, {head[len(word):]}"
    return f"WITH {views} {head}"


def _bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """``bars`` by one sort of the trades and one aggregate, where windows sort all trades twice.

    A day's sums are taken over its trades from the last to the first, as by the SQL's last window: another order changes the last bits of
    sums of doubles, and with them the whole part of an amount that is a whole number.
    """
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    t = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("trade_date"), *place)
    t = t.repartition("symbol", "trade_date").sortWithinPartitions("symbol", "trade_date", *map(F.desc, place))
    return t.select("symbol", "trade_date", F.expr("l_extendedprice / l_quantity").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amt"), F.struct(*place).alias("place")).groupBy("symbol", "trade_date").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"), F.sum("qty").alias("volume"), F.sum("amt").alias("amount"))


#: Aggregates of the largest table that queries read in several branches.
SHARED = ("bars", "fin_base")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the test data, or a view over them. ``made`` holds what a query has made of SHARED, each stored once."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if made is not None and name in SHARED:
        if name not in made:
            made[name] = stored(view(spark, sf_dir, name), name)
        return made[name]
    if name == "bars":
        return _bars(view(spark, sf_dir, "lineitem"), view(spark, sf_dir, "part"))
    sql = VIEWS[name]
    for a, b in _SPARK:
        sql = a.sub(b, sql)
    # Names are given by parameter, so that sessions and inputs don't mix.
    frames = {n: view(spark, sf_dir, n, made) for n in [*VIEWS, "lineitem", "part", "orders", "events", "conversations"] if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)}
    for n in frames:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **frames)
