"""Queries of stores and files (S2, S3, S5, S6, S9, S14, S15, S16): each writes what it needs from the tables, then reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import pit
from ..sources import files
from ..sources.store import work_path
from ..sources.versions import Markers, Store
from .base import ORACLE_SQL, QUERIES, query

KEYS = ["symbol", "trade_date"]


def _store(rows: DataFrame, name: str, keys: list[str] = KEYS, day: str = "trade_date") -> Store:
    return Store(rows.sparkSession, work_path(rows.sparkSession, name), keys, day).write(rows)


query("s02_bars_range", "bars", "symbol trade_date", "close volume", "SELECT * FROM bars WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1997-02-14'")(lambda b: _store(b, "bars").between("1996-03-01", "1997-02-14").orderBy(*KEYS))


@query("s03_upsert_bars", "bars", "symbol trade_date", "close", """
    SELECT symbol, trade_date, CASE WHEN year(trade_date) = 1997 THEN close * 2 ELSE close END AS close FROM bars UNION ALL SELECT symbol, CAST(max(trade_date) + INTERVAL 10 DAYS AS DATE), 1 FROM bars GROUP BY symbol""")
def upsert_bars(bars: DataFrame) -> DataFrame:
    """A batch with new closes of a year and a new day of each symbol; other years' files stay as they are."""
    store = _store(bars, "bars")
    changed = bars.filter("year(trade_date) = 1997").withColumn("close", F.col("close") * 2)
    added = bars.groupBy("symbol").agg(F.max("trade_date").alias("trade_date")).withColumn("trade_date", F.date_add("trade_date", 10)).withColumn("close", F.lit(1.0))
    store.upsert(changed.unionByName(added, allowMissingColumns=True))
    return store.read()


@query("s05_upsert_moneyflow", "moneyflow_raw", "symbol trade_date version", "net_mf_amount", "SELECT * FROM moneyflow_raw QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY version DESC) = 1", digits=2)
def upsert_flows(money: DataFrame) -> DataFrame:
    store = _store(money.filter("version = 'F'"), "flows")
    store.upsert(money.filter("version = 'O'"))
    return store.read()


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets of a folder: one is there as Parquet (and as CSV, which isn't read), one as CSV only, one not at all."""
    folder, schema = work_path(spark, "datasets"), "id int, name string"
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(f"cast({t[0]}_{t}key as int) as id", f"{t[0]}_name as name") for t in ("region", "nation"))
    region.write.parquet(f"{folder}/regions.parquet")
    region.limit(1).write.option("header", "true").csv(f"{folder}/regions.csv")
    nation.write.option("header", "true").csv(f"{folder}/nations.csv")
    out = None
    for name in ("regions", "nations", "towns"):
        rows, found = files.read_dataset(spark, folder, name, schema)
        part = rows.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("name").alias("last")).select(F.lit(name).alias("dataset"), F.lit(found).alias("found"), "*")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["s01_read_dataset"] = _datasets
ORACLE_SQL["s01_read_dataset"] = """
    SELECT 'regions' AS dataset, 'parquet' AS found, count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS ids, max(r_name) AS last FROM region
    UNION ALL SELECT 'nations', 'csv', count(*), CAST(sum(n_nationkey) AS BIGINT), max(n_name) FROM nation UNION ALL SELECT 'towns', 'none', 0, NULL, NULL"""


@query("s04_append_revisions", "fin_rev", "symbol end_date load_seq", "revenue", "SELECT * FROM fin_rev", digits=2)
def append_revisions(revisions: DataFrame) -> DataFrame:
    """A store of first reports; a batch of corrections, each twice, and of reports that the store has."""
    store = _store(revisions.filter("load_seq = 1"), "statements", ["symbol", "end_date"], "end_date")
    corrections = revisions.filter("load_seq = 2")
    store.append_new(corrections.unionByName(corrections).unionByName(revisions.filter("load_seq = 1 and sk % 5 = 0")))
    return store.read()


def _marked(bars: DataFrame) -> Markers:
    """Two writes: all bars up to 1997, then those of 1996 alone, and later, for every second brand and the newer bars of the first."""
    marks = Markers(bars.sparkSession, work_path(bars.sparkSession, "marks"))
    second = bars.filter("(cast(substring(symbol, 7) as int) % 2 = 0 and year(trade_date) = 1996) or (symbol = 'Brand#11' and year(trade_date) > 1996)")
    for rows, day in ((bars.filter("year(trade_date) <= 1997"), "2024-01-01"), (second, "2024-01-20")):
        marks.merge(pit.markers(rows, "daily").withColumn("updated_at", F.lit(day).cast("timestamp")))
    return marks


MARKED = """
    WITH two AS (SELECT symbol, trade_date, CAST('2024-01-01' AS TIMESTAMP) AS t FROM bars WHERE year(trade_date) <= 1997
      UNION ALL SELECT symbol, trade_date, CAST('2024-01-20' AS TIMESTAMP) FROM bars WHERE (mod(CAST(symbol[7:] AS INT), 2) = 0 AND year(trade_date) = 1996) OR (symbol = 'Brand#11' AND year(trade_date) > 1996)),
    marks AS (SELECT symbol, 'daily' AS dataset, min(trade_date) AS earliest_date, max(trade_date) AS latest_date, max(t) AS updated_at FROM two GROUP BY symbol)"""
query("s07_markers", "bars", "symbol dataset earliest_date latest_date updated_at", "", f"{MARKED} SELECT * FROM marks")(lambda b: _marked(b).read())
query("s08_is_fresh", "bars", "symbol is_fresh covers expired usable", "", f"""
    {MARKED}, f AS (SELECT symbol, latest_date >= DATE '1997-12-20' AS is_fresh, earliest_date <= DATE '1995-02-01' AND latest_date >= DATE '1997-12-20' AS covers, updated_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAYS AS expired FROM marks)
    SELECT *, covers AND NOT expired AS usable FROM f""")(lambda b: pit.fresh(_marked(b).read(), "1995-02-01", "1997-12-20", F.lit("2024-01-20 00:00:00").cast("timestamp"), 7 * 86_400))
query("s17_latest_package", "run_log", "ticker modified", "", """
    SELECT ticker, max(turn) AS modified FROM run_log WHERE mod(turn, 5) <> 1 AND mod(turn, 5) <> 2 AND mod(tokens, 3) > 0 AND mod(conv_id + turn, 7) > 0 GROUP BY ticker""")(lambda r: pit.latest_package(r.selectExpr("ticker", "turn as modified", """
    if(mod(turn, 5) = 1, '{"schema_version": "1', to_json(named_struct('schema_version', if(mod(turn, 5) = 2, '', '1.0'), 'run_id', if(mod(tokens, 3) > 0, ticker, cast(null as string)), 'stock', named_struct('code', if(mod(conv_id + turn, 7) > 0, ticker, 'other'))))) as body""")))


def _tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in several files beside one that is no Parquet file: its rows are missing, nothing fails."""
    path = work_path(spark, "customers")
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    table.repartition(4).write.parquet(path)
    table.limit(100).selectExpr("concat('broken ', c_custkey) as value").coalesce(1).write.mode("append").text(path)
    return files.read_tolerant(spark, path, "c_custkey bigint, c_acctbal double").agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("keys"))


QUERIES["s06_tolerant_read"], ORACLE_SQL["s06_tolerant_read"] = _tolerant, "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 runs of a log of JSON lines, some of which are broken."""
    path = work_path(spark, "runs")
    runs = view(spark, sf_dir, "run_log").selectExpr("cast(conv_id * 1000 + turn as bigint) as created_at", "mode", "ticker")
    line = F.to_json(F.struct("created_at", "mode", "ticker"))
    runs.select(F.when(F.col("created_at") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return files.read_log(spark, path, "created_at bigint, mode string, ticker string", "created_at")


QUERIES["s14_run_log"] = _log
ORACLE_SQL["s14_run_log"] = "SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS created_at, role AS mode, CAST(conv_id AS VARCHAR) AS ticker FROM conversations WHERE (conv_id * 1000 + turn) % 7 <> 0 ORDER BY created_at DESC LIMIT 20"
QUERIES["s15_file_index"] = lambda spark, sf_dir: files.index_files(spark, sf_dir, "*.parquet")


@query("s16_export", "supplier", "name row_count columns", "", "SELECT 'suppliers' AS name, count(*) AS row_count, 's_suppkey,s_name,s_acctbal' AS columns FROM supplier")
def exported(supplier: DataFrame) -> DataFrame:
    """A table as CSV with its manifest, read back from the files."""
    spark = supplier.sparkSession
    path = work_path(spark, "export")
    files.export(supplier.select("s_suppkey", "s_name", "s_acctbal"), path, "suppliers")
    return spark.read.json(f"{path}/suppliers.manifest")


query("s09_prefer_source", "moneyflow_raw", "symbol trade_date chosen quality", "net_mf_amount", """
    SELECT symbol, trade_date, net_mf_amount, CASE WHEN p THEN 'primary' ELSE 'stale' END AS chosen, CASE WHEN p THEN 'ok' ELSE 'stale' END AS quality FROM (
      SELECT *, symbol < 'Brand#2' AS a, bool_or(symbol < 'Brand#2' AND version = 'F') OVER (PARTITION BY symbol) AS p FROM moneyflow_raw) WHERE (p AND a AND version = 'F') OR (NOT p AND version = 'O')""", digits=2)(
    lambda m: pit.prefer_source([("primary", m.filter("version = 'F' and symbol < 'Brand#2'")), ("fallback", m.filter("false")), ("stale", m.filter("version = 'O'"))]))
#: Bars may come from elsewhere, money flow only from the primary source.
query("s09_source_quality", "bars moneyflow_raw", "symbol dataset chosen quality", "", """
    WITH k AS (SELECT DISTINCT symbol, CAST(symbol[7:] AS INT) AS k FROM bars)
    SELECT symbol, 'bars' AS dataset, CASE k % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'fallback' WHEN 2 THEN 'stale' ELSE 'unavailable' END AS chosen, CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'stale' ELSE 'invalid' END AS quality FROM k
    UNION ALL SELECT symbol, 'money_flow', CASE k % 3 WHEN 0 THEN 'primary' ELSE 'unavailable' END, CASE k % 3 WHEN 0 THEN 'ok' ELSE 'partial' END FROM k""")(lambda b, m: _quality(b, m))


def _quality(bars: DataFrame, money: DataFrame) -> DataFrame:
    some = lambda f, cond: f.filter(cond.replace("k", "cast(substring(symbol, 7) as int)"))
    sources = {
        "bars": [("primary", some(bars, "k % 4 = 0")), ("fallback", some(bars, "k % 4 < 2")), ("stale", some(bars, "k % 4 < 3"))],
        "money_flow": [("primary", some(money, "k % 3 = 0")), ("fallback", money)],
    }
    return pit.source_quality(bars, sources, critical=("bars",))
