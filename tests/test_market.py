"""Operators on small literals, plans, and DuckDB comparisons of some queries."""

import datetime as dt
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import scalars as fn
from tidemark.operators import indicators, pit, recon, strategy

SF = "/root/testdata/sf0.001"


def bars(spark, closes, symbol="X"):
    day = dt.date(2024, 1, 1)
    rows = [(symbol, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0, 100.0 * c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")


def test_ewm_equals_pandas_across_blocks(spark):
    x = [float((i * 37) % 101) for i in range(1300)]
    f = indicators.ewm(bars(spark, x), "close", "y", 1 / 3).orderBy("trade_date").toPandas()
    want = pd.Series(x).ewm(alpha=1 / 3).mean()
    assert (f["y"] - want).abs().max() < 1e-9


def test_rsi_zero_cases(spark):
    f = indicators.rsi(bars(spark, [1, 2, 3, 4, 5]), 3).orderBy("trade_date").toPandas()["rsi_3"]
    assert f.isna().tolist() == [True, True, False, False, False] and f.iloc[-1] == 100.0
    flat = indicators.rsi(bars(spark, [5] * 5), 3).toPandas()["rsi_3"]
    assert flat.isna().all()


def test_symbols(spark):
    codes = ["600000", " 000001.sz ", "920001", "430001", "600000.SZ", "12", None]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(fn.normalize_symbol(F.col("c")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("600000.SH", None), ("000001.SZ", None), ("920001.BJ", None), ("430001.BJ", None), (None, "suffix"), (None, "format"), (None, "format")]


def test_revision_choice(spark):
    d = dt.date
    rows = [("A", d(2023, 12, 31), d(2024, 3, 1), "0", "1", 1, 1.0), ("A", d(2023, 12, 31), d(2024, 5, 1), "1", "1", 2, 2.0), ("A", d(2023, 9, 30), None, "0", "1", 1, 3.0)]
    f = spark.createDataFrame(rows, "symbol string, end_date date, ann_date date, update_flag string, report_type string, load_seq int, revenue double")
    assert {r["revenue"] for r in pit.pit_view(f, "2024-04-01").collect()} == {1.0, 3.0}
    assert {r["revenue"] for r in pit.latest_revision(f).collect()} == {2.0, 3.0}


def test_ledger_waits_for_an_affordable_lot(spark):
    f = bars(spark, [10, 11, 12, 11, 10]).withColumns({"run_id": F.lit(0), "slice": F.lit("all"), "action": F.expr("case trade_date when '2024-01-02' then 'buy' when '2024-01-04' then 'sell' end")})
    (trade,) = strategy.ledger(f, cash=10_000.0).collect()
    assert trade["shares"] == 900 and trade["n"] == 1 and trade["ret"] < 0
    assert strategy.ledger(f, cash=500.0).count() == 0


def test_equity_follows_cash_and_shares(spark):
    f = bars(spark, [50, 10, 12, 11, 20]).withColumns({"run_id": F.lit(0), "slice": F.lit("all"), "signal": F.lit(1)})
    held = strategy.positions(f)
    # One lot costs too much on the second bar for the smaller account, so the next bars are tried.
    for cash, free in ((2_000.0, dict(commission=0.0, minimum=0.0, transfer=0.0, stamp=0.0, slippage=0.0)), (900.0, dict(commission=0.0, minimum=0.0, transfer=0.0, stamp=0.0, slippage=0.0))):
        money, shares, want = cash, 0, []
        for i, r in enumerate(held.orderBy("trade_date").collect()):
            if i and not shares:
                shares = money // (r["open"] * 100) * 100
                money -= shares * r["open"]
            want.append((money, shares, money + shares * r["close"]))
        got = [(r["cash"], r["shares"], r["equity"]) for r in strategy.equity(held, cash, **free).orderBy("trade_date").collect()]
        assert got == want
    assert strategy.equity(held.limit(0)).count() == 0


def test_tolerant_equality(spark):
    f = spark.createDataFrame([(1.0, 1.00005), (1.0, 1.1), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in f.select(fn.close_to(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_alignment_sides(spark):
    a, b = (spark.createDataFrame([(x, dt.date(2024, 1, 1)) for x in s], "symbol string, end_date date") for s in ("AB", "BC"))
    assert {(r["symbol"], r["side"]) for r in recon.alignment(a, b).collect()} == {("A", "left_only"), ("B", "matched"), ("C", "right_only")}


def test_indicator_plan_has_no_python_and_few_exchanges(spark):
    plan = indicators.bollinger(indicators.moving_average(bars(spark, [1, 2, 3])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1
    plan = indicators.all_indicators(bars(spark, [1, 2, 3]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1 and len(re.findall(r"- \*?\(?\d*\)?\s*Sort \[", plan)) <= 2


def test_shuffled_input_gives_equal_rows(spark):
    b = bars(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    one = indicators.macd(b).orderBy("trade_date").toPandas()
    assert one.equals(indicators.macd(b.repartition(7)).orderBy("trade_date").toPandas())


@pytest.mark.parametrize("name", [
    "w11_all_indicators", "w12_summary", "j01_adjust", "f09_score", "f10_score_impact", "r03_reconcile", "r08_overrides", "w20_cluster_rank", "b07_metrics", "b12_optimize", "t03_targets", "t05_confidence",
    "d05_gate_checks", "e04_accepted", "e08_adjudicate", "e09_scenarios", "e16_labelled_amounts", "s03_upsert_bars", "a16_run_stats",
])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    mine, sql = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    text = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: str(v)[:10]).values.tolist()))
    assert sorted(sql.columns) == cols and text(mine) == text(sql)
