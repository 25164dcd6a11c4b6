"""Account queries a scale up, where accounts of the test data's jumping prices leave the range of integers."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import fixtures, plans


@pytest.mark.parametrize("name", ["b05_ledger", "b07_metrics", "b12_optimize"])
def test_accounts_of_long_slices(spark, name):
    rows = plans.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) >= 75 and all(x == x for r in rows for x in r if isinstance(x, float))


@pytest.mark.parametrize("name", ["r13_source_gate", "t08_rankings", "t10_audit_batch", "r09_audit_queue"])
def test_branches_read_what_is_made_once(spark, name):
    """The largest table is read when its aggregate is stored, not by each branch of the plan."""
    assert not [f for f in plans.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_bars_are_one_aggregate_equal_to_the_windows(spark):
    """First and last trades of a day, among them equal keys and missing numbers, without sorting all trades."""
    rows = [(1, 1, 1, 1, 2.0, 10.0), (1, 1, 1, 1, 4.0, 12.0), (3, 1, 1, 2, 1.0, 7.0), (3, 1, 1, 2, None, 7.0), (2, 9, 2, 5, 3.0, None), (2, 8, 2, 5, 3.0, 6.0), (4, 1, 3, 1, 5.0, 5.0), (None, 1, 1, 1, 1.0, 9.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").withColumn("l_shipdate", F.lit("1997-01-02").cast("date"))
    part = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p_partkey long, p_brand string")
    got = fixtures._bars(lines, part)
    sql = re.sub(r"\b(FROM|JOIN) (lineitem|part)\b", r"\1 {\2}", fixtures.VIEWS["bars"])
    want = spark.sql(sql, lineitem=lines, part=part).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Window" not in got._jdf.queryExecution().toString()


def test_sums_of_bars_are_taken_in_the_order_of_the_sql(spark, tmp_path):
    """Amounts of a day that make a whole number in one order and a little less in another; the rule of days without volume reads the whole part."""
    days = [[70279.56, 20210.99, 7614.83, 32428.09, 41103.8, 81165.73], [17852.77, 45783.45, 14945.87, 24241.49, 14658.7, 76639.72], [16511.77, 68331.61, 47170.82, 51970.39, 35945.82, 8632.59]]
    rows = [(k, 1, s, 1, float(k + 2), amounts[::step][k], f"1997-01-0{d + 1}") for d, amounts in enumerate(days) for s, step in ((1, 1), (2, -1)) for k in range(6)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    spark.createDataFrame([(1, "a"), (2, "b")], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for i, f in enumerate((lines.orderBy("l_orderkey").coalesce(1), lines.orderBy(F.desc("l_orderkey")).coalesce(1), lines.repartition(5, "l_orderkey"))):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/part.parquet").symlink_to(tmp_path / "part.parquet")
        f.write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        for t in ("lineitem", "part"):
            con.execute(f"create or replace view {t} as select * from '{tmp_path}/{i}/{t}.parquet/*.parquet'")
        got, sql = plans.QUERIES["d01_check_bars"](spark, f"{tmp_path}/{i}"), con.execute(plans.ORACLE_SQL["d01_check_bars"]).fetchall()
        assert Counter(map(tuple, got.select("symbol", "rule", "n").collect())) == Counter(sql)
        assert ("b", "zero_volume", 3) in sql and not [r for r in sql if r[:2] == ("a", "zero_volume")]
