"""Versioned stores, markers, datasets, factors and packages: broken writes, second writers, odd rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import fundamentals, pit
from tidemark.sources import files, versions

D = dt.date
BARS = "symbol string, trade_date date, v double"


def values(frame):
    return sorted(((r[0], r[1], r[2]) for r in frame.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    rows = [(s, D(y, m, 5), float(y)) for s in "ABCD" for y in (2021, 2022, 2023) for m in (1, 6)]
    return versions.Store(spark, f"file://{tmp_path}/s", ["symbol", "trade_date"]).write(spark.createDataFrame(rows, BARS))


def read_files(frame):
    return {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}


def test_ranges_and_upserts_touch_few_files(spark, store):
    assert values(store.between("2022-01-05", "2022-05-31")) == [(s, D(2022, 1, 5), 2022.0) for s in "ABCD"]
    f = store.between("2022-01-05", "2022-05-31")
    assert all("_year=2022" in x for x in f.inputFiles()) and "PushedFilters: [IsNotNull(trade_date)" in f._jdf.queryExecution().executedPlan().toString()
    before = set(store.read().inputFiles())
    new = spark.createDataFrame([("A", D(2022, 6, 5), 1.0), ("A", D(2024, 1, 1), 2.0), ("A", None, 3.0), ("A", D(2022, 6, 5), 1.0)], BARS)
    assert store.upsert(new) == 2
    assert values(store.read()) == sorted([r for r in values(store.read(1)) if r[:2] != ("A", D(2022, 6, 5))] + [("A", D(2022, 6, 5), 1.0), ("A", D(2024, 1, 1), 2.0), ("A", None, 3.0)], key=str)
    gone = before - set(store.read().inputFiles())
    assert len(gone) == 1 and "_year=2022" in gone.pop()  # A's bucket of that year alone
    assert values(store.between("2024-01-01", "2024-12-31")) == [("A", D(2024, 1, 1), 2.0)] and store.between("1990-01-01", "1990-12-31").count() == 0


def test_a_write_that_breaks_off_leaves_the_state_before(spark, store, monkeypatch):
    before = values(store.read())
    new = spark.createDataFrame([("A", D(2022, 6, 5), 1.0)], BARS)

    def die(*_):
        raise OSError("the driver is gone")

    monkeypatch.setattr(versions.Versions, "put", die)
    for write in (store.upsert, store.append_new):
        with pytest.raises(OSError, match="gone"):
            write(new)
    assert values(store.read()) == before
    monkeypatch.undo()
    assert store.upsert(new) == 2 and len(values(store.read())) == len(before)


def test_a_second_writer_fails(spark, store):
    other = versions.Store(spark, store.path, store.keys)
    begun, files_, schema = other.manifest()
    assert store.upsert(spark.createDataFrame([("A", D(2022, 6, 5), 1.0)], BARS)) == 2
    with pytest.raises(versions.Conflict):
        other._swap(begun, files_, schema)
    with pytest.raises(versions.Conflict):
        store.write(spark.createDataFrame([("A", D(2022, 6, 5), 1.0)], BARS))
    assert store.versions.last() == 2


def test_appended_revisions_are_new_and_read_few_files(spark, store, monkeypatch):
    batch = spark.createDataFrame([("A", D(2022, 6, 5), 2022.0), ("A", D(2022, 6, 5), None), ("A", D(2022, 6, 5), None), ("B", D(2025, 1, 1), 9.0), (None, None, None)], BARS)
    read = []
    rows = versions.Store._rows
    monkeypatch.setattr(versions.Store, "_rows", lambda self, f, schema: (read.append(f.select("path").collect()), rows(self, f, schema))[1])
    before = values(store.read())
    read.clear()
    store.append_new(batch)
    assert len(read) == 1 and len(read[0]) == 1 and "_year=2022" in read[0][0]["path"]
    assert values(store.read()) == sorted([*before, ("A", D(2022, 6, 5), None), ("B", D(2025, 1, 1), 9.0), (None, None, None)], key=str)
    store.append_new(batch)
    assert len(values(store.read())) == len(before) + 3


def test_markers_only_grow(spark, tmp_path):
    marks = versions.Markers(spark, f"file://{tmp_path}/m")
    assert marks.read().count() == 0
    at = dt.datetime
    rows = [[("A", "d", D(2021, 1, 1), D(2023, 1, 1), at(2024, 1, 1)), ("B", "d", D(2021, 1, 1), None, at(2024, 1, 1))], [("A", "d", D(2022, 1, 1), D(2022, 6, 1), at(2024, 1, 9)), ("B", "d", None, D(2020, 1, 1), None)]]
    for r in rows:
        marks.merge(spark.createDataFrame(r, marks.read().schema))
    assert sorted(tuple(r) for r in marks.read().collect()) == [("A", "d", D(2021, 1, 1), D(2023, 1, 1), at(2024, 1, 9)), ("B", "d", D(2021, 1, 1), D(2020, 1, 1), at(2024, 1, 1))]
    got = pit.fresh(marks.read(), "2021-06-01", "2022-12-31", F.lit("2024-01-10").cast("timestamp"), 2 * 86_400).collect()
    assert {r["symbol"]: (r["is_fresh"], r["covers"], r["expired"], r["usable"]) for r in got} == {"A": (True, True, False, True), "B": (False, False, True, False)}
    assert pit.fresh(marks.read().withColumn("updated_at", F.lit(None).cast("timestamp")), "2021-06-01", "2022-12-31", F.current_timestamp(), 9).filter("expired").count() == 2


def test_datasets_are_parquet_csv_or_none(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "p")], "id int, name string"), spark.createDataFrame([(2, "c, d")], "id int, name string")
    one.write.parquet(f"file://{tmp_path}/a.parquet")
    for name in ("a", "b"):
        two.write.option("header", "true").csv(f"file://{tmp_path}/{name}.csv")
    got = {n: (found, [tuple(r) for r in f.collect()]) for n in "abc" for f, found in [files.read_dataset(spark, f"file://{tmp_path}", n, "id int, name string")]}
    assert got == {"a": ("parquet", [(1, "p")]), "b": ("csv", [(2, "c, d")]), "c": ("none", [])}


def test_factors_take_the_last_row_and_refuse_zero(spark):
    f = spark.createDataFrame([("A", D(2024, 1, 1), "2.0", 1), ("A", D(2024, 1, 1), "1.5", 2), ("A", D(2024, 1, 2), "x", 1), ("A", None, "3", 1)], "symbol string, trade_date date, adj_factor string, load_seq int")
    assert [tuple(r) for r in pit.normalize_factors(f).collect()] == [("A", D(2024, 1, 1), 1.5)]
    for bad in ("0", "-1"):
        with pytest.raises(Exception, match="must be positive: A 2024-01-03"):
            pit.normalize_factors(f.union(spark.createDataFrame([("A", D(2024, 1, 3), bad, 1)], f.schema))).collect()


def test_packages_are_valid_and_of_the_code(spark):
    body = lambda **k: json.dumps({"schema_version": "1", "run_id": "r", "stock": {"code": "A"}} | k)
    rows = [("A", 1, body()), ("A", 2, body(run_id="0")), ("A", 3, body(run_id="")), ("A", 4, body(schema_version=0)), ("A", 5, body(stock={"code": "B"})), ("A", 6, body(stock=["A"])), ("A", 7, "{"), ("A", 8, None), ("A", 9, "[]"), ("B", 1, "{}"), ("7", 1, body(stock={"code": 7}))]
    assert [(r["ticker"], r["modified"]) for r in pit.latest_package(spark.createDataFrame(rows, "ticker string, modified int, body string")).collect()] == [("A", 2)]


def test_bars_without_columns_or_rows_are_refused(spark):
    f = spark.createDataFrame([("A", D(2024, 1, 1), 1.0, float("nan")), ("A", D(2024, 1, 1), 1.0, 2.0), ("A", None, None, float("inf"))], "symbol string, trade_date date, open double, close double")
    assert tuple(fundamentals.bar_contract(f).first()) == ("A", 3, 2)
    with pytest.raises(ValueError, match="bars lack open, close"):
        fundamentals.bar_contract(f.drop("open", "close"))
    with pytest.raises(ValueError, match="no bars"):
        fundamentals.bar_contract(f.limit(0))
    assert not hasattr(scalars, "redact_map")
