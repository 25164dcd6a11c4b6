"""Ledgers, rules, bundles and files on small literals."""

import datetime as dt
import hashlib
import json
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, ledger, risk, rules, textfields
from tidemark.sources import files

D = dt.date


def bars(spark, closes, symbol="X"):
    day = D(2024, 1, 1)
    rows = [(symbol, day + dt.timedelta(i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0 + i % 7, 100.0 * c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")


def test_report_matching_prefers_the_issuer(spark):
    reports = spark.createDataFrame([("A", D(2023, 12, 31), "annual", "Alpha"), ("A", D(2023, 6, 30), "semiannual", "Alpha"), ("B", D(2023, 12, 31), "annual", None)], "symbol string, end_date date, report_type string, name string")
    titles = [
        ("A", "1", D(2024, 3, 1), "Alpha Bank 2023年年度报告"), ("A", "2", D(2024, 3, 2), "Alpha2023年 年度报告"), ("A", "3", D(2024, 2, 1), "Alpha2023年年度报告摘要"), ("A", "4", D(2023, 8, 1), "Alpha半年报"), ("A", "5", D(2022, 8, 1), "Alpha半年报"), ("A", "6", D(2024, 1, 1), None),
    ]
    news = spark.createDataFrame(titles, "symbol string, item_id string, published date, title string")
    got = {(r["symbol"], r["report_type"]): (r["match"], r["item_id"], r["candidates"]) for r in ledger.match_reports(reports, news).collect()}
    assert got == {("A", "annual"): ("issuer_preferred_candidate", "2", 2), ("A", "semiannual"): ("exact", "4", 1), ("B", "annual"): ("missing", None, 0)}


def test_dispositions(spark):
    audit = spark.createDataFrame([("A", D(2023, 12, 31), f, r, m) for f, r, m in (("roe", "manual_decision", " keep "), ("roa", "value", None), ("x", "value", None), ("y", "source_unreadable", None))], "symbol string, end_date date, field string, role string, manual_decision string")
    res = spark.createDataFrame([("A", D(2023, 12, 31), "roa", ledger.MATCHES), ("A", D(2023, 12, 31), "roa", ledger.MATCHES)], "symbol string, end_date date, field string, resolution string")
    got = {r["field"]: (r["disposition"], r["actionability"], r["repeated"]) for r in ledger.disposed(audit, res).collect()}
    assert got == {"roe": ("keep", "policy_required", False), "roa": ("formula_crosscheck_resolved", "none", True), "x": ("unclassified", "review_required", False), "y": ("source_unreadable", "evidence_required", False)}


def test_source_gate_needs_all(spark):
    done = spark.createDataFrame([("balance", 4, 0), ("income", 4, 3)], "dataset string, matched int, mismatches int")
    none = spark.createDataFrame([("a", "none")], "disposition string, actionability string")
    sound, derived = none.filter("false"), spark.createDataFrame([("resolved_x",), ("manual",)], "resolution string")
    gate = lambda *a: ledger.source_gate(*a).first()
    assert gate(sound, done, none, derived, 4)["status"] == "pass_with_reservations" and gate(sound, done, none, derived, 4)["derived_resolved"] == 1
    assert gate(sound, done, none, derived, 5)["status"] == gate(sound, done.filter("false"), none, derived, 4)["status"] == gate(none, done, none, derived, 4)["status"] == "fail"


def test_announcements_by_code_title_time_and_address(spark):
    rows = [
        ("000001", "1", " T ", "1704038400000", None, "/docs/a.pdf"), ("000001", None, "", "0", "1", None), ("000001", "000001", "H股公告 x", "0", "2", None), ("000001", "", "x H股公告-y", "0", "3", None),
        ("000001", "2", "other code", "0", "4", None), ("000001", " 1 ", "on H股 shares", "2024-05-06 23:59:59", "5", "https://h/z"), ("000001", None, "undated", "some day", "6", None), ("000001", None, "no time", None, "7", None), ("000001", "0000012", "long code", "0", "8", None), ("600000", None, "page", "1.7040384E12", "9", " "),
    ]
    raw = spark.createDataFrame(rows, "symbol string, sec_code string, title string, announced string, item_id string, adjunct_url string").withColumns({"plate": F.lit("p"), "org_id": F.lit("o")})
    got = {r["title"]: (r["announcement_id"], r["item_id"], r["published"], r["source_url"]) for r in ledger.normalize_announcements(raw, static_base="s:/", page_base="b:").collect()}
    first = hashlib.sha1(b"000001|2023-12-31|T|s://docs/a.pdf").hexdigest()[:16]
    assert got == {
        "T": (first, f"official:000001:{first}", D(2023, 12, 31), "s://docs/a.pdf"), "on H股 shares": ("5", "official:000001:5", D(2024, 5, 6), "https://h/z"),
        "page": ("9", "official:600000:9", D(2023, 12, 31), "b:?plate=p&orgId=o&stockCode=600000&announcementId=9"),
    }
    assert ledger.normalize_announcements(raw, with_h_shares=True).count() == 5


def test_ledger_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([("income", "A", D(2024, 3, 31), 1)], "dataset string, symbol string, end_date date, x int")
    right = spark.createDataFrame([("income", "A", D(2024, 3, 31), 2), ("income", "B", D(2024, 3, 31), 3)], "dataset string, symbol string, end_date date, y int")
    keys = ["dataset", "symbol", "end_date"]
    assert [(r["x"], r["y"]) for r in ledger.ledger_join(left, right, keys).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="several rows for income, B"):
        ledger.ledger_join(left, right.union(right.filter("y = 3")), keys).collect()


def test_wrapped_words_are_joined(spark):
    f = spark.createDataFrame([("营业\n收入\n合\n\n 计 a\nb⼈⽉合",)], "t string")
    assert f.select(ledger.normalize_text(F.col("t"), {"合": "和", "合计": "总计"})).first()[0] == "营业收入总计 a\nb人月和"


def test_rules_equal_pandas(spark):
    x = [float((i * 37) % 101 + i / 9) for i in range(150)]
    b = bars(spark, x)
    close = pd.Series(x)
    move = close.diff()
    up, down = move.clip(lower=0).rolling(14).mean(), (-move.clip(upper=0)).rolling(14).mean()
    rsi = 100 - 100 / (1 + up / down.replace(0, float("nan")))
    want = ((close.rolling(10).mean() > close.rolling(30).mean()) & (rsi.fillna(0) < 50)).astype(int).tolist()
    got = rules.apply_rule(b, "ma_cross_rsi", {"rsi_floor": 50}).orderBy("trade_date").toPandas()["signal"].tolist()
    assert got == want and 0 < sum(want) < len(want)


def test_rule_contract(spark):
    with pytest.raises(ValueError, match="taken"):
        rules.register(rules.RULES["ma_cross"])
    with pytest.raises(ValueError, match="has no"):
        rules.effective(rules.RULES["ma_cross"], {"x": 1})
    assert rules.apply_python(bars(spark, [3, 1, 2]), lambda f, p: (f["close"] > p["cut"]).astype(int), {"cut": 1.5}).orderBy("trade_date").toPandas()["signal"].tolist() == [1, 0, 1]
    with pytest.raises(Exception, match="one 0 or 1"):
        rules.apply_python(bars(spark, [3, 1]), lambda f, p: f["close"], {}).collect()


def test_confidence_by_hand(spark):
    b = bars(spark, [100 + i for i in range(70)]).unionByName(bars(spark, [200 - i for i in range(70)], "Y"))
    got = {r["symbol"]: r for r in rules.confidence(b).collect()}
    last = {r["symbol"]: r for r in indicators.latest(indicators.all_indicators(b)).collect()}
    assert got["X"]["alignment"] == "bullish" and last["X"]["rsi_14"] == 100
    buy = 1 + (last["X"]["macd"] > last["X"]["macd_signal"]) + (got["X"]["below"] < 10)
    assert got["X"]["buy_confidence"] == round(buy * 20)
    sell = 1 + (last["Y"]["macd"] < last["Y"]["macd_signal"]) + (1.5 if got["Y"]["above"] < 5 else 0) + (got["Y"]["trend_score"] < 40)
    assert got["Y"]["sell_confidence"] == min(100, round(sell * 20)) and got["Y"]["buy_confidence"] == 30 + 20 * (got["Y"]["macd"] > got["Y"]["macd_signal"]) + 20 * (got["Y"]["below"] < 10)
    assert len(rules.level_bundle(b).collect()) == 2


def test_invalidations(spark):
    f = spark.createDataFrame([("A", 1.0, 2.0, "high", None), ("B", None, None, "low", "block")], "symbol string, support double, resistance double, risk_level string, gate string")
    ids = lambda g: {(r["symbol"], r["id"]) for r in g.collect()}
    every = {("A", "price.break_support"), ("A", "price.break_resistance_context"), ("A", "risk.reassessment"), ("B", "price.levels_missing"), ("B", "data.quality_change")}
    assert ids(rules.invalidations(f)) == every
    assert ids(rules.invalidations(f, "support")) == every - {("A", "price.break_support")}


def test_package_names_gaps(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, v int")
    got = {r["symbol"]: r for r in rules.package({"one": a, "two": a.filter("v = 1")}, "2024-01-01").collect()}
    assert got["B"]["gaps"] == ["two"] and got["A"]["gaps"] == []
    assert json.loads(got["A"]["package"]) == {"symbol": "A", "as_of": "2024-01-01", "one": {"v": 1}, "two": {"v": 1}}
    assert got["A"]["digest"] == hashlib.sha256(got["A"]["package"].encode()).hexdigest() and got["A"]["size"] == len(got["A"]["package"])


def test_files(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 as v").coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "broken.parquet").write_bytes(b"not parquet")
    assert files.read_tolerant(spark, str(tmp_path / "t"), "id bigint, v bigint").count() == 5
    (tmp_path / "log.jsonl").write_text('{"at": 1}\n{broken\n{"at": 3}\n{"at": 2}\n')
    assert [r["at"] for r in files.read_log(spark, str(tmp_path / "log.jsonl"), "at int", "at", 2).collect()] == [3, 2]
    (index,) = files.index_files(spark, str(tmp_path), "*.jsonl").collect()
    assert index["member"] == "log.jsonl" and index["sha256"] == hashlib.sha256((tmp_path / "log.jsonl").read_bytes()).hexdigest()
    made = files.export(spark.range(3).toDF("id"), str(tmp_path / "out"), "ids").first()
    assert made["row_count"] == 3 and spark.read.json(str(tmp_path / "out" / "ids.manifest")).first()["columns"] == "id"


def test_empty_bars(spark):
    none = bars(spark, [1.0]).filter("false")
    assert rules.confidence(none).count() == 0 and rules.apply_rule(none, "ma_cross").count() == 0 and risk.supports(none).count() == 0


def test_labelled_amounts(spark):
    texts = [
        "单位：万元\n营业收入 (1) 1,234.5 900\n" + "-" * 90 + "\n净利润（百万元） （12）",  # a footnote, units before and within 80 characters of a label, brackets
        "营业收入比率 5\n归属于股东的净利润 7",  # a ratio and a rejected prefix
        "营业收入 3\n营业收入 8\n净利润 -2 每股 5 元",
        "", None, "净利润" * 50,
    ]
    fields = {"revenue": textfields.Labels(("营业收入",)), "profit": textfields.Labels(("净利润",), reject=("归属于",))}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["revenue"], r["profit"], r["status"]) for r in textfields.labelled_amounts(rows, fields).collect()}
    assert got == {0: (12_345_000.0, -12_000_000.0, "parsed"), 1: (None, None, "partial"), 2: (8.0, -2.0, "parsed"), **{i: (None, None, "partial") for i in (3, 4, 5)}}
    assert textfields.labelled_amounts(rows.limit(0), fields).count() == 0


def plain_amount(text, spec, lines=3):
    """Label by label and place by place, each time from the text around it alone."""
    text = (text or "").translate(str.maketrans(textfields.WIDE, textfields.NARROW))
    amount, unit = re.compile(textfields.AMOUNT, re.ASCII), re.compile(textfields.UNIT, re.ASCII)
    strip = lambda t: re.sub("每股[^\n]*", "", t)
    for label in spec.names:
        found, pieces = [], text.split(label)
        for i in range(1, len(pieces)):
            before, after = label.join(pieces[:i]), label.join(pieces[i:])
            near, head = "\n".join(after.split("\n")[:lines]), before.split("\n")[-1]
            tokens = [m.group() for m in amount.finditer(near)]
            real = [t for t in tokens if len(tokens) == 1 or not re.fullmatch(textfields.NOTE, t.replace(" ", ""))]
            if not real:
                continue
            first = amount.search(near).start()
            until = near[:first] if "\n" not in near[:first] else ""
            if any(w in head for w in spec.reject) or (not re.search("率|占比", label) and (re.search("率|占比", head) or re.search("率|占比", until))):
                continue
            value = float(re.sub(r"[^\d.]", "", real[0]))
            value = -value if re.match(r"\s*[(\[]?-|\s*[(\[].*[)\]]", real[0], re.DOTALL) else value
            own, above = unit.search(strip(after.split("\n")[0])), unit.findall(strip(before))
            scale = textfields.UNITS[own.group(1)] if own else textfields.UNITS[above[-1]] if above else 1.0
            found.append((-abs(value * (scale if spec.scaled else 1)), len(before), value * (scale if spec.scaled else 1)))
        if found:
            return min(found)[2]
    return None


def test_amounts_of_random_pages_equal_a_plain_search(spark):
    r = random.Random(16)
    pieces = ["净利润", "营业收入", "归属于", "EPS", "每股收益", "单位：万元", "（千元）", "人民币 元", "\n", "\n", "\n", " ", " ", "(1)", "(23)", "1,234.50", "-7", "(8.5)", "12%", "５６", "增长率", "占比", "x", "3.2.1", "元/股", "0.35"]
    specs = {"a": textfields.Labels(("净利润",), reject=("归属于",)), "b": textfields.Labels(("营业总收入", "营业收入")), "c": textfields.Labels(("EPS", "每股收益"), scaled=False), "d": textfields.Labels(("增长率",))}
    pages = ["".join(r.choices(pieces, k=r.randint(0, 40))) for _ in range(800)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(pages)], "i int, text string")
    got = {x["i"]: [x[c] for c in specs] for x in textfields.labelled_amounts(rows, specs).collect()}
    want = {i: [plain_amount(t, s) for s in specs.values()] for i, t in enumerate(pages)}
    assert got == want and sum(x is not None for v in want.values() for x in v) > 800


def test_a_page_of_a_megabyte_takes_one_pass():
    import time

    spec = textfields.Labels(("净利润",), reject=("归属于",))
    for line in ("净利润 (1) 1,234.50 ", "净利润 (1) 1,234.50\n", "净利润 (1) 率"):
        text = "单位:万元 " + line * (1_000_000 // len(line))
        began = time.process_time()
        assert textfields.Page(text).amount(spec, 3) == (12_345_000.0 if "234" in line else None)
        assert time.process_time() - began < 10
