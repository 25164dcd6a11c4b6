"""Scores, gates, queues, evidence and accounts against hand-made values and plain versions."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, fundamentals, gate, medians, ops, pit, recon, risk, strategy

D = dt.date
R = random.Random(17)


def bars(spark, closes, symbol="X", opens=None, volumes=None):
    day = D(2024, 1, 1)
    rows = [(symbol, day + dt.timedelta(i), float(o), float(max(o, c)), float(min(o, c)), float(c), float(v), 100.0 * c) for i, (c, o, v) in enumerate(zip(closes, opens or closes, volumes or [100] * len(closes), strict=True))]
    return spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")


def account(opens, closes, targets, cash, slip=0.0005, commission=0.0003, least=5.0, transfer=0.00001, stamp=0.0005, buys=None, sells=None):
    """The account bar by bar in plain Python: yesterday's signal is traded at today's open in whole lots."""
    start, shares, bought, curve, trades, turned = cash, 0, 0.0, [], [], 0.0
    for i, (o, c) in enumerate(zip(opens, closes, strict=True)):
        want = targets[i - 1] if i else 0
        if i and want and not shares and (buys is None or buys[i]):
            price = o * (1 + slip)
            n = int(cash / price) // 100 * 100
            while n > 0 and n * price + max(least, n * price * commission) + n * price * transfer > cash:
                n -= 100
            if n > 0:
                v = n * price
                bought = v + max(least, v * commission) + v * transfer
                cash, shares, turned = cash - bought, n, turned + v
        elif i and not want and shares and (sells is None or sells[i]):
            v = shares * o * (1 - slip)
            got = v - max(least, v * commission) - v * (transfer + stamp)
            cash, shares, turned = cash + got, 0, turned + v
            trades.append(got / bought - 1)
        curve.append(cash + shares * c)
    r = [b / a - 1 for a, b in zip(curve, curve[1:], strict=False)]
    year = lambda sd: math.sqrt(252) * statistics.fmean(r) / sd if sd > 1e-15 else 0.0
    down = [x for x in r if x < 0]
    total, peak, worst = curve[-1] / start - 1, 0.0, 0.0
    for x in curve:
        peak = max(peak, x)
        worst = min(worst, x / peak - 1)
    return {
        "total_return": total, "annual_return": (1 + total) ** (365 / max(len(curve) - 1, 1)) - 1, "max_drawdown": worst, "sharpe": year(statistics.pstdev(r)), "sortino": year(statistics.pstdev(down)) if down else 0.0, "trades": len(trades),
        "win_rate": sum(x > 0 for x in trades) / len(trades) if trades else 0.0, "turnover": turned / start, "open_shares": shares, "hold_return": closes[-1] / closes[0] - 1,
    }


def test_metrics_equal_a_plain_account(spark):
    rows, want = [], {}
    for k in range(6):
        closes = [20.0]
        for _ in range(89):
            closes.append(round(closes[-1] * (1 + R.uniform(-0.05, 0.05)), 2))
        opens = [round(c * (1 + R.uniform(-0.01, 0.01)), 2) for c in closes]
        signal = [int(i // (3 + k) % 2) for i in range(90)]
        want[f"S{k}"] = account(opens, closes, signal, 5_000.0 if k < 5 else 1_900.0)
        rows.append(bars(spark, closes, f"S{k}", opens).withColumn("signal", F.element_at(F.array(*map(F.lit, signal)), F.datediff("trade_date", F.lit(D(2024, 1, 1))) + 1)))
    for cash, names in ((5_000.0, range(5)), (1_900.0, [5])):
        every = rows[names[0]]
        for k in names[1:]:
            every = every.union(rows[k])
        for r in strategy.metrics(strategy.positions(every), cash).collect():
            for key, value in want[r["symbol"]].items():
                assert math.isclose(r[key], value, rel_tol=1e-9, abs_tol=1e-12), (r["symbol"], key, r[key], value)
    assert sum(w["trades"] for w in want.values()) > 20 and any(w["open_shares"] for w in want.values())


def test_limits_stop_one_side_and_suspensions_both(spark):
    """Accounts in small batches: an open at the upper limit stops buys only, one at the lower limit sales only."""
    rows, want = [], {}
    for k in range(4):
        closes = [round(30 * (1 + R.uniform(-0.3, 0.3)), 2) for _ in range(120)]
        signal = [R.randrange(2) for _ in range(120)]
        flag = [R.choice([None, "0", "1", " YES", "停牌", "no"]) for _ in range(120)]
        up, down = ([R.choice([None, x]) for x in (limit,) * 120] for limit in (33.0, 27.0))
        off = [f in ("1", " YES", "停牌") for f in flag]
        buys, sells = ([not o and (x is None or (c < x if side else c > x)) for o, x, c in zip(off, xs, closes, strict=True)] for side, xs in ((1, up), (0, down)))
        want[f"S{k}"] = account(closes, closes, signal, 50_000.0, buys=buys, sells=sells)
        rows += [(f"S{k}", D(2024, 1, 1) + dt.timedelta(i), c, c, g, f, u, d) for i, (c, g, f, u, d) in enumerate(zip(closes, signal, flag, up, down, strict=True))]
    frame = spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, signal int, is_suspended string, up_limit double, down_limit double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["symbol"]: r for r in strategy.metrics(strategy.positions(frame), 50_000.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for symbol, plain in want.items():
        for key, value in plain.items():
            assert math.isclose(got[symbol][key], value, rel_tol=1e-9, abs_tol=1e-12), (symbol, key)
    assert all(w["trades"] > 3 for w in want.values())
    held = [r["position"] for r in strategy.positions(spark.createDataFrame([("A", D(2024, 1, i + 1), 10.0, g, u, d) for i, (g, u, d) in enumerate([(1, 9.0, 1.0), (1, 10.0, 1.0), (0, 11.0, 1.0), (0, 9.0, 10.0), (0, 9.0, 9.0)])], "symbol string, trade_date date, open double, signal int, up_limit double, down_limit double")).orderBy("trade_date").collect()]
    assert held == [0, 0, 1, 1, 0]  # at the limit; bought; down at the limit; sold although the open is over the upper limit


def test_large_accounts_and_odd_bars(spark):
    rows = [("A", D(2024, 1, i + 1), o, c, g) for i, (o, c, g) in enumerate([(1.0, 1.0, 1), (2.0, 2.0, 1), (4.0, 3.0, 0), (5.0, 5.0, None), (None, 5.0, 1), (0.0, 6.0, 1), (3.0, 6.0, 0), (9.0, 9.0, 0)])]
    frame = spark.createDataFrame(rows, "symbol string, trade_date date, open double, close double, signal int")
    got = strategy.ledger(frame, 1e24).collect()
    assert [(r["entry"].day, r["exit"].day) for r in got] == [(2, 4), (7, 8)] and got[0]["shares"] > 4.9e23 and math.isclose(got[1]["ret"], 3 * 0.9995 * (1 - 0.00081) / (1.0005 * 1.00031) - 1, rel_tol=1e-9)
    assert strategy.metrics(frame.limit(0)).count() == 0 and strategy.metrics(frame, 1e24).first()["trades"] == 2
    from tidemark.functions import scalars
    lots = spark.range(1).select(scalars.lot_size(F.lit(1e24), F.lit(2.0)).alias("big"), scalars.lot_size(F.lit(1e3), F.lit(2.0)).alias("small"), scalars.lot_size(F.lit(1.0), F.lit(2.0)).alias("none")).first()
    assert math.isclose(lots["big"], 5e23, rel_tol=1e-3) and lots["small"] == 400 and lots["none"] == 0


def test_objectives_by_hand(spark):
    row = spark.createDataFrame([(0.5, 0.2, 0.4, -0.1, 1.5, 12.0, 4)], "total_return double, hold_return double, annual_return double, max_drawdown double, sharpe double, turnover double, trades int")
    got = row.select(*[strategy.objective(k).alias(k) for k in ("sharpe", "total_return", "calmar", "robust")]).first()
    assert got["sharpe"] == 1.5 and got["total_return"] == 0.5 and math.isclose(got["calmar"], 4.0)
    assert math.isclose(got["robust"], 0.35 * 0.3 + 0.25 * 0.4 - 0.25 * 0.1 - 0.10 * 1.0 + 0.05 * 0.4)


def test_windows_are_ok_degraded_or_failed_and_symbols_vote_alike(spark):
    rows = [("A", 0, 5, 20, "ok"), ("A", 1, 5, 20, "degraded"), ("A", 2, None, None, "failed"), ("B", 0, 10, 20, "ok"), ("B", 1, 10, 20, "ok"), ("B", 2, 5, 20, "ok"), ("C", 0, None, None, "failed")]
    numbers = ["validation_objective", "test_objective", "validation_return", "test_return", "validation_trades", "test_trades"]
    w = spark.createDataFrame([(*r, *[float(r[1])] * 6) for r in rows], "symbol string, win int, fast int, slow int, status string, " + ", ".join(f"{n} double" for n in numbers))
    summary = {r["symbol"]: (r["windows"], r["successful"], r["failed"], r["test_objective_median"]) for r in strategy.rolling_summary(w).collect()}
    assert summary == {"A": (3, 2, 1, 0.5), "B": (3, 3, 0, 1.0), "C": (1, 0, 1, None)}
    stable = {r["symbol"]: (r["fast"], r["frequency"], r["stable"], r["selected_fast"]) for r in strategy.stability(w).collect()}
    assert stable["A"] == (5, 1.0, True, 5) and stable["B"][0] == 10 and math.isclose(stable["B"][1], 2 / 3) and stable["B"][2:] == (True, 10) and stable["C"] == (None, None, False, None)
    states = spark.createDataFrame([("A", "up"), ("B", "up"), ("C", "down")], "symbol string, state string")
    got = {r["state"]: r for r in strategy.multi(w, states).collect()}
    assert got["all"]["fast"] == 5 and math.isclose(got["all"]["weight"], (1 + 1 / 3) / 2) and got["all"]["symbols"] == 2 and got["all"]["stable"] and got["down"]["fast"] is None and not got["down"]["stable"]
    decided = {r["symbol"]: r["decision"] for r in strategy.promotion(strategy.stability(w), "multi_symbol").collect()}
    assert decided == {"A": "candidate_only_pending_multi_symbol_validation", "B": "candidate_only_pending_multi_symbol_validation", "C": "do_not_promote_parameters"}


def test_medians_of_large_groups(spark):
    """Exact however values are spread or repeated, with a bound far below the groups' sizes."""
    groups = {
        "even": [R.gauss(0, 1) for _ in range(1000)], "odd": [R.lognormvariate(0, 30) for _ in range(1001)], "two": [1.0] * 500 + [2.0] * 500, "ties": [5.0] * 900 + [float(i) for i in range(200)], "one": [-3.5], "wide": [10.0**k for k in range(-300, 300)] + [-(10.0**k) for k in range(-300, 299)],
        "edge": [0.0] * 480 + [R.random() for _ in range(40)] + [1.0] * 480, "few": [3.0, float("nan"), 1.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None)]
    f = spark.createDataFrame(rows, "g string, x double").repartition(6)
    for bound in (3, 50, 10_000):
        got = {r["g"]: r["median"] for r in medians.group_medians(f, ["g"], "x", bound).collect()}
        assert got == {g: statistics.median([x for x in xs if x == x]) for g, xs in groups.items()}, bound


def test_grid_is_capped(spark):
    asked = spark.createDataFrame([(n, v) for n in ("fast", "slow") for v in (0, -3, 5, 5, 20, 60)], "name string, value int")
    assert {tuple(r) for r in strategy.grid_from(asked).collect()} == {(0, 5, 20), (1, 5, 60), (2, 20, 60)}
    with pytest.raises(Exception, match="more than 2"):
        strategy.grid_from(asked, 2).collect()


def test_risk_falls_with_the_score(spark):
    calm = bars(spark, [100.0] * 30, "calm")
    wild = bars(spark, [100.0 * (1.3 if i % 2 else 1.0) for i in range(29)] + [40.0], "wild")
    got = {r["symbol"]: (r["risk_score"], r["risk_level"], r["max_drawdown"]) for r in risk.risk(calm.union(wild)).collect()}
    # calm: low volatility +10, low liquidity -10; wild: very high volatility -20, drawdown over 40 % -20, low liquidity -10.
    assert got == {"calm": (50.0, "medium", 0.0), "wild": (0.0, "high", 69.2)}


def test_trend_points(spark):
    up, flat = bars(spark, [100 + i for i in range(70)], "up"), bars(spark, [100.0] * 70, "flat")
    got = {r["symbol"]: (r["trend_score"], r["label"], r["direction"]) for r in risk.trend_strength(up.union(flat)).collect()}
    assert got == {"up": (85.0, "strong", "up"), "flat": (45.0, "neutral", "sideways")}  # 20 + 10 + 5; no change over 5 bars counts -5


def test_fundamental_points(spark):
    rows = [("A", D(y, 12, 31), 100.0 * 1.25 ** (y - 2020), 30.0, 30.0, 45.0, 200.0, 110.0, 100.0) for y in (2020, 2021)]
    s = spark.createDataFrame(rows, "symbol string, end_date date, revenue double, net_profit double, net_profit_attributable double, operating_cf double, total_assets double, total_liabilities double, shareholders_equity double")
    got = fundamentals.score(s).first()
    # Growth of 25 % +15, ROE of 30 % +15, cash 1.5 times profit +10, debt of 55 % 0.
    assert (got["fundamental_score"], got["evidence"], got["label"]) == (90.0, 4, "excellent")
    high = fundamentals.score(s.withColumn("total_liabilities", F.lit(120.0))).first()
    assert high["fundamental_score"] == 80.0 and fundamentals.solvency(s.withColumn("total_liabilities", F.lit(120.0))).first()["status"] == "high"


def test_decisions_by_hand(spark):
    row = lambda s, p, strength, rel, q: (s, f"e{strength}{p}", "d", p, "cninfo", D(2024, 1, 2), strength, rel, q, "g")
    rows = [row("up", "positive", 0.8, 0.5, 0.9), row("up", "neutral", 0.9, 0.9, 0.5), row("mixed", "positive", 0.5, 0.8, 1.0), row("mixed", "negative", 0.5, 0.8, 1.0), row("none", "neutral", 0.5, 0.5, 0.4)]
    e = spark.createDataFrame(rows, "symbol string, evidence_id string, dimension string, polarity string, source string, published date, strength double, reliability double, quality double, independence_group string")
    got = {r["symbol"]: (r["state"], r["confidence"]) for r in evidence.adjudicate(e).collect()}
    assert got == {"up": ("conditional_positive", round(100 * (0.4 / 1.5) * 0.7)), "mixed": ("conflicted", 0.0), "none": ("insufficient", 0.0)}


def test_what_evidence_is_accepted(spark):
    good = ("A", "x", "cninfo", D(2024, 1, 2), 0.5, 0.5, 0.5, "g")
    rows = [good, ("A", "x", "cninfo", D(2024, 1, 3), 0.9, 0.5, 0.5, "g"), ("A", "y", "price_volume_proxy-v1", D(2024, 1, 2), 0.5, 0.5, 0.5, "g"), ("A", "z", "s", None, 0.5, 0.5, 0.5, "g"), ("A", "f", "s", D(2025, 1, 1), 0.5, 0.5, 0.5, "g"), ("A", "r", "s", D(2024, 1, 1), 1.5, 0.5, 0.5, "g"), ("A", "q", "s", D(2024, 1, 1), 0.5, None, None, "")]
    e = spark.createDataFrame(rows, "symbol string, evidence_id string, source string, published date, strength double, reliability double, quality double, independence_group string").withColumn("polarity", F.lit("neutral"))
    got = [(r["evidence_id"], r["published"], r["reject"]) for r in evidence.accepted(e, "2024-06-30").collect()]
    assert sorted(x[2] or "" for x in got) == ["", "date", "duplicate", "future", "range", "range", "source"] and ("x", D(2024, 1, 2), None) in got
    c = evidence.coverage(evidence.accepted(e, "2024-06-30"), "2024-06-30").first()
    assert (c["accepted"], c["rejected"], c["sources"], c["groups"], c["freshness_days"]) == (1, 6, ["cninfo"], ["g"], 180)


def test_titles(spark):
    titles = {"关于收到行政处罚及风险提示": "行政处罚", "业绩快报：增长": "业绩快报增长", "业绩快报": "unknown", "项目中标及重大合同": "重大合同", None: "unknown"}
    f = spark.createDataFrame([(t,) for t in titles], "t string").select("t", evidence.classify(F.col("t")).alias("k"), evidence.polarity_of(evidence.classify(F.col("t"))).alias("p"))
    assert {r["t"]: r["k"] for r in f.collect()} == titles and {r["p"] for r in f.collect()} == {"negative", "positive", "neutral"}


def test_priorities_and_overrides(spark):
    rows = [("income", "revenue", "over_50pct", "new"), ("income", "revenue", "missing_left", "changed"), ("fina_indicator", "roe", "10_to_50pct", "carried_forward"), ("fina_indicator", "roa", "missing_right", "new"), ("fina_indicator", "roa", "over_50pct", "new"), ("income", "revenue", "exact", "resolved")]
    f = spark.createDataFrame(rows, "dataset string, field string, bucket string, state string")
    got = [(r["priority"], r["role"]) for r in recon.prioritized(f).collect()]
    assert got == [(115, "base_financial"), (85, "base_financial"), (50, "derived_indicator"), (0, "formula_coverage"), (115, "base_financial"), (0, "resolved_regression")]


def test_batches_are_cut_by_cluster_and_in_all(spark):
    rows = [(f"S{i:02d}", D(2024, 12, 31), c, "base_financial" if i % 5 else "manual_decision", 100 - i % 3, "new") for c in ("a", "b", "c") for i in range(40)]
    q = spark.createDataFrame(rows, "symbol string, end_date date, cluster string, role string, priority int, state string").withColumns({"open": F.lit(True), "eligible": F.col("role") == "base_financial"})
    got = [(r["cluster"], r["symbol"]) for r in recon.selected(q, 4, 7).collect()]
    # Priority first, then cluster and symbol; a manual decision keeps its place in the cluster and isn't taken.
    assert got == [("a", "S03"), ("a", "S06"), ("a", "S09"), ("b", "S03"), ("b", "S06"), ("b", "S09"), ("c", "S03")]
    ranks = {(r["cluster"], r["symbol"]): r["cluster_rank"] for r in recon.cluster_ranked(q).collect()}
    order = sorted(range(40), key=lambda i: (-(100 - i % 3), i))
    assert all(ranks[c, f"S{i:02d}"] == n for c in "abc" for n, i in enumerate(order, 1))


def test_gate_outcomes(spark):
    b = bars(spark, [10.0, 11.0], "ok").union(bars(spark, [10.0, 11.0], "late")).union(bars(spark, [10.0, -1.0], "odd"))
    asked = spark.createDataFrame([("ok", "2024-01-02"), ("late", "2024-01-06"), ("odd", "2024-01-02"), ("bad", "x")], "symbol string, requested string")
    s = spark.createDataFrame([(x, D(2023, 12, 31), D(2024, 1, 1)) for x in ("ok", "late", "odd", "bad")] + [("odd", D(2023, 12, 31), D(2024, 2, 1))], "symbol string, end_date date, ann_date date")
    none = spark.createDataFrame([], "symbol string, dataset string, quality string, gap string")
    found = gate.checks(asked, b, {"income": s}, none.drop("gap"), none.select("symbol", "gap"))
    got = {r["symbol"]: (r["gate"], r["cap"], r["warnings"], r["failures"]) for r in gate.gate(found).collect()}
    assert got == {"ok": ("pass", 80, 0, 0), "late": ("degraded", 60, 2, 0), "odd": ("block", 0, 1, 2), "bad": ("block", 0, 0, 2)}
    assert gate.gate(gate.checks(asked, b.drop("high"), {}, none.drop("gap"), none.select("symbol", "gap"), "x")).filter("gate != 'block'").count() == 0


def test_reconcile_at_a_date(spark):
    schema = "symbol string, end_date date, v double, ann_date date, update_flag string, report_type string, load_seq int"
    row = lambda y, v, ann, n: ("A", D(y, 12, 31), v, ann, "0", "1", n)
    left = spark.createDataFrame([row(2022, 1.0, D(2023, 3, 1), 1), row(2022, 2.0, D(2023, 4, 1), 2), row(2023, 5.0, D(2025, 3, 1), 3)], schema)
    right = spark.createDataFrame([row(2022, 1.0, D(2023, 3, 1), 1)], schema)
    got = recon.reconcile(left, right, ["v"], "income", "2024-06-30").first()
    assert (got["left_rows"], got["left_revisions"], got["left_future"], got["right_rows"], got["matched"], got["mismatches"], got["status"]) == (2, 1, 1, 1, 1, 1, "partial")
    q = recon.audit_rows({"income": (left, right, right, ["v"])}, "2024-06-30").first()
    assert (q["state"], q["role"], q["priority"]) == ("carried_forward", "provider_revision", 5)
    assert recon.reconcile(left, right.limit(0), ["v"], "income", "2024-06-30").first()["status"] == "insufficient"


def test_nested_packages_redaction_parameters_and_tags(spark):
    f = lambda run, v: spark.sql(f"SELECT 'A' AS symbol, '{run}' AS run_id, named_struct('x', {v}, 'run_id', '{run}', 'l', array(1, {v})) AS s")
    got = [(r["path"], r["old"], r["new"], r["rank"]) for r in evidence.snapshot_diff(f("a", 1), f("b", 2), ["symbol"]).orderBy("rank").collect()]
    assert got == [("s.l", "[1,1]", "[1,2]", 1), ("s.x", "1", "2", 2)]
    g = lambda m: spark.sql(f"SELECT 'A' AS symbol, {m} AS m")
    open_maps = g("map('a', named_struct('x', map('k', 1, 'run_id', 7), 'y', 2), 'b', named_struct('x', map(), 'y', 3))"), g("map('a', named_struct('x', map('k', 5, 'run_id', 8, 'n', 6), 'y', 2), 'c', named_struct('x', map(), 'y', null))")
    got = [(r["path"], r["old"], r["new"]) for r in evidence.snapshot_diff(*open_maps, ["symbol"]).orderBy("rank").collect()]
    assert got == [("m.a.x.k", "1", "5"), ("m.a.x.n", None, "6"), ("m.b.y", "3", None)]
    nested = spark.sql("SELECT named_struct('a', array(named_struct('apiKey', '1', 'b', '2')), 'm', map('Token', 'x', 'c', 'y')) AS q, 'z' AS password")
    r = ops.redact(nested).first()
    assert r["q"]["a"][0].asDict() == {"apiKey": "<redacted>", "b": "2"} and r["q"]["m"] == {"Token": "<redacted>", "c": "y"} and r["password"] == "<redacted>"
    r = ops.redact(spark.sql("SELECT map('token', 5, 'n', 6) AS m, map('apiKey', array(1), 'o', array(2)) AS l")).first()
    assert r["m"] == {"token": None, "n": 6} and r["l"] == {"apiKey": None, "o": [2]}
    p = spark.sql("SELECT * FROM VALUES (array(5, 10), 14, 5, 20), (array(), 14, 5, 20), (array(5, 5), 14, 5, 20), (array(5), 0, 5, 20), (array(5), 14, 20, 20) AS t(ma_periods, rsi_period, ma_fast, ma_slow)")
    assert [x["reason"] for x in ops.check_parameters(p).collect()] == [None, "ma_periods", "ma_repeated", "rsi_period", "order"]
    s = spark.sql("SELECT 'value' AS mode, 'up' AS trend, 'golden' AS macd_cross, 'overbought' AS rsi_state, 'neutral' AS kdj_state, 'inside' AS boll_state, 1.0D AS volume_ratio, 1 AS supports, 0 AS resistances, 50.0D AS buy_confidence, 10.0D AS sell_confidence, 'high' AS risk_level, 'low' AS valuation_level, 'ok' AS quality, 1 AS gaps")
    assert ops.context_tags(s).first()["tags"] == ["peg_strategy", "risk_control", "trend", "macd", "rsi", "support_resistance", "buy_signal", "risk_analysis", "market_patterns", "investment_cases"]
