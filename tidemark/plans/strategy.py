"""Queries of strategy evaluation (B1-B18, W21, A14, A15): one plan over symbols, parameters and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import strategy as st
from .base import query

CASH = 1e7  # a lot of the test data's prices costs more than 100,000
FAST, SLOW = [5, 10, 20, 30], [30, 60, 120]
SIZES = (252, 63, 63, 63)
MIN_TRADES, MIN_SYMBOLS = 1, 4
PAIRS = sorted((f, s) for f in FAST for s in SLOW if f < s)
W = "PARTITION BY symbol ORDER BY trade_date"


def GRID(bars: DataFrame) -> DataFrame:  # noqa: N802
    """The grid of the requested values, as rows that any table of requests could hold."""
    return st.grid_from(bars.sparkSession.createDataFrame([*(("fast", v) for v in FAST), *(("slow", v) for v in SLOW)], "name string, value int"))


def HELD(bars: DataFrame) -> DataFrame:  # noqa: N802
    return st.held(bars, GRID(bars))


def MEASURED(bars: DataFrame) -> DataFrame:  # noqa: N802
    return st.measured(bars, GRID(bars), CASH)


def WINDOWS(bars: DataFrame) -> DataFrame:  # noqa: N802
    return st.windows(bars, *SIZES)


def ROLLED(bars: DataFrame) -> DataFrame:  # noqa: N802
    return st.rolling(bars, GRID(bars), WINDOWS, "robust", MIN_TRADES, CASH)


# --- the same in DuckDB --------------------------------------------------------------------------

GRID_SQL = "(VALUES " + ", ".join(f"({i}, {f}, {s})" for i, (f, s) in enumerate(PAIRS)) + ") g(run_id, fast, slow)"
LENGTHS = sorted({x for p in PAIRS for x in p})
MEANS_SQL = f"""
    SELECT symbol, trade_date, CAST(open AS DOUBLE) AS open, CAST(close AS DOUBLE) AS close, {{free}}, row_number() OVER ({W}) - 1 AS r, count(*) OVER (PARTITION BY symbol) AS n,
      {', '.join(f'avg(close) OVER ({W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS m{p}' for p in LENGTHS)}
    FROM {{source}}"""
#: What stops a buy and a sale, where the bars say so.
PLAIN = {"source": "bars", "free": "true AS buy, true AS sell"}
LIMITS = {"source": "limit_bars", "free": """coalesce(lower(trim(is_suspended)) NOT IN ('1', 'true', 'yes', 'y', '停牌'), true) AND coalesce(open < up_limit, true) AS buy,
      coalesce(lower(trim(is_suspended)) NOT IN ('1', 'true', 'yes', 'y', '停牌'), true) AND coalesce(open > down_limit, true) AS sell"""}
SPLIT_SQL = """
    SELECT *, r + 1 - CASE slice WHEN 'train' THEN 0 WHEN 'validation' THEN t1 ELSE t2 END AS place, 0 AS win
    FROM (SELECT *, CASE WHEN r < t1 THEN 'train' WHEN r < t2 THEN 'validation' ELSE 'test' END AS slice
      FROM (SELECT *, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS t1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS t2 FROM means))"""
WINDOW_SQL = """
    SELECT *, CASE WHEN spot < 252 THEN 'train' WHEN spot < 315 THEN 'validation' ELSE 'test' END AS slice,
      spot + 1 - CASE WHEN spot < 252 THEN 0 WHEN spot < 315 THEN 252 ELSE 315 END AS place
    FROM (SELECT m.*, w.win, m.r - w.win * 63 AS spot FROM means m JOIN (SELECT CAST(unnest(range(0, 200)) AS INT) AS win) w ON w.win * 63 + 378 <= m.n AND m.r BETWEEN w.win * 63 AND w.win * 63 + 377)"""


def mean_sql(which: str) -> str:
    return f"CASE WHEN place >= {which} THEN CASE {which} " + " ".join(f"WHEN {p} THEN m{p}" for p in LENGTHS) + " END END"


def held_sql(cut: str, bars: dict[str, str] = PLAIN) -> str:
    """CTEs up to ``held``: symbol, win, slice, run_id, trade_date, i, open, close, signal, target, position, action."""
    key = "PARTITION BY symbol, win, run_id, slice ORDER BY trade_date"
    return f"""
    means AS MATERIALIZED ({MEANS_SQL.format(**bars)}), parts AS ({cut}),
    signals AS (SELECT symbol, win, slice, run_id, fast, slow, trade_date, place AS i, open, close, buy, sell, coalesce({mean_sql('fast')} > {mean_sql('slow')}, false)::INT AS signal FROM parts CROSS JOIN {GRID_SQL}),
    targets AS (SELECT *, lag(signal) OVER ({key}) AS target FROM signals),
    led AS (SELECT *, coalesce(last_value(CASE WHEN target = 1 AND buy THEN 1 WHEN target = 0 AND sell THEN 0 END IGNORE NULLS) OVER ({key} ROWS UNBOUNDED PRECEDING), 0) AS position FROM targets),
    taken AS (SELECT *, coalesce(lag(position) OVER ({key}), 0) AS p FROM led),
    held AS MATERIALIZED (SELECT *, CASE WHEN position > p THEN 'buy' WHEN position < p THEN 'sell' END AS action, dense_rank() OVER (ORDER BY symbol, win, run_id, slice) AS kid FROM taken)"""


def account_sql(cut: str, bars: dict[str, str] = PLAIN) -> str:
    """CTEs up to ``fold``, the account at each bar by recursion over bars, and ``met``, its metrics by key."""
    price = {"buy": "(open * 1.0005::DOUBLE)", "sell": "(open * 0.9995::DOUBLE)"}
    fees = lambda v, rate: f"(greatest(5, {v} * 0.0003::DOUBLE) + {v} * {rate}::DOUBLE)"
    lots = f"greatest(floor(least(cash / 1.00031::DOUBLE, (cash - 5) / 1.00001::DOUBLE) / ({price['buy']} * 100)), 0) * 100"
    w = "PARTITION BY kid ORDER BY i"
    return f"""
    {held_sql(cut, bars)},
    account AS (
      SELECT kid, i, {CASH}::DOUBLE AS cash, 0::DOUBLE AS shares, 0::DOUBLE AS paid, 0::DOUBLE AS got, 0::DOUBLE AS turned FROM held WHERE i = 1
      UNION ALL
      SELECT kid, i, cash - paid + got, CASE WHEN q > 0 THEN q WHEN got > 0 THEN 0 ELSE shares END, paid, got, turned FROM (
        SELECT *, CASE WHEN bought > 0 THEN bought + {fees('bought', '0.00001')} ELSE 0 END AS paid, CASE WHEN sold > 0 THEN sold - {fees('sold', '0.00051')} ELSE 0 END AS got, bought + sold AS turned FROM (
          SELECT *, q * {price['buy']} AS bought, CASE WHEN asked = 0 THEN shares * {price['sell']} ELSE 0 END AS sold FROM (
            SELECT h.kid, h.i, h.open, CASE WHEN h.target = 0 AND h.sell THEN 0 END AS asked, a.cash, a.shares, CASE WHEN h.target = 1 AND h.buy AND a.shares = 0 THEN {lots} ELSE 0 END AS q FROM account a JOIN held h ON h.kid = a.kid AND h.i = a.i + 1)))),
    fold AS MATERIALIZED (SELECT h.*, a.cash, a.shares, a.paid, a.got, a.turned, a.cash + a.shares * h.close AS equity, last_value(CASE WHEN paid > 0 THEN paid END IGNORE NULLS) OVER (PARTITION BY kid ORDER BY i ROWS UNBOUNDED PRECEDING) AS cost FROM account a JOIN held h USING (kid, i)),
    curve AS (SELECT *, equity / lag(equity) OVER ({w}) - 1 AS ret, equity / max(equity) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM fold),
    sums AS (SELECT symbol, win, slice, run_id, fast, slow, arg_max(equity, i) / {CASH}::DOUBLE - 1 AS total_return, greatest(max(trade_date) - min(trade_date), 1) AS days, min(dd) AS max_drawdown,
        avg(ret) AS mean, stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < 0) AS down, arg_max(close, i) / arg_min(close, i) - 1 AS hold_return, count(*) FILTER (got > 0) AS trades, count(*) FILTER (got > cost) AS wins,
        sum(turned) / {CASH}::DOUBLE AS turnover, avg((shares > 0)::INT) AS exposure, arg_max(shares, i) AS open_shares
      FROM curve GROUP BY ALL),
    met AS MATERIALIZED (SELECT *, coalesce(mean / nullif(sd, 0) * sqrt(252), 0) AS sharpe, coalesce(mean / nullif(down, 0) * sqrt(252), 0) AS sortino, coalesce(wins / nullif(trades, 0), 0) AS win_rate,
        CASE WHEN total_return <= -1 THEN -1 ELSE power(1 + total_return, CAST(365 AS DOUBLE) / days) - 1 END AS annual_return FROM sums),
    scored AS MATERIALIZED (SELECT *, {OBJECTIVE['robust']} AS robust, {OBJECTIVE['calmar']} AS calmar FROM met)"""


#: The published weights and bounds of the robust score, and the return by drawdown.
OBJECTIVE = {
    "robust": """0.35::DOUBLE * greatest(-1, least(1, total_return - hold_return)) + 0.25::DOUBLE * greatest(-1, least(1, annual_return)) - 0.25::DOUBLE * least(1, abs(max_drawdown))
        - 0.1::DOUBLE * least(1, turnover / 5) + 0.05::DOUBLE * least(trades, 10) / 10""",
    "calmar": "CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) ELSE 0 END",
}
HELD_CTE, SPLIT, ROLL = f"WITH {held_sql(SPLIT_SQL)}", f"WITH RECURSIVE {account_sql(SPLIT_SQL)}", f"WITH RECURSIVE {account_sql(WINDOW_SQL)}"
HELD_LIMITS, SPLIT_LIMITS = f"WITH {held_sql(SPLIT_SQL, LIMITS)}", f"WITH RECURSIVE {account_sql(SPLIT_SQL, LIMITS)}"
BEST = f"SELECT symbol, win, run_id FROM scored WHERE slice = 'train' AND trades >= {MIN_TRADES} QUALIFY row_number() OVER (PARTITION BY symbol, win ORDER BY robust DESC, run_id) = 1"
SIDE = lambda c, part, name: f"max({c}) FILTER (slice = '{part}') AS {part}_{name}"
ROLLED_SQL = f"""{ROLL}, best AS ({BEST}),
    won AS (SELECT symbol, win, any_value(fast) AS fast, any_value(slow) AS slow, {', '.join(SIDE(c, part, name) for part in ('train', 'validation', 'test') for c, name in (('robust', 'objective'), ('total_return', 'return'), ('trades', 'trades')))}
      FROM scored JOIN best USING (symbol, win, run_id) GROUP BY symbol, win),
    rolled AS MATERIALIZED (SELECT e.*, w.* EXCLUDE (symbol, win), CASE WHEN fast IS NULL THEN 'failed' WHEN validation_trades < {MIN_TRADES} OR test_trades < {MIN_TRADES} THEN 'degraded' ELSE 'ok' END AS status
      FROM (SELECT symbol, win, min(trade_date) AS first_day, max(trade_date) AS last_day FROM parts GROUP BY symbol, win) e LEFT JOIN won w USING (symbol, win)),
    summary AS (SELECT symbol, count(*) AS windows, count(*) FILTER (status <> 'failed') AS successful, count(*) FILTER (status = 'failed') AS failed,
      {', '.join(f"median({c}) FILTER (status <> 'failed') AS {c}_median" for c in ('validation_objective', 'test_objective', 'validation_return', 'test_return', 'validation_trades', 'test_trades'))} FROM rolled GROUP BY symbol),
    choices AS (SELECT symbol, fast, slow, count(*) AS times FROM rolled WHERE status <> 'failed' GROUP BY ALL),
    states AS (SELECT symbol, CASE WHEN arg_max(close, r) / arg_min(close, r) - 1 >= 0 THEN 'train_trend_positive' ELSE 'train_trend_negative' END AS state FROM means WHERE r <= 252 GROUP BY symbol)"""
STABLE_SQL = f"""{ROLLED_SQL},
    top AS (SELECT *, times / windows AS frequency FROM (SELECT *, sum(times) OVER (PARTITION BY symbol) AS windows FROM choices) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY times DESC, fast, slow) = 1),
    stable AS (SELECT s.symbol, fast, slow, times, CAST(top.windows AS BIGINT) AS windows, frequency, coalesce(top.windows >= 2 AND frequency >= 0.6, false) AS stable FROM (SELECT DISTINCT symbol FROM rolled) s LEFT JOIN top USING (symbol)),
    decided AS (SELECT *, CASE WHEN stable THEN fast END AS selected_fast, CASE WHEN stable THEN slow END AS selected_slow FROM stable)"""
MULTI_SQL = f"""{ROLLED_SQL},
    one AS (SELECT *, times / sum(times) OVER (PARTITION BY symbol) AS share FROM choices JOIN states USING (symbol)),
    votes AS (SELECT coalesce(state, 'all') AS state, fast, slow, sum(share) AS share, CAST(sum(times) AS BIGINT) AS times FROM one GROUP BY GROUPING SETS ((state, fast, slow), (fast, slow))),
    weights AS (SELECT *, share / round(sum(share) OVER (PARTITION BY state)) AS weight FROM votes),
    first AS (SELECT * FROM weights QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(weight, 9) DESC, fast, slow) = 1),
    tests AS (SELECT coalesce(state, 'all') AS state, count(*) FILTER (successful > 0) AS symbols, median(test_objective_median) AS test_objective_median FROM summary JOIN states USING (symbol) GROUP BY ROLLUP (state)),
    voted AS (SELECT t.*, fast, slow, weight, times, coalesce(symbols >= {MIN_SYMBOLS} AND round(weight, 9) >= 0.6, false) AS stable FROM tests t LEFT JOIN first USING (state))"""
LOGS = {"log_return": "total_return", "log_annual": "annual_return", "log_turnover": "turnover"}


def logs(f: DataFrame) -> DataFrame:
    """Logs of what grows without bound in the test data, whose prices jump."""
    return f.withColumns({k: F.log1p(c) for k, c in LOGS.items()})


LOG_SQL = ", ".join(f"ln(1 + {c}) AS {k}" for k, c in LOGS.items())

query("b11_slices", "bars", "symbol trade_date slice place", "", f"WITH means AS ({MEANS_SQL.format(**PLAIN)}) {SPLIT_SQL}")(st.slices)
query("b01_signal", "bars", "symbol run_id slice trade_date signal", "", f"{HELD_CTE} SELECT * FROM signals")(lambda b: st.cross_signal(st.slices(st.with_means(b, GRID(b))), GRID(b)))
query("b03_position", "limit_bars", "symbol run_id slice trade_date position action", "", f"{HELD_LIMITS} SELECT * FROM held")(HELD)
query("b04_lot_size", "bars", "symbol trade_date shares", "", """
    SELECT symbol, trade_date, CAST(greatest(floor(least(1e6 / CAST(1.00031 AS DOUBLE), (1e6 - 5) / CAST(1.00001 AS DOUBLE)) / (open * 100)), 0) * 100 AS BIGINT) AS shares FROM bars
    """)(lambda b: b.select("symbol", "trade_date", fn.lot_size(F.lit(1e6), F.col("open")).cast("bigint").alias("shares")))
query("b05_ledger", "limit_bars", "symbol run_id slice n entry exit", "log_shares log_cost log_proceeds ret", f"""
    {SPLIT_LIMITS}, ends AS (SELECT *, lag(trade_date) OVER k AS entry, lag(shares) OVER k AS held_shares FROM fold WHERE paid > 0 OR got > 0 WINDOW k AS (PARTITION BY kid ORDER BY i))
    SELECT *, trade_date AS exit, CAST(row_number() OVER (PARTITION BY kid ORDER BY i) AS INT) AS n, ln(held_shares) AS log_shares, ln(cost) AS log_cost, ln(got) AS log_proceeds, got / cost - 1 AS ret FROM ends WHERE got > 0
    """, digits=3)(lambda b: st.ledger(HELD(b), CASH).withColumns({f"log_{c}": F.log(c) for c in ("shares", "cost", "proceeds")}))
query("b06_equity", "limit_bars", "symbol run_id slice trade_date invested", "log_equity", f"{SPLIT_LIMITS} SELECT *, shares > 0 AS invested, ln(equity) AS log_equity FROM fold", digits=3)(
    lambda b: st.equity(HELD(b), CASH).select("*", (F.col("shares") > 0).alias("invested"), F.log("equity").alias("log_equity")))
query("b07_metrics", "limit_bars", "symbol run_id slice trades still_open", "log_return log_annual max_drawdown sharpe sortino hold_return win_rate log_turnover exposure", f"{SPLIT_LIMITS} SELECT *, {LOG_SQL}, open_shares > 0 AS still_open FROM met", digits=3)(
    lambda b: logs(MEASURED(b)).withColumn("still_open", F.col("open_shares") > 0))
query("b08_warnings", "bars", "symbol run_id slice warned", "", f"""
    {SPLIT} SELECT *, concat_ws(',', 'no_is_suspended', 'no_up_limit', 'no_down_limit', CASE WHEN trades = 0 THEN 'no_completed_trade' END) AS warned FROM met
    """)(lambda b: st.warnings(MEASURED(b), b.columns).withColumn("warned", F.array_join("warnings", ",")))
query("b09_objective", "bars", "symbol run_id slice", "sharpe log_return log_calmar robust", f"{SPLIT} SELECT *, ln(1 + total_return) AS log_return, sign(calmar) * ln(1 + abs(calmar)) AS log_calmar FROM scored", digits=3)(
    lambda b: MEASURED(b).withColumns({"robust": st.objective("robust"), "log_return": F.log1p("total_return"), "log_calmar": F.signum(st.objective("calmar")) * F.log1p(F.abs(st.objective("calmar")))}))
query("b10_grid", "lineitem", "run_id fast slow", "", """
    WITH f AS (SELECT DISTINCT CAST(l_linenumber AS INT) * 5 - 10 AS fast FROM lineitem), s AS (SELECT DISTINCT CAST(l_quantity AS INT) AS slow FROM lineitem)
    SELECT CAST(row_number() OVER (ORDER BY fast, slow) - 1 AS INT) AS run_id, fast, slow FROM f JOIN s ON 0 < fast AND fast < slow
    """)(lambda x: st.grid_from(x.selectExpr("explode(array(named_struct('name', 'fast', 'value', cast(l_linenumber as int) * 5 - 10), named_struct('name', 'slow', 'value', cast(l_quantity as int)))) r").select("r.*")))
query("w21_candidate_rank", "bars", "symbol run_id rank", "objective", f"{SPLIT} SELECT *, robust AS objective, row_number() OVER (PARTITION BY symbol ORDER BY robust DESC, run_id) AS rank FROM scored WHERE slice = 'train' AND trades >= {MIN_TRADES}", digits=3)(
    lambda b: st.ranked(MEASURED(b), "robust", MIN_TRADES))
query("b12_optimize", "bars", "symbol run_id slice fast slow trades", "sharpe objective", f"{SPLIT}, best AS ({BEST}) SELECT *, robust AS objective FROM scored JOIN best USING (symbol, win, run_id)", digits=3)(
    lambda b: st.optimized(b, GRID(b), "robust", MIN_TRADES, CASH))


@query("a14_sensitivity", "bars", "symbol name value candidates", "low mid high", f"""
    {SPLIT} SELECT symbol, name, value, count(*) AS candidates, min(robust) AS low, median(robust) AS mid, max(robust) AS high
    FROM (SELECT symbol, robust, unnest([struct_pack(name := 'fast', value := fast), struct_pack(name := 'slow', value := slow)], recursive := true) FROM scored WHERE slice = 'train' AND trades >= {MIN_TRADES}) GROUP BY ALL
    """, digits=3)
def sensitivity(bars: DataFrame) -> DataFrame:
    """Objective of the eligible candidates by each parameter's value."""
    f = st.ranked(MEASURED(bars), "robust", MIN_TRADES).join(F.broadcast(GRID(bars)), "run_id")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("value")) for p in ("fast", "slow")])).alias("p")
    return f.select("symbol", "objective", each).groupBy("symbol", "p.name", "p.value").agg(F.count("*").alias("candidates"), F.min("objective").alias("low"), F.median("objective").alias("mid"), F.max("objective").alias("high"))


@query("a15_optimizer_summary", "bars", "symbol candidates eligible near", "best runner_up margin mid", f"""
    {SPLIT}, c AS (SELECT *, trades >= {MIN_TRADES} AS ok FROM scored WHERE slice = 'train'),
    k AS (SELECT *, max(robust) FILTER (ok) OVER (PARTITION BY symbol) AS top, row_number() OVER (PARTITION BY symbol ORDER BY ok DESC, robust DESC, run_id) AS r FROM c)
    SELECT symbol, count(*) AS candidates, count(*) FILTER (ok) AS eligible, max(top) AS best, max(robust) FILTER (ok AND r = 2) AS runner_up, max(top) - max(robust) FILTER (ok AND r = 2) AS margin, median(robust) FILTER (ok) AS mid,
      count(*) FILTER (ok AND robust >= top - greatest(0.05 * abs(top), 0.01)) AS near FROM k GROUP BY symbol
    """, digits=3)
def optimizer_summary(bars: DataFrame) -> DataFrame:
    """Candidates and eligible ones, the best, the next, its margin, the median, and how many are near the best."""
    f = MEASURED(bars).filter("slice = 'train'").withColumns({"objective": st.objective("robust"), "ok": F.col("trades") >= MIN_TRADES})
    w = Window.partitionBy("symbol")
    f = f.withColumns({"top": F.max(F.when(F.col("ok"), F.col("objective"))).over(w), "r": F.row_number().over(w.orderBy(F.desc("ok"), F.desc("objective"), "run_id"))})
    near, second = F.col("objective") >= F.col("top") - F.greatest(F.abs("top") * 0.05, F.lit(0.01)), F.max(F.when(F.col("ok") & (F.col("r") == 2), F.col("objective")))
    return f.groupBy("symbol").agg(
        F.count("*").alias("candidates"), F.count_if("ok").alias("eligible"), F.max("top").alias("best"), second.alias("runner_up"), (F.max("top") - second).alias("margin"), F.median(F.when(F.col("ok"), F.col("objective"))).alias("mid"),
        F.count_if(F.col("ok") & near).alias("near"),
    )


query("b13_windows", "bars", "symbol win slice n", "", f"WITH means AS ({MEANS_SQL.format(**PLAIN)}), parts AS ({WINDOW_SQL}) SELECT symbol, win, slice, count(*) AS n FROM parts GROUP BY ALL")(lambda b: WINDOWS(b).groupBy("symbol", "win", "slice").agg(F.count("*").alias("n")))
query("b14_rolling", "bars", "symbol win first_day last_day status fast slow train_trades validation_trades test_trades", "train_objective validation_objective test_objective", f"{ROLLED_SQL} SELECT * FROM rolled", digits=3)(ROLLED)
query("b14_summary", "bars", "symbol windows successful failed", "validation_objective_median test_objective_median validation_trades_median test_trades_median", f"{ROLLED_SQL} SELECT * FROM summary", digits=3)(lambda b: st.rolling_summary(ROLLED(b)))
query("b15_stability", "bars", "symbol fast slow times windows stable selected_fast selected_slow", "frequency", f"{STABLE_SQL} SELECT * FROM decided")(lambda b: st.stability(ROLLED(b)))
query("b16_multi", "bars", "state symbols fast slow times stable", "weight test_objective_median", f"{MULTI_SQL} SELECT * FROM voted", digits=3)(lambda b: st.multi(ROLLED(b), st.market_state(b), least=MIN_SYMBOLS))
query("b17_market_state", "bars", "symbol state", "ret", f"""
    SELECT symbol, ret, CASE WHEN ret >= 0 THEN 'train_trend_positive' ELSE 'train_trend_negative' END AS state
    FROM (SELECT symbol, arg_max(close, i) / arg_min(close, i) - 1 AS ret FROM (SELECT *, row_number() OVER ({W}) AS i FROM bars) WHERE i <= 253 GROUP BY symbol)""")(st.market_state)
query("b18_promotion", "bars", "symbol decision", "", f"{STABLE_SQL} SELECT symbol, CASE WHEN stable THEN 'candidate_only_pending_multi_symbol_validation' ELSE 'do_not_promote_parameters' END AS decision FROM decided")(
    lambda b: st.promotion(st.stability(ROLLED(b)), "multi_symbol"))
