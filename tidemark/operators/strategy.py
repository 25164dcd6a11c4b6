"""Strategy evaluation: bars, parameters and slices are rows of one plan, keyed (symbol, run_id, slice)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .accounts import accounts, keys_of, summaries, tradable


def grid_from(requests: DataFrame, most: int = 1000) -> DataFrame:
    """Sorted distinct combinations of the requested values, from rows of (name, value) with the names fast and slow.

    Positive ones with fast below slow: run_id, fast, slow. More than ``most`` are an error. A grid has few values, however
    many rows ask for them, so the product is of two short lists.
    """
    values = requests.filter("value > 0").groupBy("name").agg(F.collect_set(F.col("value").cast("int")).alias("vs"))
    lists = values.agg(*[F.max(F.when(F.col("name") == n, F.col("vs"))).alias(n) for n in ("fast", "slow")])
    pairs = lists.select(F.explode("fast").alias("fast"), "slow").select("fast", F.explode("slow").alias("slow")).filter("fast < slow")
    n = F.count("*").over(Window.partitionBy())
    capped = F.when(n > most, F.raise_error(F.concat(n.cast("string"), F.lit(f" combinations, more than {most}"))).cast("int")).otherwise(F.row_number().over(Window.orderBy("fast", "slow")) - 1)
    return pairs.select(capped.alias("run_id"), "fast", "slow")


def grid(spark: SparkSession, fast: list[int], slow: list[int], most: int = 1000) -> DataFrame:
    """The grid of two lists of values."""
    pairs = sorted({(f, s) for f in fast for s in slow if 0 < f < s})
    if len(pairs) > most:
        raise ValueError(f"{len(pairs)} combinations, more than {most}")
    return spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(pairs)], "run_id int, fast int, slow int")


def slices(bars: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Chronological parts of each symbol's bars, and each bar's place in its part from 1; each part needs two rows."""
    w = Window.partitionBy("symbol")
    f = bars.withColumns({"_i": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": F.count("*").over(w)})
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + validation))
    f = f.withColumn("slice", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "validation").otherwise("test"))
    f = f.withColumn("place", (F.col("_i") + 1 - F.when(F.col("slice") == "train", 0).when(F.col("slice") == "validation", a).otherwise(b)).cast("int"))
    return f.filter((a >= 2) & (b - a >= 2) & (F.col("_n") - b >= 2)).drop("_i", "_n")


def windows(bars: DataFrame, train: int, validation: int, test: int, step: int) -> DataFrame:
    """Walk-forward windows: ``win``, ``slice`` and place in it of each bar in each window that fits."""
    w = Window.partitionBy("symbol")
    f = bars.withColumns({"_i": F.row_number().over(w.orderBy("trade_date")) - 1, "_n": F.count("*").over(w)})
    total = train + validation + test
    last = F.floor((F.col("_n") - total) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - total + 1) / F.lit(step)))
    f = f.filter(F.col("_n") >= total).withColumn("_to", F.least(last, F.floor(F.col("_i") / step))).withColumn("_from", first)
    f = f.filter("_from <= _to").withColumn("win", F.explode(F.sequence("_from", "_to"))).withColumn("win", F.col("win").cast("int"))
    at = F.col("_i") - F.col("win") * step
    f = f.withColumn("slice", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test"))
    start = F.when(at < train, 0).when(at < train + validation, train).otherwise(train + validation)
    return f.withColumn("place", (at + 1 - start).cast("int")).drop("_i", "_n", "_from", "_to")


def with_means(bars: DataFrame, params: DataFrame) -> DataFrame:
    """``_means``, the means of the close by length, of all lengths in the grid; taken once, before bars are dealt to slices."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    periods = sorted({p for r in params.select("fast", "slow").collect() for p in r})  # a grid is small
    return bars.withColumn("_means", F.create_map(*[x for p in periods for x in (F.lit(p), F.avg("close").over(w.rowsBetween(-(p - 1), 0)))]))


def cross_signal(sliced: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """1 where the fast mean is above the slow one, for each row of ``params`` or for the parameters that the bars have.

    Slices begin anew: a mean counts from the bar on at which the slice has all its rows.
    """
    f = sliced if params is None else sliced.crossJoin(F.broadcast(params))
    mean = lambda n: F.when(F.col("place") >= F.col(n), F.col("_means")[F.col(n)])
    return f.withColumn("signal", F.coalesce(mean("fast") > mean("slow"), F.lit(False)).cast("int")).drop("_means", "place")


Cut = Callable[[DataFrame], DataFrame]


def held(bars: DataFrame, params: DataFrame, cut: Cut = slices) -> DataFrame:
    """Signals and positions of every parameter row on every slice of ``cut`` (``slices``, or windows of some sizes)."""
    return positions(cross_signal(cut(with_means(bars, params)), params))


def positions(signals: DataFrame) -> DataFrame:
    """Yesterday's signal, taken at today's open where its side can be traded, else the position before.

    A bar that asks for a share and can be bought leads to a held position whatever it was before, one that asks for none and
    can be sold to a flat one, any other leaves it; so of the bars up to now, the last that leads somewhere decides.
    """
    by = keys_of(signals)
    w = Window.partitionBy(*by).orderBy("trade_date")
    f = signals.withColumn("target", F.lag("signal").over(w))
    leads = F.when((F.col("target") == 1) & tradable(f, "buy"), 1).when((F.col("target") == 0) & tradable(f, "sell"), 0)
    f = f.withColumn("position", F.coalesce(F.last(leads, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return f.withColumn("_p", F.coalesce(F.lag("position").over(w), F.lit(0))).withColumn("action", F.when(F.col("position") > F.col("_p"), "buy").when(F.col("position") < F.col("_p"), "sell")).drop("_p")


def ledger(signals: DataFrame, cash: float = 100_000.0, **costs: float) -> DataFrame:
    """Round trips of each key with shares, cost, proceeds and net return; ``costs`` as in ``accounts.COSTS``."""
    by = keys_of(signals)
    w = Window.partitionBy(*by).orderBy("trade_date")
    trades = accounts(signals, cash, **costs).filter("money != 0").withColumn("bought", F.lag("shares").over(w)).filter("cost is not null")
    out = trades.withColumn("n", F.row_number().over(w))
    return out.select(*by, "n", "entry", F.col("trade_date").alias("exit"), F.col("bought").alias("shares"), "cost", F.col("money").alias("proceeds")).withColumn("ret", F.try_divide(F.col("proceeds"), F.col("cost")) - 1)


def equity(signals: DataFrame, cash: float = 100_000.0, **costs: float) -> DataFrame:
    """Per bar of each key: cash, shares, and equity at the close."""
    return accounts(signals, cash, **costs).select(*keys_of(signals), "trade_date", "close", "cash", "shares", "equity")


def metrics(signals: DataFrame, cash: float = 100_000.0, **costs: float) -> DataFrame:
    """Per key, of the account's equity: total, annual (365 days) and buy-and-hold return, largest drawdown, Sharpe and Sortino
    (252 bars, 0 where undefined), completed trades, share of wins, turnover by initial cash, exposure, and shares still held.
    """
    year = lambda sd: F.coalesce(F.try_divide(F.col("mean"), F.when(F.col(sd) > 0, F.col(sd))) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    m = summaries(signals, cash, **costs).withColumn("total_return", F.col("equity") / cash - 1)
    annual = F.when(F.col("total_return") <= -1, -1.0).otherwise(F.pow(1 + F.col("total_return"), F.lit(365.0) / F.greatest("days", F.lit(1))) - 1)
    return m.select(
        *keys_of(signals), "total_return", "max_drawdown", year("spread").alias("sharpe"), year("losses").alias("sortino"), (F.try_divide("last_close", "first_close") - 1).alias("hold_return"), "trades",
        F.coalesce(F.try_divide("wins", "trades"), F.lit(0.0)).alias("win_rate"), (F.col("turned") / cash).alias("turnover"), "exposure", "open_shares", annual.alias("annual_return"),
    )


def warnings(measured: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``warnings``: flag columns that the bars lack and are taken as tradable, and results without a completed trade."""
    gone = [F.lit(f"no_{c}") for c in ("is_suspended", "up_limit", "down_limit") if c not in columns]
    return measured.withColumn("warnings", F.array_compact(F.array(*gone, F.when(F.col("trades") == 0, "no_completed_trade"))))


def objective(kind: str) -> Column:
    """sharpe, total_return, calmar (0 without a drawdown), or robust: a weighted sum of bounded parts."""
    clip = lambda c, lo, hi: F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
    fall = F.abs("max_drawdown")
    robust = (
        0.35 * clip(F.col("total_return") - F.col("hold_return"), -1.0, 1.0) + 0.25 * clip(F.col("annual_return"), -1.0, 1.0) - 0.25 * clip(fall, 0.0, 1.0)
        - 0.10 * clip(F.col("turnover") / 5, 0.0, 1.0) + 0.05 * F.least(F.col("trades"), F.lit(10)) / 10
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.col("annual_return") / fall).otherwise(0.0)
    return {"sharpe": F.col("sharpe"), "total_return": F.col("total_return"), "calmar": calmar, "robust": robust}[kind]


def ranked(measured: DataFrame, kind: str = "sharpe", min_trades: int = 0) -> DataFrame:
    """Train results of eligible candidates in order: objective, then parameters."""
    by = [c for c in ("symbol", "win") if c in measured.columns]
    f = measured.filter((F.col("slice") == "train") & (F.col("trades") >= min_trades)).withColumn("objective", objective(kind))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("objective"), "run_id")))


def measured(bars: DataFrame, params: DataFrame, cash: float = 100_000.0, cut: Cut = slices) -> DataFrame:
    """Metrics of every parameter row on every slice."""
    return metrics(cross_signal(cut(with_means(bars, params)), params), cash)


def optimized(bars: DataFrame, params: DataFrame, kind: str = "sharpe", min_trades: int = 0, cash: float = 100_000.0, cut: Cut = slices) -> DataFrame:
    """The winner on train with its results and objective on every slice. All candidates run on train, winners alone on the rest."""
    parts = cut(stored(with_means(bars, params), "means"))
    train = metrics(cross_signal(parts.filter("slice = 'train'"), params), cash)
    won = stored(ranked(train, kind, min_trades).filter("rank = 1").drop("rank").join(F.broadcast(params), "run_id"), "winners")
    by = [c for c in ("symbol", "win") if c in won.columns]
    later = parts.filter("slice != 'train'").join(won.select(*by, "run_id", "fast", "slow"), by)
    rest = metrics(cross_signal(later), cash).withColumn("objective", objective(kind))
    return won.unionByName(rest.join(F.broadcast(params), "run_id"))


def rolling(bars: DataFrame, params: DataFrame, cut: Cut, kind: str = "sharpe", min_trades: int = 1, cash: float = 100_000.0) -> DataFrame:
    """One row for each symbol and window: status, the choice, and objective, return and trades of each slice.

    A window without an eligible candidate is failed; one whose validation or test has too few trades is degraded.
    """
    won = optimized(bars, params, kind, min_trades, cash, cut)
    of = lambda c, part, name: F.max(F.when(F.col("slice") == part, F.col(c))).alias(f"{part}_{name}")
    each = [of(c, part, name) for part in ("train", "validation", "test") for c, name in (("objective", "objective"), ("total_return", "return"), ("trades", "trades"))]
    won = won.groupBy("symbol", "win").agg(F.first("fast").alias("fast"), F.first("slow").alias("slow"), *each)
    every = cut(bars).groupBy("symbol", "win").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))
    few = (F.col("validation_trades") < min_trades) | (F.col("test_trades") < min_trades)
    return stored(every.join(won, ["symbol", "win"], "left").withColumn("status", F.when(F.col("fast").isNull(), "failed").when(few, "degraded").otherwise("ok")), "windows")  # summaries, votes and choices all read it


def rolling_summary(windows_: DataFrame) -> DataFrame:
    """Per symbol: windows, successful and failed ones, and medians over the successful."""
    done = F.col("status") != "failed"
    middle = [F.median(F.when(done, F.col(c))).alias(f"{c}_median") for c in ("validation_objective", "test_objective", "validation_return", "test_return", "validation_trades", "test_trades")]
    return windows_.groupBy("symbol").agg(F.count("*").alias("windows"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"), *middle)


def stability(windows_: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """Per symbol: the most frequent choice over its successful windows (ties to the smaller parameters), its frequency, whether
    it is stable, and the selected parameters, null where it isn't."""
    f = windows_.filter("status != 'failed'").groupBy("symbol", "fast", "slow").agg(F.count("*").alias("times"))
    f = f.withColumn("windows", F.sum("times").over(Window.partitionBy("symbol")))
    f = f.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("times"), "fast", "slow"))).filter("_r = 1").drop("_r")
    f = windows_.select("symbol").distinct().join(f.withColumn("frequency", F.col("times") / F.col("windows")), "symbol", "left")
    f = f.withColumn("stable", F.coalesce((F.col("windows") >= least) & (F.col("frequency") >= share), F.lit(False)))
    return f.withColumns({f"selected_{c}": F.when(F.col("stable"), F.col(c)) for c in ("fast", "slow")})


def multi(windows_: DataFrame, states: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """The choice over symbols of equal weight, by market state and over all (state ``all``).

    Each successful symbol shares one vote among its windows' choices. With the symbols that take part, whether the choice is
    stable, and the median of the symbols' median test objectives.
    """
    done = windows_.filter("status != 'failed'")
    f = done.groupBy("symbol", "fast", "slow").agg(F.count("*").alias("times")).withColumn("one", F.col("times") / F.sum("times").over(Window.partitionBy("symbol")))
    f = f.join(states.select("symbol", "state"), "symbol", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    votes = f.groupingSets([["state", "fast", "slow"], ["fast", "slow"]], "state", "fast", "slow").agg(F.sum("one").alias("weight"), F.sum("times").alias("times"))
    votes = votes.withColumn("state", F.coalesce("state", F.lit("all"))).withColumn("weight", F.col("weight") / F.round(F.sum("weight").over(Window.partitionBy("state"))))
    # Shares of windows are sums of fractions: equal ones may differ in the last digits, which must not decide.
    first = Window.partitionBy("state").orderBy(F.desc(F.round("weight", 9)), "fast", "slow")
    votes = votes.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    tests = rolling_summary(windows_).join(states.select("symbol", "state"), "symbol", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    tests = tests.rollup("state").agg(F.count_if(F.col("successful") > 0).alias("symbols"), F.median("test_objective_median").alias("test_objective_median")).withColumn("state", F.coalesce("state", F.lit("all")))
    f = tests.join(votes, "state", "left")
    return f.withColumn("stable", F.coalesce((F.col("symbols") >= least) & (F.round("weight", 9) >= share), F.lit(False)))


def market_state(bars: DataFrame, n: int = 252) -> DataFrame:
    """The sign of the return over the first ``n`` bars after the first, for grouping only."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    f = bars.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n + 1).groupBy("symbol").agg((F.max_by("close", "_i") / F.min_by("close", "_i") - 1).alias("ret"))
    return f.withColumn("state", F.when(F.col("ret") >= 0, "train_trend_positive").otherwise("train_trend_negative"))


def promotion(stable: DataFrame, pending: str) -> DataFrame:
    """Unstable parameters aren't promoted; stable ones are candidates that wait for ``pending`` validation."""
    return stable.withColumn("decision", F.when(F.col("stable"), f"candidate_only_pending_{pending}_validation").otherwise("do_not_promote_parameters"))
