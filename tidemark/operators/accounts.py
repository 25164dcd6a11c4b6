"""The traded account: one scan over the bars of each key in order, with cash, shares and equity carried from bar to bar.

How many lots a buy takes depends on the cash that earlier trades left, so an account is followed in order. Keys (symbol,
parameters, window, slice) are dealt over all tasks and sorted by day; a task reads them as Arrow batches and goes from
trade to trade, never holding more than a batch. What lies between two trades is filled in as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn

#: Shares of a lot, rates of the fees and their minimum, and slippage.
COSTS = {"lot": 100, "commission": 0.0003, "minimum": 5.0, "transfer": 0.00001, "stamp": 0.0005, "slippage": 0.0005}
KEYS = ("symbol", "run_id", "win", "slice")
STATE = ["cash", "shares", "equity", "money", "turned", "ret", "drawdown", "cost"]


def keys_of(frame: DataFrame) -> list[str]:
    """The columns that tell accounts apart, of those that there are."""
    return [c for c in KEYS if c in frame.columns]


def tradable(frame: DataFrame, side: str) -> F.Column:
    """Whether a bar's open can be bought or sold: not suspended, and not at the limit of that side. A column that isn't there doesn't stop a trade."""
    has = lambda c: F.col(c).cast("double") if c in frame.columns else F.lit(None).cast("double")
    suspended = fn.is_suspended(F.col("is_suspended")) if "is_suspended" in frame.columns else F.lit(False)
    open_ = F.col("open").cast("double")
    return F.coalesce((open_ > 0) & fn.executable(side, open_, suspended, has("up_limit"), has("down_limit")), F.lit(False))


class Account:
    """State of one key's account, and its steps over arrays of bars."""

    def __init__(self, cash: float, costs: dict, follows: bool = True):
        self.start, self.k, self.follows = cash, costs, follows
        self.reset()

    def reset(self) -> None:
        self.cash, self.shares, self.paid, self.entry = self.start, 0.0, np.nan, None
        self.signal, self.equity, self.peak = None, np.nan, -np.inf

    def lots(self, price: np.ndarray | float) -> np.ndarray | float:
        """The most shares, in lots, that cash pays with fees."""
        k = self.k
        most = min(self.cash / (1 + k["transfer"] + k["commission"]), (self.cash - k["minimum"]) / (1 + k["transfer"]))
        return np.maximum(np.floor(most / (price * k["lot"])), 0.0) * k["lot"]

    def fees(self, value: float, tax: float) -> float:
        return max(self.k["minimum"], value * self.k["commission"]) + value * (self.k["transfer"] + tax)

    def bars(self, day: np.ndarray, open_: np.ndarray, close: np.ndarray, signal: np.ndarray, buy: np.ndarray, sell: np.ndarray) -> dict[str, np.ndarray]:
        """Go on over the next bars: yesterday's signal is traded at today's open where that side can be traded.

        A buy that cash can't pay is tried again at each later bar that still asks for it; cash stays the same meanwhile, so the
        first affordable one is found at once.
        """
        n = len(day)
        target = np.concatenate([[-1 if self.signal is None else self.signal], signal[:-1]]) if self.follows else signal
        buys, sells = np.flatnonzero((target == 1) & buy), np.flatnonzero((target == 0) & sell)
        out = {c: np.zeros(n) for c in ("money", "turned")} | {"cost": np.full(n, np.nan), "cash": np.empty(n), "shares": np.empty(n)}
        entry, at = np.full(n, np.datetime64("NaT"), "datetime64[D]"), 0
        while at < n:
            todo = sells if self.shares else buys
            todo = todo[np.searchsorted(todo, at) :]
            if not self.shares and len(todo):
                todo = todo[self.lots(open_[todo] * (1 + self.k["slippage"])) > 0]
            i = int(todo[0]) if len(todo) else n
            out["cash"][at:i], out["shares"][at:i] = self.cash, self.shares
            if i == n:
                break
            if self.shares:
                value = self.shares * open_[i] * (1 - self.k["slippage"])
                money, out["cost"][i], entry[i] = value - self.fees(value, self.k["stamp"]), self.paid, self.entry
                self.shares = 0.0
            else:
                price = open_[i] * (1 + self.k["slippage"])
                self.shares = float(self.lots(price))
                value = self.shares * price
                money = -value - self.fees(value, 0.0)
                self.paid, self.entry = -money, day[i]
            self.cash += money
            out["money"][i], out["turned"][i], out["cash"][i], out["shares"][i] = money, value, self.cash, self.shares
            at = i + 1
        equity = out["cash"] + out["shares"] * close
        before, peak = np.concatenate([[self.equity], equity[:-1]]), np.maximum(np.maximum.accumulate(equity), self.peak)
        with np.errstate(divide="ignore", invalid="ignore"):
            out |= {"equity": equity, "ret": np.where(before == 0, np.nan, equity / before - 1), "drawdown": np.where(peak == 0, np.nan, equity / peak - 1), "entry": entry}
        self.signal, self.equity, self.peak = int(signal[-1]), equity[-1], peak[-1]
        return out


class Summary:
    """What a key's account comes to, gathered from stretches of its bars; means and spreads are merged exactly as sums of squares about them."""

    def __init__(self) -> None:
        self.n, self.held, self.trades, self.wins, self.turned, self.fall = 0, 0, 0, 0, 0.0, np.nan
        self.returns, self.losses = (0, 0.0, 0.0), (0, 0.0, 0.0)

    @staticmethod
    def _with(before: tuple[int, float, float], x: np.ndarray) -> tuple[int, float, float]:
        """Count, mean and sum of squares about it, with further values."""
        n, mean, squares = before
        if not len(x):
            return before
        m, own = len(x), float(x.mean())
        total, step = n + m, own - mean
        return total, mean + step * m / total, squares + float(((x - own) ** 2).sum()) + step * step * n * m / total

    def add(self, day: np.ndarray, close: np.ndarray, got: dict[str, np.ndarray]) -> None:
        if not self.n:
            self.first_day, self.first_close = day[0], close[0]
        self.last_day, self.last_close, self.equity, self.shares = day[-1], close[-1], got["equity"][-1], got["shares"][-1]
        self.n, self.held, self.turned = self.n + len(day), self.held + int((got["shares"] > 0).sum()), self.turned + float(got["turned"].sum())
        sold = ~np.isnan(got["cost"])
        self.trades, self.wins = self.trades + int(sold.sum()), self.wins + int((got["money"][sold] > got["cost"][sold]).sum())
        self.fall = float(np.fmin(self.fall, np.fmin.reduce(got["drawdown"])))
        ret = got["ret"][~np.isnan(got["ret"])]
        self.returns, self.losses = self._with(self.returns, ret), self._with(self.losses, ret[ret < 0])

    def row(self) -> dict:
        spread = lambda s: (s[2] / s[0]) ** 0.5 if s[0] else None
        return {
            "days": int((self.last_day - self.first_day).astype(int)), "first_close": self.first_close, "last_close": self.last_close, "equity": self.equity, "open_shares": self.shares, "turned": self.turned, "exposure": self.held / self.n,
            "trades": self.trades, "wins": self.wins, "max_drawdown": self.fall, "mean": self.returns[1] if self.returns[0] else None, "spread": spread(self.returns), "losses": spread(self.losses),
        }


SUMMARY = "days bigint, first_close double, last_close double, equity double, open_shares double, turned double, exposure double, trades bigint, wins bigint, max_drawdown double, mean double, spread double, losses double"


def _parts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where keys begin in a batch."""
    new = np.zeros(len(batch), bool)
    new[0] = True
    for column in batch.columns[:n_keys]:
        new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def accounts(signals: DataFrame, cash: float = 100_000.0, **costs: float) -> DataFrame:
    """Per bar of each key's account: cash, shares, equity at the close, its return and its distance from the highest so far;
    money (paid or got at the open), turned (price times shares without fees), and at sales cost and entry day of what was sold.

    In: symbol, trade_date, open, close, signal (1: hold; or action, a buy or sell at the bar's own open), and run_id, win, slice where accounts differ by them; is_suspended,
    up_limit and down_limit where known. A null signal is 0; at a null open nothing is traded. ``costs`` as in ``COSTS``.
    """
    by, scan, kinds = keys_of(signals), *_scanned(signals, cash, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in scan(batches):
            column = {c: np.concatenate([p[-1][c] for p in parts]) for c in [*STATE, "entry"]}
            numbers = [pa.array(column[c], pa.float64(), from_pandas=True) for c in STATE]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], batch.column(len(by) + 2), *numbers, pa.array(column["entry"], pa.date32())], [*by, "trade_date", "close", *STATE, "entry"])

    schema = ", ".join([*kinds, "trade_date date, close double", *[f"{c} double" for c in STATE], "entry date"])
    return _in_order(signals).mapInArrow(run, schema)


def summaries(signals: DataFrame, cash: float = 100_000.0, **costs: float) -> DataFrame:
    """One row for each key's account, from the same scan: the keys and ``SUMMARY``. Only these rows leave the tasks."""
    by, scan, kinds = keys_of(signals), *_scanned(signals, cash, costs)
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        key, own = None, None
        for batch, parts in scan(batches):
            for k, day, close, got in parts:
                if k != key:
                    if own:
                        done.append(dict(zip(by, key, strict=True)) | own.row())
                    key, own = k, Summary()
                own.add(day, close, got)
            if len(done) > 10_000:
                yield _table(done)
                done = []
        if own:
            done.append(dict(zip(by, key, strict=True)) | own.row())
        yield _table(done)

    def _table(rows: list[dict]) -> pa.RecordBatch:
        long = {"days", "trades", "wins"}
        text = {c.split()[0]: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[c.split()[1]] for c in kinds}
        columns = [pa.array([r[c] for r in rows], text.get(c) or (pa.int64() if c in long else pa.float64()), from_pandas=True) for c in [*by, *names]]
        return pa.RecordBatch.from_arrays(columns, [*by, *names])

    return _in_order(signals).mapInArrow(run, ", ".join([*kinds, SUMMARY]))


def _in_order(signals: DataFrame) -> DataFrame:
    """The keys, day, open, close, wish and whether each side can be traded, by key in order of days."""
    by = keys_of(signals)
    wish = F.coalesce(F.col("signal").cast("int"), F.lit(0)) if "signal" in signals.columns else F.when(F.col("action") == "buy", 1).when(F.col("action") == "sell", 0).otherwise(-1)
    prices = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("open", "close")]
    bars = signals.select(*by, "trade_date", *prices, wish.alias("signal"), tradable(signals, "buy").alias("_buy"), tradable(signals, "sell").alias("_sell"))
    return bars.repartition(*by).sortWithinPartitions(*by, "trade_date")


def _scanned(signals: DataFrame, cash: float, costs: dict):
    """The scan over batches of ``_in_order``: each with its stretches (key, days, closes, what the account did); and the keys with their types."""
    by, k, follows = keys_of(signals), COSTS | costs, "signal" in signals.columns
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema if f.name in by}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        account, last = Account(cash, k, follows), None
        for batch in batches:
            if not len(batch):
                continue
            day, open_, close, signal, buy, sell = (batch.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(6))
            day, starts, parts = day.astype("datetime64[D]"), _parts(batch, len(by)), []
            for a, b in zip(starts, np.append(starts[1:], len(batch)), strict=True):
                key = tuple(batch.column(i)[int(a)].as_py() for i in range(len(by)))
                if key != last:
                    account.reset()
                    last = key
                parts.append((key, day[a:b], close[a:b], account.bars(day[a:b], open_[a:b], close[a:b], signal[a:b], buy[a:b], sell[a:b])))
            yield batch, parts

    return scan, [f"{c} {kinds[c]}" for c in by]
