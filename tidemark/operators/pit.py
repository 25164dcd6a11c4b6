"""Bars and statements as known at a date: adjustment, revisions, calendar, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def announced(df: DataFrame) -> Column:
    """Effective announcement date: the final one where there is one."""
    return F.coalesce(*[F.col(c) for c in ("f_ann_date", "ann_date") if c in df.columns])


def as_of(df: DataFrame, date: str) -> DataFrame:
    """Rows whose period and announcement are not after ``date``; unknown dates stay."""
    day = F.lit(date).cast("date")
    return df.filter((F.col("end_date").isNull() | (F.col("end_date") <= day)) & (announced(df).isNull() | (announced(df) <= day)))


def future_rows(df: DataFrame, date: str) -> DataFrame:
    day = F.lit(date).cast("date")
    return df.groupBy("symbol").agg(F.count_if((F.col("end_date") > day) | (announced(df) > day)).alias("future_rows"))


def latest_revision(df: DataFrame, with_report_type: bool = True) -> DataFrame:
    """The last revision of each period: by announcement, update flag, report type (1, then 3 and 4), load order."""
    rank = F.when(F.col("report_type") == "1", 3).when(F.col("report_type").isin("3", "4"), 2).otherwise(1)
    order = [announced(df).desc_nulls_last(), F.desc(F.coalesce(F.col("update_flag") == "1", F.lit(False)))] + ([rank.desc()] if with_report_type else []) + [F.desc("load_seq")]
    return keep_first(df, ["symbol", "end_date"], order)


def pit_view(df: DataFrame, date: str) -> DataFrame:
    """First the filter, then the choice of revision."""
    return latest_revision(as_of(df, date))


def normalize_factors(factors: DataFrame) -> DataFrame:
    """Numeric factors of known days, of a day the row loaded last (by ``load_seq``). A factor that isn't positive is an error."""
    f = factors.withColumn("adj_factor", F.col("adj_factor").try_cast("double")).filter("adj_factor is not null and trade_date is not null")
    wrong = F.concat(F.lit("adjustment factors must be positive: "), F.col("symbol"), F.lit(" "), F.col("trade_date").cast("string"))
    f = f.withColumn("adj_factor", F.when(F.col("adj_factor") > 0, F.col("adj_factor")).otherwise(F.raise_error(wrong).cast("double")))
    return keep_first(f, ["symbol", "trade_date"], [F.desc("load_seq")]).drop("load_seq")


def adjust(bars: DataFrame, factors: DataFrame, mode: str = "qfq") -> DataFrame:
    """Adjusted prices and ``missing_factor``: a bar without a factor has null prices, never raw ones. Volume stays."""
    f = normalize_factors(factors)
    base = f.groupBy("symbol").agg(F.max_by("adj_factor", "trade_date").alias("base"))
    out = bars.join(f, ["symbol", "trade_date"], "left").join(base, "symbol", "left")
    scale = F.col("adj_factor") / F.col("base") if mode == "qfq" else F.col("adj_factor")
    return out.withColumns({c: F.col(c) * scale for c in ("open", "high", "low", "close")}).withColumn("missing_factor", F.col("adj_factor").isNull()).drop("base")


def money_flow(raw: DataFrame, date: str, order: str = "version") -> DataFrame:
    """Last row of each day up to ``date``, with a numeric amount."""
    f = raw.filter(F.col("trade_date") <= F.lit(date).cast("date")).withColumn("net_mf_amount", F.col("net_mf_amount").try_cast("double"))
    return keep_first(f, ["symbol", "trade_date"], [F.desc(order)])


def bars_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    return bars.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("symbol", "trade_date")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows; the new one wins for each key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.desc("_new")]).drop("_new")


def unlike(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that ``old`` doesn't have in the same columns, nulls being alike. The keys deal the join; rows of the same keys are compared whole."""
    n, o = new.alias("n"), old.select(*new.columns).alias("o")
    condition = F.lit(True)
    for c in [*keys, *[c for c in new.columns if c not in keys]]:
        condition = condition & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return n.join(o, condition, "left_anti")


def markers(df: DataFrame, dataset: str, day: str = "trade_date") -> DataFrame:
    """How far each symbol is covered: first and last day."""
    return df.groupBy("symbol").agg(F.lit(dataset).alias("dataset"), F.min(day).alias("earliest_date"), F.max(day).alias("latest_date"))


def merged_markers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new marks together: a range only grows, and a symbol was updated when the newest of them was."""
    each = {"earliest_date": F.min, "latest_date": F.max, "updated_at": F.max}
    return old.unionByName(new).groupBy("symbol", "dataset").agg(*[f(c).alias(c) for c, f in each.items()])


def fresh(marks: DataFrame, start: str, end: str, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """``is_fresh``: the last day isn't before ``end``; ``covers``: all of ``start`` to ``end``; ``expired``: written longer than
    ``ttl_seconds`` before ``now``, or at no known time; ``usable``: covered and not expired."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    known = lambda c: F.coalesce(c, F.lit(False))
    out = marks.withColumns({"is_fresh": known(F.col("latest_date") >= e), "covers": known((F.col("earliest_date") <= s) & (F.col("latest_date") >= e))})
    if ttl_seconds is not None:
        age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
        out = out.withColumn("expired", ~known(age <= ttl_seconds)).withColumn("usable", F.col("covers") & ~F.col("expired"))
    return out


def latest_package(packages: DataFrame) -> DataFrame:
    """Of each ticker the newest readable package (ticker, modified, body): JSON with a schema version and a run id whose stock has that code."""
    body = F.try_parse_json("body")
    at, kind = lambda path: F.try_variant_get(body, path, "string"), lambda path: F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    empty = lambda path: (at(path) == "") | ((kind(path) != "STRING") & at(path).isin("0", "0.0", "false", "[]", "{}"))
    good = F.coalesce(~empty("$.schema_version") & ~empty("$.run_id") & (kind("$.stock.code") == "STRING") & (at("$.stock.code") == F.col("ticker")), F.lit(False))
    return keep_first(packages.filter(good), ["ticker"], [F.desc("modified"), F.desc("body")])


def prefer_source(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Of each symbol the rows of the first source that has any, with its name and quality (ok, partial, stale by place)."""
    every = None
    for i, (name, df) in enumerate(sources):
        part = df.withColumns({"_p": F.lit(i), "chosen": F.lit(name)})
        every = part if every is None else every.unionByName(part)
    out = every.withColumn("_r", F.rank().over(Window.partitionBy("symbol").orderBy("_p"))).filter("_r = 1")
    quality = F.when(F.col("_p") == 0, "ok").when(F.col("_p") == len(sources) - 1, "stale").otherwise("partial")
    return out.withColumn("quality", quality).drop("_p", "_r")


def source_quality(symbols: DataFrame, datasets: dict[str, list[tuple[str, DataFrame]]], critical: tuple[str, ...] = ("security", "bars", "factors")) -> DataFrame:
    """For each symbol and dataset the source that is chosen and its quality.

    Critical datasets fall back: the first source is ok, a later one partial, the last of several stale, none invalid. Other
    datasets come from the first source only: without it they are unavailable and partial.
    """
    known, out = symbols.select("symbol").distinct(), None
    for name, sources in datasets.items():
        used = sources if name in critical else sources[:1]
        f = known
        for i, (_, df) in enumerate(used):
            f = f.join(df.select("symbol").distinct().withColumn(f"_{i}", F.lit(True)), "symbol", "left")
        last = len(used) - 1
        pick = [F.when(F.col(f"_{i}"), F.struct(F.lit(source).alias("chosen"), F.lit("ok" if i == 0 else "stale" if i == last else "partial").alias("quality"))) for i, (source, _) in enumerate(used)]
        none = F.struct(F.lit("unavailable").alias("chosen"), F.lit("invalid" if name in critical else "partial").alias("quality"))
        part = f.select("symbol", F.lit(name).alias("dataset"), F.coalesce(*pick, none).alias("x")).select("symbol", "dataset", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def provider_label(df: DataFrame) -> DataFrame:
    names = F.collect_set(F.when(F.col("provider") != "cache", F.col("provider")))
    return df.groupBy("symbol").agg(F.when(F.size(names) == 0, "cache").when(F.size(names) == 1, F.array_join(names, "")).otherwise("mixed").alias("provider"))


def data_gaps(quality: DataFrame) -> DataFrame:
    return quality.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("quality").isin("partial", "stale", "invalid"), F.col("dataset")))), ",").alias("gaps"))


def conform(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Canonical columns from a provider's; None for what it doesn't have."""
    return df.select(*[(F.col(src) if src else F.lit(None).cast("double")).alias(dst) for dst, src in mapping.items()])


def year_ago(df: DataFrame, column: str) -> DataFrame:
    """``prior``, the value one year before, and growth over its absolute value; a prior 0 gives none."""
    before = df.select("symbol", F.col("end_date").alias("_d"), F.col(column).alias("prior"))
    out = df.withColumn("_d", F.add_months("end_date", -12)).join(before, ["symbol", "_d"], "left").drop("_d")
    return out.withColumn("growth", F.when(F.col("prior") != 0, (F.col(column) - F.col("prior")) / F.abs("prior") * 100))


def opening(df: DataFrame, columns: list[str]) -> DataFrame:
    """Balances at the end of the year before, as open_*."""
    ends = df.select("symbol", F.col("end_date").alias("_d"), *[F.col(c).alias(f"open_{c}") for c in columns])
    return df.withColumn("_d", F.make_date(F.year("end_date") - 1, F.lit(12), F.lit(31))).join(ends, ["symbol", "_d"], "left").drop("_d")


def trading_days(cal: DataFrame) -> DataFrame:
    return cal.filter("is_open = 1").select("exchange", "cal_date")


def neighbours(cal: DataFrame, n: int = 1) -> DataFrame:
    """For each calendar day whether it is open and its n-th next and previous open days, at most 30 + 7n days away."""
    order = Window.partitionBy("exchange").orderBy("cal_date")
    days = cal.withColumn("_k", F.sum("is_open").over(order))
    opens = days.filter("is_open = 1").select("exchange", F.col("_k").alias("_o"), F.col("cal_date").alias("d"))
    near = lambda d: F.when(F.abs(F.datediff(d, "cal_date")) <= 30 + 7 * n, F.col(d))
    out = days.withColumns({"_next": F.col("_k") + n, "_prev": F.col("_k") - n + (1 - F.col("is_open"))})
    for name in ("next", "prev"):
        out = out.join(opens.select("exchange", F.col("_o").alias(f"_{name}"), F.col("d").alias(name)), ["exchange", f"_{name}"], "left")
    return out.select("exchange", "cal_date", "is_open", near("next").alias("next_open"), near("prev").alias("prev_open"))


def event_bars(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Strict as-of: of each event the number of the last bar before its day and of the first bar from it on."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    numbered = bars.select("symbol", "trade_date", F.row_number().over(w).alias("i"))
    both = events.select("symbol", F.col("published").alias("d"), "item_id", F.lit(None).cast("int").alias("i"), F.lit(0).alias("kind")).unionByName(
        numbered.select("symbol", F.col("trade_date").alias("d"), F.lit(None).cast("bigint").alias("item_id"), "i", F.lit(1).alias("kind"))
    )
    order = Window.partitionBy("symbol").orderBy("d", "kind", "item_id").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("before", F.last("i", ignorenulls=True).over(order)).filter("kind = 0")
    last = numbered.groupBy("symbol").agg(F.max("i").alias("n"))
    out = out.join(last, "symbol", "left")
    return out.select("symbol", "item_id", F.col("d").alias("published"), "before", F.when(F.coalesce("before", F.lit(0)) < F.col("n"), F.coalesce("before", F.lit(0)) + 1).alias("from_bar"))


def event_returns(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Returns in percent over bars after an event, from the close before it; null past the last bar."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    closes = bars.select("symbol", F.row_number().over(w).alias("_i"), "close")
    out = event_bars(events, bars).filter("before is not null").join(closes.select("symbol", F.col("_i").alias("before"), F.col("close").alias("base")), ["symbol", "before"])
    out = out.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_i", F.col("before") + F.col("horizon"))
    return out.join(closes, ["symbol", "_i"], "left").select("symbol", "item_id", "horizon", ((F.col("close") / F.col("base") - 1) * 100).alias("ret"))
