"""Events, evidence rows, adjudication, scenarios by reference to levels, and differences of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import W, latest, rows

# Official event types in the order in which their keywords are tried, and whether all keywords are needed.
EVENT_RULES = [
    ("退市风险", ["退市风险", "终止上市风险"], False),
    ("行政处罚", ["行政处罚", "纪律处分", "公开谴责"], False),
    ("监管问询", ["监管问询", "问询函", "关注函"], False),
    ("重大诉讼", ["重大诉讼", "重大仲裁"], False),
    ("股东减持", ["股东减持", "减持计划", "减持股份"], False),
    ("停产", ["停产", "临时停产", "生产线停产"], False),
    ("风险提示", ["风险提示", "风险公告", "特别风险"], False),
    ("业绩预亏", ["业绩预亏", "预计亏损", "预告亏损"], False),
    ("业绩预减", ["业绩预减", "预计下降", "预告下降"], False),
    ("业绩快报下降", ["业绩快报", "下降"], True),
    ("业绩预增", ["业绩预增", "预计增长", "预告增长"], False),
    ("业绩快报增长", ["业绩快报", "增长"], True),
    ("重大合同", ["重大合同", "战略合作协议"], False),
    ("重大订单", ["重大订单", "订单金额"], False),
    ("中标", ["中标", "项目中标"], False),
    ("股份回购", ["股份回购", "回购公司股份", "回购进展"], False),
    ("股东增持", ["股东增持", "增持计划", "增持股份"], False),
    ("分红", ["利润分配", "现金分红", "分红派息"], False),
]
# Event types that speak for and against a security; all others are neutral.
POLARITY = {
    "positive": ["业绩预增", "业绩快报增长", "重大合同", "重大订单", "中标", "股份回购", "股东增持", "分红"],
    "negative": ["业绩预减", "业绩预亏", "业绩快报下降", "风险提示", "监管问询", "行政处罚", "股东减持", "重大诉讼", "停产", "退市风险"],
}
# Official sources, proxies that can't count as independent sources, and defaults.
OFFICIAL, PROXIES = ["cninfo", "sse", "szse"], ["price_volume_proxy-v1", "tushare_moneyflow-v1"]
ROW = ["symbol", "evidence_id", "dimension", "polarity", "source", "published", "strength", "reliability", "quality", "independence_group"]


def classify(title: Column, rules: list[tuple[str, list[str], bool]] | None = None) -> Column:
    """Event type of the first rule that holds: (type, keywords, all of them needed)."""
    out = F.lit("unknown")
    for kind, words, every in reversed(EVENT_RULES if rules is None else rules):
        hits = [F.coalesce(F.contains(title, F.lit(w)), F.lit(False)) for w in words]
        hit = hits[0]
        for h in hits[1:]:
            hit = hit & h if every else hit | h
        out = F.when(hit, kind).otherwise(out)
    return out


def polarity_of(event_type: Column) -> Column:
    return F.when(event_type.isin(POLARITY["positive"]), "positive").when(event_type.isin(POLARITY["negative"]), "negative").otherwise("neutral")


def official(records: DataFrame) -> DataFrame:
    """Evidence of official disclosures: rows of ``ROW`` with the title as claim.

    records: symbol, source, item_id, published, title; event_type, strength, reliability and quality where they are known.
    Rows of other sources and without a title are left out. An unknown event type follows from the title.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in records.columns else F.lit(None).cast(kind)
    title, source = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("source", F.lit("")))
    known = F.lit(False)
    for name in OFFICIAL:
        known = known | F.contains(F.lower(source), F.lit(name))
    f = records.select("*", title.alias("claim"), source.alias("_source")).filter(known & (F.col("claim") != "") & F.col("item_id").isNotNull())
    f = f.withColumn("_type", F.coalesce(F.nullif(F.trim(given("event_type", "string")), F.lit("")), classify(F.col("claim"))))
    f = f.withColumn("polarity", polarity_of(F.col("_type")))
    default = F.when(F.col("polarity") == "neutral", 0.1).otherwise(0.55)
    return f.select(
        "symbol", F.concat(F.lit("official_event."), F.col("item_id").cast("string")).alias("evidence_id"), F.lit("official_event").alias("dimension"), "polarity", F.col("_source").alias("source"), "published",
        F.coalesce(given("strength", "double"), default).alias("strength"), F.coalesce(given("reliability", "double"), F.lit(0.85)).alias("reliability"), F.coalesce(given("quality", "double"), F.lit(0.85)).alias("quality"),
        F.concat(F.lit("official_disclosure:"), "_source").alias("independence_group"), "claim", F.col("_type").alias("event_type"),
    )


def accepted(evidence: DataFrame, as_of: str) -> DataFrame:
    """Evidence with its reject reason, null where it is taken.

    Reasons: source (none, or a proxy), date, future (after ``as_of``), range (strength, reliability or quality missing or not
    within 0 to 1), duplicate (a later row of the same symbol, source and id).
    """
    good = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(False))
    f = evidence.withColumn("quality", F.coalesce("quality", F.lit(0.5))).withColumn("independence_group", F.coalesce(F.nullif("independence_group", F.lit("")), F.concat(F.lit("external:"), "source")))
    source = F.trim(F.coalesce("source", F.lit("")))
    reason = F.when((source == "") | source.isin(PROXIES) | F.col("evidence_id").isNull(), "source").when(F.col("published").isNull(), "date").when(F.col("published") > F.lit(as_of).cast("date"), "future")
    f = f.withColumn("reject", reason.when(~(good("strength") & good("reliability") & good("quality")), "range"))
    w = Window.partitionBy("symbol", "source", "evidence_id").orderBy(F.col("reject").isNotNull(), "published", "strength", "reliability", "quality", "polarity")
    return f.withColumn("_n", F.row_number().over(w)).withColumn("reject", F.when(F.col("reject").isNull() & (F.col("_n") > 1), "duplicate").otherwise(F.col("reject"))).drop("_n")


def coverage(evidence: DataFrame, as_of: str) -> DataFrame:
    """Per symbol: status, counts, sources and independence groups, days covered, freshness, and quality."""
    ok = lambda c: F.when(F.col("reject").isNull(), F.col(c))
    names = lambda c: F.array_sort(F.collect_set(ok(c)))
    f = evidence.groupBy("symbol").agg(
        F.count_if(F.col("reject").isNull()).alias("accepted"), F.count_if(F.col("reject").isNotNull()).alias("rejected"), names("source").alias("sources"), names("independence_group").alias("groups"), F.min(ok("published")).alias("first_day"),
        F.max(ok("published")).alias("last_day"), F.min(ok("quality")).alias("quality_min"), F.avg(ok("quality")).alias("quality_mean"), F.avg(ok("strength")).alias("mean_strength"),
    )
    return f.withColumns({"status": F.when(F.col("accepted") > 0, "ok").otherwise("insufficient"), "source_count": F.size("sources"), "freshness_days": F.datediff(F.lit(as_of).cast("date"), "last_day")})


def adjudicate(evidence: DataFrame) -> DataFrame:
    """Positive against negative weight (strength times reliability) of the rows that weren't rejected: state and confidence.

    Confidence grows with the net weight, up to 80, and is lowered by the mean quality of all evidence.
    """
    f = evidence.filter("reject is null") if "reject" in evidence.columns else evidence
    side = lambda p: F.coalesce(F.sum(F.when(F.col("polarity") == p, F.col("strength") * F.col("reliability"))), F.lit(0.0))
    f = f.groupBy("symbol").agg(side("positive").alias("pos"), side("negative").alias("neg"), F.count("*").alias("evidence_count"), F.round(F.min("quality"), 4).alias("quality_min"), F.round(F.avg("quality"), 4).alias("quality_mean"), F.array_sort(F.collect_set("independence_group")).alias("groups"))
    f = f.withColumn("total", F.col("pos") + F.col("neg")).withColumn("net", F.try_divide(F.col("pos") - F.col("neg"), F.col("total")))
    f = f.withColumn("conflict", F.try_divide(F.least("pos", "neg"), F.col("total")))
    state = F.when(F.col("total") == 0, "insufficient").when((F.col("conflict") >= 0.3) & (F.abs("net") < 0.25), "conflicted").when(F.col("net") >= 0.25, "conditional_positive").when(F.col("net") <= -0.25, "conditional_negative").otherwise("neutral")
    sure = F.bround(F.least(F.lit(80.0), F.abs("net") * 100 * F.least(F.lit(1.0), F.col("total") / 1.5)) * F.col("quality_mean"))
    return f.withColumns({"state": state, "confidence": F.when(F.col("total") > 0, sure).otherwise(0.0)})


def sentiment(bars: DataFrame) -> DataFrame:
    """A price and volume proxy: 50, moved by the return over 19 bars (20 at most) and by the volume against its 20-bar mean (10 at
    most); fewer than 20 bars are insufficient."""
    clip = lambda c, most: F.greatest(F.least(c, F.lit(most)), F.lit(-most))
    f = bars.withColumns({"ret_19": F.try_divide(F.col("close"), F.lag("close", 19).over(W())) - 1, "vol_ratio": F.try_divide(F.col("volume"), F.avg("volume").over(rows(20))), "n": F.count("*").over(W()), "_r": F.try_divide(F.col("close"), F.lag("close").over(W())) - 1})
    f = latest(f.withColumn("volatility", F.stddev_pop("_r").over(rows(20)) * F.sqrt(F.lit(252.0)))).drop("_r")
    score = 50 + clip(F.col("ret_19") * 100, 20.0) + F.coalesce(clip((F.col("vol_ratio") - 1) * 10, 10.0), F.lit(0.0))
    return f.withColumns({"status": F.when(F.col("n") < 20, "insufficient").otherwise("ok"), "sentiment_score": F.when(F.col("n") >= 20, F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)))})


def _row(when: Column, symbol: Column, evidence_id: Column | str, dimension: str, polarity: Column | str, source: str, day: Column, strength: Column | float, reliability: float, quality: float, group: str) -> Column:
    """One evidence row where ``when`` holds, else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [symbol, lit(evidence_id), lit(dimension), lit(polarity), lit(source), day, lit(strength).cast("double"), lit(reliability).cast("double"), lit(quality).cast("double"), lit(group)]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*[v.alias(n) for n, v in zip(ROW, values, strict=True)]))


def _rows(frame: DataFrame, items: list[Column]) -> DataFrame:
    return frame.select(F.inline(F.array_compact(F.array(*items))))


def sentiment_evidence(measured: DataFrame) -> DataFrame:
    """Evidence rows of ``sentiment``: momentum, and activity where the last volume is more than 1.2 times the mean."""
    c, ret = F.col, F.col("ret_19")
    up = F.when(ret >= 0, "positive").otherwise("negative")
    of = lambda name: F.concat(F.lit(f"sentiment.{name}."), up)
    enough = c("n") >= 20
    common = {"symbol": c("symbol"), "dimension": "sentiment", "polarity": up, "source": PROXIES[0], "day": c("trade_date"), "quality": 0.55, "group": "price_volume_proxy"}
    return _rows(measured, [
        _row(enough & (ret != 0), evidence_id=of("momentum"), strength=F.least(F.lit(1.0), F.abs(ret) * 5), reliability=0.4, **common),
        _row(enough & (c("vol_ratio") > 1.2), evidence_id=of("activity"), strength=F.least(F.lit(1.0), (c("vol_ratio") - 1) / 1.5), reliability=0.35, **common),
    ])


def flow(money: DataFrame) -> DataFrame:
    """Net money flow over the last five days with a number, of the amount or else of the volume, and its direction."""
    column = "net_mf_amount" if "net_mf_amount" in money.columns else "net_mf_vol"
    f = money.withColumn("_v", F.col(column).try_cast("double")).filter("_v is not null and trade_date is not null")
    f = f.withColumn("back", F.row_number().over(W().orderBy(F.desc("trade_date")))).filter("back <= 5").groupBy("symbol").agg(F.sum("_v").alias("net_5d"), F.max("trade_date").alias("trade_date"))
    return f.withColumns({"polarity": F.when(F.col("net_5d") > 0, "positive").when(F.col("net_5d") < 0, "negative").otherwise("neutral"), "unit": F.lit(column)})


def flow_evidence(flows: DataFrame) -> DataFrame:
    c = F.col
    strength = F.when(c("polarity") == "neutral", 0.25).otherwise(0.5)
    return _rows(flows, [_row(F.lit(True), c("symbol"), "sentiment.moneyflow.net_5d", "market_behavior", c("polarity"), PROXIES[1], c("trade_date"), strength, 0.55, 0.65, "tushare_moneyflow")])


def analysis_evidence(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """Evidence rows of the last technical summary and of a fundamental score (symbol, fundamental_score, evidence).

    A score above 55 or below 45 counts, with its distance from 50; trend, MACD, and an RSI beyond 80 or 20.
    """
    f, c = summary.join(scores.select("symbol", "fundamental_score", "evidence"), "symbol", "left"), F.col
    local = {"symbol": c("symbol"), "dimension": "technical", "source": "local_technical_analysis-v1", "day": c("trade_date"), "quality": 0.85, "group": "technical_local"}
    score, either = c("fundamental_score"), lambda column, good: F.when(c(column) == good, "positive").otherwise("negative")
    return _rows(f, [
        _row((c("evidence") > 0) & ((score > 55) | (score < 45)), c("symbol"), "fundamental.score", "fundamental", F.when(score > 55, "positive").otherwise("negative"), "local_fundamental_analysis-v2", c("trade_date"), F.least(F.lit(1.0), F.abs(score - 50) / 30), 0.75, 0.9, "fundamental_local"),
        _row(c("trend").isin("up", "down"), evidence_id="technical.trend", polarity=either("trend", "up"), strength=0.45, reliability=0.65, **local),
        _row(c("macd_cross").isin("golden", "death"), evidence_id="technical.macd", polarity=either("macd_cross", "golden"), strength=0.3, reliability=0.6, **local),
        _row(c("rsi_14") > 80, evidence_id="technical.rsi.overbought", polarity="negative", strength=0.35, reliability=0.55, **local),
        _row(c("rsi_14") < 20, evidence_id="technical.rsi.oversold", polarity="positive", strength=0.25, reliability=0.45, **local),
    ])


def sentiment_bundle(measured: DataFrame, flows: DataFrame, *outside: DataFrame) -> DataFrame:
    """Per symbol: the proxy's score, the numbers of evidence rows by kind, and the status of all of them together.

    With fewer than 20 bars the status is ok only where other evidence is there; otherwise ok where any row is, else neutral.
    outside are frames of accepted evidence.
    """
    count = lambda f, name: f.groupBy("symbol").agg(F.count("*").alias(name))
    f = measured.select("symbol", "n", "sentiment_score").join(count(sentiment_evidence(measured), "own"), "symbol", "left").join(count(flow_evidence(flows), "flow_rows"), "symbol", "full")
    others = []
    for i, frame in enumerate(outside):
        f = f.join(count(frame.filter("reject is null"), f"outside_{i}"), "symbol", "full")
        others.append(F.coalesce(f"outside_{i}", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    more = sum(others, zero("flow_rows"))
    short = zero("n") < 20
    status = F.when(short, F.when(more > 0, "ok").otherwise("insufficient")).when(more + zero("own") > 0, "ok").otherwise("neutral")
    return f.select("symbol", "sentiment_score", zero("own").alias("own"), zero("flow_rows").alias("flow_rows"), (more - zero("flow_rows")).alias("outside"), status.alias("status"))


def scenarios(levels: DataFrame, gates: DataFrame, risks: DataFrame, valuation: DataFrame) -> DataFrame:
    """Three rows a symbol that refer to levels that are there; no price and no probability is made up.

    levels: a level bundle with close, alignment, label, buy_targets and sell_targets. gates: gate and cap. risks: risk_level.
    valuation: summary. The base case refers to the upper level in an uptrend, else to the lower one, else to the close.
    """
    c = F.col
    direction = F.when(c("alignment") == "bullish", "up").when(c("alignment") == "bearish", "down").otherwise("sideways")
    f = levels.join(gates.select("symbol", "gate", "cap"), "symbol", "left").join(risks.select("symbol", "risk_level"), "symbol", "left").join(valuation.select("symbol", "summary"), "symbol", "left")
    f = f.withColumns({"direction": direction, "gate": F.coalesce("gate", F.lit("pass")), "cap": F.coalesce("cap", F.lit(80))})
    first = lambda k: F.get(k, F.lit(0))["price"]
    upper, lower = F.coalesce(first("sell_targets"), first("resistances")), F.coalesce(first("buy_targets"), first("supports"))
    trend = F.concat(F.lit("trend:"), "direction", F.lit("/"), "label")
    value, danger = F.concat(F.lit("valuation:"), F.coalesce("summary", F.lit("unknown"))), F.concat(F.lit("risk:"), F.coalesce("risk_level", F.lit("unknown")))
    one = lambda name, way, price, drivers: F.struct(F.lit(name).alias("scenario"), way.alias("way"), price.cast("double").alias("reference_price"), F.array(*drivers).alias("drivers"))
    base = F.coalesce(F.when(c("direction") == "up", upper).otherwise(lower), c("close"))
    every = F.array(one("optimistic", F.lit("up"), upper, [trend, value, danger]), one("base", c("direction"), base, [trend, value, danger]), one("pessimistic", F.lit("down"), lower, [danger]))
    return f.select("symbol", "gate", "cap", F.inline(every))


def _leaves(kind: T.DataType, at: Column, path: Column, ignored: tuple[str, ...]) -> Column:
    """An array of (path, value) of a nested column: structs and maps by field and key at any depth, arrays whole, as JSON."""
    joined = lambda name: F.concat(path, F.when(path != "", ".").otherwise(""), name)
    if isinstance(kind, T.StructType):
        parts = [_leaves(f.dataType, at[f.name], joined(F.lit(f.name)), ignored) for f in kind.fields if f.name not in ignored]
        return F.flatten(F.array(*parts)) if parts else F.array().cast("array<struct<path:string,value:string>>")
    if isinstance(kind, T.MapType):
        kept = F.filter(F.map_entries(at), lambda e: ~e["key"].cast("string").isin(*ignored)) if ignored else F.map_entries(at)
        found = F.flatten(F.transform(kept, lambda e: _leaves(kind.valueType, e["value"], joined(e["key"].cast("string")), ignored)))
        return F.coalesce(found, F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), (F.to_json(at) if isinstance(kind, T.ArrayType) else at.cast("string")).alias("value")))


def flattened(packages: DataFrame, keys: list[str], ignored: tuple[str, ...] = ("run_id", "generated_at", "package_hash")) -> DataFrame:
    """Rows (keys, path, value) of nested packages, without what tells runs apart: fields and keys named in ``ignored``, at any depth.

    Lists are values as a whole; a map's keys are part of the path, so packages may have different ones.
    """
    own = T.StructType([f for f in packages.schema.fields if f.name not in keys])
    return packages.select(*keys, F.inline(_leaves(own, F.struct(*own.names), F.lit(""), ignored)))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], most: int = 100, **how: tuple[str, ...]) -> DataFrame:
    """Changed paths between two packages of the same key, at most so many of each, by path: the value before and after."""
    a, b = flattened(before, keys, **how).withColumnRenamed("value", "old"), flattened(after, keys, **how).withColumnRenamed("value", "new")
    both = before.select(*keys).join(after.select(*keys), keys, "left_semi")
    f = a.join(b, [*keys, "path"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).join(both, keys, "left_semi")
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).filter(F.col("rank") <= most)
