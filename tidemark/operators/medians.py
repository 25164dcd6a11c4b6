"""Exact medians of groups of any size: the two middle ranks are closed in from both sides, and only their neighbourhood is sorted.

Each round cuts what is left around a rank by approximate quantiles, which are small and merge before the shuffle, counts what
lies below and at the cuts, and goes on between two neighbouring cuts. When at most ``bound`` values are left they are sorted.
So no task holds more than that of a group, however many rows or equal values it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

#: Cuts of a round, and how far apart cuts are chosen around a rank, beyond the error of the approximate quantiles.
CUTS, MARGIN = 40, 0.002


def _inside(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each rank that is still looked for among them."""
    return rows.join(ranks.select(*keys, "r", "low", "high", "below", "inside"), keys).filter("(low is null or v > low) and (high is null or v < high)")


def _closer(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """One round: ranks with their answer, or with closer bounds (exclusive ones)."""
    by = [*keys, "r"]
    at = (F.col("r") - F.col("below")) / F.col("inside")
    first, last = F.greatest(F.floor((at - MARGIN) * CUTS), F.lit(0)).cast("int"), F.least(F.ceil((at + MARGIN) * CUTS), F.lit(CUTS)).cast("int")
    cuts = _inside(rows, ranks, keys).groupBy(*by).agg(F.approx_percentile("v", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("q"))
    cut = stored(ranks.drop("answer").join(cuts, by).withColumns({"from": F.get("q", first), "to": F.get("q", last)}).drop("q"), "cuts")
    within = rows.join(cut.select(*by, "low", "high", "from", "to"), keys).filter("(low is null or v > low) and (high is null or v < high)")
    counts = within.groupBy(*by).agg(F.count_if(F.col("v") < F.col("from")).alias("under"), F.count_if(F.col("v") == F.col("from")).alias("at_from"), F.count_if((F.col("v") > F.col("from")) & (F.col("v") < F.col("to"))).alias("between"), F.count_if(F.col("v") == F.col("to")).alias("at_to"))
    f = cut.join(counts, by)
    k = F.col("r") - F.col("below")
    at_to = F.when(F.col("to") > F.col("from"), F.col("at_to")).otherwise(0)
    base, end = F.col("under") + F.col("at_from"), F.col("under") + F.col("at_from") + F.col("between")
    out = {
        "answer": F.when((k >= F.col("under")) & (k < base), F.col("from")).when((k >= end) & (k < end + at_to), F.col("to")),
        # where a cut was off, the rank lies outside, and the search goes on there
        "next_low": F.when(k < F.col("under"), F.col("low")).when(k < end, F.col("from")).otherwise(F.col("to")), "next_high": F.when(k < F.col("under"), F.col("from")).when(k < end, F.col("to")).otherwise(F.col("high")),
        "next_below": F.col("below") + F.when(k < F.col("under"), 0).when(k < end, base).otherwise(end + at_to),
        "next_inside": F.when(k < F.col("under"), F.col("under")).when(k < end, F.col("between")).otherwise(F.col("inside") - end - at_to),
    }
    return f.withColumns(out).select(*by, F.col("next_low").alias("low"), F.col("next_high").alias("high"), F.col("next_below").alias("below"), F.col("next_inside").alias("inside"), "answer")


def group_medians(frame: DataFrame, keys: list[str], value: str, bound: int = 10_000) -> DataFrame:
    """(keys, median) of the numbers in ``value``: the middle one, or the mean of the two middle ones.

    Nulls and NaN don't count; groups without a number are absent. Keys aren't null.
    """
    rows = stored(frame.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    n = rows.groupBy(*keys).agg(F.count("*").alias("inside"))
    none = F.lit(None).cast("double")
    ranks = n.withColumn("r", F.explode(F.array_distinct(F.array(F.expr("(inside - 1) div 2"), F.expr("inside div 2"))))).select(*keys, "r", none.alias("low"), none.alias("high"), F.lit(0).cast("bigint").alias("below"), "inside", none.alias("answer"))
    ranks = stored(ranks, "ranks")
    is_open = F.col("answer").isNull() & (F.col("inside") > bound)
    while ranks.filter(is_open).limit(1).count():
        ranks = stored(_closer(rows, ranks.filter(is_open), keys).unionByName(ranks.filter(~is_open)), "ranks")
    few = _inside(rows, ranks.filter("answer is null"), keys).groupBy(*keys, "r", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    each = few.select(*keys, F.get("vs", (F.col("r") - F.col("below")).cast("int")).alias("x")).unionByName(ranks.filter("answer is not null").select(*keys, F.col("answer").alias("x")))
    return each.groupBy(*keys).agg(F.avg("x").alias("median"))
