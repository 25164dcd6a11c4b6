"""Reconciliation of two sources and the audit queue, in long form: (symbol, end_date, field, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import close_to, difference_bucket, report_type
from ..sources.store import stored
from . import pit
from .medians import group_medians

KEY = ["symbol", "end_date"]


def long(df: DataFrame, fields: list[str], value: str = "value") -> DataFrame:
    return df.select(*KEY, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(value)) for f in fields])).alias("x")).select(*KEY, "x.*")


def alignment(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Each key as matched, left_only or right_only."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("matched")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def compared(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """Matched keys and fields with both values, whether they match, and the bucket of their difference."""
    f = long(left, fields, "left_value").join(long(right, fields, "right_value"), [*KEY, "field"])
    return f.withColumns({"matches": close_to(F.col("left_value"), F.col("right_value")), "bucket": difference_bucket(F.col("left_value"), F.col("right_value"))})


def known(frame: DataFrame, as_of: str | None) -> DataFrame:
    """A side's rows as known at a date, one revision of each period; all rows where no date is given."""
    return frame if as_of is None else pit.pit_view(frame, as_of)


def _side(frame: DataFrame, as_of: str | None, name: str) -> DataFrame:
    """One row on a side: rows known at the date, periods, revisions beyond one of each period, and rows from the future."""
    frame = frame.filter("end_date is not null")
    if as_of is None:
        future = F.lit(False)
    else:
        day = F.lit(as_of).cast("date")
        future = (F.col("end_date") > day) | F.coalesce(pit.announced(frame) > day, F.lit(False))
    f = frame.withColumn("_future", future)
    keys = F.count_distinct(F.when(~F.col("_future"), F.struct(*KEY)))
    return f.agg(F.count_if(~F.col("_future")).alias(f"{name}_rows"), keys.alias(f"{name}_periods"), F.count_if("_future").alias(f"{name}_future")).withColumn(f"{name}_revisions", F.col(f"{name}_rows") - F.col(f"{name}_periods"))


def reconcile(left: DataFrame, right: DataFrame, fields: list[str], dataset: str, as_of: str | None = None) -> DataFrame:
    """One row: both sides' rows, revisions and future rows, keys matched and not, mismatches, and pass, partial or insufficient."""
    a, b = known(left, as_of), known(right, as_of)
    sides = alignment(a, b).agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("matched", "left_only", "right_only")])
    miss = compared(a, b, fields).agg(F.count("*").alias("cells"), F.count_if(~F.col("matches")).alias("mismatches"))
    none = (F.col("left_periods") == 0) | (F.col("right_periods") == 0)
    status = F.when(none, "insufficient").when((F.col("mismatches") == 0) & (F.col("left_only") == 0) & (F.col("right_only") == 0), "pass").otherwise("partial")
    # All of these are single rows.
    return _side(left, as_of, "left").crossJoin(_side(right, as_of, "right")).crossJoin(sides).crossJoin(miss).select(F.lit(dataset).alias("dataset"), "*", status.alias("status"))


def overall(results: DataFrame) -> DataFrame:
    """Status of a set of datasets: the worst one's."""
    bad = F.max(F.when(F.col("status") == "insufficient", 2).when(F.col("status") == "partial", 1).otherwise(0))
    return results.agg(F.count("*").alias("datasets"), F.sum("mismatches").alias("mismatches"), bad.alias("v")).select("datasets", "mismatches", F.element_at(F.array(*map(F.lit, ("pass", "partial", "insufficient"))), F.col("v") + 1).alias("status"))


def field_profile(cells: DataFrame) -> DataFrame:
    """Per field: compared cells, mismatches, sign flips, median and largest difference."""
    gap, both = F.abs(F.col("left_value") - F.col("right_value")), F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    rel = gap / F.greatest(F.abs("left_value"), F.abs("right_value"), F.lit(1e-12))
    stats = cells.groupBy("field").agg(
        F.count("*").alias("cells"), F.count_if(both).alias("comparable"), F.count_if(~F.col("matches")).alias("mismatches"), F.count_if(F.col("left_value") * F.col("right_value") < 0).alias("sign_flips"),
        F.max(gap).alias("max_abs"), F.max(rel).alias("max_rel"),
    )
    # a field's cells are a group that grows with the table, so medians are closed in on
    measures = F.explode(F.array(F.struct(F.lit("abs").alias("measure"), gap.alias("x")), F.struct(F.lit("rel").alias("measure"), rel.alias("x")))).alias("m")
    middle = group_medians(cells.select("field", measures).select("field", "m.*"), ["field", "measure"], "x")
    of = lambda name: F.max(F.when(F.col("measure") == name, F.col("median"))).alias(f"median_{name}")
    return stats.join(middle.groupBy("field").agg(of("abs"), of("rel")), "field", "left")


BUCKETS = ["exact", "under_1pct", "1_to_10pct", "10_to_50pct", "over_50pct", "missing_left", "missing_right", "missing_both"]


def security_profile(cells: DataFrame) -> DataFrame:
    """Per security and field the cells of each bucket, and all mismatches."""
    return cells.groupBy("symbol", "field").agg(*[F.count_if(F.col("bucket") == b).alias(f"b_{b}") for b in BUCKETS], F.count_if(~F.col("matches")).alias("mismatches"))


MISMATCHES = ["under_1pct", "1_to_10pct", "10_to_50pct", "over_50pct", "missing_left", "missing_right"]


def three_way(left: DataFrame, now: DataFrame, before: DataFrame, fields: list[str]) -> DataFrame:
    """Differences now and before: new, changed, carried_forward or resolved; other cells are left out."""
    f = compared(left, now, fields).join(long(before, fields, "previous"), [*KEY, "field"], "left")
    f = f.withColumn("previous_bucket", difference_bucket(F.col("left_value"), F.col("previous")))
    was, still = F.col("previous_bucket").isin(MISMATCHES), difference_bucket(F.col("right_value"), F.col("previous")) == "exact"
    state = F.when((F.col("bucket") == "exact") & was, "resolved").when(~F.col("bucket").isin(MISMATCHES), None).when(~was, "new").when(still, "carried_forward").otherwise("changed")
    return f.withColumn("state", state).filter("state is not null")


# Points of a difference by its bucket and state; indicators that providers derive, and the one a formula covers.
BUCKET_POINTS = {"over_50pct": 90, "10_to_50pct": 70, "missing_left": 65, "missing_right": 60, "1_to_10pct": 35, "under_1pct": 15}
STATE_POINTS = {"new": 25, "changed": 20, "carried_forward": 0}
INDICATORS, DERIVED, COVERED, DERIVED_POINTS = "fina_indicator", ["roe", "eps"], "roa", -20
#: Roles that no report has to be read for.
EXPLAINED = ["formula_coverage", "derived_indicator", "provider_revision", "source_unreadable", "manual_decision"]


def prioritized(diffs: DataFrame) -> DataFrame:
    """Score and role of differences, by ``dataset``, field, bucket and state."""
    points = lambda c, m: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)], F.lit(0))
    score, indicator = points("bucket", BUCKET_POINTS) + points("state", STATE_POINTS), F.col("dataset") == INDICATORS
    solved, covered, derived = F.col("state") == "resolved", indicator & (F.col("field") == COVERED) & (F.col("bucket") == "missing_right"), indicator & F.col("field").isin(DERIVED)
    role = F.when(solved, "resolved_regression").when(covered, "formula_coverage").when(derived, "derived_indicator").otherwise("base_financial")
    return diffs.withColumns({"priority": F.when(solved | covered, 0).when(derived, score + DERIVED_POINTS).otherwise(score), "role": role})


def with_revisions(queue: DataFrame, revisions: DataFrame, fields: list[str]) -> DataFrame:
    """Open differences whose current value is that of some revision of the left source: role provider_revision, score 5."""
    same = queue.join(long(revisions, fields, "some"), [*KEY, "field"]).filter(F.col("right_value").isNotNull() & F.col("some").isNotNull() & close_to(F.col("right_value"), F.col("some")))
    same = same.select(*KEY, "field").distinct().withColumn("_rev", F.lit(True))
    out, hit = queue.join(same, [*KEY, "field"], "left"), F.col("_rev") & (F.col("state") != "resolved")
    return out.withColumns({"role": F.when(hit, "provider_revision").otherwise(F.col("role")), "priority": F.when(hit, 5).otherwise(F.col("priority"))}).drop("_rev")


def unreadable_reports(snapshot: DataFrame, at_least: int = 8) -> DataFrame:
    """Reports of a parsed snapshot (symbol, end_date, missing: names joined by commas) that miss at least so many fields."""
    names = F.filter(F.split(F.coalesce("missing", F.lit("")), ","), lambda x: F.trim(x) != "")
    return snapshot.filter(F.size(names) >= at_least).select(*KEY).distinct()


def with_unreadable(queue: DataFrame, reports: DataFrame) -> DataFrame:
    """Open differences of unreadable reports: role source_unreadable, score 0."""
    out = queue.join(reports.select(*KEY).distinct().withColumn("_bad", F.lit(True)), KEY, "left")
    hit = F.col("_bad") & (F.col("state") != "resolved")
    return out.withColumns({"role": F.when(hit, "source_unreadable").otherwise(F.col("role")), "priority": F.when(hit, 0).otherwise(F.col("priority"))}).drop("_bad")


def with_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions override: role manual_decision, score 0. An empty decision is none; of several of a key the last by name counts."""
    made = decisions.filter(F.trim("decision") != "").groupBy("dataset", *KEY, "field").agg(F.max(F.trim("decision")).alias("manual_decision"))
    out, hit = queue.join(made, ["dataset", *KEY, "field"], "left"), F.col("manual_decision").isNotNull()
    return out.withColumns({"role": F.when(hit, "manual_decision").otherwise(F.col("role")), "priority": F.when(hit, 0).otherwise(F.col("priority"))})


def audit_rows(datasets: dict[str, tuple[DataFrame, DataFrame, DataFrame, list[str]]], as_of: str | None, reports: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """All differences of the datasets (left, right now, right before, fields), known at a date, with state, score, role and cluster.

    Overrides come in this order: a revision of the left source, unreadable reports, manual decisions. A cluster is the
    dataset, field, bucket (of a resolved difference the previous one) and kind of report.
    """
    parts = []
    for name, (left, now, before, fields) in datasets.items():
        f = three_way(known(left, as_of), known(now, as_of), known(before, as_of), fields).withColumn("dataset", F.lit(name))
        f = stored(prioritized(f), "differences")  # read again beside the revisions
        parts.append(with_revisions(f, left if as_of is None else pit.as_of(left, as_of), fields))
    queue = reduce(DataFrame.unionByName, parts)
    if reports is not None:
        queue = with_unreadable(queue, reports)
    if decisions is not None:
        queue = with_decisions(queue, decisions)
    queue = queue.withColumn("report_type", report_type(F.col("end_date")))
    seen = F.when(F.col("state") == "resolved", F.col("previous_bucket")).otherwise(F.col("bucket"))
    return queue.withColumns({"cluster": F.concat_ws(".", "dataset", "field", seen, "report_type"), "eligible": ~F.col("role").isin(EXPLAINED), "open": F.col("state") != "resolved"})


#: The order of the queue; a cluster has one row for each symbol and period.
ORDER = ["cluster", "symbol", "end_date"]


def cluster_ranked(queue: DataFrame) -> DataFrame:
    """``cluster_rank``, the place of each row in its cluster by score, symbol and period.

    A cluster may hold a large part of all rows. So rows are ranked within cluster, score and symbol, and what comes before is
    added from the counts of these.
    """
    step = ["cluster", "priority", "symbol"]
    counts = queue.groupBy(*step).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("cluster").orderBy(F.desc("priority"), "symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy(*step).orderBy("end_date"))
    return queue.withColumn("_in", inner).join(counts.withColumn("_before", before).drop("_n"), step).withColumn("cluster_rank", F.col("_before") + F.col("_in")).drop("_in", "_before")


def selected(queue: DataFrame, per_cluster: int = 3, most: int = 30) -> DataFrame:
    """The batch to look at: open and eligible rows among the first of their cluster, then so many in all."""
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("priority"), *ORDER[1:]))
    f = queue.withColumn("cluster_rank", first).filter(F.col("cluster_rank") <= per_cluster).filter("eligible and open")
    return f.orderBy(F.desc("priority"), *ORDER).limit(most)


def audit_tables(queue: DataFrame, per_cluster: int = 3, most: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open rows with a flag for the selected ones, the selected batch, and resolved rows."""
    queue = stored(queue, "queue")  # all three tables read it
    batch = selected(queue, per_cluster, most)
    marks = batch.select("dataset", *KEY, "field", F.lit(True).alias("selected"))  # ``most`` rows at most
    listed = queue.filter("open").join(F.broadcast(marks), ["dataset", *KEY, "field"], "left")
    return listed.withColumn("selected", F.coalesce("selected", F.lit(False))), batch, queue.filter("not open")


def queue_summary(queue: DataFrame, per_cluster: int = 3, most: int = 30) -> DataFrame:
    """One row of counts over open, selected and resolved rows."""
    queue = stored(queue, "queue")  # read for the counts and for the batch
    of = lambda c: F.count_if(F.col("open") & c)
    state, role = F.col("state"), F.col("role")
    every = queue.agg(
        F.count_if("open").alias("open_candidates"), F.count_if(~F.col("open")).alias("resolved_since_previous"), of(state == "carried_forward").alias("carried_forward"), of(state.isin("new", "changed")).alias("new_or_changed"),
        *[of(role == r).alias(f"excluded_{r}") for r in EXPLAINED], of(F.col("eligible")).alias("actionable_open_candidates"),
    )
    batch = selected(queue, per_cluster, most).agg(F.count("*").alias("selected_candidates"), F.count_distinct(*KEY).alias("selected_reports"))
    return every.crossJoin(batch).withColumns({"max_per_cluster": F.lit(per_cluster), "max_candidates": F.lit(most)})


def patched(base: DataFrame, patches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Base and patches; of each key the last patch wins."""
    every = base.withColumn("_o", F.lit(0))
    for i, p in enumerate(patches, 1):
        every = every.unionByName(p.withColumn("_o", F.lit(i)), allowMissingColumns=True)
    return pit.keep_first(every, keys, [F.desc("_o")]).drop("_o")


def shared_numeric(left: DataFrame, right: DataFrame, skip: tuple[str, ...] = (*KEY, "ann_date", "update_flag", "report_type", "load_seq")) -> DataFrame:
    """Columns of both sides that aren't metadata and have a number on some side: field, left_numbers, right_numbers.

    Names come from the schemas; each side is one aggregate of counts. Text that reads as numbers counts.
    """
    names = sorted((set(left.columns) & set(right.columns)) - set(skip))
    if not names:
        return left.limit(0).select(F.lit("").alias("field"), *[F.lit(0).cast("bigint").alias(f"{k}_numbers") for k in ("left", "right")])
    count = lambda f, k: f.agg(*[F.count(F.col(n).try_cast("double")).alias(n) for n in names]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias(f"{k}_numbers")) for n in names])).alias("x")).select("x.*")
    return count(left, "left").join(count(right, "right"), "field").filter("left_numbers > 0 or right_numbers > 0")
