"""Audit ledgers: attribution, dispositions, lineage, report matching, snapshot validation, normalized tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pit
from .recon import KEY, long

# Names of resolutions and roles, and what each of them leads to (disposition, actionability); first match wins.
MATCHES, NO_FORMULA, NO_PROVIDER = "resolved_formula_matches_annualized_provider", "unresolved_missing_formula", "unresolved_provider_missing"
NOT_ANNUAL, DEFINITION, SHARES, REVIEW = "definition_review_nonannualized_candidate", "manual_definition_review", "manual_eps_share_count_review", "manual_review"
DISPOSITIONS = [
    ("role", "provider_revision", "provider_revision_explained", "none"),
    ("resolution", MATCHES, "formula_crosscheck_resolved", "none"),
    ("resolution", NO_FORMULA, "formula_insufficient_opening_balance", "none"),
    ("resolution", NOT_ANNUAL, NOT_ANNUAL, "policy_required"),
    ("resolution", DEFINITION, DEFINITION, "policy_required"),
    ("resolution", SHARES, SHARES, "policy_required"),
    ("role", "formula_coverage", "formula_coverage_explained", "none"),
    ("role", "derived_indicator", "derived_indicator_explained", "none"),
    ("role", "source_unreadable", "source_unreadable", "evidence_required"),
]
# What titles of reports contain after the year, and what rules a title out.
TITLES = {
    "annual": ["年年度报告", "年度报告"],
    "q1": ["年第一季度报告", "年一季度报告"],
    "semiannual": ["年半年度报告", "半年度报告", "年中期报告", "中期报告", "年半年报", "半年报"],
    "q3": ["年第三季度报告", "年三季度报告"],
}
EXCLUDED = [
    "摘要", "英文", "English", "ESG", "环境、社会及治理", "H股", "网上说明会", "关于披露", "董事会决议", "监事会", "审核意见", "业绩说明会", "监管工作函", "回复公告", "风险提示", "财务报表", "财务报告",
    "资金占用", "业绩预告", "专项报告",
]


def attributed(audit: DataFrame, ratios: DataFrame, provider: DataFrame, tolerance: float = 0.2, room: float = 1.0) -> DataFrame:
    """Why a derived indicator differs, from two left joins on (symbol, end_date).

    audit: symbol, end_date, field, right_value. ratios: roa, roe, factor (annualization). provider: ann_date, roa_yearly,
    roe_yearly; the last announcement counts. The formula is compared with the annualized value first, then, without its
    factor, with the reported one. Earnings per share and unknown fields go to a review.
    """
    last = pit.keep_first(provider, KEY, [F.desc_nulls_last("ann_date")]).select(*KEY, "roa_yearly", "roe_yearly")
    f = audit.join(ratios.select(*KEY, "roa", "roe", "factor"), KEY, "left").join(last, KEY, "left")
    of = lambda a, b: F.when(F.col("field") == "roa", F.col(a)).when(F.col("field") == "roe", F.col(b))
    f = f.withColumns({"formula_value": of("roa", "roe"), "provider_value": of("roa_yearly", "roe_yearly")})
    f = f.withColumn("raw_value", F.try_divide("formula_value", "factor"))
    ratio = F.when(F.col("formula_value").isNull(), NO_FORMULA).when(F.col("provider_value").isNull(), NO_PROVIDER)
    ratio = ratio.when(F.abs(F.col("formula_value") - F.col("provider_value")) <= tolerance, MATCHES)
    ratio = ratio.when(F.abs(F.col("raw_value") - F.col("right_value")) <= room, NOT_ANNUAL).otherwise(DEFINITION)
    kind = F.when(F.col("field").isin("roa", "roe"), ratio).when(F.col("field") == "eps", SHARES).otherwise(REVIEW)
    return f.withColumn("resolution", kind).drop("roa", "roe", "roa_yearly", "roe_yearly")


def key_counts(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows of ``left`` with ``versions``, the rows that ``right`` has for their key, and whether there is at most one."""
    n = right.groupBy(*keys).agg(F.count("*").alias("versions"))
    return left.join(n, keys, "left").withColumn("versions", F.coalesce("versions", F.lit(0))).withColumn("unique_key", F.col("versions") <= 1)


def ledger_join(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Left join of a ledger that has one row for each key; a key with more is an error when the rows are read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = right.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("several rows for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("bigint")).otherwise(n))
    return left.join(checked.filter("_n = 1").drop("_n"), keys, "left")


def disposed(audit: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Disposition and actionability of each audit row by ``role``, ``manual_decision`` and the resolution of its key.

    Keys that have more than one resolution are an error of the input: ``repeated`` marks them, and no row is multiplied.
    """
    keys = [*KEY, "field"]
    one = resolutions.groupBy(*keys).agg(F.min("resolution").alias("resolution"), (F.count("*") > 1).alias("repeated"))
    f = audit.join(one, keys, "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    manual = F.col("role") == "manual_decision"
    decision = F.coalesce(F.when(F.trim("manual_decision") != "", F.trim("manual_decision")), F.lit("manual_decision_recorded"))
    what, act = F.when(manual, decision), F.when(manual, "policy_required")
    for column, value, disposition, action in DISPOSITIONS:
        what, act = what.when(F.col(column) == value, disposition), act.when(F.col(column) == value, action)
    return f.withColumns({"disposition": what.otherwise("unclassified"), "actionability": act.otherwise("review_required")})


def source_gate(snapshot: DataFrame, reconciled: DataFrame, disposition: DataFrame, derived: DataFrame, expected: int, exact: tuple[str, ...] = ("balance", "cashflow")) -> DataFrame:
    """One row: whether a source passes with reservations.

    It needs a sound snapshot (no broken rules), the expected coverage of every dataset, no mismatch in ``exact`` ones, and
    nothing left to act on or unclassified. What waits for a policy is a reservation. derived has the resolutions of derived
    indicators, which are reported only.
    """
    broken = snapshot.agg(F.count("*").alias("broken_rules"))
    cover = reconciled.agg(F.count("*").alias("datasets"), F.min("matched").alias("least_matched"), F.sum(F.when(F.col("dataset").isin(*exact), F.col("mismatches")).otherwise(0)).alias("hard_mismatches"))
    left = disposition.agg(F.count_if(F.col("actionability").isin("evidence_required", "review_required")).alias("actionable"), F.count_if(F.col("disposition") == "unclassified").alias("unclassified"), F.count_if(F.col("actionability") == "policy_required").alias("reservations"))
    solved = derived.agg(F.count_if(F.startswith("resolution", F.lit("resolved"))).alias("derived_resolved"), F.count("*").alias("derived_rows"))
    good = (F.col("broken_rules") == 0) & (F.col("datasets") > 0) & (F.col("least_matched") == expected) & (F.col("hard_mismatches") == 0) & (F.col("actionable") == 0) & (F.col("unclassified") == 0)
    # All of these are single rows.
    return broken.crossJoin(cover).crossJoin(left).crossJoin(solved).withColumn("status", F.when(good, "pass_with_reservations").otherwise("fail"))


def wide_matches(wide: DataFrame, normalized: DataFrame, fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """A wide table against (ts_code, period_end, field, amount): each cell and whether both are equal, missing or not."""
    other = normalized.select(F.col("ts_code").alias("symbol"), F.col("period_end").alias("end_date"), "field", F.col("amount").cast("double").alias("amount"))
    f = long(wide, fields).join(other, [*KEY, "field"], "left")
    same = F.when(F.col("value").isNull() | F.col("amount").isNull(), F.col("value").isNull() & F.col("amount").isNull())
    return f.withColumn("equal", same.otherwise(F.abs(F.col("value") - F.col("amount")) <= tolerance * F.greatest(F.abs("value"), F.lit(1.0))))


def lineage(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(local_path, sha256) against the index (member, sha256): ok, hash or unknown; the member comes after the last ``!``."""
    f = rows.withColumn("member", F.element_at(F.split("local_path", "!"), -1))
    known = index.groupBy("member").agg(F.max("sha256").alias("_hash"))
    status = F.when(F.col("_hash").isNull(), "unknown").when(F.col("_hash").eqNullSafe(F.col("sha256")), "ok").otherwise("hash")
    return f.join(known, "member", "left").withColumn("lineage", status).drop("_hash")


def checklist_status(checklist: DataFrame, archive: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Each expected report: an exception's status first, then provided or missing by the archive's members."""
    member = F.concat_ws("_", "symbol", F.col("end_date").cast("string"), "report_type", F.lit("original.pdf"))
    f = checklist.withColumn("member", member).join(archive.select("member", F.lit(True).alias("_in")).distinct(), "member", "left")
    f = f.join(exceptions.groupBy(*KEY).agg(F.max(F.coalesce("status", F.lit("structural_missing"))).alias("_x")), KEY, "left")
    return f.withColumn("status", F.coalesce("_x", F.when(F.col("_in"), "provided").otherwise("missing"))).drop("_x", "_in")


def unmatched_members(archive: DataFrame, checked: DataFrame) -> DataFrame:
    """Members of the archive that no report of the checklist has."""
    return archive.join(checked.filter("status = 'provided'"), "member", "left_anti").select("member").distinct()


def _starts(title: Column, year: Column, kind: Column) -> Column:
    """Position in a title of the first pattern for the kind of report, 0 if it has none."""
    out = F.lit(0)
    for name, tails in TITLES.items():
        places = F.filter(F.array(*[F.position(F.concat(year, F.lit(t)), title) for t in tails]), lambda p: p > 0)
        out = F.when(kind == name, F.coalesce(F.array_min(places), F.lit(0))).otherwise(out)
    return out


def match_reports(reports: DataFrame, announcements: DataFrame) -> DataFrame:
    """The announcement of each report (symbol, end_date, report_type, name): earliest of those with the best issuer score.

    announcements: symbol, item_id, published, title. A title matches by year and kind, a half-year one also by ``半年报``
    in a year's publications, unless it holds an excluded marker. The score is 3 if just the issuer's name comes before
    the pattern, 2 if it begins that part, 1 if it is in the title, else 0. Reports without a match stay, as ``missing``.
    """
    year, kind = F.year("end_date").cast("string"), F.col("report_type")
    # Blanks never count: patterns and names have none. A title is for the years that it names, or for that of its publication.
    titled = announcements.withColumn("_t", F.regexp_replace("title", r"\s+", ""))
    years = F.transform(F.regexp_extract_all("_t", F.lit(r"(?=(\d{4}))"), F.lit(1)), lambda y: y.cast("int"))
    titled = titled.withColumn("_y", F.explode(F.array_distinct(F.concat(F.coalesce(years, F.array().cast("array<int>")), F.array(F.year("published"))))))
    f = reports.withColumn("_y", F.year("end_date")).join(titled, ["symbol", "_y"]).drop("_y")
    f = f.withColumn("_at", _starts(F.col("_t"), year, kind))
    half = (kind == "semiannual") & F.contains("_t", F.lit("半年报")) & (F.year("published") == F.year("end_date"))
    f = f.filter((F.col("_at") > 0) | F.coalesce(half, F.lit(False)))
    f = f.filter(~F.coalesce(F.col("title").rlike("|".join(EXCLUDED)), F.lit(False)))
    name, before = F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", ""), F.expr("substring(_t, 1, _at - 1)")
    score = F.when((name == "") | ~F.contains("_t", name) | (F.col("_at") == 0), 0).when(before == name, 3)
    score = score.when(F.startswith(before, name) & ~before.rlike("[:：]"), 2).otherwise(1)
    w = Window.partitionBy(*KEY)
    f = f.withColumn("_score", score).withColumns({"candidates": F.count("*").over(w), "_best": F.max("_score").over(w)})
    f = f.filter(F.col("_score") == F.col("_best")).withColumn("_left", F.count("*").over(w))
    f = pit.keep_first(f, KEY, ["published", "item_id"])
    label = F.when(F.col("_left") > 1, "earliest_original_candidate").when(F.col("candidates") > 1, "issuer_preferred_candidate").otherwise("exact")
    found = f.select(*KEY, F.col("published").alias("announce_date"), "item_id", "candidates", label.alias("match"))
    out = reports.join(found, KEY, "left")
    return out.withColumns({"match": F.coalesce("match", F.lit("missing")), "candidates": F.coalesce("candidates", F.lit(0).cast("bigint"))})


def validate_snapshot(
    snapshot: DataFrame, checklist: DataFrame, required: tuple[str, ...] = (), index: DataFrame | None = None, normalized: DataFrame | None = None, fields: list[str] | None = None
) -> DataFrame:
    """Broken rules of a snapshot: rule and how often; no rows mean that it passes.

    Required columns, keys against the checklist, keys that are there twice, claims of status that don't hold; with an index of
    files the lineage of each row (local_path, sha256), and with a normalized table its cells against the wide ones.
    """
    keys, want = snapshot.groupBy(*KEY).agg(F.count("*").alias("n")), checklist.select(*KEY).distinct()
    claims = snapshot.filter((F.col("status") == "parsed") & (F.col("missing") != "") | (F.col("status") != "parsed") & (F.col("missing") == ""))
    rules = [("missing_key", want.join(keys, KEY, "left_anti")), ("extra_key", keys.join(want, KEY, "left_anti")), ("duplicate_key", keys.filter("n > 1")), ("status", claims)]
    rules += [(f"column_{c}", snapshot.limit(1)) for c in required if c not in snapshot.columns]
    if index is not None:
        rules.append(("lineage", lineage(snapshot, index).filter("lineage != 'ok'")))
    if normalized is not None:
        rules.append(("normalized", wide_matches(snapshot, normalized, fields or []).filter("not equal")))
    out = None
    for rule, rows in rules:
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = counted if out is None else out.union(counted)
    return out.filter("n > 0")


def event_profile(events: DataFrame, known: list[str]) -> DataFrame:
    """One row on a sample of events: invalid dates, repeated ids, missing titles and addresses, coverage, and the share of recognized types."""
    events = events if "url" in events.columns else events.withColumn("url", F.lit(None).cast("string"))
    f = events.agg(
        F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.count_if(F.col("published").isNull()).alias("invalid_dates"), F.min("published").alias("first_day"), F.max("published").alias("last_day"),
        (F.count("*") - F.countDistinct("source", "item_id")).alias("duplicates"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("missing_titles"), F.count_if(F.coalesce(F.trim("url"), F.lit("")) == "").alias("missing_urls"), F.count_if(F.col("event_type").isin(known)).alias("recognized"),
    )
    good = (F.col("invalid_dates") == 0) & (F.col("missing_titles") == 0)
    return f.withColumns({"rate": F.coalesce(F.try_divide("recognized", "rows"), F.lit(0.0)), "status": F.when(good, "pass").otherwise("fail")})


#: What titles of announcements on H shares begin with or contain.
H_SHARES_BEGIN, H_SHARES_HOLD = ["H股公告", "港股公告", "[H股公告]"], ["H股公告-", "H股公告——"]


def announced_on(raw: Column) -> Column:
    """The day of a time given as milliseconds since 1970 or, where it is no number, as a text date."""
    ms = raw.try_cast("double")
    text = F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(raw), F.lit(f))) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm")])
    return F.when(ms.isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))).otherwise(text)


def source_url(adjunct: Column, code: Column, announcement_id: Column, static_base: str, page_base: str) -> Column:
    """A whole address as it is, a path below the files' address, and without either the page of the announcement."""
    page = F.concat(F.lit(f"{page_base}?plate="), F.coalesce("plate", F.lit("")), F.lit("&orgId="), F.coalesce("org_id", F.lit("")), F.lit("&stockCode="), code, F.lit("&announcementId="), announcement_id)
    return F.when(adjunct.rlike("^https?://"), adjunct).when(adjunct != "", F.concat(F.lit(f"{static_base}/"), F.regexp_replace(adjunct, "^/+", ""))).otherwise(page)


def normalize_announcements(raw: DataFrame, with_h_shares: bool = False, source: str = "official", static_base: str = "https://files.example", page_base: str = "https://pages.example/detail") -> DataFrame:
    """Announcements of securities: symbol, announcement_id, item_id, title, published, source_url.

    In: symbol (the security's code), announced (milliseconds or a text date), title, and where known sec_code, item_id,
    adjunct_url, plate, org_id. Rows of another code (sec_code, filled to six digits), without a title or a date, and unless
    ``with_h_shares`` those whose title has the form of an H-share announcement, go. A missing id is a prefix of the SHA-1 of
    code, day, title and address.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in raw.columns else F.lit("")
    f = raw.withColumns({"title": text("title"), "_code": text("sec_code"), "_id": text("item_id"), "_url": text("adjunct_url"), "published": announced_on(F.col("announced").cast("string")), **{c: text(c) for c in ("plate", "org_id")}})
    full = F.when(F.length("_code") < 6, F.lpad("_code", 6, "0")).otherwise(F.col("_code"))
    f = f.filter((F.col("title") != "") & F.col("published").isNotNull() & ((F.col("_code") == "") | (full == F.col("symbol"))))
    if not with_h_shares:
        of_h = F.lit(False)
        for word in H_SHARES_BEGIN:
            of_h = of_h | F.startswith("title", F.lit(word))
        for word in H_SHARES_HOLD:
            of_h = of_h | F.contains("title", F.lit(word))
        f = f.filter(~of_h)
    f = f.withColumn("source_url", source_url(F.col("_url"), F.col("symbol"), F.col("_id"), static_base, page_base))
    spare = F.substring(F.sha1(F.concat_ws("|", "symbol", F.col("published").cast("string"), "title", "source_url").cast("binary")), 1, 16)
    f = f.withColumn("announcement_id", F.when(F.col("_id") != "", F.col("_id")).otherwise(spare))
    return f.select("symbol", "announcement_id", F.concat_ws(":", F.lit(source), "symbol", "announcement_id").alias("item_id"), "title", "published", "source_url")


#: Column names of the provider for each normalized table.
STATEMENTS = {"income": {"revenue": "revenue", "n_income": "net_profit"}, "balance": {"total_assets": "total_assets", "total_liab": "total_liabilities"}, "cashflow": {"n_cashflow_act": "operating_cf"}, "indicator": {"debt_to_assets": "debt_to_assets"}}


def statements(wide: DataFrame) -> dict[str, DataFrame]:
    """Four tables with the provider's column names from one wide table; a column that it hasn't is null."""
    of = lambda c: F.col(c).cast("double") if c in wide.columns else F.lit(None).cast("double")
    return {t: wide.select(*KEY, *[of(src).alias(dst) for dst, src in cols.items()]) for t, cols in STATEMENTS.items()}


#: Radicals of the Kangxi and supplement blocks stand for the characters that compatibility normalisation gives, by rule.
_RADICALS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2E80, 0x2FE0)}
RADICALS = {a: b for a, b in _RADICALS.items() if a != b and len(b) == 1}


def normalize_text(text: Column, vocabulary: dict[str, str]) -> Column:
    """Radicals become characters, Chinese words that line breaks split are joined, then the vocabulary is replaced, longer words first."""
    out = F.translate(text, "".join(RADICALS), "".join(RADICALS.values()))
    out = F.regexp_replace(out, r"([\x{4e00}-\x{9fa5}])[ \t]*(?:\r?\n[ \t]*)+(?=[\x{4e00}-\x{9fa5}])", "$1")
    for a in sorted(vocabulary, key=lambda w: (-len(w), w)):
        out = F.replace(out, F.lit(a), F.lit(vocabulary[a]))
    return out
