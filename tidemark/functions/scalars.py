"""Column functions: symbols, numbers, dates, fees, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provider spellings of a true flag, and patterns of secrets.
TRUE_WORDS = ["1", "true", "yes", "y", "停牌"]
SECRET_KEY = "key|token|password|secret"
SECRET_PAIR = r"(?i)([\w-]*(?:key|token|password|secret)[\w-]*)\s*[:=]\s*\S+"
SECRET_PATTERNS = [r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"(?i)(api_?key|token|secret|password)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{16,}[\"']", r"\bsk-[A-Za-z0-9]{16,}"]


def exchange_of(digits: Column) -> Column:
    """Exchange of six digits: 4, 8 and 920 are BJ; 5, 6 and 9 SH; the rest SZ."""
    first = F.substring(digits, 1, 1)
    return F.when(first.isin("4", "8") | digits.startswith("920"), "BJ").when(first.isin("5", "6", "9"), "SH").otherwise("SZ")


def normalize_symbol(code: Column) -> Column:
    """struct(symbol, error): canonical DDDDDD.XX, or why it isn't one. Null is an error."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    digits, suffix = F.regexp_extract(c, r"^(\d{6})(\.(SH|SZ|BJ))?$", 1), F.regexp_extract(c, r"^(\d{6})(\.(SH|SZ|BJ))?$", 3)
    error = F.when(digits == "", "format").when((suffix != "") & (suffix != exchange_of(digits)), "suffix")
    return F.struct(F.when(error.isNull(), F.concat_ws(".", digits, exchange_of(digits))).alias("symbol"), error.alias("error"))


def announcement_symbol(code: Column) -> Column:
    """struct(code, market): bare codes of 5, 6 and 9 are SH, others SZ; a suffix is taken as it is."""
    c = F.upper(F.trim(code))
    digits, suffix = F.substring_index(c, ".", 1), F.when(c.contains("."), F.substring_index(c, ".", -1))
    return F.struct(digits.alias("code"), F.coalesce(suffix, F.when(F.substring(digits, 1, 1).isin("5", "6", "9"), "SH").otherwise("SZ")).alias("market"))


def number(value: Column) -> Column:
    """A finite double, else null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_named(candidates: list[str]) -> Column:
    """struct(name, value) of the first column that has a finite number; null if none has."""
    out = F.lit(None).cast("struct<name:string,value:double>")
    for c in reversed(candidates):
        out = F.when(number(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("name"), number(F.col(c)).alias("value"))).otherwise(out)
    return out


def report_type(period_end: Column) -> Column:
    """q1, semiannual, q3 or annual by the quarter's last day, else unknown."""
    day, out = F.date_format(period_end, "MM-dd"), F.lit("unknown")
    for d, name in (("03-31", "q1"), ("06-30", "semiannual"), ("09-30", "q3"), ("12-31", "annual")):
        out = F.when(day == d, name).otherwise(out)
    return out


def annualization(period_end: Column) -> Column:
    """4, 2, 4/3 and 1 for the quarters' ends; 1 for other months."""
    m = F.month(period_end)
    return F.when(m == 3, 4.0).when(m == 6, 2.0).when(m == 9, 4.0 / 3.0).otherwise(1.0)


def safe_ratio(numerator: Column, denominator: Column, scale: float = 100.0) -> Column:
    """struct(value, status): calculated, missing or division_by_zero."""
    n, d = number(numerator), number(denominator)
    status = F.when(n.isNull() | d.isNull(), "missing").when(d == 0, "division_by_zero").otherwise("calculated")
    return F.struct((F.try_divide(n, d) * scale).alias("value"), status.alias("status"))


def rounded(value: Column, digits: int = 2) -> Column:
    return F.round(number(value), digits)


def clip(x: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def is_suspended(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def executable(side: str, open_: Column, suspended: Column, up: Column, down: Column) -> Column:
    """Whether a bar's open can be traded; a null limit is no limit."""
    blocked = open_ >= up if side == "buy" else open_ <= down
    return ~suspended & ~F.coalesce(blocked, F.lit(False))


def fee(notional: Column, side: str, commission: float = 0.0003, minimum: float = 5.0, transfer: float = 0.00001, stamp: float = 0.0005) -> Column:
    """Commission with its minimum, transfer fee, and stamp duty on sells."""
    return F.greatest(F.lit(minimum), notional * commission) + notional * (transfer + (stamp if side == "sell" else 0.0))


def slipped(price: Column, side: str, slippage: float = 0.0005) -> Column:
    return price * (1 + slippage if side == "buy" else 1 - slippage)


def lot_size(cash: Column, price: Column, lot: int = 100, commission: float = 0.0003, minimum: float = 5.0, transfer: float = 0.00001) -> Column:
    """The most shares, in lots, whose notional and fees the cash pays."""
    most = F.least(cash / (1 + transfer + commission), (cash - minimum) / (1 + transfer))
    lots = F.try_divide(most, price * lot)  # a double throughout: floor() of a large account leaves the range of integers
    return F.greatest(F.when(F.abs(lots) < 2.0**53, F.floor(lots).cast("double")).otherwise(lots), F.lit(0.0)) * lot


def run_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost of a model run by its token counts."""
    return F.coalesce(tokens_in, F.lit(0)) * 2e-6 + F.coalesce(tokens_out, F.lit(0)) * 8e-6


def redact_text(text: Column) -> Column:
    """Text with the values of secret-like pairs starred, cut to 500 characters."""
    return F.substring(F.regexp_replace(text, SECRET_PAIR, "$1=***"), 1, 500)


def has_secret(text: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(p) for p in SECRET_PATTERNS)), F.lit(False))


def fingerprint(*columns: str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the columns' JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def close_to(left: Column, right: Column, abs_tol: float = 1e-6, rel_tol: float = 1e-4) -> Column:
    """Equal within tolerance; both missing are equal, one missing isn't."""
    room = abs_tol + rel_tol * F.greatest(F.abs(left), F.abs(right), F.lit(1.0))
    return F.when(left.isNull() & right.isNull(), True).when(left.isNull() | right.isNull(), False).otherwise(F.abs(left - right) <= room)


def difference_bucket(left: Column, right: Column) -> Column:
    """exact, under_1pct, 1_to_10pct, 10_to_50pct, over_50pct, missing_left, missing_right or missing_both."""
    share = F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1e-12))
    missing = F.when(left.isNull() & right.isNull(), "missing_both").when(left.isNull(), "missing_left").when(right.isNull(), "missing_right")
    return missing.when(close_to(left, right), "exact").when(share < 0.01, "under_1pct").when(share < 0.1, "1_to_10pct").when(share < 0.5, "10_to_50pct").otherwise("over_50pct")
