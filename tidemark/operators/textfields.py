"""Amounts after labels in the text of statement pages: one narrow pass, each page by itself, no join and no shuffle.

SQL functions don't tell where a pattern matches, so pages go through a vectorised UDF: one scan of a page finds the places of
all amounts, units and line ends, in order; each label is found from left to right, and what belongs to it is looked up among
these places by bisection. So the work is the page's length for each label, however many places a label has. Text is folded to
half-width first, so that one set of marks is left. An amount belongs to a label if it comes after it, on its line or within
the next lines. Amounts are tokens: digits with group commas and decimals, a sign or brackets around them, maybe a
per cent sign.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width characters and other spellings of a sign, and what they are folded to.
WIDE, NARROW = "（）［］，．％－−–：／　０１２３４５６７８９", "()[],.%---:/ 0123456789"
# What the names of units stand for.
UNITS = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "百万": 1e6, "亿元": 1e8}
#: A token of an amount, and a note's number in brackets, which is none.
AMOUNT, NOTE = r"(?<![\w.])[(\[]?-?\d+(?:,\d{3})*(?:\.\d+)?\s?[)\]]?%?", r"\(\d\d?\)"
#: A unit is named after the word for it, in brackets, or after the currency; an amount for each share isn't one.
_NAMES = "|".join(sorted(UNITS, key=len, reverse=True))
UNIT = rf"(?:单位:?|币种:?|人民币|\()\s*(?:人民币)?\s*({_NAMES})(?!\s*/\s*股)"
#: Words of rates, and what begins the part of a line that is about single shares.
RATES, SHARE = ("率", "占比"), "每股"


_FOLD = str.maketrans(WIDE, NARROW)
_AMOUNT, _UNIT, _NOTE = (re.compile(p, re.ASCII) for p in (AMOUNT, UNIT, NOTE))
#: An amount that begins right here, whatever stands before.
_FIRST = re.compile(AMOUNT.removeprefix(r"(?<![\w.])"), re.ASCII)


@dataclass(frozen=True)
class Labels:
    """Labels of a field, the preferred first; ``scaled`` amounts follow the page's unit; a hit after a ``reject`` word on its line is none."""

    names: tuple[str, ...]
    scaled: bool = True
    reject: tuple[str, ...] = ()


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WIDE, NARROW)


def number(token: Column) -> Column:
    """The value of an amount token; brackets make it negative, per cent signs and commas don't count. Null for other text."""
    token = folded(token)
    size = F.regexp_replace(token, r"[^\d.]", "").try_cast("double")
    whole = token.rlike(rf"^\s*(?:{AMOUNT})\s*$")
    return F.when(whole, F.when(token.rlike(r"^\s*[(\[]?-|^\s*[(\[].*[)\]]"), -size).otherwise(size))


@dataclass(frozen=True)
class _Amount:
    start: int
    value: float
    note: bool


def _value(token: str) -> float:
    size = float(re.sub(r"[^\d.]", "", token))
    return -size if re.match(r"\s*[(\[]?-|\s*[(\[].*[)\]]", token, re.DOTALL) else size


class Page:
    """Places in a folded text, in order: line ends, amounts, units, and words when they are first asked for."""

    def __init__(self, text: str):
        self.text = text
        self._words: dict[str, list[int]] = {}
        self.ends = self.places("\n")
        self.amounts = [self._amount(m) for m in _AMOUNT.finditer(text)]
        self.amount_at = [a.start for a in self.amounts]
        #: Of each amount, the next one from it on that is no note's number.
        self.real, after = [0] * len(self.amounts), len(self.amounts)
        for i in range(len(self.amounts) - 1, -1, -1):
            after = self.real[i] = after if self.amounts[i].note else i
        self.units = [(m.start(), m.end(), UNITS[m.group(1)]) for m in _UNIT.finditer(text)]
        self.unit_at = [u[0] for u in self.units]
        #: Units outside what is said of single shares.
        self.plain = [u for u in self.units if not self._holds(SHARE, self._line(u[0]), u[0])]
        self.plain_end = [u[1] for u in self.plain]

    @staticmethod
    def _amount(match: re.Match) -> _Amount:
        token = match.group()
        return _Amount(match.start(), _value(token), _NOTE.fullmatch(token.replace(" ", "")) is not None)

    def places(self, word: str) -> list[int]:
        """Where a word stands, from left to right, one after the other."""
        if word not in self._words:
            found, at = [], self.text.find(word)
            while at >= 0:
                found.append(at)
                at = self.text.find(word, at + len(word))
            self._words[word] = found
        return self._words[word]

    def _holds(self, word: str, start: int, end: int) -> bool:
        places = self.places(word)
        i = bisect_left(places, start)
        return i < len(places) and places[i] + len(word) <= end

    def _line(self, place: int) -> int:
        """Where the line of a place begins."""
        i = bisect_left(self.ends, place)
        return self.ends[i - 1] + 1 if i else 0

    def _line_end(self, place: int, lines: int = 1) -> int:
        i = bisect_left(self.ends, place) + lines - 1
        return self.ends[i] if i < len(self.ends) else len(self.text)

    def scale(self, place: int, after: int) -> float:
        """By the unit on the label's line after it, else by the last one before, else 1; units of single shares don't count."""
        shares = self.places(SHARE)
        j, k = bisect_left(shares, after), bisect_left(self.unit_at, after)
        stop = min(self._line_end(after), shares[j] if j < len(shares) else len(self.text))
        if k < len(self.units) and self.units[k][1] <= stop:
            return self.units[k][2]
        k = bisect_right(self.plain_end, place) - 1
        return self.plain[k][2] if k >= 0 else 1.0

    def _following(self, after: int, stop: int) -> tuple[_Amount | None, int]:
        """The amount that counts between two places, and where the first of all amounts begins; a note's number counts if it is alone."""
        first = None
        if match := _FIRST.match(self.text, after, stop):  # an amount may begin right after a letter or digit of the label
            first, after = self._amount(match), match.end()
        a, b = bisect_left(self.amount_at, after), bisect_left(self.amount_at, stop)
        if first is None and a == b:
            return None, stop
        start = first.start if first else self.amount_at[a]
        if first and (not first.note or a == b):
            return first, start
        if a < b and self.real[a] < b:
            return self.amounts[self.real[a]], start
        return (self.amounts[a], start) if not first and b - a == 1 else (None, start)

    def candidate(self, place: int, label: str, spec: Labels, lines: int) -> float | None:
        """The amount that belongs to a label at a place; none where the line speaks of a rate or of a rejected kind."""
        after, line = place + len(label), self._line(place)
        amount, start = self._following(after, self._line_end(after, lines))
        if amount is None or any(self._holds(w, line, place) for w in spec.reject):
            return None
        until = start if start <= self._line_end(after) else after
        if not any(w in label for w in RATES) and any(self._holds(w, line, place) or self._holds(w, after, until) for w in RATES):
            return None
        return amount.value * self.scale(place, after) if spec.scaled else amount.value

    def amount(self, spec: Labels, lines: int) -> float | None:
        """The preferred label's amounts win, then the largest, then the first place."""
        for name in spec.names:
            label = name.translate(_FOLD)
            found = [(-abs(x), place, x) for place in self.places(label) if (x := self.candidate(place, label, spec, lines)) is not None]
            if found:
                return min(found)[2]
        return None


def labelled_amounts(pages: DataFrame, fields: dict[str, Labels], text: str = "text", lines: int = 3) -> DataFrame:
    """``pages`` with a double for each field and ``status``: parsed where all were found, else partial.

    Of a field's candidates the preferred label's win, then the largest amount, then the first place. A null or empty text has
    no amounts. An amount may stand on the label's line or the ``lines`` - 1 after it. Columns of ``pages`` named like a field
    or ``status`` are replaced.
    """
    struct = ", ".join(f"`{name}` double" for name in fields)

    @F.pandas_udf(struct)
    def amounts(texts: pd.Series) -> pd.DataFrame:
        rows = [[page.amount(spec, lines) for spec in fields.values()] for page in map(Page, (("" if t is None else t).translate(_FOLD) for t in texts))]
        return pd.DataFrame(rows, columns=list(fields), dtype="float64")

    found = pages.withColumn("_amounts", amounts(F.col(text).cast("string"))).withColumns({name: F.col("_amounts")[name] for name in fields}).drop("_amounts")
    missing = F.lit(False)
    for name in fields:
        missing = missing | F.col(name).isNull()
    return found.withColumn("status", F.when(missing, "partial").otherwise("parsed"))
