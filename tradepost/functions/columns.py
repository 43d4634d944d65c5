"""Column helpers for the places where Spark's NULL, rounding and time rules differ from the shop's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import MONEY_SUM

WIDE = "decimal(20,0)"


def full_name(first: str | Column = "first_name", last: str | Column = "last_name") -> Column:
    """First and last name with a space; a missing part counts as empty, so the space stays."""
    return F.concat(_col_or_empty(first), F.lit(" "), _col_or_empty(last))


def _col_or_empty(part: str | Column) -> Column:
    return F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit(""))


def money_sum(amount: Column) -> Column:
    return F.sum(amount).cast(MONEY_SUM)


def whole_sum(count: str | Column) -> Column:
    return F.sum(count).cast("bigint")


def mean(total: str | Column, n: str | Column) -> Column:
    """Exact mean of whole numbers from their sum and count, NULL when the count is 0. The decimal
    quotient keeps 18 digits after the point, so a later cast to 2 rounds halves upwards as it should."""
    total = F.col(total) if isinstance(total, str) else total
    n = F.col(n) if isinstance(n, str) else n
    return total.cast(WIDE) / F.when(n > 0, n.cast(WIDE))


def month_of(time: str | Column) -> Column:
    """First moment of the month, still without a zone."""
    return F.date_trunc("month", time).cast("timestamp_ntz")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def month_range(time: str, year: int, month: int) -> Column:
    """``time`` within one month, as a range that a parquet scan can use."""
    after = (year + 1, 1) if month == 12 else (year, month + 1)
    first, last = (f"{y:04d}-{m:02d}-01" for y, m in ((year, month), after))
    return (F.col(time) >= moment(first)) & (F.col(time) < moment(last))


def within(time: str, start: str, end: str) -> Column:
    """``time`` between two moments, both ends included; a plain date means its midnight."""
    return F.col(time).between(moment(start), moment(end))


def extended(old: str | Column, more: str | Column) -> Column:
    """Array ``old`` followed by ``more``; a missing array counts as empty."""
    old = F.col(old) if isinstance(old, str) else old
    more = F.col(more) if isinstance(more, str) else more
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(old, empty), F.coalesce(more, empty))
