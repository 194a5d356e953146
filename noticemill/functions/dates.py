"""Date and date-time display, normalisation and lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticemill import constants as C
from noticemill.functions.text import clean_capture, compact, groups, let, matches, strip, text_or_empty

_DATE_HEAD = r"^(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
_TIME_HEAD = r"^(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2})"


def _number(c: Column) -> Column:
    """Digits without leading zeros, as text."""
    return c.cast("int").cast("string")


def _cn_day(p: Column) -> Column:
    return F.concat(_number(p[0]), F.lit("年"), _number(p[1]), F.lit("月"), _number(p[2]), F.lit("日"))


def _cn_date(s: Column) -> Column:
    """``cn_date`` of a stripped text."""
    return (
        F.when(s == "", C.MISSING)
        .when(F.startswith(s, F.lit("1970")) & matches(s, r"^1970[-/年]0?1[-/月]0?1"), C.MISSING)
        .otherwise(let(groups(s, _DATE_HEAD, 3), lambda p: F.when(F.size(p) == 3, _cn_day(p)).otherwise(s)))
    )


def cn_date(value: Column) -> Column:
    """Text to ``2026年7月16日``; blanks and 1970-01-01 are missing, other text is kept."""
    return let(strip(text_or_empty(value)), _cn_date)


def cn_date_of(day: Column) -> Column:
    """A date or timestamp column to the same display form."""
    return F.when(day.isNull(), C.MISSING).otherwise(
        F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"),
                 F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日")))


def cn_datetime(value: Column) -> Column:
    def shown(s: Column) -> Column:
        return let(groups(s, _TIME_HEAD, 5), lambda p: F.when(F.size(p) == 5, F.concat(
            _cn_day(p), F.lit(" "), p[3], F.lit(":"), p[4])).otherwise(_cn_date(s)))

    return let(strip(text_or_empty(value)), shown)


def normal_datetime(value: Column) -> Column:
    """Bring a date-time that stands in the text to one form; parts are never invented."""
    def clock(p: Column) -> Column:
        return F.concat(F.lit(" "), F.lpad(_number(p[3]), 2, "0"), F.lit(":"), F.lpad(_number(p[4]), 2, "0"))

    return let(value, lambda v: let(groups(compact(text_or_empty(v)), C.DATETIME_PARTS, 5), lambda p: (
        F.when(F.size(p) < 5, clean_capture(v)).when((p[3] != "") & (p[4] != ""), F.concat(_cn_day(p), clock(p)))
        .otherwise(_cn_day(p)))))


def _real_day(value: Column, pattern: str) -> Column:
    """The date whose three parts the pattern finds; NULL when absent or not a real day."""
    return let(groups(value, pattern, 3), lambda p: F.when(F.size(p) == 3, F.try_to_date(
        F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")), "yyyy-MM-dd")))


def lenient_date(value: Column) -> Column:
    """First date in a text; NULL when absent or not a real day."""
    return _real_day(value, r"(20\d{2})[年\-/](\d{1,2})[月\-/](\d{1,2})")


def list_date(value: Column) -> Column:
    """Receive time of a list row: 20xx only, 1970 and bad days are NULL."""
    return _real_day(strip(text_or_empty(value)), r"^(20\d{2})-(\d{1,2})-(\d{1,2})")


def page_date(value: Column) -> Column:
    """First 20xx date of a page fragment with ``.``, ``-``, ``/`` or 年月 separators."""
    return _real_day(value, r"(20\d{2})[年.\-/](\d{1,2})[月.\-/](\d{1,2})")
