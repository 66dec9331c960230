"""Calendar expressions.  Months are DATEs at day one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from isopleth.functions.stats import col


def month_start(ts: Column | str) -> Column:
    return F.trunc(col(ts).cast("date"), "MM")


def month_number(t: Column | str) -> Column:
    """Months since year zero: consecutive months differ by one."""
    c = col(t)
    return F.year(c) * 12 + F.month(c)


def previous_month(ts: Column | str) -> Column:
    """Month of a stamp that marks the right edge of its period."""
    return F.add_months(month_start(ts), -1)


def split_label(t: Column | str, train_end: str, val_end: str) -> Column:
    """0 up to ``train_end``, 1 up to ``val_end``, else 2."""
    c = col(t)
    return (
        F.when(c <= F.lit(train_end).cast("date"), 0)
        .when(c <= F.lit(val_end).cast("date"), 1)
        .otherwise(2)
        .cast("tinyint")
    )


def cyclic(t: Column | str, zero_based: bool = True) -> tuple[Column, Column]:
    """Sine and cosine of the month; January is angle 0 only if ``zero_based``."""
    m = F.month(col(t)) - (1 if zero_based else 0)
    angle = F.lit(2.0 * math.pi) * m / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def from_mjd(day: Column | str) -> Column:
    """Date of a modified Julian day."""
    return F.date_add(F.lit("1858-11-17").cast("date"), col(day).cast("int"))


def exclusive_end(end: str) -> Column:
    """Exclusive bound for an inclusive textual end: a month gets 31 days, a date one."""
    if len(end) == 7:
        return F.date_add(F.lit(end + "-01").cast("date"), 31)
    return F.date_add(F.lit(end[:10]).cast("date"), 1)


def step_code(text: Column | str) -> Column:
    """Date from a ``yyMONdd`` code such as ``20JAN05``; NULL if malformed."""
    c = col(text)
    proper = F.concat(F.substring(c, 1, 2), F.initcap(F.substring(c, 3, 3)), F.substring(c, 6, 2))
    good = F.upper(c).rlike("^[0-9]{2}(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[0-9]{2}$")
    return F.when(good, F.try_to_timestamp(proper, F.lit("yyMMMdd")).cast("date"))
