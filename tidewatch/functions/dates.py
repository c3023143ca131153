"""Weeks, anchors and seasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week_start(year: Column, week: Column) -> Column:
    """The Monday of an ISO week; null where the year has no such week."""
    y = F.when(year.between(1, 9998), year.cast("int"))
    fourth = F.make_date(y, F.lit(1), F.lit(4))
    day = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (F.when(week.between(1, 53), week.cast("int")) - 1) * 7)
    return F.when(F.year(F.date_add(day, 3)) == y, day)


def to_anchor(day: Column, anchor: int) -> Column:
    """The nearest day with the weekday ``anchor`` (Monday 0); 3 days back and 4 forward at most."""
    behind = F.pmod(F.weekday(day) - anchor, F.lit(7))
    return F.when(behind <= 3, F.date_sub(day, behind)).otherwise(F.date_add(day, 7 - behind))


def from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts; null where there is no such date."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "pre_monsoon")
        .when(month.between(6, 9), "monsoon").when(month.isin(10, 11), "post_monsoon")
    )
