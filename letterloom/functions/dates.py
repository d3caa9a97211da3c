"""Date functions relative to a given moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str | datetime | Column) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def week_start(day: Column) -> Column:
    """The Sunday on or before ``day``."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def date_bucket(date: Column, as_of) -> Column:
    day, today = F.to_date(date), F.to_date(moment(as_of))
    return (F.when(day == today, "Today")
            .when(day == F.date_sub(today, 1), "Yesterday")
            .when(week_start(day) == week_start(today), "This week")
            .when(F.trunc(day, "month") == F.trunc(today, "month"), "This month")
            .otherwise("Earlier"))


def age_days(date: Column, as_of) -> Column:
    """Whole days between ``date`` and ``as_of``, never negative."""
    return F.greatest(F.lit(0).cast("bigint"),
                      F.timestamp_diff("DAY", date, moment(as_of)))


def snooze_until(preset: Column, as_of) -> Column:
    """When a snoozed message returns, by preset name; NULL for unknown presets."""
    now = moment(as_of)
    today = F.to_date(now)
    # Saturday is day 7; on a Saturday the next one is a week away.
    to_saturday = F.when(F.dayofweek(today) == 7, 7).otherwise(7 - F.dayofweek(today))
    at = lambda day, hour: (
        day.cast("timestamp_ntz") + F.make_interval(hours=F.lit(hour)))
    return (F.when(preset == "later-today", now + F.make_interval(hours=F.lit(4)))
            .when(preset == "tomorrow", at(F.date_add(today, 1), 9))
            .when(preset == "next-week", at(F.date_add(today, 7), 9))
            .when(preset == "weekend", at(F.date_add(today, to_saturday), 10)))
