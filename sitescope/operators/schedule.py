"""Schedules: the next run in an organisation's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("daily", "weekly", "monthly")


def _at(local: Column, hour: Column, zone: Column) -> Column:
    """That local day's ``hour``:00 as a time in UTC."""
    return F.to_utc_timestamp(F.date_trunc("DAY", local) + F.make_dt_interval(F.lit(0), hour), zone)


def first_run(now: Column, hour: Column, zone: Column) -> Column:
    local = F.from_utc_timestamp(now, zone)
    today = _at(local, hour, zone)
    return F.when(today > now, today).otherwise(_at(local + F.make_dt_interval(F.lit(1)), hour, zone))


def following_run(previous: Column, now: Column, frequency: str, hour: Column, zone: Column) -> Column:
    """The run after ``previous`` that is still to come; missed ones are skipped. Month ends are cut to the month.

    Computed from the number of periods that have passed, not by counting up.
    """
    local, until = F.from_utc_timestamp(previous, zone), F.from_utc_timestamp(now, zone)
    if frequency == "monthly":
        months = F.greatest(F.floor(F.months_between(F.date_trunc("MONTH", until), F.date_trunc("MONTH", local))), F.lit(0)).cast("int")
        tries = [_at(F.add_months(local, F.greatest(months + k, F.lit(1))).cast("timestamp"), hour, zone) for k in (0, 1, 2)]
    else:
        step = 7 if frequency == "weekly" else 1
        days = F.greatest(F.datediff(until, local), F.lit(0))
        ago = (F.floor(days / step) * step).cast("int")
        tries = [_at(F.date_add(F.to_date(local), F.greatest(ago + k * step, F.lit(step))).cast("timestamp"), hour, zone) for k in (0, 1, 2)]
    return F.when(tries[0] > now, tries[0]).when(tries[1] > now, tries[1]).otherwise(tries[2])


def shown(at: Column, zone: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(at, zone), "d MMMM yyyy, HH:mm"), F.lit(" ("), zone, F.lit(")"))
