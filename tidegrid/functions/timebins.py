"""Time expressions on zone-less timestamps. Bins are epoch arithmetic on the wall clock, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp."""
    return F.unix_timestamp(_c(ts).cast("timestamp_ntz"))


def from_epoch(seconds: Column) -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def time_bin(ts: Column | str, seconds: int) -> Column:
    """Start of the bin of ``seconds`` that holds ``ts``; floors below 1970 too."""
    return from_epoch(F.floor(epoch(ts) / F.lit(seconds)) * seconds)


def zoned(ts: Column | str, tz: str) -> Column:
    """The wall clock in ``tz`` of an instant, for sources that hold instants."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz"))


def calendar(ts: Column | str) -> dict[str, Column]:
    """Calendar parts: hour, minute, day of week from Sunday 1 and from Monday 0, month, year, day, ISO week, slot, weekend flags."""
    ts = _c(ts)
    monday0 = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "dow_sunday1": F.dayofweek(ts),
        "dow_monday0": monday0,
        "month": F.month(ts),
        "year": F.year(ts),
        "day": F.dayofmonth(ts),
        "iso_week": F.weekofyear(ts),
        "slot_30m": half_hour_slot(ts),
        "is_weekday": (monday0 < 5).cast("int"),
        "is_weekend": (monday0 >= 5).cast("int"),
        "day_name": F.date_format(ts, "EEEE"),
        "date": F.to_date(ts),
    }


def half_hour_slot(ts: Column | str) -> Column:
    return (F.hour(_c(ts)) * 2 + F.floor(F.minute(_c(ts)) / F.lit(30))).cast("int")


def time_index(ts: Column | str, origin: Column | str, seconds: int) -> Column:
    """Number of whole bins between ``origin`` and ``ts``."""
    return F.floor((epoch(ts) - epoch(origin)) / F.lit(seconds)).cast("long")


def minutes_between(begin: Column | str, end: Column | str) -> Column:
    return (epoch(end) - epoch(begin)) / F.lit(60.0)
