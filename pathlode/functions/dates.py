"""UTC days: argument texts, day columns, and times for people."""

import datetime
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
_CYCLE_YEARS, _CYCLE_DAYS = 400, 146_097  # the calendar repeats after 400 years


def epoch_day(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 of any year of the proleptic Gregorian calendar."""
    cycle, in_cycle = divmod(year, _CYCLE_YEARS)
    same_day = datetime.date(_CYCLE_YEARS + in_cycle, month, day)
    return same_day.toordinal() - datetime.date(1970, 1, 1).toordinal() + (cycle - 1) * _CYCLE_DAYS


def day_bounds(text: str, now: int | None = None) -> tuple[int, int]:
    """First and last second of ``today``, ``yesterday`` or ``Y-M-D``."""
    value = text.strip()
    if value.lower() in ("today", "yesterday"):
        now = int(time.time()) if now is None else now
        start = now // DAY * DAY - (DAY if value.lower() == "yesterday" else 0)
    else:
        parts = re.fullmatch(r"\+?([0-9]+)-\+?([0-9]+)-\+?([0-9]+)", value)
        try:
            start = epoch_day(*map(int, parts.groups())) * DAY
        except (AttributeError, ValueError, OverflowError):
            raise ValueError(f"invalid date: {text}") from None
    return start, start + DAY - 1


def start_of_day(seconds: Column) -> Column:
    return seconds - seconds % DAY


def end_of_day(seconds: Column) -> Column:
    return start_of_day(seconds) + (DAY - 1)


def day_start_of_text(text: Column) -> Column:
    """First second of the ``Y-M-D`` day in a text column; null where it is no date."""
    return F.unix_date(F.try_to_date(F.trim(text), "y-M-d")).cast("bigint") * DAY


def format_time(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` in the session time zone; empty when unknown."""
    return F.when(
        seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    ).otherwise(F.lit(""))
