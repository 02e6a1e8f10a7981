"""Dates and deadlines.  Portals print Indian wall clocks; instants are kept as timestamps of a UTC session.

Every function takes ``now``: nothing reads the clock.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
#: The formats that portals print, in order of precedence.
FORMATS = (
    "d-MMM-yyyy h:m a", "d-MMM-yyyy H:m", "d-MMM-yyyy", "d/M/yyyy h:m a", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy h:m a", "d-M-yyyy H:m",
    "d-M-yyyy", "d.M.yyyy H:m", "d.M.yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d MMM yyyy h:m a", "d MMM yyyy", "d MMMM yyyy",
)
_PARTS = {"MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "yyyy": r"\d{4}", "a": "[AaPp][Mm]", **{c: r"\d{1,2}" for c in "dMhHms"}}
_MISSING = ("", "na", "n/a", "not available", "-")


def _shape(form: str) -> str:
    """What a text of a format looks like."""
    return "^" + re.sub("MMMM|MMM|yyyy|[dMhHmsa]|[.]", lambda m: _PARTS.get(m[0], r"\."), form) + "$"


def parse_datetime(raw: Column) -> Column:
    """An instant, or null.  Without an offset the text is Indian time."""
    text = F.trim(F.regexp_replace(raw, r"\s+", " "))
    text = F.when(~F.lower(text).isin(*_MISSING), text)
    local = F.coalesce(*[F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in FORMATS])  # only what has its shape is parsed
    offset = text.rlike(r"[Tt ]\d{1,2}:\d{2}.*(?:[Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text.try_cast("timestamp"))
    return F.coalesce(F.to_utc_timestamp(local, ZONE), F.when(offset, iso).otherwise(F.to_utc_timestamp(iso, ZONE)))


def seconds_until(instant: Column, now: Column) -> Column:
    """Seconds from ``now``, with a fraction."""
    return (F.unix_micros(instant.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(1e6)


def days_until(instant: Column, now: Column) -> Column:
    return F.floor(seconds_until(instant, now) / 86400).cast("int")


def days_remaining(instant: Column, now: Column) -> Column:
    return F.ceil(seconds_until(instant, now) / 86400).cast("int")


def ist_day(instant: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(instant.cast("timestamp"), ZONE), "yyyy-MM-dd")


def ist_month_end(now: Column) -> Column:
    """The last millisecond of ``now``'s Indian month, as an instant."""
    first = F.date_trunc("month", F.from_utc_timestamp(now.cast("timestamp"), ZONE))
    return F.to_utc_timestamp(F.add_months(first, 1).cast("timestamp"), ZONE) - F.expr("INTERVAL 1 MILLISECOND")


def month_start(now: Column) -> Column:
    """The first instant of ``now``'s Indian month."""
    return F.to_utc_timestamp(F.date_trunc("month", F.from_utc_timestamp(now.cast("timestamp"), ZONE)), ZONE)


def time_ago(instant: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days since an instant; null for none."""
    seconds = -seconds_until(instant, now)
    count = lambda unit, size: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, count("m ago", 60)).when(seconds < 86400, count("h ago", 3600)).otherwise(count("d ago", 86400))


def deadline_bucket(instant: Column, now: Column) -> Column:
    days = days_remaining(instant, now)
    return F.when(days < 0, "closed").when(days <= 3, "urgent").when(days <= 7, "soon").when(days.isNotNull(), "later")


def relative_deadline(instant: Column, now: Column) -> Column:
    days = days_remaining(instant, now)
    return (
        F.when(days.isNull(), "No deadline").when(days < 0, "Closed").when(days == 0, "Closes today").when(days == 1, "1 day left")
        .otherwise(F.concat(days.cast("string"), F.lit(" days left")))
    )


def portal_timestamp(raw: Column) -> Column:
    """Epoch milliseconds (above 1e11), epoch seconds, or ISO text whose trailing Z is dropped (it is Indian wall clock)."""
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("long"))
    epoch = F.when(number > 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    text = F.regexp_replace(raw, r"[Zz]$", "").try_cast("timestamp_ntz").cast("timestamp")
    return F.coalesce(epoch, F.to_utc_timestamp(text, ZONE))
