"""Times as ISO 8601 strings, without a zone: the strings mean what the clock of the column shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """2024-01-31T09:05:00, with six digits of a second's fraction if it isn't whole."""
    t = ts.cast("timestamp_ntz")
    fraction = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))


def from_iso(c: Column) -> Column:
    """The time of an ISO string, null if it isn't one."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds from 1970 by the clock of the column."""
    day, second = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.hour(ts) * 3600 + F.minute(ts) * 60
    return (day * 86400 + second) * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
