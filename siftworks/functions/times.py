"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    since = ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = (F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)) * 60 + F.extract(F.lit("MINUTE"), since)
    return seconds.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")
