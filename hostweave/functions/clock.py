"""Zone-free time arithmetic on TIMESTAMP_NTZ."""

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock time; no session zone is involved."""
    seconds = F.unix_date(F.to_date(ts)) * F.lit(86400).cast("bigint") + (
        F.hour(ts) * 3600 + F.minute(ts) * 60
    )
    fraction = (F.extract(F.lit("SECOND"), ts) * MICROS).cast("bigint")
    return seconds * MICROS + fraction


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, towards zero."""
    return F.call_function("div", micros(end) - micros(start), F.lit(MICROS).cast("bigint"))
