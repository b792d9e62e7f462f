"""Report text as JVM expressions.

Decimal places follow the exact binary value of the double, ties to even, as C
``printf`` does. ``format_string`` rounds the shortest decimal text instead
(1.005 -> 1.01), so the digits are worked out in 64-bit integers here.
"""

from pyspark.sql import Column, functions as F

from hostweave.functions.binding import let
from hostweave.functions.clock import seconds_between

# Unit names, one per power of 1024.
BYTE_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")

# Bits kept of the fraction: 10**places * 2**bits must stay below 2**63.
_FRACTION_BITS = {1: 57, 2: 56}


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def fixed_point(value: Column, places: int) -> Column:
    """Text of a DOUBLE with 1 or 2 decimals, exact half-even rounding."""
    step, unit = 10**places, 2 ** _FRACTION_BITS[places]

    def rounded(scaled: Column) -> Column:
        digits, rest = _div(scaled, unit), scaled % F.lit(unit)
        tie_to_odd = (rest == unit // 2) & (digits % 2 == 1)
        return digits + F.when((rest > unit // 2) | tie_to_odd, 1).otherwise(0)

    def counted(size: Column) -> Column:
        """The value as a count of its last decimal place."""
        whole = F.floor(size)
        fraction = ((size - whole.cast("double")) * F.lit(float(unit))).cast("bigint")
        return whole * step + let(fraction * F.lit(step).cast("bigint"), rounded)

    def text(count: Column) -> Column:
        decimals = F.lpad((count % step).cast("string"), places, "0")
        return F.concat(_div(count, step).cast("string"), F.lit("."), decimals)

    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, let(let(F.abs(value), counted), text))


def _unit_ladder(size: Column, units: tuple[str, ...], places: int) -> Column:
    """``N B`` below 1024, else the largest unit that fits, with decimals."""
    divisor, name = F.lit(1024.0), F.lit(units[0])
    for power, unit in enumerate(units[1:], start=2):
        reached = size >= 1024**power
        divisor = F.when(reached, F.lit(float(1024**power))).otherwise(divisor)
        name = F.when(reached, F.lit(unit)).otherwise(name)
    text = let(size.cast("double") / divisor, lambda v: fixed_point(v, places))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(
        F.concat(text, F.lit(" "), name)
    )


def format_bytes(size: Column) -> Column:
    """``500 B``, ``1.50 KB`` .. ``2.00 PB``, and EB from 1 EiB on."""
    return _unit_ladder(size, BYTE_UNITS, 2)


def format_file_size(size: Column) -> Column:
    """``-`` for zero, one decimal, gigabytes at most."""
    return F.when(size == 0, F.lit("-")).otherwise(_unit_ladder(size, BYTE_UNITS[:3], 1))


def format_duration_ms(ms: Column) -> Column:
    seconds = _div(ms, 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(
            (seconds < 60) & (ms % 1000 > 0),
            F.concat(fixed_point(ms.cast("double") / F.lit(1000.0), 1), F.lit("s")),
        )
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(
            F.concat(
                _div(seconds, 60).cast("string"), F.lit("m"),
                (seconds % 60).cast("string"), F.lit("s"),
            )
        )
    )


def format_interval(ms: Column) -> Column:
    """Whole hours, minutes or seconds, ties to even."""

    def in_units(size_ms: float, suffix: str) -> Column:
        rounded = F.bround(ms.cast("double") / F.lit(size_ms), 0).cast("bigint")
        return F.concat(rounded.cast("string"), F.lit(suffix))

    return (
        F.when(ms >= 3_600_000, in_units(3_600_000.0, "h"))
        .when(ms >= 60_000, in_units(60_000.0, "m"))
        .otherwise(in_units(1000.0, "s"))
    )


def format_gauge(percent: Column, width: int) -> Column:
    """Bar of at least three cells and the percentage, clamped to 0..100."""
    cells = max(width, 3)
    clamped = F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))
    filled = (clamped / F.lit(100.0) * F.lit(float(cells))).cast("int")
    return F.concat(
        F.lit("["),
        F.repeat(F.lit("█"), filled),
        F.repeat(F.lit("░"), F.lit(cells) - filled),
        F.lit("] "),
        F.lpad(fixed_point(clamped, 1), 5, " "),
        F.lit("%"),
    )


def format_number(value: Column) -> Column:
    return F.format_number(value, 0)


def format_clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def format_timestamp(ts: Column) -> Column:
    """``-`` where the time is unknown."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def uptime_seconds(started: Column, now: Column) -> Column:
    return seconds_between(started, now)
