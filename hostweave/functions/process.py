"""Fields of a process listing."""

from pyspark.sql import Column, functions as F


# State words by the first letter of the code.
STATES = {
    "": "unknown",
    "R": "running",
    "S": "sleeping",
    "I": "sleeping",
    "D": "disk-wait",
    "Z": "zombie",
    "T": "stopped",
}


def process_state(code: Column) -> Column:
    """State word from the first character of a ``ps`` state code."""
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(code, 1, 1)), F.lit("other"))


def basename(path: Column) -> Column:
    """Last element of a slash path; ``.`` for the empty string, ``/`` for only slashes."""
    bare = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", F.lit("."))
        .when(bare == "", F.lit("/"))
        .otherwise(F.substring_index(bare, "/", -1))
    )


def runtime_seconds(elapsed: Column) -> Column:
    """Seconds in a ``[[dd-]hh:]mm:ss`` elapsed time; NULL when it is not one."""
    shape = r"\A(?:(?:(\d+)-)?(\d+):)?(\d+):(\d+)\z"

    def part(group: int) -> Column:
        text = F.nullif(F.regexp_extract(elapsed, shape, group), F.lit(""))
        return F.coalesce(text.cast("bigint"), F.lit(0))

    return F.when(
        elapsed.rlike(shape),
        part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4),
    )
