"""Stored log lines: tails, search, trimming.

``order`` names the arrival order, newest last: ``id`` within a log; over all logs, where
ids may coincide, with the log's name; batch and byte position where one number cannot
hold them.
"""

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.operators.ranking import TAIL_ROWS, newest_n_counted, top_n_per_group

ARRIVAL = ["id"]
FLEET_ARRIVAL = ["id", "node_name", "log_name"]
LOG_KEY = ["node_name", "log_name"]


def filter_by_name(lines: DataFrame, log_name: str) -> DataFrame:
    return lines.filter(F.col("log_name") == log_name)


def search_log(lines: DataFrame, regex: str) -> DataFrame:
    return lines.filter(F.col("line").rlike(regex))


def _newest(lines: DataFrame, n: int, order: list[str]) -> DataFrame:
    newest = lines.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return newest.orderBy(*order)


def tail_log(
    lines: DataFrame, log_name: str, limit: int | None = TAIL_ROWS, order: list[str] = ARRIVAL
) -> DataFrame:
    """Newest ``limit`` lines of one log, oldest first. No or a bad limit means 200."""
    n = limit if isinstance(limit, int) and limit > 0 else TAIL_ROWS
    return _newest(filter_by_name(lines, log_name), n, order)


def tail_all_logs(lines: DataFrame, order: list[str] = FLEET_ARRIVAL) -> DataFrame:
    """Newest 200 lines over all logs, oldest first."""
    return _newest(lines, TAIL_ROWS, order)


def keep_last_n(
    lines: DataFrame, n: int, keys: list[str] = LOG_KEY, order: list[str] = ARRIVAL
) -> DataFrame:
    """Newest ``n`` lines of every log."""
    newest_first = [F.col(c).desc() for c in order]
    return top_n_per_group(lines, keys, newest_first, n)


def keep_last_per_spec(
    lines: DataFrame, specs: DataFrame, order: list[str] = ARRIVAL
) -> DataFrame:
    """Newest ``max_lines`` of every log, the number taken from its specification.

    Of several specifications of one log the first counts (by ``idx``, if there is such a
    column). Logs without one are kept whole.
    """
    place = "idx" if "idx" in specs.columns else "max_lines"
    first = F.min_by("max_lines", place).alias("_max_lines")
    limits = specs.groupBy("node_name", F.col("name").alias("log_name")).agg(first)
    limited = lines.join(limits, LOG_KEY, "left")
    # One pass: a log without specification has a limit that no row reaches.
    most = F.coalesce(F.col("_max_lines").cast("bigint"), F.lit((1 << 63) - 1))
    return top_n_per_group(limited, LOG_KEY, [F.col(c).desc() for c in order], most).select(*lines.columns)


def log_line_counts(lines: DataFrame, keys: list[str] = LOG_KEY) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"))


def retention(
    rows: DataFrame,
    now: Column,
    days: int,
    max_rows: int,
    bucket: Column,
    keys: list[str] = [],
    time: str = "created_at",
    order: list[str] = ARRIVAL,
) -> DataFrame:
    """Rows younger than ``days`` and among the newest ``max_rows`` of their group.

    The age test reaches the scan; the cap counts rows per ``bucket`` (see
    :func:`newest_n_counted`). Without ``keys`` the cap is over the whole table.
    """
    young = rows.filter(F.col(time) >= now - F.expr(f"INTERVAL '{days}' DAY"))
    grouped = young.withColumn("_table", F.lit(0))
    kept = newest_n_counted(grouped, keys or ["_table"], order, max_rows, bucket)
    return kept.select(*rows.columns)
