"""Ordered listings, pages and their totals."""

from pyspark.sql import DataFrame, functions as F


def list_fs(samples: DataFrame) -> DataFrame:
    return samples.orderBy("mount_point")


def list_paths(stats: DataFrame) -> DataFrame:
    return stats.orderBy("path")


def get_path_stats(stats: DataFrame, path: str) -> DataFrame:
    """The row of one path; no row when it is unknown."""
    return stats.filter(F.col("path") == path)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _checked(name: str, value) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"invalid {name} parameter") from None
    if number < 0:
        raise ValueError(f"invalid {name} parameter")
    return number


def page(df: DataFrame, order: list[str], limit=0, offset=0) -> DataFrame:
    """Rows ``offset .. offset + limit`` in order; limit 0 lists all and ignores offset.

    Plans as a top-k of ``offset + limit`` rows. For deep pages use :func:`page_after`,
    whose cost does not grow with the page number.
    """
    limit, offset = _checked("limit", limit), _checked("offset", offset)
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if limit else ordered


def page_after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The page following key ``last``: a pushed-down range filter and a top-k."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(_checked("limit", limit))


def page_paths(stats: DataFrame, limit=0, offset=0) -> DataFrame:
    return page(stats, ["path"], limit, offset)


def page_meta(df: DataFrame, limit=0, offset=0) -> DataFrame:
    """Total, limit and offset as one row; limit and offset are NULL for a full list."""
    limit, offset = _checked("limit", limit), _checked("offset", offset)
    return count_rows(df).select(
        "total",
        F.lit(limit or None).cast("int").alias("limit"),
        F.lit(offset if limit else None).cast("int").alias("offset"),
    )
