"""Disk usage figures from filesystem counters."""

from pyspark.sql import Column, functions as F


def ratio_percent(used: Column, total: Column) -> Column:
    """``used / total * 100`` as DOUBLE, 0.0 where the total is not positive."""
    return F.when(total > 0, used.cast("double") / total.cast("double") * F.lit(100.0)).otherwise(
        F.lit(0.0)
    )


def total_bytes(blocks: Column, bsize: Column) -> Column:
    return blocks * bsize


def used_bytes(blocks: Column, bfree: Column, bsize: Column) -> Column:
    return blocks * bsize - bfree * bsize


def avail_bytes(bavail: Column, bsize: Column) -> Column:
    return bavail * bsize
