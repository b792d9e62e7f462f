"""Severity words. All thresholds are strict."""

from pyspark.sql import Column, functions as F

# Thresholds and status words.
PERCENT_CRITICAL, PERCENT_WARNING = 90, 75
CPU_CRITICAL, CPU_WARNING = 80, 50
STATUS_OK = ("OK", "ok", "connected")
STATUS_WARNING = ("SCANNING", "WARNING", "warning")
STATUS_CRITICAL = ("ERROR", "error", "CRITICAL", "critical")


def _above(value: Column, critical: float, warning: float, calm: str) -> Column:
    return (
        F.when(value > critical, F.lit("critical"))
        .when(value > warning, F.lit("warning"))
        .otherwise(F.lit(calm))
    )


def severity_percent(percent: Column) -> Column:
    return _above(percent, PERCENT_CRITICAL, PERCENT_WARNING, "ok")


def severity_cpu(cpu: Column) -> Column:
    return _above(cpu, CPU_CRITICAL, CPU_WARNING, "normal")


def severity_process_state(state: Column) -> Column:
    return (
        F.when(state == "running", F.lit("ok"))
        .when(state == "zombie", F.lit("critical"))
        .when(state == "stopped", F.lit("warning"))
        .otherwise(F.lit("neutral"))
    )


def severity_status(status: Column) -> Column:
    """Case-sensitive classification of a status word."""
    return (
        F.when(status.isin(*STATUS_OK), F.lit("ok"))
        .when(status.isin(*STATUS_WARNING), F.lit("warning"))
        .when(status.isin(*STATUS_CRITICAL), F.lit("critical"))
        .otherwise(F.lit("neutral"))
    )
