"""Runs of scheduled jobs: the next ones, those of a span of time, and those that did not happen."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions.clock import seconds_between
from hostweave.functions.schedule import allowed_numbers, is_unrestricted, spelled_out

# Days searched: two months serve nearly every schedule; eight years hold every
# combination of day and month, February 29th included.
NEAR_DAYS, FAR_DAYS = 62, 8 * 366 + 1


def _days(start: dt.date, count: int) -> Column:
    end = start + dt.timedelta(days=count - 1)
    return F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))


def _calendar(jobs: DataFrame) -> tuple[DataFrame, Callable[[Column], Column], Column]:
    """The jobs with the sets of their schedule's fields, whether one runs on a day, and whether it is sound."""
    fields = F.split(spelled_out(F.col("schedule")), r"\s+")
    parts = jobs.withColumn("_f", F.when(F.size(fields) == 5, fields))
    kinds = ("minute", "hour", "dom", "month", "dow")
    sets = parts.withColumns(
        {f"_{kind}": allowed_numbers(F.col("_f")[i], kind) for i, kind in enumerate(kinds)}
    )
    minute, hour, dom, month, dow = (F.col(f"_{kind}") for kind in kinds)
    any_day = is_unrestricted(F.col("_f")[2]) | is_unrestricted(F.col("_f")[4])

    def runs_on(day: Column) -> Column:
        by_date = F.array_contains(dom, F.dayofmonth(day))
        by_weekday = F.array_contains(dow, F.dayofweek(day) - 1)
        fits = F.when(any_day, by_date & by_weekday).otherwise(by_date | by_weekday)
        return F.array_contains(month, F.month(day)) & fits

    valid = minute.isNotNull() & hour.isNotNull() & dom.isNotNull() & month.isNotNull() & dow.isNotNull()
    return sets, runs_on, valid


def expected_runs(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    """Adds ``next_run``, the first minute after ``now`` that the ``schedule`` allows.

    NULL for a malformed schedule or one that never comes true. Jobs share schedules, so
    the search is made once per distinct schedule and joined back.
    """
    schedules = jobs.select("schedule").distinct()
    return jobs.join(next_runs(schedules, now), "schedule", "left").select(
        *jobs.columns, "next_run"
    )


def next_runs(jobs: DataFrame, now: dt.datetime) -> DataFrame:
    """As :func:`expected_runs`, row by row. With both day fields restricted either may
    match, as in cron. Narrow: no calendar is joined.
    """
    sets, runs_on, valid = _calendar(jobs)
    minute, hour = F.col("_minute"), F.col("_hour")

    today, past = now.date(), now.hour * 60 + now.minute
    times = F.flatten(F.transform(hour, lambda h: F.transform(minute, lambda m: h * 60 + m)))
    later_today = F.array_min(F.filter(times, lambda t: t > past))
    first_of_day = hour[0] * 60 + minute[0]
    tomorrow = today + dt.timedelta(days=1)
    next_day = F.coalesce(
        F.get(F.filter(_days(tomorrow, NEAR_DAYS), runs_on), F.lit(0)),
        F.get(F.filter(_days(tomorrow, FAR_DAYS), runs_on), F.lit(0)),
    )
    runs_today = runs_on(F.lit(today)) & later_today.isNotNull()
    day = F.when(runs_today, F.lit(today)).otherwise(next_day)
    at = F.when(runs_today, later_today).otherwise(first_of_day)
    next_run = day.cast("timestamp_ntz") + F.make_dt_interval(mins=at)
    return sets.withColumn("next_run", F.when(valid, next_run)).select(*jobs.columns, "next_run")


def runs_between(jobs: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """A row per job and ``run_at``, each minute in [start, end) that the ``schedule`` allows.

    Runs are made once per distinct schedule, day by day, and joined to the jobs that share it.
    Malformed schedules and @reboot have none.
    """
    sets, runs_on, valid = _calendar(jobs.select("schedule").distinct())
    days = _days(start.date(), (end.date() - start.date()).days + 1)
    # Outer, as Spark would move the filter that a plain explode brings, and with it the reading of
    # the schedule, below distinct() to every job. What has no day, hour or minute is not inside.
    on_days = sets.withColumn("_day", F.explode_outer(F.when(valid, F.filter(days, runs_on))))
    hours = on_days.withColumn("_h", F.explode_outer("_hour")).withColumn("_m", F.explode_outer("_minute"))
    at = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("_h"), mins=F.col("_m"))
    low, high = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
    inside = (F.col("run_at") >= low) & (F.col("run_at") < high)
    return jobs.join(hours.select("schedule", at.alias("run_at")).filter(inside), "schedule").select(*jobs.columns, "run_at")


def missed_runs(expected: DataFrame, observed: DataFrame, keys: list[str], late_s: int) -> DataFrame:
    """Expected runs (keys, run_at) with ``started_at``, the first observed start (keys, started_at) of each,
    and ``outcome``: ran, late (more than ``late_s`` seconds after) or missed.

    A start belongs to the last run due by then. Both sides are put in one order of time per job, in which
    a run's first start is the row after it: no join on a range, and no aggregate that holds a task's runs.
    """
    runs = expected.filter("run_at IS NOT NULL").select(*keys, F.col("run_at").alias("_at"), F.lit(False).alias("_start"))
    starts = observed.filter("started_at IS NOT NULL").select(*keys, F.col("started_at").alias("_at"), F.lit(True).alias("_start"))
    in_time = Window.partitionBy(*keys).orderBy("_at", "_start")
    after = {"_after": F.lead("_at").over(in_time), "_started": F.lead("_start").over(in_time)}
    at, later, started = F.col("_at"), F.col("_after"), F.col("_started")
    last_of_equal = started.isNull() | started | (later != at)  # a run may be expected several times
    found = runs.unionByName(starts).withColumns(after).filter(~F.col("_start") & last_of_equal)
    delay = seconds_between(at, later)
    outcome = F.when(delay > late_s, "late").otherwise("ran")
    return found.select(
        *keys, at.alias("run_at"), F.when(started, later).alias("started_at"), F.when(started, outcome).otherwise("missed").alias("outcome")
    )
