"""Capacity totals and node overviews."""

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.clock import MICROS, micros, seconds_between
from hostweave.functions.usage import ratio_percent
from hostweave.operators.processes import with_previous


def fs_summary(samples: DataFrame, by: list[str] = []) -> DataFrame:
    """Mounts, summed bytes and weighted use, overall or per group; no row for no input."""
    total, used = F.col("total_bytes"), F.col("used_bytes")
    summed = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mounts"),
        F.sum("total_bytes").alias("total_bytes"),
        F.sum("used_bytes").alias("used_bytes"),
        F.sum("avail_bytes").alias("avail_bytes"),
    )
    return summed.filter(F.col("mounts") > 0).withColumn("used_percent", ratio_percent(used, total))


def node_health(samples: DataFrame, now: Column, stale_after_s: int) -> DataFrame:
    """Last sample of each node, its age, and whether the node still reports."""
    seen = samples.groupBy("node_name").agg(
        F.max("collected_at").alias("last_seen"), F.count(F.lit(1)).alias("samples")
    )
    age = seconds_between(F.col("last_seen"), now)
    return seen.select(
        "node_name", "last_seen", "samples", age.alias("age_sec"),
        F.when(age > stale_after_s, F.lit("stale")).otherwise(F.lit("ok")).alias("status"),
    )


def outages(samples: DataFrame, specs: DataFrame, now: Column, factor: int = 3) -> DataFrame:
    """Spans in which a node's feed was silent for more than ``factor`` of its intervals.

    ``samples`` (node_name, feed, collected_at, times unique per feed), ``specs`` (node_name, feed,
    interval_ms, resolved). Gives node_name, feed, outage_from (the last sample before), outage_to (the next one, null
    where the feed is still silent at ``now``), silent_sec and missed, the samples that the span should have had.
    Feeds without a specification or a positive interval have none. The sample before comes
    from :func:`with_previous`, which splits a feed with very many samples by time.
    """
    key = ["node_name", "feed"]
    paired = with_previous(samples.select(*key, "collected_at"), key, "collected_at", ["collected_at"], 86_400)
    between = paired.select(*key, F.col("prev_collected_at").alias("outage_from"), F.col("collected_at").alias("outage_to"))
    last = samples.groupBy(*key).agg(F.max("collected_at").alias("outage_from"))
    open_end = last.select(*key, "outage_from", F.lit(None).cast("timestamp_ntz").alias("outage_to"))
    silent = micros(F.coalesce("outage_to", now)) - micros(F.col("outage_from"))
    spans = between.unionByName(open_end).filter("outage_from IS NOT NULL").withColumn("_silent", silent)
    interval = F.col("interval_ms") * F.lit(1000).cast("bigint")
    long = spans.join(specs.select(*key, "interval_ms").filter("interval_ms > 0"), key).filter(F.col("_silent") > interval * factor)
    whole = F.call_function("div", F.col("_silent"), interval)
    # A sample that is due just when the next one came is not missed.
    missed = whole - F.when(F.col("outage_to").isNotNull() & (F.col("_silent") % interval == 0), 1).otherwise(0)
    seconds = F.call_function("div", F.col("_silent"), F.lit(MICROS).cast("bigint"))
    return long.select(*key, "outage_from", "outage_to", seconds.alias("silent_sec"), missed.alias("missed"))


def collector_status(samples: DataFrame, specs: DataFrame, now: Column, factor: int = 3) -> DataFrame:
    """Each specified feed of each node: last_seen, samples, outages, silent_sec in them, and status.

    ok while the last sample is at most one interval old, late up to ``factor`` intervals, then down;
    unseen without any sample. A feed without a positive interval is ok once it was seen.
    """
    key = ["node_name", "feed"]
    seen = samples.groupBy(*key).agg(F.max("collected_at").alias("last_seen"), F.count(F.lit(1)).alias("samples"))
    spans = outages(samples, specs, now, factor).groupBy(*key).agg(F.count(F.lit(1)).alias("outages"), F.sum("silent_sec").alias("silent_sec"))
    age = micros(now) - micros(F.col("last_seen"))
    interval = F.when(F.col("interval_ms") > 0, F.col("interval_ms") * F.lit(1000).cast("bigint"))
    status = F.when(age.isNull(), "unseen").when(age > interval * factor, "down").when(age > interval, "late").otherwise("ok")
    found = specs.select(*key, "interval_ms").join(seen, key, "left").join(spans, key, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("samples", "outages", "silent_sec")]
    return found.select(*key, "interval_ms", "last_seen", *zero, status.alias("status"))


def fleet_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several nodes as one, with the node's name in front."""
    fleet = None
    for node_name, table in tables.items():
        named = table.select(F.lit(node_name).alias("node_name"), *table.columns)
        fleet = named if fleet is None else fleet.unionByName(named)
    if fleet is None:
        raise ValueError("at least one node must be given")
    return fleet
