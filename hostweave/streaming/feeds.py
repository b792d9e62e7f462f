"""Streaming queries, one per feed, so that a slow feed does not hold up the others."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave.sources.registry import register_source
from hostweave.sources.taillog import FORMAT, LogTail
from hostweave.streaming.sinks import BatchSink


def tail_logs(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """Stream of new log lines; options as in :class:`LogTail`."""
    register_source(spark, LogTail)
    reader = spark.readStream.format(FORMAT).options(**options)
    return reader.load(pattern).withColumn("created_at", F.localtimestamp())


def read_whole_logs(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """All lines of the files now, with their byte positions."""
    register_source(spark, LogTail)
    return spark.read.format(FORMAT).options(**options).load(pattern)


def run_feed(
    stream: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    every: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Starts a feed: once over what is available, or with ``every`` periodically.

    A run longer than the period delays the next one and never overlaps it.
    """
    writer = stream.writeStream.outputMode(output_mode).foreachBatch(sink)
    writer = writer.option("checkpointLocation", checkpoint)
    return (
        writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    ).start()


def drain(
    stream: DataFrame, sink: BatchSink, checkpoint: str, output_mode: str = "append"
) -> None:
    """Runs a feed over all available input and waits for it."""
    run_feed(stream, sink, checkpoint, output_mode=output_mode).awaitTermination()


def drain_backlog(stream: Callable[[], DataFrame], sink: BatchSink, checkpoint: str) -> int:
    """Runs a feed with admission control until nothing is left; the number of runs that had input.

    A run over what is available is one batch of a tail, so of one budget.
    """
    runs = 0
    while True:
        run = run_feed(stream(), sink, checkpoint)
        run.awaitTermination()
        if not any(p["numInputRows"] for p in run.recentProgress):
            return runs
        runs += 1


def last_seen(samples: DataFrame) -> DataFrame:
    """Latest sample time per node; for a stream, in complete mode (one row per node)."""
    return samples.groupBy("node_name").agg(F.max("collected_at").alias("last_seen"))
