"""``foreachBatch`` sinks. Each is repeatable: a batch written twice leaves one copy.

Batches are told apart by the stream that writes them, so a new checkpoint on an existing
table adds to it and replaces nothing.
"""

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave.operators.latest import current_snapshot, last_per_pid, latest_by_key
from hostweave.operators.ranking import newest_by_quota, rows_before
from hostweave.streaming.versions import apply_batch, file_system, run_of
from hostweave.workspace import fresh_dir

BatchSink = Callable[[DataFrame, int], None]

STORED_LINES = (
    "node_name string, log_path string, line_offset bigint, line string, oversize_line string, "
    "created_at timestamp_ntz, run string, batch_id bigint, created_date date, log_name string"
)

#: Order of arrival of stored lines within a log; with the file for a log of several files.
STORED_ORDER = ["run", "batch_id", "log_path", "line_offset"]


def _run_folder(spark: SparkSession, base: str) -> str:
    """Folder of the writing stream's batches. Streams are numbered in the order in which they
    came to the table, so that the order of folders is the order of arrival."""
    hadoop, fs = file_system(spark, base)
    names = [s.getPath().getName() for s in fs.globStatus(hadoop.Path(f"{base}/run=*")) or []]
    own = run_of(spark)
    for name in names:
        if name.endswith(f"-{own}"):
            return f"{base}/{name}"
    taken = [int(re.match(r"run=(\d+)", name)[1]) for name in names]
    return f"{base}/run={max(taken, default=-1) + 1:08d}-{own}"


def append_history(base: str) -> BatchSink:
    """Appends every batch as ``run=<nth stream>/batch_id=<n>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = _run_folder(batch.sparkSession, base)
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def append_log(base: str) -> BatchSink:
    """Appends log lines, a folder per stream, batch, day and log.

    Lines of a log arrived in ``STORED_ORDER``: no number has to hold it, so neither batches nor
    positions have a limit. Rows of a day and log are gathered by a rebalancing shuffle, which splits
    a log with many lines over several files and leaves one of few lines one file, whatever the number of tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = _run_folder(batch.sparkSession, base)
        dated = batch.withColumn("created_date", F.to_date("created_at"))
        target = f"{folder}/batch_id={batch_id}"
        even = dated.hint("rebalance", "created_date", "log_name")
        even.write.mode("overwrite").partitionBy("created_date", "log_name").parquet(target)

    return write


def read_log_table(spark: SparkSession, base: str) -> DataFrame:
    """Lines stored by :func:`append_log`; log names stay text even when they are numbers."""
    return spark.read.schema(STORED_LINES).parquet(base)


def retain_stored(
    spark: SparkSession, base: str, today: Column, days: int, max_rows: int, keys: list[str] = []
) -> None:
    """Drops stored lines older than ``days`` days, and all but the newest ``max_rows`` (of each
    ``keys`` group, or of the table): whole day folders where a day goes as a whole.

    Lines are counted per day, which reads no line. Only day folders that the cap cuts through
    are written again, with what stays of them.
    """
    stored = read_log_table(spark, base)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    groups = [c.alias(f"_g{i}") for i, c in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    counts = stored.groupBy("created_date", *groups).agg(F.count(F.lit(1)).alias("_rows"))
    quota = F.lit(max_rows) - rows_before(F.col("_rows"), names, [F.col("created_date").desc()])
    young = F.col("created_date") >= F.date_sub(today, days)
    state = counts.withColumn("_quota", F.when(young, quota).otherwise(F.lit(0)))
    # Stored before any folder goes: nothing later may look for files that are gone.
    folder = fresh_dir(spark, "retention")
    state.write.parquet(folder)
    state = spark.read.schema(state.schema).parquet(folder)
    by_day = state.groupBy("created_date").agg(
        F.max(F.col("_quota") > 0).alias("_some"), F.min(F.col("_quota") >= F.col("_rows")).alias("_all")
    )
    hadoop, fs = file_system(spark, base)
    _restore(base, fs, hadoop)
    for day, some, whole in by_day.where("NOT _all").collect():  # at most one row per day
        folders = fs.globStatus(hadoop.Path(f"{base}/run=*/batch_id=*/created_date={day}")) or []
        if some:
            _trim_day(read_log_table(spark, base), state, day, groups, names, base, fs, hadoop)
        else:
            for status in folders:
                fs.delete(status.getPath(), True)


def _trim_day(stored, state, day, groups, names, base, fs, hadoop) -> None:
    """Replaces one day's folders by what the cap leaves of them. The old folder is set aside until
    the new one stands, and comes back (:func:`_restore`) if the job ends in between."""
    lines = stored.where(F.col("created_date") == F.lit(day)).select("*", *groups)
    quotas = state.where(F.col("created_date") == F.lit(day)).select(*names, "_rows", "_quota")
    kept = newest_by_quota(lines, quotas, names, STORED_ORDER).drop(*names)
    spare = f"{base}/_trimmed/{day}"
    kept.write.mode("overwrite").partitionBy("run", "batch_id", "created_date", "log_name").parquet(spare)
    for status in fs.globStatus(hadoop.Path(f"{base}/run=*/batch_id=*/created_date={day}")) or []:
        path = status.getPath()
        part = f"{path.getParent().getParent().getName()}/{path.getParent().getName()}/{path.getName()}"
        aside = hadoop.Path(f"{base}/_aside/{part}")
        fs.mkdirs(aside.getParent())
        fs.rename(path, aside)
        if fs.exists(hadoop.Path(f"{spare}/{part}")):
            fs.rename(hadoop.Path(f"{spare}/{part}"), path)
        fs.delete(aside, True)
    fs.delete(hadoop.Path(f"{base}/_trimmed"), True)
    fs.delete(hadoop.Path(f"{base}/_aside"), True)


def _restore(base: str, fs, hadoop) -> None:
    for status in fs.globStatus(hadoop.Path(f"{base}/_aside/run=*/batch_id=*/created_date=*")) or []:
        part = status.getPath().toString().split("/_aside/")[1]
        if fs.exists(hadoop.Path(f"{base}/{part}")):
            fs.delete(status.getPath(), True)
        else:
            fs.rename(status.getPath(), hadoop.Path(f"{base}/{part}"))


def upsert_latest(base: str, keys: list[str], order: str = "seq") -> BatchSink:
    """Keeps one row per key, the last written one. Rewrites the table, one row per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def change(held: DataFrame | None) -> DataFrame:
            return latest_by_key(batch if held is None else held.unionByName(batch), keys, order)

        apply_batch(batch, batch_id, base, change)

    return write


def replace_snapshot(base: str) -> BatchSink:
    """Keeps each node's newest process snapshot; readers see whole snapshots only.

    A snapshot is expected within one batch. Nodes absent from a batch keep theirs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.persist()  # read twice: for the snapshot numbers and for the rows

        def change(held: DataFrame | None) -> DataFrame:
            return last_per_pid(current_snapshot(fresh if held is None else held.unionByName(fresh)))

        try:
            apply_batch(fresh, batch_id, base, change)
        finally:
            fresh.unpersist()

    return write


def trim_log(base: str, keep: Callable[[DataFrame], DataFrame]) -> BatchSink:
    """Keeps what ``keep`` keeps: ``keep_last_n`` or ``keep_last_per_spec``.

    The batch is cut before it meets the held lines, so a batch costs its own size and that of
    the kept lines, which are written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def change(held: DataFrame | None) -> DataFrame:
            newest = keep(batch)
            return newest if held is None else keep(held.unionByName(newest))

        apply_batch(batch, batch_id, base, change)

    return write


def store(base: str) -> BatchSink:
    """Replaces the table by the batch: for a complete-mode aggregate."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, base, lambda held: batch)

    return write


def all_of(*sinks: BatchSink) -> BatchSink:
    """Feeds one batch to several sinks, reading its source once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, batch_id)
        finally:
            held.unpersist()

    return write


def compact_table(df: DataFrame, target: str, files: int, by: list[str] = []) -> None:
    """Rewrites a table of many small files into about ``files`` even ones.

    With ``by``, a partition value gets as many of them as its share of the rows asks for, at
    least one: rows are dealt by value and a salt, so a hot value still spreads over many writers
    and a rare one is one file. Values are counted first, in one pass over their columns.
    """
    if not by:
        df.repartition(files).write.mode("overwrite").parquet(target)
        return
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"), F.count(F.lit(1)).alias("_values")).first()
    share = F.greatest(F.lit(1), F.round(F.col("_rows") * files / (total["_total"] or 1)))
    sized = counts.select(*[F.col(c).alias(f"_{c}") for c in by], share.cast("long").alias("_files"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    on = same[0]
    for one in same[1:]:
        on = on & one
    salted = df.join(sized, on).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
    dealt = salted.repartition(files + total["_values"], *by, "_salt").select(*df.columns)
    dealt.write.mode("overwrite").partitionBy(*by).parquet(target)
