"""Streams with a state of their own per key: newest lines of a log, heartbeats, bounded latest rows.

State lies in RocksDB, checkpointed with the query, so nothing is written anew per batch but
what changed. It is bounded: by the number kept per log, by one row per node, and for latest rows
by the watermark.
"""

import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from hostweave.operators.latest import latest_by_key
from hostweave.operators.logs import ARRIVAL, LOG_KEY

#: RocksDB, with native memory bounded per executor and no disk held in advance per partition.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's settings come back after."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _travels() -> None:
    """The processors' code goes to executors with the query, which then need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


# -- newest lines ------------------------------------------------------------------


class _KeepNewest(StatefulProcessor):
    """The newest ``n`` rows of a key, as a list in order; a batch gives what entered and what left."""

    def __init__(self, n: int, keys: list[str], order: list[str], schema: StructType):
        self.n, self.keys, self.order, self.schema = n, keys, order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("kept", self.schema)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = [tuple(r) for r in initialState[self.schema.names].itertuples(index=False)]
        self.held.put(sorted((_plain(r) for r in rows), key=self._place)[-self.n :])

    def _place(self, row: tuple) -> tuple:
        return tuple(row[self.schema.names.index(c)] for c in self.order)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        before = set(kept)
        for batch in rows:
            new = [_plain(r) for r in batch[self.schema.names].itertuples(index=False)]
            # Cut per Arrow batch: no more than n rows and a batch are held at a time.
            kept = sorted({*kept, *new}, key=self._place)[-self.n :]
        after = set(kept)
        if after != before:
            self.held.put(kept)
        changes = [(*r, "left") for r in before - after] + [(*r, "entered") for r in kept if r not in before]
        yield pd.DataFrame(changes, columns=[*self.schema.names, "change"], dtype=object)

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """Python values of a pandas row: missing ones as None, times as Python has them."""
    return tuple(
        None if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
        else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
        for v in row
    )


def _cut_in_task(n: int, keys: list[str], order: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest ``n`` rows of each key in each of a task's batches: more cannot be among the newest of all."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([(c, "descending") for c in order])
        nth, seen = [], {}
        for own in zip(*(rows[c].to_pylist() for c in keys), strict=True):
            seen[own] = seen.get(own, 0) + 1
            nth.append(seen[own] <= n)
        yield from rows.filter(pa.array(nth, pa.bool_())).combine_chunks().to_batches()


def keep_newest(
    lines: DataFrame, n: int, keys: list[str] = LOG_KEY, order: list[str] = ARRIVAL, initial: DataFrame | None = None
) -> DataFrame:
    """Changes to the newest ``n`` rows of each key of a stream: its columns and ``change``, entered or left.

    ``order`` names columns without nulls that tell a key's rows apart, newest last; a row that
    comes twice counts once. State is ``n`` rows a key. Each task first cuts its own input to ``n`` rows a key, so a
    key with very many rows sends few of them to its state. ``initial`` is what another
    checkpoint's state holds (:func:`newest_kept`), for a query that goes on from there.
    Start the query within :func:`keyed_state`, in update mode.
    """
    _travels()
    names = [*keys, *[c for c in lines.columns if c not in keys]]
    schema = StructType([lines.schema[c] for c in lines.columns if c not in keys])
    cut = lines.select(*names).mapInArrow(lambda batches: _cut_in_task(n, keys, order, batches), lines.select(*names).schema)
    processor = _KeepNewest(n, keys, order, schema)
    output = StructType([*[lines.schema[c] for c in keys], *schema.fields]).add("change", "string")
    start = None if initial is None else initial.select(*names).groupBy(*keys)
    grouped = cut.groupBy(*keys)
    return grouped.transformWithStateInPandas(_WithKey(processor, keys), output, "Update", "None", start)


class _WithKey(StatefulProcessor):
    """Puts the key's columns before what a processor gives."""

    def __init__(self, processor, keys: list[str]):
        self.processor, self.keys = processor, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processor.init(handle)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.processor.handleInitialState(key, initialState, timerValues)

    def handleInputRows(self, key, rows, timerValues):
        for out in self.processor.handleInputRows(key, rows, timerValues):
            yield self._with(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for out in self.processor.handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield self._with(key, out)

    def _with(self, key, out: pd.DataFrame) -> pd.DataFrame:
        for i, (name, value) in enumerate(zip(self.keys, key, strict=True)):
            out.insert(i, name, [value] * len(out))
        return out.astype(object)  # plain Python values, which any Arrow type takes

    def close(self) -> None:
        self.processor.close()


def newest_kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that the state of :func:`keep_newest` holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "kept").option("flattenCollectionTypes", True).load(checkpoint)
    return state.select("key.*", "list_element.*")


# -- heartbeats --------------------------------------------------------------------


class _Heartbeat(StatefulProcessor):
    """When a node was last seen; a timer tells when it has been silent for too long."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_seen timestamp_ntz, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((b["last_seen"].max() for b in rows), default=pd.NaT)
        held = self.seen.get() if self.seen.exists() else None
        last = max((x for x in (held and held[0], None if newest is pd.NaT else newest.to_pydatetime()) if x is not None), default=None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        self.seen.update((last, "alive"))
        yield self._row(last, "alive")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.update((last, "stale"))
        yield self._row(last, "stale")

    def _row(self, last, status: str) -> pd.DataFrame:
        return pd.DataFrame([(last, status)], columns=["last_seen", "status"], dtype=object)

    def close(self) -> None:
        pass


def _last_in_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        newest = pa.Table.from_batches([batch]).group_by("node_name").aggregate([("last_seen", "max")])
        yield from newest.rename_columns(["node_name", "last_seen"]).combine_chunks().to_batches()


def heartbeats(samples: DataFrame, timeout_ms: int) -> DataFrame:
    """Changes of each node's state: node_name, last_seen and status.

    A node with input is alive, at its latest ``collected_at`` so far; one without input for
    ``timeout_ms`` of processing time becomes stale, by a timer, without any input, and alive again
    by the next sample. Times may come in any order and be null (a sample still shows life).
    State is a row per node. Start the query within :func:`keyed_state`, in update mode, with a
    processing-time trigger: a run over what is available ends before a timer can.
    """
    _travels()
    seen = samples.select("node_name", F.col("collected_at").cast("timestamp_ntz").alias("last_seen"))
    grouped = seen.mapInArrow(_last_in_task, seen.schema).groupBy("node_name")
    output = "node_name string, last_seen timestamp_ntz, status string"
    return grouped.transformWithStateInPandas(_WithKey(_Heartbeat(timeout_ms), ["node_name"]), output, "Update", "ProcessingTime")


# -- latest rows within a watermark ------------------------------------------------


def latest_in_windows(
    samples: DataFrame, keys: list[str], order: str = "seq", time: str = "collected_at", late: str = "1 hour", width: str = "1 day"
) -> DataFrame:
    """The last written row of each key and event-time window, as far as it changed (update mode).

    A window's state goes when the watermark (latest ``time`` of earlier batches less ``late``) has
    passed its end; rows that come for it later are dropped, as are rows without a time. So state is bounded by
    the keys of the open windows, whatever the history. Over all windows :func:`latest_by_key` has each key's last row.
    """
    marked = samples.withColumn("_event", _instant(samples, time)).withWatermark("_event", late)
    others = [c for c in samples.columns if c not in keys]
    last = F.max_by(F.struct(*others), order).alias("_last")
    windowed = marked.groupBy(F.window("_event", width).alias("_window"), *keys).agg(last)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("_window.start") / 86400).cast("int"))
    return windowed.select(day.alias("window_date"), *keys, "_last.*").select("window_date", *samples.columns)


def _instant(samples: DataFrame, time: str) -> Column:
    """The time as an instant; one without a zone is taken as UTC, whatever the session's zone."""
    if samples.schema[time].dataType.typeName() != "timestamp_ntz":
        return F.col(time).cast("timestamp")
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', `{time}`)"))


def first_copies(samples: DataFrame, keys: list[str], time: str = "collected_at", late: str = "1 hour") -> DataFrame:
    """The first row of each ``keys`` value to come, forgotten once the watermark is ``late`` past it (append mode).

    A copy that comes within ``late`` of the first is dropped; a row behind the watermark is dropped, too.
    """
    marked = samples.withColumn("_event", _instant(samples, time)).withWatermark("_event", late)
    return marked.dropDuplicatesWithinWatermark(keys).drop("_event")


def latest_of_windows(stored: DataFrame, keys: list[str], order: str = "seq", since: Column | None = None) -> DataFrame:
    """Each key's last row in what the batches of :func:`latest_in_windows` stored; ``since`` a date prunes older windows."""
    rows = stored if since is None else stored.where(F.col("window_date") >= since)
    return latest_by_key(rows.drop("run", "batch_id", "window_date"), keys, order)
