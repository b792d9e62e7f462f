"""Last written row per key."""

from pyspark.sql import DataFrame, functions as F, types as T

# Types whose aggregation buffer is a fixed-width slot, so that Spark hash-aggregates.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def latest_by_key(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Newest row of each key by ``order``, an ingest sequence unique within a key.

    Aggregates before the shuffle, so one row per key and task travels however hot a
    key is. All-numeric rows use one ``max_by`` per column (hash aggregate, no sort);
    rows with strings travel as one struct, which Spark sort-aggregates.
    """
    values = [f for f in df.schema.fields if f.name not in keys]
    if all(isinstance(f.dataType, _FIXED_WIDTH) for f in values):
        aggregates = [
            (F.max(order) if f.name == order else F.max_by(f.name, order)).alias(f.name)
            for f in values
        ]
        return df.groupBy(*keys).agg(*aggregates).select(*df.columns)
    packed = F.max_by(F.struct(*[f.name for f in values]), order).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def current_snapshot(df: DataFrame, snapshot: str = "snapshot_id", node: str = "node_name") -> DataFrame:
    """Rows of each node's newest snapshot.

    The snapshot numbers are one small row per node, so Spark broadcasts them once it knows
    their bytes, and the history is not sorted.
    """
    newest = df.groupBy(node).agg(F.max(snapshot).alias(snapshot))
    return df.join(newest, [node, snapshot], "left_semi")


def last_per_pid(df: DataFrame, keys: list[str] = ["node_name", "snapshot_id", "pid"]) -> DataFrame:
    """A process id captured twice in one snapshot keeps its last row."""
    return latest_by_key(df, keys, "pos")
