"""Schemas of the telemetry tables.

Timestamps are ``TIMESTAMP_NTZ``: captures carry a wall clock and no zone, and
results must not depend on the session time zone.
"""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampNTZType()

FS_COUNTERS = _struct(
    ("node_name", _S), ("mount_point", _S), ("blocks", _L), ("bfree", _L), ("bavail", _L),
    ("bsize", _L), ("collected_at", _TS), ("seq", _L),
)
FS_SAMPLES = _struct(
    ("node_name", _S), ("mount_point", _S), ("total_bytes", _L), ("used_bytes", _L),
    ("avail_bytes", _L), ("used_percent", _D), ("collected_at", _TS), ("seq", _L),
)
PATH_STATS = _struct(
    ("node_name", _S), ("path", _S), ("file_count", _L), ("dir_count", _L),
    ("scan_duration_ms", _L), ("status", _S), ("error_message", _S), ("collected_at", _TS),
    ("seq", _L),
)
PATH_INVENTORY = _struct(
    ("node_name", _S), ("path", _S), ("is_dir", _B), ("size", _L), ("mtime", _TS),
    ("snapshot_id", _L),
)
PROCESS_SAMPLES = _struct(
    ("node_name", _S), ("snapshot_id", _L), ("pos", _L), ("pid", _L), ("name", _S), ("user", _S),
    ("cpu_percent", _D), ("mem_rss", _L), ("status", _S), ("elapsed", _S), ("collected_at", _TS),
)
CAPTURE_LINES = _struct(
    ("node_name", _S), ("capture_id", _S), ("pos", _L), ("line", _S),
)
LOG_LINES = _struct(
    ("node_name", _S), ("id", _L), ("log_name", _S), ("log_path", _S), ("line", _S),
    ("created_at", _TS),
)
NODE_SPECS = _struct(
    ("node_name", _S), ("listen", _S), ("db_path", _S), ("disk_interval_ms", _L),
    ("path_interval_ms", _L), ("process_interval_ms", _L), ("log_interval_ms", _L),
)
PATH_SPECS = _struct(
    ("node_name", _S), ("path", _S), ("scan_interval_ms", _L), ("max_depth", _I),
    ("exclude", T.ArrayType(_S)), ("timeout_ms", _L),
)
LOG_SPECS = _struct(("node_name", _S), ("name", _S), ("path", _S), ("max_lines", _I))
PROCESS_SPECS = _struct(("node_name", _S), ("patterns", T.ArrayType(_S)), ("top_n", _I))
