"""Monitoring specifications as tables: defaults, checks, selection."""

from pyspark.sql import Column, DataFrame, functions as F

# Defaults, times in milliseconds.
DEFAULT_LISTEN = "0.0.0.0:8080"
DEFAULT_DISK_INTERVAL_MS = 15_000
DEFAULT_PATH_INTERVAL_MS = 60_000
DEFAULT_PROCESS_INTERVAL_MS = 10_000
DEFAULT_LOG_INTERVAL_MS = 2_000
DEFAULT_MAX_DEPTH = 10
DEFAULT_TIMEOUT_MS = 30_000
DEFAULT_TOP_N = 50
DEFAULT_MAX_LINES = 1000


def _unless_zero(column: str, *defaults) -> Column:
    given = F.nullif(F.col(column), F.lit(0))
    return F.coalesce(given, *[d if isinstance(d, Column) else F.lit(d) for d in defaults])


def _unless_positive(column: str, default: int) -> Column:
    return F.when(F.col(column) > 0, F.col(column)).otherwise(F.lit(default))


def resolve_node_specs(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns(
        {
            "listen": F.coalesce(F.nullif("listen", F.lit("")), F.lit(DEFAULT_LISTEN)),
            "disk_interval_ms": _unless_zero("disk_interval_ms", DEFAULT_DISK_INTERVAL_MS),
            "path_interval_ms": _unless_zero("path_interval_ms", DEFAULT_PATH_INTERVAL_MS),
            "process_interval_ms": _unless_zero("process_interval_ms", DEFAULT_PROCESS_INTERVAL_MS),
            "log_interval_ms": _unless_zero("log_interval_ms", DEFAULT_LOG_INTERVAL_MS),
        }
    )


def resolve_path_specs(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path specifications with defaults; the scan interval falls back to the node's own."""
    node_default = nodes.select("node_name", F.col("path_interval_ms").alias("_node_interval"))
    return (
        paths.join(node_default, "node_name", "left")
        .withColumns(
            {
                "scan_interval_ms": _unless_zero(
                    "scan_interval_ms", F.nullif(F.col("_node_interval"), F.lit(0)),
                    DEFAULT_PATH_INTERVAL_MS,
                ),
                "max_depth": _unless_zero("max_depth", DEFAULT_MAX_DEPTH),
                "timeout_ms": _unless_zero("timeout_ms", DEFAULT_TIMEOUT_MS),
            }
        )
        .drop("_node_interval")
    )


def resolve_log_specs(logs: DataFrame) -> DataFrame:
    return logs.withColumn("max_lines", _unless_positive("max_lines", DEFAULT_MAX_LINES))


def resolve_process_specs(processes: DataFrame) -> DataFrame:
    return processes.withColumn("top_n", _unless_positive("top_n", DEFAULT_TOP_N))


def _is_blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _first_violation(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(
        F.min_by("message", "rank").alias("message"), F.count(F.lit(1)).alias("violations")
    )


def _list_violations(items: DataFrame, key: str, message: Column, rank: Column) -> DataFrame:
    return items.select(key, rank.alias("rank"), message.alias("message")).dropna(subset=["message"])


def validate_node_specs(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """First violation and their number, per configuration that has any.

    ``nodes`` has ``config_id, node_name``; ``paths`` has ``config_id, idx, path``.
    """
    unnamed = nodes.filter(_is_blank("node_name")).select(
        "config_id", F.lit(0).cast("bigint").alias("rank"),
        F.lit("node_name is required").alias("message"),
    )
    pathless = nodes.join(paths.select("config_id").distinct(), "config_id", "left_anti").select(
        "config_id", F.lit(1).cast("bigint").alias("rank"),
        F.lit("at least one path must be configured").alias("message"),
    )
    empty = _list_violations(
        paths, "config_id",
        F.when(
            _is_blank("path"),
            F.concat(F.lit("path["), F.col("idx").cast("string"), F.lit("]: path is required")),
        ),
        F.col("idx").cast("bigint") + 2,
    )
    return _first_violation(unnamed.unionByName(pathless).unionByName(empty), "config_id")


def validate_client_specs(clients: DataFrame, nodes: DataFrame) -> DataFrame:
    """As above for clients: ``config_id`` and nodes ``config_id, idx, name, address``."""
    nodeless = clients.join(nodes.select("config_id").distinct(), "config_id", "left_anti").select(
        "config_id", F.lit(0).cast("bigint").alias("rank"),
        F.lit("at least one node must be configured").alias("message"),
    )
    label = F.concat(F.lit("nodes["), F.col("idx").cast("string"), F.lit("]: "))
    missing = [
        _list_violations(
            nodes, "config_id",
            F.when(_is_blank(column), F.concat(label, F.lit(f"{column} is required"))),
            F.col("idx").cast("bigint") * 2 + 1 + order,
        )
        for order, column in enumerate(("name", "address"))
    ]
    return _first_violation(
        nodeless.unionByName(missing[0]).unionByName(missing[1]), "config_id"
    )


def select_specs(specs: DataFrame, requested: DataFrame) -> DataFrame:
    """Specifications of the requested paths, in request order (``requested.pos``).

    A path asked for twice comes twice; the first of equal specifications is taken by
    ``spec_pos`` where the table has one.
    """
    keys = [c for c in ("node_name", "path") if c in requested.columns]
    if "spec_pos" in specs.columns:
        others = [c for c in specs.columns if c not in keys]
        specs = specs.groupBy(*keys).agg(F.min_by(F.struct(*others), "spec_pos").alias("s"))
        specs = specs.select(*keys, "s.*")
    return requested.join(specs, keys, "inner").orderBy("pos")


def unknown_paths(specs: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths no specification covers; to be checked before work starts."""
    keys = [c for c in ("node_name", "path") if c in requested.columns]
    return requested.join(specs.select(*keys).distinct(), keys, "left_anti")
