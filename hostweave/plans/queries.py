"""The registered queries: each operator over whole tables."""

import datetime as dt
import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.functions import formatting as fmt, severity as sev
from hostweave.functions.process import process_state, runtime_seconds
from hostweave.operators import jsonrows, logs, paging, paths, processes, ranking, summary
from hostweave.operators.latest import current_snapshot, last_per_pid, latest_by_key
from hostweave.operators.schedule import expected_runs, missed_runs, runs_between
from hostweave.plans.bindings import Bindings
from hostweave.sources import specs
from hostweave.sources.crontabs import parse_crontabs
from hostweave.sources.filesystems import (
    exclude_pseudo_fs,
    fs_samples_from_counters,
    only_block_devices,
    parse_mount_captures,
    read_fs_samples,
)
from hostweave.sources.inventory import read_path_inventory, scan_file_tree
from hostweave.sources.logs import log_file_info, read_log_files
from hostweave.sources.processes import parse_ps_captures
from hostweave.sources.transfers import list_transfers, parse_transfer_log
from hostweave.streaming import feeds, keyed, sinks
from hostweave.streaming.versions import file_system, read_version
from hostweave.workspace import fresh_dir

NOW = dt.datetime(2024, 1, 30, 10, 7, 30)
HEALTH_NOW = dt.datetime(2024, 1, 31)
MOUNT = ["node_name", "mount_point"]

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def _query(build: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
    _registered[build.__name__] = lambda spark, sf_dir: build(Bindings(spark, sf_dir))
    return build


def registered() -> dict[str, Query]:
    return dict(_registered)


def _now(moment: dt.datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _samples(b: Bindings) -> DataFrame:
    return fs_samples_from_counters(b.fs_counters())


def _latest_mounts(b: Bindings) -> DataFrame:
    return latest_by_key(_samples(b), MOUNT)


def _processes(b: Bindings) -> DataFrame:
    return parse_ps_captures(b.ps_lines())


def _current_processes(b: Bindings) -> DataFrame:
    """The newest capture of each node, chosen before any line is parsed."""
    return last_per_pid(parse_ps_captures(current_snapshot(b.ps_lines())))


# -- filesystems -------------------------------------------------------------------


@_query
def fs_usage_derive(b: Bindings) -> DataFrame:
    return _samples(b)


@_query
def fs_latest(b: Bindings) -> DataFrame:
    return _latest_mounts(b)


@_query
def fs_list(b: Bindings) -> DataFrame:
    return paging.list_fs(_latest_mounts(b)).select(*MOUNT, "total_bytes", "used_bytes")


@_query
def fs_summary(b: Bindings) -> DataFrame:
    return summary.fs_summary(_latest_mounts(b))


@_query
def fs_summary_by_node(b: Bindings) -> DataFrame:
    by_node = summary.fs_summary(_latest_mounts(b), ["node_name"])
    return by_node.withColumn("severity", sev.severity_percent(F.col("used_percent")))


@_query
def fs_severity(b: Bindings) -> DataFrame:
    return _samples(b).select("seq", sev.severity_percent(F.col("used_percent")).alias("severity"))


@_query
def fs_read_landed(b: Bindings) -> DataFrame:
    """Counters landed as JSON and read back."""
    landed = fresh_dir(b.spark, "landed")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    b.fs_counters().write.option("timestampNTZFormat", micros).json(landed)
    return read_fs_samples(b.spark, landed)


@_query
def mount_real_disks(b: Bindings) -> DataFrame:
    """The two mount filters on their own."""
    fields = F.split("line", r"\s+")
    split = b.mount_lines("linux").select("pos", fields[0].alias("device"), F.get(fields, F.lit(2)).alias("fstype"))
    return only_block_devices(exclude_pseudo_fs(split))


@_query
def mount_parse(b: Bindings) -> DataFrame:
    return parse_mount_captures(b.mount_lines("linux"))


@_query
def mount_parse_bsd(b: Bindings) -> DataFrame:
    return parse_mount_captures(b.mount_lines("bsd"), dialect="bsd")


@_query
def mount_first_device(b: Bindings) -> DataFrame:
    lines = b.mount_lines("bsd")
    failed = lines.filter(F.col("pos") % 3 == 0).select(
        "node_name", "capture_id",
        F.concat(F.lit("/mnt/"), F.col("pos").cast("string"), F.lit(" on (x)")).alias("mount_point"),
    )
    return parse_mount_captures(lines, dialect="bsd", unreachable=failed)


# -- processes ---------------------------------------------------------------------


@_query
def ps_parse(b: Bindings) -> DataFrame:
    return _processes(b)


@_query
def proc_glob_filter(b: Bindings) -> DataFrame:
    kept = processes.match_any_glob(_processes(b), ["view?", "PURCHASE", "*:1]"])
    return kept.select("node_name", "pos", "name")


@_query
def proc_spec_globs(b: Bindings) -> DataFrame:
    specified = specs.resolve_process_specs(b.process_specs())
    return processes.match_spec_globs(_processes(b), specified).select(
        "node_name", "pos", "name", "top_n"
    )


@_query
def proc_first_n(b: Bindings) -> DataFrame:
    kept = ranking.first_n_in_capture(_processes(b), 20)
    return kept.select("node_name", "snapshot_id", "pos", "pid")


@_query
def proc_spec_first_n(b: Bindings) -> DataFrame:
    specified = specs.resolve_process_specs(b.process_specs())
    matched = processes.match_spec_globs(_processes(b), specified)
    kept = ranking.first_n_in_capture(matched, F.col("top_n"))
    return kept.select("node_name", "snapshot_id", "pos", "name")


@_query
def proc_snapshot_latest(b: Bindings) -> DataFrame:
    return _current_processes(b)


@_query
def proc_list(b: Bindings) -> DataFrame:
    return ranking.list_processes(_current_processes(b)).select("node_name", "pid", "cpu_percent")


@_query
def top_cpu(b: Bindings) -> DataFrame:
    return ranking.top_cpu(_current_processes(b)).select("pid", "name", "cpu_percent")


@_query
def top_mem(b: Bindings) -> DataFrame:
    return ranking.top_mem(_current_processes(b)).select("pid", "name", "mem_rss")


@_query
def top_cpu_per_node(b: Bindings) -> DataFrame:
    ranked = ranking.top_per_node(_current_processes(b), "cpu_percent")
    return ranked.select("node_name", "rank", "pid", "cpu_percent")


@_query
def proc_state_map(b: Bindings) -> DataFrame:
    code = F.substring("o_orderpriority", 3, 20)
    codes = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(
        F.substring(F.concat(F.lit("RSDZTIt"), code), (F.col("o_orderkey") % 9 + 1).cast("int"), F.lit(2))
    )
    return b.table("orders").select("o_orderkey", process_state(codes).alias("state"))


@_query
def proc_pattern_pairs(b: Bindings) -> DataFrame:
    return processes.match_patterns(_processes(b), b.watch_patterns())


@_query
def cpu_delta(b: Bindings) -> DataFrame:
    rates = processes.cpu_delta(b.cpu_times())
    return rates.select("node_name", "pid", "collected_at", "prev_cpu_time_ms", "cpu_delta_percent")


@_query
def runtime_sec(b: Bindings) -> DataFrame:
    return _processes(b).select(
        "node_name", "pos", runtime_seconds(F.col("elapsed")).alias("runtime_sec")
    )


# -- logs --------------------------------------------------------------------------


@_query
def log_lines(b: Bindings) -> DataFrame:
    return b.log_lines()


@_query
def log_read_files(b: Bindings) -> DataFrame:
    """Texts landed as files and read whole, through both readers."""
    root = fresh_dir(b.spark, "logs")
    b.log_texts().select("node_name", "log_name", F.col("text").alias("value")).write.partitionBy(
        "node_name", "log_name"
    ).text(root)
    columns = ["node_name", "log_name", "line"]
    by_spark = read_log_files(b.spark, root).select(*columns, F.lit("text").alias("reader"))
    by_tail = feeds.read_whole_logs(b.spark, f"{root}/node_name=*/log_name=*/part-*")
    return by_spark.unionByName(by_tail.select(*columns, F.lit("tail").alias("reader")))


@_query
def log_by_name(b: Bindings) -> DataFrame:
    return logs.filter_by_name(b.log_lines(), "src5").select("id", "line")


@_query
def log_tail_one(b: Bindings) -> DataFrame:
    return logs.tail_log(b.log_lines(), "src3", 50).select("id", "line")


@_query
def log_tail_all(b: Bindings) -> DataFrame:
    return logs.tail_all_logs(b.log_lines()).select("id", "log_name", "line")


@_query
def log_keep_last_n(b: Bindings) -> DataFrame:
    return logs.keep_last_n(b.log_lines(), 20).select("node_name", "log_name", "id")


@_query
def log_keep_last_per_spec(b: Bindings) -> DataFrame:
    limits = specs.resolve_log_specs(b.log_specs())
    return logs.keep_last_per_spec(b.log_lines(), limits).select("node_name", "log_name", "id")


@_query
def log_search(b: Bindings) -> DataFrame:
    return logs.search_log(b.log_lines(), r"[0-9]{3}.*\.$").select("id", "line")


@_query
def log_line_counts(b: Bindings) -> DataFrame:
    return logs.log_line_counts(b.log_lines())


@_query
def log_files(b: Bindings) -> DataFrame:
    files = b.page_files()
    wanted = files.select(
        "node_name",
        F.concat(F.lit("log"), F.col("page_id").cast("string")).alias("name"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.col("path"), F.lit(".gone")))
        .otherwise(F.col("path")).alias("path"),
        (F.col("page_id") % 3 * 100).cast("int").alias("max_lines"),
    )
    info = log_file_info(specs.resolve_log_specs(wanted), b.path_inventory())
    return info.withColumn("size_text", fmt.format_file_size(F.col("size"))).withColumn(
        "time_text", fmt.format_timestamp(F.col("mod_time"))
    )


@_query
def retention(b: Bindings) -> DataFrame:
    kept = logs.retention(
        b.log_lines(), _now(NOW), days=7, max_rows=1500,
        bucket=F.call_function("div", F.col("id"), F.lit(10_000_000).cast("bigint")),
    )
    return kept.select("id", "created_at")


@_query
def stored_retention(b: Bindings) -> DataFrame:
    """The stored form: whole day folders go, and only the day in which the cap ends is written again."""
    work = fresh_dir(b.spark, "stored")
    lines = b.log_lines(b.stream("documents")).select(
        "node_name", "log_path", F.col("id").alias("line_offset"), "line", F.lit(None).cast("string").alias("oversize_line"), "created_at", "log_name"
    )
    feeds.drain(lines, sinks.append_log(f"{work}/table"), f"{work}/checkpoint")
    sinks.retain_stored(b.spark, f"{work}/table", F.to_date(_now(NOW)), days=20, max_rows=1500)
    return sinks.read_log_table(b.spark, f"{work}/table").select("log_name", F.col("line_offset").alias("id"), "created_at")


@_query
def retention_per_log(b: Bindings) -> DataFrame:
    kept = logs.retention(
        b.log_lines(), _now(NOW), days=20, max_rows=100, keys=["log_name"],
        bucket=F.call_function("div", F.col("id"), F.lit(10_000_000).cast("bigint")),
    )
    return kept.select("log_name", "id")


# -- file trees --------------------------------------------------------------------


@_query
def path_counts(b: Bindings) -> DataFrame:
    return paths.path_counts(b.path_inventory(), b.path_specs())


@_query
def path_counts_depth(b: Bindings) -> DataFrame:
    return paths.path_counts(b.path_inventory(), b.path_specs(depth=True))


@_query
def path_counts_exclude(b: Bindings) -> DataFrame:
    return paths.path_counts(b.path_inventory(), b.path_specs(depth=True, exclude=True))


def _root_pairs(b: Bindings) -> DataFrame:
    specified = b.path_specs(depth=True, exclude=True).withColumnRenamed("path", "root")
    roots = paths.compile_excludes(specified)
    inventory = b.path_inventory().select("node_name", "path", "is_dir")
    return paths.under_roots(inventory, roots).filter(F.col("rel") != "")


@_query
def path_under_roots(b: Bindings) -> DataFrame:
    return _root_pairs(b).select("node_name", "root", "path", "rel")


@_query
def path_limit_depth(b: Bindings) -> DataFrame:
    return paths.limit_depth(_root_pairs(b)).select("node_name", "root", "path")


@_query
def path_exclude(b: Bindings) -> DataFrame:
    return paths.exclude_paths(_root_pairs(b)).select("node_name", "root", "path")


@_query
def path_scan_status(b: Bindings) -> DataFrame:
    scans = b.path_stats().select(
        "node_name", "path", "file_count", "scan_duration_ms",
        F.lit(30_000).alias("timeout_ms"),
        F.nullif("error_message", F.lit("")).alias("scan_error"),
    )
    return paths.scan_status(scans).select("path", "file_count", "status", "error_message")


@_query
def path_latest(b: Bindings) -> DataFrame:
    return latest_by_key(b.path_history(), ["node_name", "path"])


@_query
def path_lookup(b: Bindings) -> DataFrame:
    return paging.get_path_stats(b.path_stats(), "/data/000000000042").select("path", "file_count", "status")


@_query
def path_list(b: Bindings) -> DataFrame:
    return paging.list_paths(b.path_stats()).select("node_name", "path", "status")


@_query
def path_page(b: Bindings) -> DataFrame:
    return paging.page_paths(b.path_stats(), limit="25", offset="100").select("path", "file_count")


@_query
def path_page_after(b: Bindings) -> DataFrame:
    rows = paging.page_after(b.path_stats(), "path", "/data/000000000099", 25)
    return rows.select("path", "file_count")


@_query
def path_count_total(b: Bindings) -> DataFrame:
    return paging.count_rows(b.path_stats())


@_query
def path_page_meta(b: Bindings) -> DataFrame:
    return paging.page_meta(b.path_stats(), limit=25, offset=100)


def _requested(b: Bindings) -> DataFrame:
    line = b.table("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    return line.select(
        F.col("l_orderkey").alias("pos"),
        F.concat(F.lit("/data/"), F.lpad((F.col("p") * 11).cast("string"), 12, "0")).alias("path"),
    )


@_query
def path_semi(b: Bindings) -> DataFrame:
    stats = b.path_stats().select("path", "file_count")
    return specs.select_specs(stats, _requested(b)).select("pos", "path", "file_count")


@_query
def path_unknown(b: Bindings) -> DataFrame:
    return specs.unknown_paths(b.path_stats().select("path"), _requested(b)).select("pos", "path")


@_query
def largest_files(b: Bindings) -> DataFrame:
    roots = b.path_specs().select("node_name", F.col("path").alias("root"))
    return paths.largest_files(b.path_inventory(), roots, 3)


@_query
def directory_sizes(b: Bindings) -> DataFrame:
    return paths.directory_sizes(b.path_inventory())


@_query
def tree_sizes(b: Bindings) -> DataFrame:
    return paths.rolled_up_sizes(b.path_inventory()).drop("files")


@_query
def inventory_read(b: Bindings) -> DataFrame:
    folder = fresh_dir(b.spark, "inventory")
    b.path_inventory().write.parquet(folder)
    return read_path_inventory(b.spark, folder).select("node_name", "path", "is_dir", "size", "snapshot_id")


def _write_files(batches):
    """Writes each row's bytes under its path, and gives the paths."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist()):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as handle:
                handle.write(data)
        yield batch.select(["path"])


@_query
def inventory_files(b: Bindings) -> DataFrame:
    """Writes a file per document, some hidden, and walks them: names, kinds and sizes."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    root = fresh_dir(b.spark, "files").removeprefix("file://")
    hidden = F.when(F.col("doc_id") % 3 == 0, ".").when(F.col("doc_id") % 3 == 1, "_").otherwise("")
    path = F.concat(F.lit(f"{root}/"), "source", F.lit("/"), "lang", F.lit("/"), hidden, F.col("doc_id"), F.lit(".txt"))
    files = b.table("documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("data"))
    files.mapInArrow(_write_files, "path string").write.format("noop").mode("overwrite").save()
    found = scan_file_tree(b.spark, root, "node-0", task_entries=200)
    return found.select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "is_dir", F.when(~F.col("is_dir"), F.col("size")).alias("size"))


@_query
def inventory_scan(b: Bindings) -> DataFrame:
    """Writes the documents as a directory tree and walks it."""
    root = fresh_dir(b.spark, "tree")
    b.table("documents").select("source", "lang", "doc_id").write.partitionBy(
        "source", "lang"
    ).parquet(root)
    found = scan_file_tree(b.spark, root, "node-0")
    kept = found.filter(~F.element_at(F.split("path", "/"), -1).rlike(r"\A[._]"))
    rel = F.substr(F.col("path"), F.lit(len(root) + 2))
    return kept.select(
        F.regexp_extract(rel, r"\Asource=([^/]*)", 1).alias("log_name"), "is_dir"
    ).groupBy("log_name").agg(
        F.count_if("is_dir").alias("dirs"), (F.count_if(~F.col("is_dir")) > 0).alias("has_files")
    )


# -- specifications ----------------------------------------------------------------


@_query
def spec_defaults(b: Bindings) -> DataFrame:
    resolved = specs.resolve_path_specs(
        b.configured_paths(), b.node_specs().select("node_name", "path_interval_ms")
    )
    return resolved.select("node_name", "idx", "scan_interval_ms", "max_depth", "timeout_ms")


@_query
def node_spec_defaults(b: Bindings) -> DataFrame:
    return specs.resolve_node_specs(b.node_specs())


@_query
def spec_violations(b: Bindings) -> DataFrame:
    nodes = b.node_specs().select("config_id", "node_name")
    return specs.validate_node_specs(nodes, b.configured_paths().select("config_id", "idx", "path"))


@_query
def client_spec_violations(b: Bindings) -> DataFrame:
    return specs.validate_client_specs(b.node_specs().select("config_id"), b.client_nodes())


# -- report text -------------------------------------------------------------------


def _order_number(b: Bindings, text, **extra) -> DataFrame:
    return b.table("orders").select("o_orderkey", text.alias("text"), *[c.alias(n) for n, c in extra.items()])


@_query
def fmt_bytes(b: Bindings) -> DataFrame:
    size = (F.col("o_custkey") % 1500 + 1) * F.pow(F.lit(1024.0), F.col("o_orderkey") % 6).cast("bigint")
    return _order_number(b, fmt.format_bytes(size + F.col("o_orderkey") % 1000))


@_query
def fmt_file_size(b: Bindings) -> DataFrame:
    size = (F.col("o_custkey") % 1500) * F.pow(F.lit(1024.0), F.col("o_orderkey") % 4).cast("bigint")
    odd = F.when(F.col("o_orderkey") % 3 == 0, size).otherwise(size + F.col("o_orderkey") % 1000)
    return _order_number(b, fmt.format_file_size(odd))


@_query
def fmt_duration(b: Bindings) -> DataFrame:
    return _order_number(b, fmt.format_duration_ms(F.col("o_custkey") * 97 % 200_000 - 50))


@_query
def fmt_interval(b: Bindings) -> DataFrame:
    return _order_number(b, fmt.format_interval(F.col("o_custkey") * F.col("o_orderkey") % 20_000_000))


@_query
def fmt_gauge(b: Bindings) -> DataFrame:
    percent = F.col("value") / F.lit(4.0) - F.lit(5.0)
    return b.table("events").select("event_id", fmt.format_gauge(percent, 20).alias("text"))


@_query
def fmt_number(b: Bindings) -> DataFrame:
    return _order_number(b, fmt.format_number(F.col("o_custkey") * F.col("o_orderkey") - 1_000_000))


@_query
def fmt_time(b: Bindings) -> DataFrame:
    ts = F.col("ts")
    known = F.when(F.col("event_id") % 7 != 0, ts)
    return b.table("events").select(
        "event_id", fmt.format_clock(ts).alias("clock"), fmt.format_timestamp(known).alias("stamp"),
        fmt.uptime_seconds(ts, _now(HEALTH_NOW)).alias("uptime_sec"),
    )


@_query
def sev_cpu(b: Bindings) -> DataFrame:
    return b.table("events").select(
        "event_id", sev.severity_cpu(F.col("value") / F.lit(5.0)).alias("severity")
    )


@_query
def sev_state(b: Bindings) -> DataFrame:
    return _processes(b).select(
        "node_name", "pos", sev.severity_process_state(F.col("status")).alias("severity")
    )


@_query
def sev_status(b: Bindings) -> DataFrame:
    words = F.when(F.col("seq") % 2 == 0, F.lower("status")).otherwise(F.col("status"))
    return b.path_stats().select("seq", sev.severity_status(words).alias("severity"))


@_query
def json_rows(b: Bindings) -> DataFrame:
    rows = b.path_stats().select("path", "file_count", "dir_count", "status", "error_message")
    return jsonrows.to_json_rows(rows, omit_empty=["error_message"])


@_query
def json_page(b: Bindings) -> DataFrame:
    stats = b.path_stats().select("path", "file_count", "status")
    return jsonrows.page_envelope(
        paging.page_paths(stats, 10, 5), paging.page_meta(stats, 10, 5), ["path"]
    )


# -- transfers, schedules, fleet ---------------------------------------------------


@_query
def json_full_list(b: Bindings) -> DataFrame:
    """A list without a limit: objects in order of path, and no meta."""
    rows = paging.list_paths(b.path_stats().select("path", "file_count", "dir_count", "status"))
    return jsonrows.to_json_rows(rows)


@_query
def transfer_parse(b: Bindings) -> DataFrame:
    return parse_transfer_log(b.transfer_lines(), _now(dt.datetime(1996, 1, 1)))


@_query
def transfer_page(b: Bindings) -> DataFrame:
    found = list_transfers(parse_transfer_log(b.transfer_lines()), user="user7", direction="upload")
    return paging.page(found, ["id"], limit=20, offset=3).select("id", "username", "filename", "bytes")


@_query
def transfer_from(b: Bindings) -> DataFrame:
    """Transfer logs in order of time, of which only what comes from a moment on is read."""
    work, since = fresh_dir(b.spark, "transfers"), dt.datetime(1996, 1, 1)
    timed = b.transfer_lines().join(b.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id")
    at = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("id") % 86_400)
    order = ["node_name", "log_name", "at"]
    lines = timed.select("node_name", F.lit("xferlog").alias("log_name"), at.alias("at"), F.col("line").alias("value"))
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("node_name", "log_name", "value").write.partitionBy("node_name", "log_name").text(f"{work}/logs")
    read = feeds.read_whole_logs(b.spark, f"{work}/logs/node_name=*/log_name=*/part-*", startTime=since.isoformat())
    return parse_transfer_log(read.select("node_name", "line"))


@_query
def cron_parse(b: Bindings) -> DataFrame:
    jobs = parse_crontabs(b.crontab_lines())
    return jobs.withColumns({name: F.try_element_at("variables", F.lit(name)) for name in ("MAILTO", "LEVEL")}).drop("variables")


@_query
def cron_missed_runs(b: Bindings) -> DataFrame:
    expected = runs_between(b.cron_jobs(), dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 31))
    return missed_runs(expected, b.job_starts(), ["job_id"], 60)


@_query
def proc_lifetimes(b: Bindings) -> DataFrame:
    samples = last_per_pid(_processes(b)).withColumn("elapsed_sec", runtime_seconds(F.col("elapsed")))
    return processes.lifetimes(samples)


@_query
def feed_outages(b: Bindings) -> DataFrame:
    return summary.outages(b.feed_samples(), b.feed_specs(), _now(HEALTH_NOW))


@_query
def collector_status(b: Bindings) -> DataFrame:
    return summary.collector_status(b.feed_samples(), b.feed_specs(), _now(HEALTH_NOW))


@_query
def cron_next_runs(b: Bindings) -> DataFrame:
    return expected_runs(b.cron_jobs(), NOW)


@_query
def node_health(b: Bindings) -> DataFrame:
    return summary.node_health(_samples(b), _now(HEALTH_NOW), 3600)


@_query
def fleet_union(b: Bindings) -> DataFrame:
    events = b.table("events").select("event_id", "user_id", "ts")
    nodes = {f"node-{n}": events.filter(F.col("user_id") % 4 == n).drop("user_id") for n in range(4)}
    return summary.fleet_union(nodes)


# -- streams and sinks -------------------------------------------------------------


@_query
def stream_latest(b: Bindings) -> DataFrame:
    work = fresh_dir(b.spark, "latest")
    stream = fs_samples_from_counters(b.fs_counters(b.stream("events")))
    feeds.drain(stream, sinks.upsert_latest(f"{work}/table", MOUNT), f"{work}/checkpoint")
    return read_version(b.spark, f"{work}/table")


@_query
def stream_last_seen(b: Bindings) -> DataFrame:
    work = fresh_dir(b.spark, "seen")
    seen = feeds.last_seen(fs_samples_from_counters(b.fs_counters(b.stream("events"))))
    feeds.drain(seen, sinks.store(f"{work}/table"), f"{work}/checkpoint", "complete")
    return read_version(b.spark, f"{work}/table")


@_query
def stream_snapshot(b: Bindings) -> DataFrame:
    work = fresh_dir(b.spark, "snapshot")
    stream = parse_ps_captures(b.ps_lines(b.stream("events")))
    feeds.drain(stream, sinks.replace_snapshot(f"{work}/table"), f"{work}/checkpoint")
    return read_version(b.spark, f"{work}/table")


@_query
def stream_trim(b: Bindings) -> DataFrame:
    work = fresh_dir(b.spark, "trim")
    sink = sinks.trim_log(f"{work}/table", lambda lines: logs.keep_last_n(lines, 20))
    feeds.drain(b.log_lines(b.stream("documents")), sink, f"{work}/checkpoint")
    return read_version(b.spark, f"{work}/table").select("node_name", "log_name", "id")


@_query
def stream_tail_replay(b: Bindings) -> DataFrame:
    """Log files grow in two steps and are tailed from one checkpoint."""
    work = fresh_dir(b.spark, "tail")
    texts = b.log_texts()
    for half in range(2):
        texts.filter(F.col("doc_id") % 2 == half).select(
            "node_name", "log_name", F.col("text").alias("value")
        ).write.mode("append").partitionBy("node_name", "log_name").text(f"{work}/logs")
        stream = feeds.tail_logs(b.spark, f"{work}/logs/node_name=*/log_name=*/part-*")
        feeds.drain(stream, sinks.append_log(f"{work}/table"), f"{work}/checkpoint")
    stored = sinks.read_log_table(b.spark, f"{work}/table")
    return stored.select("node_name", "log_name", "line")


def _land_logs(b: Bindings, folder: str, texts: DataFrame) -> None:
    rows = texts.select("node_name", "log_name", F.col("text").alias("value"))
    rows.write.mode("append").partitionBy("node_name", "log_name").text(folder)


@_query
def stream_tail_rotate(b: Bindings) -> DataFrame:
    """Logs are rotated between two runs: the old files go on under other names, new ones take their place."""
    work = fresh_dir(b.spark, "rotate")
    logs_at, pattern = f"{work}/logs", f"{work}/logs/node_name=*/log_name=*/*.[0-9t]*"
    for half in range(2):
        _land_logs(b, logs_at, b.log_texts().filter(F.col("doc_id") % 2 == half))
        stream = feeds.tail_logs(b.spark, pattern)
        feeds.drain(stream, sinks.append_log(f"{work}/table"), f"{work}/checkpoint")
        hadoop, fs = file_system(b.spark, logs_at)
        for status in fs.globStatus(hadoop.Path(f"{logs_at}/node_name=*/log_name=*/part-*.txt")):
            path = status.getPath()
            fs.rename(path, hadoop.Path(path.getParent(), path.getName().replace(".txt", f".{half}")))
    feeds.drain(feeds.tail_logs(b.spark, pattern), sinks.append_log(f"{work}/table"), f"{work}/checkpoint")
    return sinks.read_log_table(b.spark, f"{work}/table").select("node_name", "log_name", "line")


@_query
def stream_tail_backlog(b: Bindings) -> DataFrame:
    """A backlog is taken in many batches of bounded bytes."""
    work = fresh_dir(b.spark, "backlog")
    texts = b.log_texts()
    _land_logs(b, f"{work}/logs", texts)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    options = {"maxBytesPerTrigger": -(-size // 4), "stateFile": f"{work}/offsets"}

    def tail() -> DataFrame:
        return feeds.tail_logs(b.spark, f"{work}/logs/node_name=*/log_name=*/part-*", **options)

    feeds.drain_backlog(tail, sinks.append_log(f"{work}/table"), f"{work}/checkpoint")
    return sinks.read_log_table(b.spark, f"{work}/table").select("node_name", "log_name", "line")


@_query
def stream_trim_state(b: Bindings) -> DataFrame:
    """Lines come in four steps; a second checkpoint goes on from the state of the first."""
    work = fresh_dir(b.spark, "trim-state")
    documents, held = b.table("documents"), None
    for step in range(4):
        part = documents.where(F.col("doc_id") % 4 == step) if step else documents.where("doc_id % 4 = 0 OR doc_id IS NULL")
        part.write.mode("append").parquet(f"{work}/landed")
        stream = b.spark.readStream.schema(documents.schema).parquet(f"{work}/landed")
        changes = keyed.keep_newest(b.log_lines(stream), 20, initial=held if step >= 2 else None)
        checkpoint = f"{work}/checkpoint{step // 2}"
        with keyed.keyed_state(b.spark):
            feeds.drain(changes, sinks.append_history(f"{work}/changes"), checkpoint, "update")
        if step == 1:
            held = keyed.newest_kept(b.spark, checkpoint)
    return keyed.newest_kept(b.spark, checkpoint).select("node_name", "log_name", "id")


@_query
def stream_heartbeat(b: Bindings) -> DataFrame:
    """Every node is seen, and is stale once no sample has come for a while."""
    work = fresh_dir(b.spark, "heartbeat")
    beats = keyed.heartbeats(fs_samples_from_counters(b.fs_counters(b.stream("events"))), timeout_ms=500)
    with keyed.keyed_state(b.spark):
        run = feeds.run_feed(beats, sinks.append_history(f"{work}/changes"), f"{work}/checkpoint", "1 second", "update")
    try:
        while not any(p["numInputRows"] for p in run.recentProgress):
            _running(run)
        while True:
            now = latest_by_key(b.spark.read.parquet(f"{work}/changes"), ["node_name"], "batch_id")
            if now.where("status = 'alive'").isEmpty():
                return now.select("node_name", "last_seen", "status")
            _running(run)
    finally:
        run.stop()


def _running(run) -> None:
    if run.awaitTermination(0.5):
        raise RuntimeError("the stream of heartbeats ended before all nodes were silent")


@_query
def stream_latest_bounded(b: Bindings) -> DataFrame:
    """Samples come by weeks, some of them a week late; a second checkpoint takes the last two."""
    work = fresh_dir(b.spark, "bounded")
    events = b.table("events")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8) + (F.col("event_id") % 50 == 0).cast("int"), F.lit(4))
    for step in range(5):
        folder, checkpoint = f"{work}/landed{step // 3}", f"{work}/checkpoint{step // 3}"
        events.where(week == step).write.mode("append").parquet(folder)
        stream = fs_samples_from_counters(b.fs_counters(b.spark.readStream.schema(events.schema).parquet(folder)))
        with keyed.keyed_state(b.spark):
            feeds.drain(keyed.latest_in_windows(stream, MOUNT), sinks.append_history(f"{work}/table"), checkpoint, "update")
    return keyed.latest_of_windows(b.spark.read.parquet(f"{work}/table"), MOUNT)


@_query
def compacted_table(b: Bindings) -> DataFrame:
    work = fresh_dir(b.spark, "compact")
    sinks.compact_table(_samples(b), f"{work}/table", files=4, by=["node_name"])
    return b.spark.read.parquet(f"{work}/table")
