import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import values
from hostweave.operators import logs, paging, paths, processes, ranking, summary
from hostweave.operators.jsonrows import page_envelope, to_json_rows
from hostweave.operators.latest import current_snapshot, last_per_pid, latest_by_key
from hostweave.operators.schedule import expected_runs
from hostweave.sources import specs

GIB = 1 << 30

TREE = [("dir1", True), ("dir1/subdir1", True), ("dir2", True), ("dir1/file1.txt", False),
        ("dir1/file2.log", False), ("dir1/subdir1/file3.txt", False), ("dir2/file4.tmp", False),
        ("file5.txt", False)]


@pytest.fixture
def tree(rows):
    data = [("n", "/r/" + p, d, len(p)) for p, d in TREE] + [("n", "/r", True, 0), ("n", "/rx", False, 9)]
    return rows(data, "node_name string, path string, is_dir boolean, size bigint")


SPEC = "node_name string, path string, max_depth int, exclude array<string>"


@pytest.mark.parametrize(
    "root, depth, exclude, files, dirs, found",
    [
        ("/r", 10, [], 5, 3, True), ("/r", 1, [], 1, 2, True), ("/r", 10, ["*.tmp", "*.log"], 3, 3, True),
        ("/r", 10, ["dir1"], 2, 1, True), ("/r", 0, ["subdir1"], 4, 2, True), ("/r", 0, ["[", "r"], 5, 3, True),
        ("/none", 10, [], 0, 0, False), ("/r/", 1, [], 4, 3, True), ("/", 0, [], 6, 4, True),
    ],
)
def test_path_counts(rows, tree, root, depth, exclude, files, dirs, found):
    counted = paths.path_counts(tree, rows([("n", root, depth, exclude)], SPEC))
    assert values(counted) == [("n", root, files, dirs, found, "OK")]


def test_overlapping_roots_both_count(rows, tree):
    roots = rows([("n", "/r", 0, []), ("n", "/r/dir1", 0, []), ("m", "/r", 0, [])], SPEC)
    got = values(paths.path_counts(tree, roots), "node_name", "path", "file_count")
    assert got == [("m", "/r", 0), ("n", "/r", 5), ("n", "/r/dir1", 3)]


def test_repeated_root_counts_once(rows, tree):
    twice = rows([("n", "/r", 1, [], 1), ("n", "/r", 0, [], 0)], SPEC + ", idx int")
    assert values(paths.path_counts(tree, twice), "file_count", "dir_count") == [(5, 3)]


def test_largest_files(rows, tree):
    roots = rows([("n", "/r")], "node_name string, root string")
    got = values(paths.largest_files(tree, roots, 2), "path", "is_dir", "size")
    assert got == [("/r/dir1", True, 50), ("/r/dir1/subdir1", True, 22)]


def test_scan_status(rows):
    scans = rows([(10, 5, None), (5, 5, None), (1, 5, "permission denied"), (9, 5, "x")],
                 "scan_duration_ms bigint, timeout_ms bigint, scan_error string")
    got = [tuple(r) for r in paths.scan_status(scans).select("status", "error_message").collect()]
    assert got == [("ERROR", "scan timeout exceeded"), ("OK", ""), ("ERROR", "permission denied"),
                   ("ERROR", "scan timeout exceeded")]


def test_latest_by_key(rows):
    numeric = rows([("/d", 60.0, None, 1), ("/d", 70.0, None, 2), ("/e", 1.0, 5, 1)],
                   "mount string, used double, n bigint, seq bigint")
    assert values(latest_by_key(numeric, ["mount"])) == [("/d", 70.0, None, 2), ("/e", 1.0, 5, 1)]
    text = rows([("/l", "OK", 1), ("/l", "ERROR", 3), ("/l", "OK", 2)], "path string, status string, seq bigint")
    assert values(latest_by_key(text, ["path"])) == [("/l", "ERROR", 3)]


def test_current_snapshot(rows):
    df = rows([("a", 1, 1, 5, "x"), ("a", 2, 1, 5, "old"), ("a", 2, 2, 5, "new"), ("b", 1, 1, 9, "y")],
              "node_name string, snapshot_id bigint, pos bigint, pid bigint, name string")
    assert values(last_per_pid(current_snapshot(df)), "node_name", "pid", "name") == [("a", 5, "new"), ("b", 9, "y")]


def skewed(rows, count=4000, seed=3):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(50)}", i, rng.randrange(20)) for i in range(count)]
    return data, rows(data, "k string, id bigint, v int")


def newest(data, n):
    groups = defaultdict(list)
    for key, i, _ in data:
        groups[key].append(i)
    limit = n if callable(n) else lambda key: n
    return sorted((k, i) for k, ids in groups.items() for i in sorted(ids)[-limit(k):])


@pytest.mark.parametrize("column", [False, True])
@pytest.mark.parametrize("n", [1, 7, 5000])
def test_top_n_per_group_matches_brute_force(rows, n, column):
    data, df = skewed(rows)
    kept = ranking.top_n_per_group(df, ["k"], [F.col("id").desc()], F.lit(n) if column else n)
    assert sorted(tuple(r) for r in kept.select("k", "id").collect()) == newest(data, n)


@pytest.mark.parametrize("n", [1, 100, 777, 10_000])
def test_newest_n_counted_matches_brute_force(rows, n):
    data, df = skewed(rows)
    bucket = F.call_function("div", F.col("id"), F.lit(64).cast("bigint"))
    kept = ranking.newest_n_counted(df, ["k"], ["id"], n, bucket)
    assert sorted(tuple(r) for r in kept.select("k", "id").collect()) == newest(data, n)


def test_retention_age_and_cap(rows):
    now = dt.datetime(2024, 1, 10)
    data = [(i, now - dt.timedelta(hours=100 - i)) for i in range(100)]
    df = rows(data, "id bigint, created_at timestamp_ntz")
    bucket = F.call_function("div", F.col("id"), F.lit(10).cast("bigint"))
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    assert [r.id for r in logs.retention(df, at, 1, 1000, bucket).orderBy("id").collect()] == list(range(76, 100))
    assert [r.id for r in logs.retention(df, at, 1, 5, bucket).orderBy("id").collect()] == list(range(95, 100))


def test_keep_last_n_of_10000(rows, spark):
    lines = spark.range(10_000).selectExpr("'n' node_name", "'app' log_name", "id", "'x' line")
    kept = logs.keep_last_n(lines, 1000)
    assert tuple(kept.agg(F.count("*"), F.min("id")).first()) == (1000, 9000)


def test_keep_last_per_spec(rows):
    data, _ = skewed(rows)
    lines = rows([("n", k, i) for k, i, _ in data], "node_name string, log_name string, id bigint")
    limits = {f"k{i}": i for i in range(1, 50)} | {"hot": 300}
    table = rows([("n", k, v) for k, v in limits.items()], "node_name string, name string, max_lines int")
    kept = logs.keep_last_per_spec(lines, table).select("log_name", "id")
    wanted = newest(data, lambda k: limits.get(k, len(data)))  # k0 has no specification
    assert sorted(tuple(r) for r in kept.collect()) == wanted
    twice = rows([("n", "hot", 5, 1), ("n", "hot", 3, 0)], "node_name string, name string, max_lines int, idx int")
    assert logs.keep_last_per_spec(lines, twice).filter("log_name = 'hot'").count() == 3


def test_tails(rows):
    lines = rows([("n", "a" if i % 2 else "b", i, f"l{i}") for i in range(600)],
                 "node_name string, log_name string, id bigint, line string")
    assert [r.id for r in logs.tail_log(lines, "a", 3).collect()] == [595, 597, 599]
    for bad in (None, 0, -4, "x"):
        assert logs.tail_log(lines, "a", bad).count() == 200
    assert [r.id for r in logs.tail_all_logs(lines).collect()] == list(range(400, 600))
    assert logs.search_log(lines, "l59[0-9]$").count() == 10
    assert values(logs.log_line_counts(lines)) == [("n", "a", 300), ("n", "b", 300)]


def test_top_rows(rows):
    cpu = rows([(i + 1, c) for i, c in enumerate([30.0, 90.0, 60.0, 45.0, 80.0])], "pid bigint, cpu_percent double")
    assert [r.pid for r in ranking.top_cpu(cpu).collect()] == [2, 5, 3, 4, 1]
    mem = rows([(i + 1, m) for i, m in enumerate([50, 200, 100, 75, 150])], "pid bigint, mem_rss bigint")
    assert [r.pid for r in ranking.top_mem(mem).collect()] == [2, 5, 3, 4, 1]
    many = rows([(i, 1) for i in range(15)], "pid bigint, mem_rss bigint")
    assert [r.pid for r in ranking.top_mem(many).collect()] == list(range(10))


def test_first_n_keeps_listing_order(rows):
    df = rows([("n", s, p, 100 - p) for s in (1, 2) for p in range(5)],
              "node_name string, snapshot_id bigint, pos bigint, pid bigint")
    assert values(ranking.first_n_in_capture(df, 2), "snapshot_id", "pos") == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_spec_globs(rows):
    procs = rows([("a", "java17"), ("a", "bash"), ("b", "bash"), ("c", "bash")], "node_name string, name string")
    table = rows([("a", ["java*"], 1), ("b", [], 2)], "node_name string, patterns array<string>, top_n int")
    got = values(processes.match_spec_globs(procs, table))
    assert got == [("a", "java17", 1), ("b", "bash", 2), ("c", "bash", None)]
    assert processes.match_any_glob(procs, []).count() == 4


@pytest.mark.parametrize("seconds", [60, 1800, 10**7])
def test_with_previous_matches_brute_force(rows, seconds):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 9, 20)  # spans a daylight saving gap of the session zone
    seen, data = set(), []
    while len(data) < 1500:
        key, at = ("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"), rng.randrange(40 * 3600)
        if (key, at) not in seen:
            seen.add((key, at))
            data.append((key, start + dt.timedelta(seconds=at), rng.choice([None, rng.randrange(100)])))
    df = rows(data, "k string, ts timestamp_ntz, v int")
    got = values(processes.with_previous(df, ["k"], "ts", ["v", "ts"], seconds), "k", "ts", "prev_v", "prev_ts")
    expected, last = [], {}
    for key, ts, v in sorted(data, key=lambda r: (r[0], r[1])):
        expected.append((key, ts, *last.get(key, (None, None))))
        last[key] = (v, ts)
    assert got == sorted(expected, key=repr)


def test_cpu_delta(rows):
    t = dt.datetime(2024, 1, 1)
    df = rows([("n", 1, t, 0), ("n", 1, t + dt.timedelta(seconds=10), 5000), ("n", 1, t + dt.timedelta(hours=3), 10)],
              "node_name string, pid bigint, collected_at timestamp_ntz, cpu_time_ms bigint")
    got = [r.cpu_delta_percent for r in processes.cpu_delta(df).orderBy("collected_at").collect()]
    assert got == [None, 50.0, None]


def test_summary(rows):
    schema = "node_name string, mount_point string, total_bytes bigint, used_bytes bigint, avail_bytes bigint"
    df = rows([("n", "/", 100 * GIB, 60 * GIB, 40 * GIB), ("n", "/data", 200 * GIB, 180 * GIB, 20 * GIB)], schema)
    assert values(summary.fs_summary(df)) == [(2, 300 * GIB, 240 * GIB, 60 * GIB, 80.0)]
    assert values(summary.fs_summary(df.limit(0))) == []
    assert [r.mount_point for r in paging.list_fs(df).collect()] == ["/", "/data"]


def test_paging(rows):
    df = rows([(f"/data/path{i}", i * 100) for i in (3, 1, 5, 2, 4)], "path string, file_count bigint")
    page = lambda *args: [r.path[-1] for r in paging.page_paths(df, *args).collect()]
    assert page(2, 1) == ["2", "3"] and page("2", "4") == ["5"] and page(0, 3) == list("12345")
    assert tuple(paging.page_meta(df, 2, 1).first()) == (5, 2, 1)
    assert tuple(paging.page_meta(df).first()) == (5, None, None)
    assert [r.path[-1] for r in paging.page_after(df, "path", "/data/path3", 9).collect()] == ["4", "5"]
    for bad in (-1, "x", None):
        with pytest.raises(ValueError, match="invalid limit"):
            paging.page_paths(df, bad)
        with pytest.raises(ValueError, match="invalid offset"):
            paging.page_paths(df, 1, bad)
    assert values(paging.get_path_stats(df, "/none")) == []


def test_json(rows):
    df = rows([("/a", 1, ""), ("/b", 0, "denied")], "path string, n bigint, error_message string")
    got = [r.json for r in to_json_rows(df, ["error_message"]).collect()]
    assert got == ['{"path":"/a","n":1}', '{"path":"/b","n":0,"error_message":"denied"}']
    page = page_envelope(paging.page(df, ["path"], 1, 0), paging.page_meta(df, 1, 0), ["path"]).first().json
    assert page == '{"data":[{"path":"/a","n":1,"error_message":""}],"meta":{"total":2,"limit":1}}'
    none = df.limit(0)
    empty = page_envelope(paging.page(none, ["path"], 5, 0), paging.page_meta(none, 5, 0), ["path"]).first().json
    assert empty == '{"data":[],"meta":{"limit":5}}'


def test_spec_defaults(rows):
    nodes = rows([("a", None, None, 0, 0, 0, 0), ("b", "x", None, 1, 7, 1, 1)],
                 "node_name string, listen string, db_path string, disk_interval_ms bigint, "
                 "path_interval_ms bigint, process_interval_ms bigint, log_interval_ms bigint")
    resolved = values(specs.resolve_node_specs(nodes))
    assert resolved[0] == ("a", "0.0.0.0:8080", None, 15000, 60000, 10000, 2000)
    table = rows([("a", "/p", 0, 0, 0), ("b", "/p", 0, -1, 5), ("b", "/q", 3, 4, 5)],
                 "node_name string, path string, scan_interval_ms bigint, max_depth int, timeout_ms bigint")
    got = values(specs.resolve_path_specs(table, nodes))
    assert got == [("a", "/p", 60000, 10, 30000), ("b", "/p", 7, -1, 5), ("b", "/q", 3, 4, 5)]
    logs_ = rows([("a", 0), ("b", -3), ("c", 7)], "name string, max_lines int")
    assert values(specs.resolve_log_specs(logs_)) == [("a", 1000), ("b", 1000), ("c", 7)]


def test_spec_violations(rows):
    nodes = rows([(1, ""), (2, "x"), (3, "y"), (4, "z")], "config_id int, node_name string")
    table = rows([(1, 0, ""), (3, 0, "/a"), (3, 1, None), (3, 2, ""), (4, 0, "/a")], "config_id int, idx int, path string")
    assert values(specs.validate_node_specs(nodes, table)) == [
        (1, "node_name is required", 2), (2, "at least one path must be configured", 1),
        (3, "path[1]: path is required", 2)]
    clients = rows([(1,), (2,)], "config_id int")
    listed = rows([(2, 0, "a", ""), (2, 1, "", "h")], "config_id int, idx int, name string, address string")
    assert values(specs.validate_client_specs(clients, listed)) == [
        (1, "at least one node must be configured", 1), (2, "nodes[0]: address is required", 2)]


def test_spec_selection(rows):
    table = rows([("/a", 1), ("/b", 2)], "path string, max_depth int")
    wanted = rows([(0, "/b"), (1, "/x"), (2, "/a"), (3, "/b")], "pos int, path string")
    assert [(r.pos, r.max_depth) for r in specs.select_specs(table, wanted).collect()] == [(0, 2), (2, 1), (3, 2)]
    assert values(specs.unknown_paths(table, wanted), "path") == [("/x",)]


@pytest.mark.parametrize(
    "schedule, expected",
    [
        ("0 * * * *", dt.datetime(2024, 1, 30, 11)), ("7 10 * * *", dt.datetime(2024, 1, 31, 10, 7)),
        ("8 10 * * *", dt.datetime(2024, 1, 30, 10, 8)), ("@daily", dt.datetime(2024, 1, 31)),
        ("0 0 29 2 *", dt.datetime(2024, 2, 29)), ("0 0 30 2 *", None), ("0 12 13 * FRI", dt.datetime(2024, 2, 2, 12)),
        ("0 0 1 */2 *", dt.datetime(2024, 3, 1)), ("bad", None), ("61 * * * *", None),
        ("  */20  9-11  *  *  MON-WED ", dt.datetime(2024, 1, 30, 10, 20)),
    ],
)
def test_expected_runs(rows, schedule, expected):
    jobs = rows([(1, schedule)], "job int, schedule string")
    assert expected_runs(jobs, dt.datetime(2024, 1, 30, 10, 7, 30)).first().next_run == expected


def test_node_health_and_fleet(rows):
    t = dt.datetime(2024, 1, 1)
    a, b = rows([(t, 1)], "collected_at timestamp_ntz, x int"), rows([(2, t + dt.timedelta(hours=2))], "x int, collected_at timestamp_ntz")
    fleet = summary.fleet_union({"a": a, "b": b})
    assert values(fleet, "node_name", "x") == [("a", 1), ("b", 2)]
    health = summary.node_health(fleet, F.lit("2024-01-01 02:30:00").cast("timestamp_ntz"), 3600)
    assert values(health, "node_name", "age_sec", "status") == [("a", 9000, "stale"), ("b", 1800, "ok")]
    with pytest.raises(ValueError):
        summary.fleet_union({})
