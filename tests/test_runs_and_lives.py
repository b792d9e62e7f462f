import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import values
from hostweave.operators.paths import directory_sizes, rolled_up_sizes
from hostweave.operators.processes import lifetimes, match_any_glob, match_patterns, running_count
from hostweave.operators.schedule import missed_runs, runs_between
from hostweave.operators.summary import collector_status, outages
from hostweave.sources.crontabs import parse_crontabs
from hostweave.sources.taillog import LogFiles, first_line_from
from hostweave.streaming import feeds

DAY = dt.datetime(2024, 1, 1)


def minutes(n):
    return DAY + dt.timedelta(minutes=n)


def test_crontab_grammar(rows):
    system = ["# head", "SHELL=/bin/sh", ' MAILTO = "a b" ', "17 *\t* * *  root   cd / && run \\%d%in 1%in 2", "@daily www backup", "", "*/5 * * *", "MAILTO=''",
              "0 1 * * 1-5 root x = y", None]
    user = ["@reboot /bin/start  ", "1 2 3 4 5 cmd with spaces", "NAME=v", "1 2 3 4 5"]
    lines = rows(
        [("n", "/etc/crontab", "system", None, i, x) for i, x in enumerate(system)] + [("n", "/spool/u", "user", "u", i, x) for i, x in enumerate(user)],
        "node_name string, path string, source string, owner string, pos long, line string",
    )
    found = parse_crontabs(lines).orderBy("path", "pos").collect()
    assert [(r.pos, r.user, r.schedule, r.command, r.input) for r in found] == [
        (3, "root", "17 * * * *", "cd / && run %d", "in 1\nin 2"),
        (4, "www", "@daily", "backup", None),
        (8, "root", "0 1 * * 1-5", "x = y", None),
        (0, "u", "@reboot", "/bin/start", None),
        (1, "u", "1 2 3 4 5", "cmd with spaces", None),
    ]
    assert [r.variables for r in found] == [{"SHELL": "/bin/sh", "MAILTO": "a b"}] * 2 + [{"SHELL": "/bin/sh", "MAILTO": ""}, {}, {}]
    assert parse_crontabs(lines.limit(0)).collect() == []


def test_missed_and_late_runs(rows):
    jobs = rows([(1, "*/20 * * * *"), (2, "0 0 29 2 *"), (3, "@reboot"), (4, None), (5, "30 0 * * *")], "job_id int, schedule string")
    due = runs_between(jobs, DAY, minutes(60))
    assert values(due, "job_id", "run_at") == [(1, minutes(m)) for m in (0, 20, 40)] + [(5, minutes(30))]
    starts = rows([(1, minutes(-5)), (1, minutes(1)), (1, minutes(2)), (1, minutes(59)), (7, minutes(3)), (1, None), (5, minutes(30))], "job_id int, started_at timestamp_ntz")
    assert values(missed_runs(due, starts, ["job_id"], 600)) == [
        (1, minutes(0), minutes(1), "ran"), (1, minutes(20), None, "missed"), (1, minutes(40), minutes(59), "late"), (5, minutes(30), minutes(30), "ran"),
    ]


def test_runs_expected_twice_and_starts_at_once(rows):
    due = rows([(1, minutes(0)), (1, minutes(0)), (1, minutes(5)), (None, minutes(1)), (None, minutes(1)), (2, None), (2, minutes(2))], "job_id int, run_at timestamp_ntz")
    starts = rows([(1, minutes(5)), (1, minutes(5)), (1, minutes(6)), (None, minutes(1)), (2, minutes(1)), (3, minutes(1))], "job_id int, started_at timestamp_ntz")
    assert values(missed_runs(due, starts, ["job_id"], 60)) == [
        (1, minutes(0), None, "missed"), (1, minutes(5), minutes(5), "ran"), (2, minutes(2), None, "missed"), (None, minutes(1), minutes(1), "ran"),
    ]


def test_runs_between_skips_what_never_runs(rows):
    schedules = ["0 0 1 1 *", "0 0 1 1 *", "0 0 2 1 *", "61 * * * *", "* *", "", None, "@reboot", "59 23 * * 1"]
    jobs = rows(list(enumerate(schedules)), "job_id int, schedule string")
    assert values(runs_between(jobs, DAY, minutes(1440)), "job_id", "run_at") == [(0, minutes(0)), (1, minutes(0)), (8, minutes(1439))]


def test_running_count_is_that_of_one_window(rows):
    rng = random.Random(1)
    data = [(rng.choice("ab"), minutes(60 * i), rng.random() < 0.3) for i in range(200)]
    counted = running_count(rows(data, "k string, at timestamp_ntz, hit boolean"), ["k"], "at", F.col("hit"), "n", bucket_seconds=7200)
    want, seen = [], {}
    for k, at, hit in data:
        seen[k] = seen.get(k, 0) + hit
        want.append((k, at, seen[k]))
    assert values(counted, "k", "at", "n") == sorted(want, key=repr)


def test_lifetimes(rows):
    seen = {(1, 7): [0, 1, 2, 3], (1, 8): [0, 2, 3], (1, 9): [1, 2], (2, 7): [0]}
    fell = {(1, 7): 2}  # its elapsed time starts anew
    data = []
    for (node, pid), snapshots in seen.items():
        for s in snapshots:
            age = s * 60 - (120 if s >= fell.get((node, pid), 99) else 0)
            data.append((f"n{node}", s * 10, pid, f"p{s}", 5 + age if pid != 9 else None, minutes(s)))
    found = lifetimes(rows(data, "node_name string, snapshot_id long, pid long, name string, elapsed_sec long, collected_at timestamp_ntz"))
    assert values(found, "node_name", "pid", "life", "name", "first_seen", "last_seen", "snapshots", "status") == [
        ("n1", 7, 1, "p1", minutes(0), minutes(1), 2, "STOPPED"),
        ("n1", 7, 2, "p3", minutes(2), minutes(3), 2, "RUNNING"),
        ("n1", 8, 1, "p0", minutes(0), minutes(0), 1, "STOPPED"),
        ("n1", 8, 2, "p3", minutes(2), minutes(3), 2, "RUNNING"),
        ("n1", 9, 1, "p2", minutes(1), minutes(2), 2, "STOPPED"),
        ("n2", 7, 1, "p0", minutes(0), minutes(0), 1, "RUNNING"),
    ]


def test_outages_and_collector_status(rows):
    samples = rows([("n", "fs", minutes(m)) for m in (0, 1, 2, 10, 11)] + [("n", "log", minutes(11)), ("n", "odd", minutes(0))], "node_name string, feed string, collected_at timestamp_ntz")
    specs = rows([("n", "fs", 60_000), ("n", "log", 60_000), ("n", "path", 60_000), ("n", "odd", 0)], "node_name string, feed string, interval_ms long")
    now = F.lit("2024-01-01 00:12:30").cast("timestamp_ntz")
    assert values(outages(samples, specs, now)) == [("n", "fs", minutes(2), minutes(10), 480, 7)]
    assert values(collector_status(samples, specs, now), "feed", "samples", "outages", "silent_sec", "status") == [
        ("fs", 5, 1, 480, "late"), ("log", 1, 0, 0, "late"), ("odd", 1, 0, 0, "ok"), ("path", 0, 0, 0, "unseen"),
    ]
    later = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    assert ("n", "log", minutes(11), None, 2940, 49) in values(outages(samples, specs, later))
    assert values(collector_status(samples, specs, later), "feed", "status") == [("fs", "down"), ("log", "down"), ("odd", "ok"), ("path", "unseen")]


def test_first_line_by_bisection(spark, tmp_path):
    rng, stamp = random.Random(2), LogFiles({"path": "x"})._stamp
    path = tmp_path / "node_name=n" / "log_name=x" / "log"
    path.parent.mkdir(parents=True)
    for trial in range(60):
        at, lines = DAY, []
        for _ in range(rng.randrange(12)):
            at += dt.timedelta(seconds=rng.choice([0, 0, 1, 90]))
            text = at.strftime("%a %b %d %H:%M:%S %Y") + " " + "x" * rng.randrange(60)
            lines.append((at, text) if rng.random() < 0.8 else (None, "  no time " + "y" * rng.randrange(200)))
        path.write_text("".join(f"{t}\n" for _, t in lines))
        for since in (DAY, DAY + dt.timedelta(seconds=1), at, at + dt.timedelta(seconds=1)):
            begin, wanted = 0, path.stat().st_size
            for time, text in lines:
                if time is not None and time >= since:
                    wanted = begin
                    break
                begin += len(text) + 1
            assert first_line_from(str(path), path.stat().st_size, since, stamp) == wanted
    path.write_text("Mon Jan 01 00:00:00 2024 a\nMon Jan 01 00:00:05 2024 b\n")
    read = feeds.read_whole_logs(spark, f"{tmp_path}/node_name=*/log_name=*/*", startTime="2024-01-01T00:00:05")
    assert [r.line[-1] for r in read.collect()] == ["b"]


def test_patterns_by_pieces_match_as_each_by_itself(rows):
    names = ["java17", "Java", "nifi-1", "a", "ab", "", "KELVIN \u212a", "\u0130stanbul", "stra\u00dfe", "x.y", "long\u017f", None, "java17"]
    patterns = ["java", "java*", "*1?", "?", "*", "k", "ist", "stra\u00dfe", "x.*", "S", "", "[a", "NIFI", "a?", None]
    processes = rows([(n,) for n in names], "name string")
    listed = rows(list(enumerate(patterns)), "pattern_id long, pattern string")
    found = {(r.name, r.pattern_id) for r in match_patterns(processes, listed).collect()}
    want = set()
    for i, p in enumerate(patterns):
        if p is not None:
            want |= {(r.name, i) for r in match_any_glob(processes.filter("name IS NOT NULL"), [p]).collect()}
    assert found == want and len(match_patterns(processes, listed).collect()) == len(found)


def test_sizes_rolled_up_are_the_exploded_ones(rows):
    files = [("n", "/a/b/c/d", False, 5), ("n", "/a/b/e", False, 7), ("n", "/f", False, 1), ("m", "/a/b/g", False, 2), ("n", "/a/b", True, 0), ("n", "/empty", True, 0)]
    inventory = rows(files, "node_name string, path string, is_dir boolean, size long")
    found = rolled_up_sizes(inventory)
    assert values(found, "node_name", "path", "size") == values(directory_sizes(inventory), "node_name", "path", "size")
    assert ("n", "/a", 2) in values(found, "node_name", "path", "files")
    assert rolled_up_sizes(inventory.limit(0)).collect() == []
