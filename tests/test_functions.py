import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hostweave.functions import formatting as fmt, globs, severity as sev
from hostweave.functions.process import basename, process_state, runtime_seconds
from hostweave.functions.schedule import allowed_numbers
from hostweave.functions.text import trimmed, words

MIB = 1 << 20


def apply(rows, inputs, sql_type, expression):
    df = rows(list(enumerate(inputs)), f"i int, x {sql_type}")
    return [r.out for r in df.select("i", expression(F.col("x")).alias("out")).orderBy("i").collect()]


def test_format_bytes(rows):
    cases = {0: "0 B", 500: "500 B", 1023: "1023 B", 1024: "1.00 KB", 1536: "1.50 KB",
             2560 * MIB: "2.50 GB", 1 << 40: "1.00 TB", 1 << 60: "1.00 EB"}
    assert apply(rows, list(cases), "bigint", fmt.format_bytes) == list(cases.values())


def test_format_file_size(rows):
    cases = {0: "-", 512: "512 B", 1024: "1.0 KB", 524288: "512.0 KB", MIB: "1.0 MB",
             1 << 30: "1.0 GB", 1 << 40: "1024.0 GB"}
    assert apply(rows, list(cases), "bigint", fmt.format_file_size) == list(cases.values())


def test_format_duration(rows):
    cases = {0: "0ms", 500: "500ms", -5: "-5ms", 1500: "1.5s", 1250: "1.2s", 2000: "2s",
             59999: "60.0s", 90000: "1m30s", 9_000_000: "150m0s"}
    assert apply(rows, list(cases), "bigint", fmt.format_duration_ms) == list(cases.values())


def test_format_interval(rows):
    cases = {2000: "2s", 2500: "2s", 3500: "4s", 90_000: "2m", 150_000: "2m", 3_600_000: "1h"}
    assert apply(rows, list(cases), "bigint", fmt.format_interval) == list(cases.values())


@pytest.mark.parametrize(
    "percent, width, text",
    [
        (0.0, 10, "[░░░░░░░░░░]   0.0%"), (50.0, 10, "[█████░░░░░]  50.0%"),
        (89.1, 20, "[" + "█" * 17 + "░░░]  89.1%"), (-5.0, 5, "[░░░░░]   0.0%"),
        (150.0, 5, "[█████] 100.0%"), (50.0, 1, "[█░░]  50.0%"),
    ],
)
def test_format_gauge(rows, percent, width, text):
    assert apply(rows, [percent], "double", lambda c: fmt.format_gauge(c, width)) == [text]


def test_format_number(rows):
    cases = {0: "0", 999: "999", 1234: "1,234", 1234567: "1,234,567", -1234: "-1,234"}
    assert apply(rows, list(cases), "bigint", fmt.format_number) == list(cases.values())


def test_times(rows):
    ts = dt.datetime(2024, 1, 15, 9, 5, 7)
    assert apply(rows, [ts, None], "timestamp_ntz", fmt.format_timestamp) == ["2024-01-15 09:05:07", "-"]
    assert apply(rows, [ts], "timestamp_ntz", fmt.format_clock) == ["09:05:07"]


def test_uptime_ignores_daylight_saving(rows):
    # The session zone skips 02:00-03:00 on this day; wall clock captures do not.
    df = rows([(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))],
              "a timestamp_ntz, b timestamp_ntz")
    assert df.select(fmt.uptime_seconds(F.col("a"), F.col("b"))).first()[0] == 7200


def test_fixed_point_is_exact(rows):
    rng = random.Random(7)
    numbers = [0.0, 0.05, 0.15, 0.25, 1.005, 1.125, 1.25, 2.675, 99.95, 1e-300, -0.04, -1.25, 0.045]
    numbers += [rng.random() * 10 ** rng.randrange(-3, 9) for _ in range(2000)]
    numbers += [rng.randrange(0, 4000) / 8 for _ in range(500)]
    for places in (1, 2):
        got = apply(rows, numbers, "double", lambda c: fmt.fixed_point(c, places))
        assert got == [f"{x:.{places}f}" for x in numbers]


def test_severities(rows):
    percent = {75.0: "ok", 75.1: "warning", 90.0: "warning", 90.1: "critical"}
    assert apply(rows, list(percent), "double", sev.severity_percent) == list(percent.values())
    cpu = {85.0: "critical", 80.0: "warning", 60.0: "warning", 50.0: "normal", 30.0: "normal"}
    assert apply(rows, list(cpu), "double", sev.severity_cpu) == list(cpu.values())
    states = {"running": "ok", "zombie": "critical", "stopped": "warning", "sleeping": "neutral"}
    assert apply(rows, list(states), "string", sev.severity_process_state) == list(states.values())
    words_ = {"OK": "ok", "connected": "ok", "SCANNING": "warning", "warning": "warning",
              "ERROR": "critical", "critical": "critical", "Ok": "neutral", "x": "neutral"}
    assert apply(rows, list(words_), "string", sev.severity_status) == list(words_.values())


def test_process_fields(rows):
    codes = {"R": "running", "Ss": "sleeping", "I": "sleeping", "D": "disk-wait", "Z": "zombie",
             "T": "stopped", "t": "other", "": "unknown", "X": "other"}
    assert apply(rows, list(codes), "string", process_state) == list(codes.values())
    names = {"/sbin/init": "init", "[kworker/0:1]": "0:1]", "/a/b//": "b", "/": "/", "//": "/",
             "": ".", "x": "x"}
    assert apply(rows, list(names), "string", basename) == list(names.values())
    elapsed = {"05:03": 303, "1:02:03": 3723, "2-01:02:03": 176523, "x": None, "5": None}
    assert apply(rows, list(elapsed), "string", runtime_seconds) == list(elapsed.values())


def test_words(rows):
    lines = ["  a  b\tc ", "", " x　y ", "é ü"]
    assert apply(rows, lines, "string", words) == [["a", "b", "c"], [], ["x", "y"], ["é", "ü"]]
    assert apply(rows, ["  a b 　"], "string", trimmed) == ["a b"]


@pytest.mark.parametrize(
    "pattern, name, expected",
    [
        ("java", "MyJAVAapp", True), ("java*", "java17", True), ("java*", "Java17", False),
        ("java*", "xjava", False), ("a?c", "abc", True), ("a.c*", "axc", False),
        ("a.c*", "a.cd", True), ("*b", "a\nb", False), ("a*", "a\n", False), ("[k]*", "[k]w", True),
        ("É", "é", True), ("a+b", "xA+By", True), ("", "any", True),
    ],
)
def test_process_globs(rows, pattern, name, expected):
    df = rows([(name, [pattern])], "name string, patterns array<string>")
    from_column = globs.matches_any_process_glob(F.col("name"), F.col("patterns"))
    from_literal = F.rlike("name", globs.any_process_glob_of([pattern]))
    assert tuple(df.select(from_column, from_literal).first()) == (expected, expected)


@pytest.mark.parametrize(
    "pattern, name, expected",
    [
        ("*.log", "a.log", True), ("*.log", "a.logx", False), ("[a-c]x", "bx", True),
        ("[^a]x", "bx", True), ("[^a]x", "ax", False), ("a[", "a[", False), ("[]a]", "]", False),
        (r"\*", "*", True), (r"\*", "a", False), ("[z-a]", "b", False), ("[^z-a]", "b", True),
        ("[-a]", "-", False), ("a.c", "abc", False), ("a?c", "aéc", True), (r"[\-x]", "-", True),
        ("x\\", "x\\", False), ("[é-ü]", "ö", True), ("[!a]", "!", True), ("{a}", "{a}", True),
        ("[a&&b]", "&", True), ("*", "", True),
    ],
)
def test_path_globs(rows, pattern, name, expected):
    df = rows([(name, [pattern])], "name string, patterns array<string>")
    regex = globs.any_path_element_regex(F.col("patterns"))
    found = F.coalesce(F.rlike("name", regex), F.lit(False))
    assert df.select(found).first()[0] is expected


def test_schedule_fields(rows):
    minutes = {"*/15": [0, 15, 30, 45], "1-3,10": [1, 2, 3, 10], "5/20": [5, 25, 45], "60": None,
               "x": None, "5-1": None, "1,,2": None}
    got = apply(rows, list(minutes), "string", lambda c: allowed_numbers(c, "minute"))
    assert got == list(minutes.values())
    days = {"MON-FRI": [1, 2, 3, 4, 5], "7": [0], "5-7": [0, 5, 6], "*": [0, 1, 2, 3, 4, 5, 6]}
    assert apply(rows, list(days), "string", lambda c: allowed_numbers(c, "dow")) == list(days.values())
