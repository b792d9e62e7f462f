import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from hostweave.operators.logs import keep_last_n
from hostweave.sources.taillog import ByteRange, LogFiles, LogTailStreamReader
from hostweave.streaming import feeds, sinks
from hostweave.sources.logs import read_log_files
from hostweave.streaming.versions import RUN_PROPERTY, complete_versions, read_version
from hostweave.workspace import fresh_dir, shared_root


class Tail:
    """A log folder tailed from one checkpoint."""

    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.folder = base / "logs" / "node_name=n" / "log_name=app"
        self.folder.mkdir(parents=True)
        self.file = self.folder / "app.log"
        self.seen = set()

    def run(self, **options):
        """Lines stored by one more run."""
        pattern = f"{self.base}/logs/node_name=*/log_name=*/*"
        stream = feeds.tail_logs(self.spark, pattern, **options)
        feeds.drain(stream, sinks.append_log(f"{self.base}/table"), f"{self.base}/checkpoint")
        stored = sinks.read_log_table(self.spark, f"{self.base}/table").orderBy(*sinks.STORED_ORDER)
        rows = [(tuple(r[c] for c in sinks.STORED_ORDER), r.line or r.oversize_line) for r in stored.collect()]
        new = [line for key, line in rows if key not in self.seen]
        self.seen |= {key for key, _ in rows}
        return new

    def append(self, data: bytes):
        with open(self.file, "ab") as handle:
            handle.write(data)


def test_tail_append_partial_truncate_rotate_restart(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    tail.append(b"a\r\nb\rc\n\nd")
    assert tail.run() == ["a", "b\rc"]  # the unterminated line is held back
    tail.append(b"d\ne\n")
    assert tail.run() == ["dd", "e"]
    tail.file.write_bytes(b"new\n")  # truncated
    assert tail.run() == ["new"]
    os.rename(tail.file, tmp_path / "app.log.1")  # rotated to a larger file
    tail.file.write_bytes(b"r1\nr2 which is longer\n")
    (tail.folder / "second.log").write_bytes(b"other\n")  # and a file that was not there before
    assert sorted(tail.run()) == ["other", "r1", "r2 which is longer"]
    assert sorted(values(spark.read.parquet(f"{tmp_path}/table"), "log_name", "node_name"))[0] == ("app", "n")


def test_tail_absence_rename_and_reused_inode(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    state = {"stateFile": str(tmp_path / "state.json")}
    tail.append(b"a\nb\n")
    assert tail.run(**state) == ["a", "b"]
    os.rename(tail.file, tmp_path / "away")
    (tail.folder / "other.log").write_bytes(b"o\n")
    assert tail.run(**state) == ["o"]
    os.rename(tmp_path / "away", tail.file)  # back, with nothing new
    (tail.folder / "third.log").write_bytes(b"t\n")
    assert tail.run(**state) == ["t"]
    os.rename(tail.file, tail.folder / "app.log.1")  # rotated within the pattern
    with open(tail.folder / "app.log.1", "ab") as handle:
        handle.write(b"late\n")
    tail.file.write_bytes(b"new\n")
    assert sorted(tail.run(**state)) == ["late", "new"]
    reader = LogTailStreamReader(LogFiles({"path": str(tail.file)}))
    inode = os.stat(tail.file).st_ino
    planned = reader.partitions({"gone": [inode, 2, 12345]}, reader.latestOffset())
    assert [(p.start, p.stop) for p in planned] == [(0, 4)]  # the same inode, but another file


def test_names_are_read_as_they_were_written(spark, tmp_path):
    folder = tmp_path / "node_name=01" / "log_name=web%3A80"
    folder.mkdir(parents=True)
    (folder / "part-0").write_bytes(b"x\n")
    tailed = feeds.read_whole_logs(spark, f"{tmp_path}/node_name=*/log_name=*/*")
    assert values(tailed, "node_name", "log_name") == [("01", "web:80")]
    assert values(read_log_files(spark, str(tmp_path)), "node_name", "log_name", "line") == [("01", "web:80", "x")]


def test_tail_takes_a_backlog_in_bounded_batches(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    want = [f"line {i} " + "x" * (i % 40) for i in range(400)]
    tail.append("".join(f"{line}\n" for line in want).encode())
    (tail.folder / "small.log").write_bytes(b"s\n")
    (tail.folder / "long.log").write_bytes(b"y" * 5000 + b"\nend\n")  # a line beyond any budget is taken whole
    options = {"maxBytesPerTrigger": 3000, "stateFile": str(tmp_path / "state.json")}
    batches = []
    while new := tail.run(**options):
        batches.append(new)
    assert batches[0].count("s") == 1 and len(batches) > 4
    assert [x for b in batches for x in b if x.startswith("line")] == want
    assert sorted(x for b in batches for x in b if not x.startswith("line")) == sorted(["s", "y" * 5000, "end"])
    assert max(sum(len(x) + 1 for x in b if x[0] != "y") for b in batches) <= 3000
    tail.append(b"more\n")
    assert tail.run(**options) == ["more"]
    with pytest.raises(ValueError, match="stateFile"):
        LogFiles({"path": "x", "maxBytesPerTrigger": "10"})


def test_tail_does_not_open_unchanged_files_and_forgets_absent_ones(tmp_path, monkeypatch):
    path = tmp_path / "a.log"
    path.write_bytes(b"a\n")
    reader = LogTailStreamReader(LogFiles({"path": f"{tmp_path}/*.log", "forgetAfterSeconds": "60"}))
    first = reader.latestOffset()
    opened = []
    monkeypatch.setattr("hostweave.sources.taillog._head", lambda *a: opened.append(a) or 0)
    assert reader.latestOffset() == first and not opened
    os.rename(path, tmp_path / "gone")
    assert reader.latestOffset() == first
    reader._absent = {p: t - 61 for p, t in reader._absent.items()}
    assert reader.latestOffset() == {}


def test_tail_partial_and_oversize(spark, tmp_path):
    tail = Tail(spark, tmp_path)
    tail.append(b"x" * 50 + b"\nab")
    assert tail.run(emitPartial=True, maxLineBytes=20) == ["x" * 20, "x" * 20, "x" * 10, "ab"]
    tail.append(b"c\n")
    assert tail.run(emitPartial=True, maxLineBytes=20) == ["c"]
    stored = spark.read.parquet(f"{tmp_path}/table").filter("oversize_line is not null")
    assert values(stored, "line", "line_offset", "oversize_line") == [
        (None, 0, "x" * 20), (None, 20, "x" * 20), (None, 40, "x" * 10)
    ]


def read_ranges(path, data, range_bytes):
    path.write_bytes(data)
    files = LogFiles({"path": str(path), "maxPartitionBytes": str(range_bytes)})
    inode = os.stat(path).st_ino
    found = []
    for part in files.ranges(str(path), inode, 0, len(data)):
        for batch in files.lines(part):
            found += list(zip(batch.column("line_offset").to_pylist(), batch.column("line").to_pylist()))
    return found


def test_ranges_split_lines_once(tmp_path):
    rng = random.Random(11)
    for trial in range(200):
        data = "".join(rng.choice(["\n", "\r\n", "é", "b", "cc"]) for _ in range(rng.randrange(40))).encode()
        expected, offset = [], 0
        for raw in data.split(b"\n"):
            text = raw.removesuffix(b"\r")
            if text:
                expected.append((offset, text.decode()))
            offset += len(raw) + 1
        assert read_ranges(tmp_path / "x", data, rng.randrange(1, 12)) == expected, (trial, data)


def test_last_line_end_is_found_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr("hostweave.sources.taillog.BLOCK_BYTES", 4)
    path = tmp_path / "x"
    reader = LogTailStreamReader(LogFiles({"path": str(path)}))
    for data, end in [(b"abc\ndefghijkl", 4), (b"abcdefghij", 0), (b"abcdefghij\n", 11), (b"", 0)]:
        path.write_bytes(data)
        assert reader.latestOffset()[str(path)][1] == end


def test_lost_bytes_fail_unless_allowed(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"a\n")
    part = ByteRange("", "", str(path), os.stat(path).st_ino, 0, 0, 9, 9)
    with pytest.raises(RuntimeError, match="truncated"):
        list(LogFiles({"path": "x"}).lines(part))
    assert list(LogFiles({"path": "x", "failOnDataLoss": "false"}).lines(part)) == []


def file_stream(spark, base, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


def test_upsert_over_batches_equals_batch(spark, rows, tmp_path):
    schema = "k string, status string, seq bigint"
    data = [(f"k{i % 3}", f"s{i}", i) for i in range(30)]
    source, work = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        rows(data[part * 10:part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(source)
    sink = sinks.upsert_latest(f"{work}/table", ["k"])
    history = sinks.append_history(f"{work}/history")
    feeds.drain(file_stream(spark, source, schema), sinks.all_of(sink, history), f"{work}/checkpoint")
    assert values(read_version(spark, f"{work}/table")) == [("k0", "s27", 27), ("k1", "s28", 28), ("k2", "s29", 29)]
    assert spark.read.parquet(f"{work}/history").count() == 30
    assert len(complete_versions(spark, f"{work}/table")) == 3


def test_sinks_are_repeatable(spark, rows, tmp_path):
    schema = "k string, v int, seq bigint"
    sink = sinks.upsert_latest(f"{tmp_path}/t", ["k"])
    for batch_id, data in [(0, [("a", 1, 1)]), (1, [("a", 2, 2)]), (1, [("a", 2, 2)]), (2, [("b", 9, 1)]),
                           (3, [("c", 1, 1)])]:
        sink(rows(data, schema), batch_id)
    assert values(read_version(spark, f"{tmp_path}/t")) == [("a", 2, 2), ("b", 9, 1), ("c", 1, 1)]
    assert complete_versions(spark, f"{tmp_path}/t") == [1, 2, 3]  # older ones are dropped


@pytest.fixture
def in_run(spark):
    """Names the stream that the sinks of this thread write for."""
    yield lambda name: spark.sparkContext.setLocalProperty(RUN_PROPERTY, name)
    spark.sparkContext.setLocalProperty(RUN_PROPERTY, None)


def test_new_checkpoint_goes_on_with_the_table(rows, spark, tmp_path, in_run):
    schema = "k string, v int, seq bigint"
    latest, history = sinks.upsert_latest(f"{tmp_path}/t", ["k"]), sinks.append_history(f"{tmp_path}/h")
    for run, batch_id, data in [("a", 7, ("old", 1, 1)), ("a", 8, ("old", 2, 2)), ("b", 0, ("new", 1, 1)), ("b", 0, ("new", 1, 1)),
                                ("a", 8, ("old", 2, 2)), ("a", 9, ("last", 1, 1))]:
        in_run(run)
        latest(rows([data], schema), batch_id)
        history(rows([data], schema), batch_id)
    assert values(read_version(spark, f"{tmp_path}/t")) == [("last", 1, 1), ("new", 1, 1), ("old", 2, 2)]
    assert spark.read.parquet(f"{tmp_path}/h").count() == 4


def test_streams_with_two_checkpoints(spark, rows, tmp_path):
    schema = "k string, status string, seq bigint"
    for n in range(2):
        rows([(f"k{n}", "x", n)], schema).write.parquet(f"{tmp_path}/in{n}")
        sink = sinks.all_of(sinks.upsert_latest(f"{tmp_path}/t", ["k"]), sinks.append_history(f"{tmp_path}/h"))
        feeds.drain(file_stream(spark, f"{tmp_path}/in{n}", schema), sink, f"{tmp_path}/checkpoint{n}")
    assert values(read_version(spark, f"{tmp_path}/t"), "k") == [("k0",), ("k1",)]
    assert sorted(r.run.split("-")[0] for r in spark.read.parquet(f"{tmp_path}/h").collect()) == ["00000000", "00000001"]


def test_replace_snapshot(spark, rows, tmp_path):
    schema = "node_name string, snapshot_id bigint, pos bigint, pid bigint, name string"
    sink = sinks.replace_snapshot(f"{tmp_path}/t")
    sink(rows([("a", 1, 1, 1, "x"), ("a", 1, 2, 2, "y"), ("b", 1, 1, 7, "z")], schema), 0)
    sink(rows([("a", 2, 1, 1, "old"), ("a", 2, 2, 1, "new")], schema), 1)
    assert values(read_version(spark, f"{tmp_path}/t"), "node_name", "pid", "name") == [("a", 1, "new"), ("b", 7, "z")]


def test_trim_over_batches(spark, rows, tmp_path):
    schema = "log_name string, id bigint"
    sink = sinks.trim_log(f"{tmp_path}/t", lambda lines: keep_last_n(lines, 3, ["log_name"]))
    sink(rows([("a", i) for i in range(10)] + [("b", 1)], schema), 0)
    sink(rows([("a", 10)], schema), 1)
    assert values(read_version(spark, f"{tmp_path}/t")) == [("a", 10), ("a", 8), ("a", 9), ("b", 1)]


def test_batches_and_positions_have_no_limit(rows, spark, tmp_path):
    lines = rows([("n", "/l", 1 << 41, "x", None, dt.datetime(2024, 1, 1), "app")],
                 "node_name string, log_path string, line_offset bigint, line string, oversize_line string, created_at timestamp_ntz, log_name string")
    for batch_id in (1 << 23, (1 << 23) + 1):
        sinks.append_log(f"{tmp_path}/t")(lines, batch_id)
    stored = sinks.read_log_table(spark, f"{tmp_path}/t")
    assert values(stored, "batch_id", "line_offset") == [(1 << 23, 1 << 41), ((1 << 23) + 1, 1 << 41)]


@pytest.mark.parametrize("keys", [[], ["log_name"]])
@pytest.mark.parametrize("days, most", [(100, 10**6), (2, 10**6), (100, 25), (100, 3), (3, 40), (0, 7)])
def test_stored_retention(rows, spark, tmp_path, keys, days, most):
    data = [("n", "/l", i, f"l{i}", None, dt.datetime(2024, 1, 10) - dt.timedelta(hours=5 * (59 - i)), "a" if i % 3 else "b") for i in range(60)]
    schema = "node_name string, log_path string, line_offset bigint, line string, oversize_line string, created_at timestamp_ntz, log_name string"
    for batch_id in range(3):
        sinks.append_log(f"{tmp_path}/t")(rows(data[batch_id * 20 : batch_id * 20 + 20], schema), batch_id)
    sinks.retain_stored(spark, f"{tmp_path}/t", F.lit(dt.date(2024, 1, 10)), days, most, keys)
    young = [d for d in data if d[5].date() >= dt.date(2024, 1, 10) - dt.timedelta(days=days)]
    groups = {k: [d[2] for d in young if not keys or d[6] == k] for k in ("a", "b")}
    want = {i for ids in groups.values() for i in ids[-most:]}
    assert {r.line_offset for r in sinks.read_log_table(spark, f"{tmp_path}/t").collect()} == want
    assert not [f for f in os.listdir(tmp_path / "t") if f.startswith("_")]


def test_compaction_bounds_files_of_many_and_hot_values(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 'hot', concat('k', id % 99)) AS k").repartition(40)
    sinks.compact_table(df, f"{tmp_path}/out", 8, ["k"])
    files = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.endswith(".parquet")]
    hot = [f for f in os.listdir(tmp_path / "out" / "k=hot") if f.endswith(".parquet")]
    assert len(files) <= 8 + 100 and 2 <= len(hot) <= 4
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20_000


def test_compaction_keeps_rows(spark, tmp_path):
    spark.range(1000).repartition(50).write.parquet(f"{tmp_path}/in")
    sinks.compact_table(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", 2)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.agg(F.sum("id")).first()[0] == 499500
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]) == 2


def test_workspace_uses_the_named_folder(spark):
    assert fresh_dir(spark, "x").startswith(shared_root(spark) + "/x-")
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x") != fresh_dir(spark, "x")
