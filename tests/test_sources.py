import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import values
from hostweave.sources.captures import read_text_captures
from hostweave.sources.filesystems import fs_samples_from_counters, parse_mount_captures, read_fs_samples
from hostweave.sources.inventory import scan_file_tree
from hostweave.sources.logs import log_file_info, read_log_files, split_log_lines
from hostweave.sources.processes import parse_ps_captures
from hostweave.sources.transfers import list_transfers, parse_transfer_log

MOUNT_TEXT = [
    "/dev/sda1 / ext4 rw 0 0",
    "tmpfs /run tmpfs rw 0 0",
    "/dev/sda1 /bind ext4 rw 0 0",
    "/dev/sdb1 /data xfs rw 0 0",
    "overlay /var/x overlay rw 0 0",
    "short line",
]
CAPTURE = "node_name string, capture_id string, pos bigint, line string"


def capture(rows, lines, capture_id="c1"):
    return rows([("n", capture_id, i, line) for i, line in enumerate(lines)], CAPTURE)


def test_mounts_linux(rows):
    lines = capture(rows, MOUNT_TEXT).unionByName(capture(rows, ["tmpfs /run tmpfs rw", ""], "none"))
    got = values(parse_mount_captures(lines), "capture_id", "device", "mount_point", "pos")
    assert got == [("c1", "/dev/sda1", "/", 0), ("c1", "/dev/sdb1", "/data", 3), ("none", None, "/", None)]


def test_mounts_bsd(rows):
    lines = capture(rows, [
        "/dev/disk1 on /Volumes/a on b (x) (apfs, local)",
        "/dev/disk2 on /first (apfs)",
        "/dev/disk2 on /second (apfs)",
        "map auto on /net (autofs)",
        "/dev/disk3 on /noparen",
    ])
    got = values(parse_mount_captures(lines, "bsd"), "device", "mount_point")
    assert got == [("/dev/disk1", "/Volumes/a on b (x)"), ("/dev/disk2", "/first")]
    failed = rows([("n", "c1", "/first")], "node_name string, capture_id string, mount_point string")
    got = values(parse_mount_captures(lines, "bsd", failed), "device", "mount_point")
    assert got == [("/dev/disk1", "/Volumes/a on b (x)"), ("/dev/disk2", "/second")]


def test_fs_counters(rows, spark, tmp_path):
    schema = ("node_name string, mount_point string, blocks bigint, bfree bigint, bavail bigint, "
              "bsize bigint, collected_at timestamp_ntz, seq bigint")
    ts = dt.datetime(2024, 3, 10, 2, 30, 0, 5)
    counters = rows([("n", "/", 100, 40, 30, 10, ts, 1), ("n", "/z", 0, 0, 0, 10, ts, 2),
                     ("n", "/x", None, 1, 1, 10, ts, 3)], schema)
    expected = [("/", 1000, 600, 300, 60.0), ("/z", 0, 0, 0, 0.0)]
    columns = ["mount_point", "total_bytes", "used_bytes", "avail_bytes", "used_percent"]
    assert values(fs_samples_from_counters(counters), *columns) == expected
    target = str(tmp_path / "fs")
    counters.write.json(target)
    assert values(read_fs_samples(spark, target), *columns) == expected


def test_ps(rows):
    lines = ["PID USER %CPU RSS S ELAPSED COMMAND", "  1 root 0.5 1024 Ss 01:00 /sbin/init", "",
             "7 root x y Z 1 [kworker/0:1]", "abc root 1 1 R 1 x", "9 root 1 1 R 1",
             "8 u 1e999 9223372036854775807 R 1 my prog", "99999999999999999999 u 1 1 R 1 x",
             "5 u -3.5 +2 T 1 /opt/x/"]
    df = rows([("n", 1, i, line, None) for i, line in enumerate(lines)],
              "node_name string, snapshot_id bigint, pos bigint, line string, collected_at timestamp_ntz")
    got = values(parse_ps_captures(df), "pid", "name", "cpu_percent", "mem_rss", "status")
    assert got == [
        (1, "init", 0.5, 1048576, "sleeping"), (5, "x", -3.5, 2048, "stopped"),
        (7, "0:1]", 0.0, 0, "zombie"), (8, "my", 0.0, 0, "running"),
    ]


def test_text_captures(spark, tmp_path):
    folder = tmp_path / "node_name=a"
    folder.mkdir()
    (folder / "cap7.txt").write_bytes(b"HEAD\r\nline one\n\n")
    got = values(read_text_captures(spark, str(tmp_path)))
    assert got == [("a", "cap7", 0, "HEAD"), ("a", "cap7", 1, "line one"), ("a", "cap7", 2, ""),
                   ("a", "cap7", 3, "")]


def test_log_line_rules(rows, spark, tmp_path):
    text = "a\r\nb\rc\n\nd"
    got = values(split_log_lines(rows([(1, text)], "k int, text string")), "pos", "line")
    assert got == [(0, "a"), (1, "b\rc"), (3, "d")]
    (tmp_path / "log_name=app").mkdir()
    (tmp_path / "log_name=app" / "x.log").write_bytes(text.encode())
    got = values(read_log_files(spark, str(tmp_path)), "log_name", "line")
    assert got == [("app", "a"), ("app", "b\rc"), ("app", "d")]


def test_log_file_info(rows):
    specs = rows([("n", "app", "/l/app", 10), ("n", "gone", "/l/gone", 5), ("n", "dir", "/l", 1)],
                 "node_name string, name string, path string, max_lines int")
    ts = dt.datetime(2024, 1, 15, 10, 30)
    inventory = rows([("n", "/l", True, 0, ts), ("n", "/l/app", False, 524288, ts), ("m", "/l/gone", False, 1, ts)],
                     "node_name string, path string, is_dir boolean, size bigint, mtime timestamp_ntz")
    got = values(log_file_info(specs, inventory), "name", "size", "mod_time")
    assert got == [("app", 524288, ts), ("dir", 0, None), ("gone", 0, None)]


def test_transfers(rows):
    line = "Thu Sep  2 09:52:00 2004 50 192.168.20.10 896242 /home/test/f1.tgz b _ o r suporte ftp 0 * c"
    lines = rows([(1, line), (2, line.replace("2004", "2003").replace(" o r", " i r")), (3, "junk"),
                  (4, line + " extra")], "id int, line string")
    parsed = parse_transfer_log(lines)
    assert values(parsed) == [
        (1, dt.datetime(2004, 9, 2, 9, 52), "192.168.20.10", "suporte", "/home/test/f1.tgz", 896242, 50,
         "download", "complete"),
        (2, dt.datetime(2003, 9, 2, 9, 52), "192.168.20.10", "suporte", "/home/test/f1.tgz", 896242, 50,
         "upload", "complete"),
    ]
    start = F.lit("2004-01-01").cast("timestamp_ntz")
    assert values(parse_transfer_log(lines, start), "id") == [(1,)]
    assert values(list_transfers(parsed, user="suporte", direction="upload"), "id") == [(2,)]
    assert values(list_transfers(parsed, host="other"), "id") == []


def test_scan_file_tree(spark, tmp_path):
    for name in ("d1/s1", "d2"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("f.txt", "d1/a.log", "d1/s1/b", "d2/.hidden"):
        (tmp_path / name).write_text("xy")
    os.symlink(tmp_path / "d1", tmp_path / "link")
    expected = [("d1", True), ("d1/a.log", False), ("d1/s1", True), ("d1/s1/b", False), ("d2", True),
                ("d2/.hidden", False), ("f.txt", False), ("link", False)]
    for task_entries in (1, 3, 1000):
        found = scan_file_tree(spark, str(tmp_path), "n", task_entries).collect()
        assert sorted((os.path.relpath(r.path, tmp_path), r.is_dir) for r in found) == expected
    assert scan_file_tree(spark, str(tmp_path / "none")).count() == 0
