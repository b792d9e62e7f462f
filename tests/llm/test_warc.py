import gzip

import duckdb
import pytest
from plain import result

from hostweave.llm import warc

PAGES = [
    (4, "u4", "<p>same</p>"),
    (2, "u2", "<p>same</p>"),
    (2, "u2", "<p>same</p>"),
    (None, "u", "<p>same</p>"),
    (3, None, None),
    (1, "u1", ""),
    (5, "bad\r\nurl", "é\r\n\r\nWARC/1.1\r\n" * 3),
    (6, "u6", "x" * 200_000),
    (None, None, "alone"),
    (None, None, "alone"),
]


def pages(spark, rows=PAGES):
    made = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "a long, b string, c string, d string, e string")
    return made.toDF("page_id", "url", "html", "HTML", "first_id")


def read(uri):
    found = list(warc.salvage(uri))
    return [f for f in found if not f.reason and f.fields["warc-type"] != "warcinfo"], [(f.begin, f.end, f.reason) for f in found if f.reason]


def members(count=6):
    return [gzip.compress(warc.page_record(i, f"u{i}", f"payload {i} ".encode() * 50, i), mtime=0) for i in range(count)]


def test_archives_hold_every_page(spark, tmp_path):
    files = warc.write_archives(pages(spark), f"file://{tmp_path}/w", file_bytes=400)
    assert files.count() > 1
    found = warc.read_archives(files, with_payload=True).where("record_type IN ('response', 'revisit')")
    database = duckdb.connect()
    database.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    database.executemany("INSERT INTO pages VALUES (?, ?)", [(p, h) for p, _, h in PAGES])
    want = sorted(database.sql(warc.SQL).fetchall(), key=repr)
    assert result(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    texts = {r.page_id: bytes(r.payload) for r in found.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert texts == {p: (h or "").encode() for p, _, h in PAGES if p in (1, 2, 5, 6)}


def test_least_bytes(spark):
    found = warc.read_archives(warc.write_archives(pages(spark), least_bytes=6))
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in found.where("page_id IS NOT NULL").collect()}
    assert kinds[3, 0] == kinds[1, 0] == "response" and kinds[4, 11] == "revisit"


def test_no_pages(spark):
    assert result(warc.read_archives(warc.write_archives(pages(spark, [])))) == []


@pytest.mark.parametrize("damage", ["flip", "cut", "garbage", "header"])
def test_salvage_goes_on_after_damage(tmp_path, damage):
    parts = members()
    bad = bytearray(parts[2])
    if damage == "flip":
        bad[len(bad) // 2] ^= 0xFF
    elif damage == "cut":
        del bad[len(bad) // 2 :]
    elif damage == "garbage":
        bad = bytearray(b"\x1f\x8b\x08 no member \x1f\x8b")
    else:
        bad = bytearray(gzip.compress(gzip.decompress(parts[2]).replace(b"Content-Length: ", b"Content-Length: 9"), mtime=0))
    parts[2] = bytes(bad)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    good, gaps = read(f"file://{tmp_path}/a.warc.gz")
    assert [warc.page_of(f.fields["warc-record-id"]) for f in good] == [0, 1, 3, 4, 5]
    begin = len(parts[0]) + len(parts[1])
    assert [g[:2] for g in gaps] == [(begin, begin + len(parts[2]))] and gaps[0][2]


def test_gap_at_either_end(tmp_path):
    parts = members(3)
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + b"".join(parts) + parts[0][:30])
    good, gaps = read(f"{tmp_path}/a.warc.gz")
    assert len(good) == 3 and [(b, e) for b, e, _ in gaps] == [(0, 4), (4 + sum(map(len, parts)), 34 + sum(map(len, parts)))]


def test_changed_payload_is_found_by_its_digest(tmp_path):
    records = [warc.page_record(i, "u", b"abcdef", i) for i in range(3)]
    records[1] = records[1].replace(b"abcdef", b"abcdeX")
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    good, gaps = read(f"{tmp_path}/a.warc")
    assert [warc.page_of(f.fields["warc-record-id"]) for f in good] == [0, 2]
    assert gaps == [(len(records[0]), len(records[0]) + len(records[1]), "block digest")]


def test_plain_archive_is_searched_by_version_lines(tmp_path):
    records = [warc.page_record(i, "u", b"x" * 700_000, i) for i in range(4)]
    torn = records[1][: len(records[1]) // 2]
    (tmp_path / "a.warc").write_bytes(records[0] + torn + records[2] + records[3])
    good, gaps = read(f"{tmp_path}/a.warc")
    assert [warc.page_of(f.fields["warc-record-id"]) for f in good] == [0, 2, 3]
    assert [(b, e) for b, e, _ in gaps] == [(len(records[0]), len(records[0]) + len(torn))]


def test_sound_records_of_a_damaged_member_are_kept(tmp_path):
    both = gzip.compress(b"".join(warc.page_record(i, "u", bytes(range(256)) * 3_000, i) for i in range(2)), 0, mtime=0)
    (tmp_path / "a.warc.gz").write_bytes(both[:-400_000] + members(1)[0])
    good, gaps = read(f"{tmp_path}/a.warc.gz")
    assert [warc.page_of(f.fields["warc-record-id"]) for f in good] == [0, 0] and len(gaps) == 1


def ids(found):
    return [warc.page_of(f.fields["warc-record-id"]) for f in found]


def test_plain_archive_with_a_compressed_payload(tmp_path):
    records = [warc.page_record(i, "u", gzip.compress(b"inner") if i == 2 else b"plain", i) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    good, gaps = read(f"{tmp_path}/a.warc")
    assert ids(good) == [0, 1, 2, 3, 4] and not gaps


def test_plain_record_between_members(tmp_path):
    parts = members(3)
    plain = warc.page_record(7, "u", b"plain", 7)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + plain + parts[1] + b"junk" + plain + parts[2])
    good, gaps = read(f"{tmp_path}/a.warc.gz")
    assert ids(good) == [0, 7, 1, 7, 2]
    at = len(parts[0]) + len(plain) + len(parts[1])
    assert [g[:2] for g in gaps] == [(at, at + 4)]


@pytest.mark.parametrize("damaged", [False, True])
def test_records_within_a_long_plain_record_are_payload(tmp_path, damaged):
    inner = warc.page_record(9, "u", b"inner", 9)
    outer = warc.page_record(1, "u", b"x" * 1_500_000 + inner + b"y" * 10, 1)
    if damaged:  # its digest is wrong, its length holds
        outer = outer.replace(b"yyyy", b"yyyz")
    first, last = warc.page_record(0, "u", b"a", 0), warc.page_record(2, "u", b"b", 2)
    (tmp_path / "a.warc").write_bytes(first + outer + last)
    good, gaps = read(f"{tmp_path}/a.warc")
    assert ids(good) == ([0, 2] if damaged else [0, 1, 2])
    assert [g[:2] for g in gaps] == ([(len(first), len(first) + len(outer))] if damaged else [])


def test_small_windows_find_the_same(tmp_path, monkeypatch):
    parts = members()
    bad = b"\x1f\x8b" + b"\x1f\x8b\x08" * 3 + b"WARC/1.1\r\nX: 1\r\n\r\nWARC/1.1" + parts[2][: len(parts[2]) // 2]
    stored = gzip.compress(b"".join(warc.page_record(i, "u", b"s" * 300, i) for i in (20, 21)), 0, mtime=0)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + bad + parts[1] + stored[:-200] + warc.page_record(8, "u", b"p" * 900, 8) + bad + parts[3])
    want = read(f"{tmp_path}/a.warc.gz")
    assert ids(want[0]) == [0, 1, 20, 8, 3]
    for size in (11, 64, 1000):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        monkeypatch.setattr(warc, "FEED_BYTES", size)
        found = read(f"{tmp_path}/a.warc.gz")
        assert ids(found[0]) == ids(want[0]) and [g[0] for g in found[1]] == [g[0] for g in want[1]]


def test_empty_file(tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"")
    assert read(f"{tmp_path}/a.warc.gz") == ([], [])
