"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The reader checks every record: compressed member, version line, header, length, digests. Where
a check fails it searches on for whichever comes first, the next member or the next version line,
that holds a whole record, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm.tables import file_system, only, output_folder, written

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
#: What a member or a version line begins with, and its most bytes.
START, START_BYTES = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n"), 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Own header field: length of the payload that a revisit leaves out.
PAYLOAD_BYTES = "X-Payload-Bytes"
ARCHIVED = "1970-01-01T00:00:00Z"
#: A file ends with the record that brings it to so many bytes; bytes read at a time.
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes that are decompressed, or looked through for a header, at first.
FEED_BYTES, LITTLE = 1 << 14, 16
#: A header longer than this is taken for damage.
HEADER_BYTES = 1 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record; fields in the order given, then the block's digest and length."""
    fields |= {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block + END


def page_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """A response with the payload or, where another page holds it, a revisit of that page."""
    revisit = page_id != first_id
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": page_name(page_id),
        "WARC-Date": ARCHIVED,
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or ""),
        "WARC-Payload-Digest": digest(payload),
        PAYLOAD_BYTES: str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Refers-To": page_name(first_id), "WARC-Profile": REVISIT_PROFILE}
    return record(fields, HTTP_HEAD if revisit else HTTP_HEAD + payload)


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every page to gzip-member archives; returns their stored list (path, records).

    Payload is the html in UTF-8, null being empty. Of pages with equal payloads of at least
    ``least_bytes`` bytes the one with the smallest page_id is a response, the others revisit it.
    A null page_id comes after all others; rows that repeat the smallest page_id, and pages of
    one payload that have no page_id at all, are all responses. Columns other than page_id, url
    and html are not read. A repeated task writes files of new names; only those of the attempt
    that Spark committed are listed. An empty table gives no file.
    """
    spark = pages.sparkSession
    target = output_folder(spark, "archives", folder)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload"))
    shared = (
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("_sha1")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_sha1", "first_id", F.lit(True).alias("shared"))
    )

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, files, size = None, [], 0
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "first_id", "shared"))
            for page_id, url, body, first_id, shared in zip(*columns, strict=True):
                if out is None:
                    uri = f"{target}/{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId()}.warc.gz"
                    system, path = file_system(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, size = system.open_output_stream(path, compression=None), 0
                    files.append([uri, 0])
                    info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{task.partitionId()}:{len(files)}>", "WARC-Date": ARCHIVED}
                    out.write(gzip.compress(record(info, b"format: WARC File Format 1.1\r\n"), mtime=0))
                own = page_id.as_py()
                made = page_record(own, url.as_py(), body.as_py(), first_id.as_py() if shared.as_py() else own)
                size += out.write(packed := gzip.compress(made, 6, mtime=0)) or len(packed)
                files[-1][1] += 1
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64())], ["path", "records"])

    joined = rows.join(shared, "_sha1", "left").select("page_id", "url", "payload", "first_id", "shared")
    return written(joined.mapInArrow(write, "path string, records long"), "archive-list")


@dataclass
class Found:
    """A record, or with a reason a gap of bytes begin to end of the file (of the member's content, if inside)."""

    begin: int
    end: int
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""


def parse_record(data: bytes, at: int) -> tuple[Found | None, str]:
    """The record that begins at this place of ``data`` if it is whole and right, else why not."""
    version = VERSION_LINE.match(data, at)
    if not version:
        return None, "version"
    head = data.find(END, at, at + HEADER_BYTES)
    if head < 0:
        return None, "header"
    fields = {}
    for line in data[version.end() : head].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None, "header"
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, "length"
    begin = head + len(END)
    end = begin + int(length)
    if data[end : end + len(END)] != END:
        return None, "length"
    block = data[begin:end]
    if fields.get("warc-block-digest", digest(block)) != digest(block):
        return None, "block digest"
    found = Found(at, end + len(END), fields, block)
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:"):
        if fields["warc-payload-digest"] != digest(payload_of(found)):
            return None, "payload digest"
    return found, ""


def payload_of(found: Found) -> bytes:
    return found.block.partition(END)[2] if found.fields.get("content-type", "").startswith("application/http") else found.block


def records_in(data: bytes) -> Iterator[Found]:
    """Records and gaps of uncompressed bytes."""
    at = gap = 0
    reason = ""
    while at < len(data):
        found, why = parse_record(data, at)
        if found:
            if gap < at:
                yield Found(gap, at, reason=reason)
            yield found
            at = gap = found.end
        else:
            reason = reason if gap < at else why
            later = VERSION_LINE.search(data, at + 1)
            at = later.start() if later else len(data)
    if gap < len(data):
        yield Found(gap, len(data), reason=reason)


class _Source:
    """Bytes of a file by place, through a window that is read once."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.window, self.begin = b"", 0

    def read(self, at: int, count: int) -> bytes:
        """``count`` bytes from ``at`` on, fewer at the end of the file."""
        end = min(at + count, self.size)
        if at < self.begin or end > self.begin + len(self.window):
            self.window, self.begin = self.file.read_at(min(max(end - at, READ_BYTES), self.size - at), at), at
        return self.window[at - self.begin : end - self.begin]

    def next_start(self, at: int) -> int:
        """Place of the next member's or version line's first bytes, or the size."""
        while at < self.size:
            data = self.read(at, READ_BYTES)
            if here := START.search(data):
                return at + here.start()
            at += max(1, len(data) - START_BYTES + 1) if at + len(data) < self.size else len(data)
        return self.size


def _member(source: _Source, at: int, most: int | None = None, feed: int | None = None) -> tuple[bytes, int, str]:
    """Content of the gzip member at this place (``most`` bytes of it), where it ends, and what is wrong with it."""
    feed = feed or FEED_BYTES
    engine, parts, held, place = zlib.decompressobj(31), [], 0, at
    try:
        while place < source.size:
            data = source.read(place, feed)
            parts.append(engine.decompress(data, 0 if most is None else most - held))
            held += len(parts[-1])
            place += len(data)
            if engine.eof or held == most:
                return b"".join(parts), place - len(engine.unused_data or engine.unconsumed_tail), ""
    except zlib.error:
        # What came before the damage in the bytes last fed is lost with the error: they are fed in little.
        return _member(source, at, most, LITTLE) if feed > LITTLE else (b"".join(parts), place, "member")
    return b"".join(parts), place, "end of file"


def _plain(source: _Source, at: int) -> tuple[Found | None, str, int | None]:
    """The uncompressed record at this place; else why not, and where it ends if its length holds."""
    head = -1
    for size in (FEED_BYTES, HEADER_BYTES):
        start = source.read(at, size)
        if (head := start.find(END)) >= 0:
            break
    length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", start[: head + 2], re.I) if head >= 0 else None
    end = at + head + 2 * len(END) + int(length[1]) if length else 0
    if not length or end > source.size:
        return None, parse_record(start, 0)[1] or "length", None
    found, why = parse_record(source.read(at, end - at), 0)
    if found:
        return Found(at, end, found.fields, found.block), "", end
    follows = why.endswith("digest") and (end == source.size or START.match(source.read(end, START_BYTES)))
    return None, why, end if follows else None


def salvage(uri: str) -> Iterator[Found]:
    """All records of an archive that are whole, in order, and the gaps between them.

    Compressed members and plain records may follow one another. Where a check fails the nearer
    of the next member and the next version line that holds a whole record is gone on with, and
    the bytes up to it are a gap; a plain record whose digest alone is wrong is a gap up to its own end. A damaged
    member gives the whole records before its damage. One member or plain record is held in memory.
    """
    source = _Source(uri)
    try:
        at, gap, reason = 0, 0, ""
        while at < source.size:
            good, why, end = _records_at(source, at)
            if good:
                if gap < at:
                    yield Found(gap, at, reason=reason)
                yield from good
            if not why:
                if not good and gap < at:
                    yield Found(gap, at, reason=reason)
                at = gap = end
                continue
            if good:
                gap = at = end
                reason = why
            elif gap == at:
                reason = why
            at = source.next_start(at + 1) if good or end is None else end
        if gap < source.size:
            yield Found(gap, source.size, reason=reason)
    finally:
        source.file.close()


def _records_at(source: _Source, at: int) -> tuple[list[Found], str, int | None]:
    """What begins at this place: records and gaps of a sound member or plain record, or the sound
    records before the damage; what is wrong; and where the search goes on, if that is known."""
    if source.read(at, len(MEMBER)) != MEMBER:
        found, why, end = _plain(source, at)
        return [found] if found else [], why, end
    data, end, why = _member(source, at)
    inside = list(records_in(data)) if data else []
    good = [f for f in inside if not f.reason]
    if not why and (good or not data):
        return [Found(at, end, f.fields, f.block, f.reason) for f in inside], "", end
    if not good:
        return [], why or next((f.reason for f in inside), "member"), None
    # What was read of the member for its good records is theirs; the search goes on behind it.
    read = _member(source, at, good[-1].end)[1]
    return [Found(at, read, f.fields, f.block) for f in good], why, read


RECORDS = (
    "path string, begin long, end long, gap string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives in column path: place in the file, record_type, page_id, url,
    payload_bytes and payload_digest of the full payload, refers_to, and the payload if wanted.

    A row whose ``gap`` is not null is no record: it logs quarantined bytes and why. An empty list
    gives no row, an empty archive none either; records may be of any length, and one that repeats comes as often.
    Columns of ``files`` other than path are not read.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for found in salvage(path):
                    rows.append(_row(path, found, with_payload))
                    held += len(found.block) if with_payload else 1000
                    if held > 4 << 20:
                        yield _table(rows)
                        rows, held = [], 0
                if rows:
                    yield _table(rows)

    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RECORDS.split(", ")] + [pa.binary()] * with_payload

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # A file is a task's work.
    listed = files.select("path").repartition(max(1, files.count()))
    return listed.mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def _row(path: str, found: Found, with_payload: bool) -> tuple:
    if found.reason:
        return (path, found.begin, found.end, found.reason, *[None] * (6 + with_payload))
    f = found.fields
    kind = f.get("warc-type", "")
    payload = payload_of(found)
    own = kind != "revisit"
    size = len(payload) if own else int(f[PAYLOAD_BYTES.lower()]) if f.get(PAYLOAD_BYTES.lower(), "").isdigit() else None
    name = digest(payload) if own else f.get("warc-payload-digest")
    return (
        path, found.begin, found.end, None, kind, page_of(f.get("warc-record-id")), f.get("warc-target-uri"), size,
        name.removeprefix("sha1:") if name else None, page_of(f.get("warc-refers-to")), *[payload if own else None] * with_payload,
    )


#: Response and revisits from the table itself; base32 from the digest's bits, five at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, CAST(CAST(unhex(sha1(t)) AS BIT) AS VARCHAR) AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(substr(bits, i + 1, 1) AS INT) * 16 + CAST(substr(bits, i + 2, 1) AS INT) * 8 + CAST(substr(bits, i + 3, 1) AS INT) * 4
           + CAST(substr(bits, i + 4, 1) AS INT) * 2 + CAST(substr(bits, i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
