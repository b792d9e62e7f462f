"""Growing log files as a stream of lines.

Spark's file sources take a file once and do not see appends, hence this source. Its
offset is, per file, the inode and the byte after the last complete line, kept in the
query's checkpoint: a restart resumes where it was. Files must be on storage that every
executor mounts.

A file is read again from its start when another file took its place (rotation) or when it
ends before the last offset (truncation). A file that only changed its name goes on where it
was, known by its inode and a checksum of its first bytes. A file that is absent for a while keeps its offset: in memory, and
across restarts in ``stateFile``, as a source is not told where the query stood before. A file
truncated and grown past the old offset between two triggers is not noticed.

With ``maxBytesPerTrigger`` a batch takes about that many bytes, cut at line starts, and the rest of
a backlog comes in later batches: small backlogs first whole, what is left shared between the large ones.
"""

import glob
import json
import os
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote
from dataclasses import dataclass
from datetime import datetime
from collections.abc import Callable
from typing import Iterator

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

FORMAT = "log_tail"
BLOCK_BYTES = 1 << 20
DEFAULT_RANGE_BYTES = 128 << 20
DEFAULT_MAX_LINE_BYTES = 1 << 20
BATCH_ROWS = 8192
HEAD_BYTES = 256
#: Files whose size and last line are looked up at once: storage is waited for, not computed on.
LOOKUPS = 32
# Fixed value: the time a transfer log line begins with, xferlog(5).
XFERLOG_TIME = "%a %b %d %H:%M:%S %Y"
DEFAULT_FORGET_S = 30 * 24 * 3600

_SCHEMA = (
    "node_name string, log_name string, log_path string, line_offset bigint, "
    "line string, oversize_line string"
)
_ARROW = pa.schema(
    [
        ("node_name", pa.string()),
        ("log_name", pa.string()),
        ("log_path", pa.string()),
        ("line_offset", pa.int64()),
        ("line", pa.string()),
        ("oversize_line", pa.string()),
    ]
)


@dataclass
class ByteRange(InputPartition):
    """Lines of one file that start at or after ``start`` and before ``stop``."""

    node_name: str
    log_name: str
    path: str
    inode: int
    first: int  # where the batch begins in this file: always a line start
    start: int
    stop: int
    last: int  # where the batch ends in this file


class LogTail(DataSource):
    """Lines of log files, as a stream or (whole files) as a table.

    Options: ``path``, a glob of files below directories ``node_name=<n>/log_name=<l>``
    (new files join at the next trigger); ``stateFile``, where offsets of absent files outlive
    a restart; ``maxPartitionBytes``; ``maxLineBytes``, beyond which a line comes in
    ``oversize_line``, in pieces of that many bytes with a row and offset each; ``maxBytesPerTrigger``, the
    input of a batch, about (needs ``stateFile``, which then belongs to the checkpoint, as a source
    is not told where its query stood); ``forgetAfterSeconds``, after which an absent file's offset goes
    (default 30 days; should it come back, it is read from its start); ``startTime`` (ISO), before
    which a file's lines are not read: files ordered in time are bisected on line starts, by the
    time in a line's first ``timeBytes`` bytes as ``timeFormat`` (that of a transfer log if none is given) has it; ``emitPartial`` (default false) to emit an
    unterminated last line, whose rest then becomes another line; ``failOnDataLoss``
    (default true) for planned bytes that are gone before they were read.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> "LogTailStreamReader":
        return LogTailStreamReader(LogFiles(dict(self.options)))

    def reader(self, schema) -> "LogFileReader":
        return LogFileReader(LogFiles(dict(self.options)))


class LogFiles:
    """Finding files, cutting them into ranges and reading the ranges' lines."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.pattern = given["path"]
        if self.pattern.startswith("file:"):
            self.pattern = self.pattern[len("file:"):]
        self.range_bytes = int(given.get("maxpartitionbytes", DEFAULT_RANGE_BYTES))
        self.max_line_bytes = int(given.get("maxlinebytes", DEFAULT_MAX_LINE_BYTES))
        self.state_file = given.get("statefile", "").removeprefix("file:")
        self.budget = int(given["maxbytespertrigger"]) if "maxbytespertrigger" in given else None
        if self.budget is not None and (self.budget < 1 or not self.state_file):
            raise ValueError("maxBytesPerTrigger must be positive and needs a stateFile")
        start = given.get("starttime")
        self.start_time = datetime.fromisoformat(start) if start else None
        self.time_format = given.get("timeformat", XFERLOG_TIME)
        self.time_bytes = int(given.get("timebytes", 24))
        self.forget_s = float(given.get("forgetafterseconds", DEFAULT_FORGET_S))
        self.emit_partial = given.get("emitpartial", "false").lower() == "true"
        self.fail_on_loss = given.get("failondataloss", "true").lower() == "true"

    def paths(self) -> list[str]:
        return sorted(p for p in glob.glob(self.pattern) if os.path.isfile(p))

    def begin(self, path: str, last: int) -> int:
        """Where reading a file begins: its start, or its first line from ``startTime`` on."""
        return 0 if self.start_time is None else first_line_from(path, last, self.start_time, self._stamp)

    def _stamp(self, raw: bytes) -> datetime | None:
        try:
            return datetime.strptime(raw[: self.time_bytes].decode("ascii"), self.time_format)
        except ValueError:
            return None

    def ranges(self, path: str, inode: int, first: int, last: int) -> list[ByteRange]:
        labels = {k: unquote(v) for k, v in (p.split("=", 1) for p in path.split("/") if "=" in p)}
        return [
            ByteRange(
                labels.get("node_name", ""), labels.get("log_name", ""), path, inode,
                first, start, min(start + self.range_bytes, last), last,
            )
            for start in range(first, last, self.range_bytes)
        ]

    def lines(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        try:
            handle = open(part.path, "rb")
        except FileNotFoundError:
            self._lost(part, "the file is gone")
            return
        with handle:
            stat = os.fstat(handle.fileno())
            if stat.st_ino != part.inode or stat.st_size < part.last:
                self._lost(part, "the file was replaced or truncated")
                return
            yield from self._batches(part, _lines_in(handle, part, self.max_line_bytes))

    def _lost(self, part: ByteRange, why: str) -> None:
        if self.fail_on_loss:
            raise RuntimeError(f"bytes {part.start}-{part.stop} of {part.path}: {why}")

    def _batches(self, part: ByteRange, lines) -> Iterator[pa.RecordBatch]:
        offsets, texts, oversize = [], [], []

        def flush() -> pa.RecordBatch:
            count = len(offsets)
            columns = [
                pa.array([value] * count, pa.string())
                for value in (part.node_name, part.log_name, part.path)
            ] + [pa.array(offsets, pa.int64()), pa.array(texts, pa.string()),
                 pa.array(oversize, pa.string())]
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for offset, raw, fits in lines:
            raw = raw.removesuffix(b"\r") if fits else raw
            if not raw:
                continue
            text = raw.decode("utf-8", "replace")
            offsets.append(offset)
            texts.append(text if fits else None)
            oversize.append(None if fits else text)
            if len(offsets) == BATCH_ROWS:
                yield flush()
                offsets, texts, oversize = [], [], []
        if offsets:
            yield flush()


def _lines_in(handle, part: ByteRange, most: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes without line feed, whole) of the lines that start within the range.

    A line of more than ``most`` bytes comes in pieces of ``most`` bytes, none of them whole:
    no more of it is held at a time.
    """
    position = part.start
    handle.seek(position)
    if part.start > part.first:
        # A line running into the range belongs to the one before; a line starting
        # exactly here is ours, so the search begins one byte earlier.
        position -= 1
        handle.seek(position)
        skipped = b""
        while not skipped.endswith(b"\n") and position < part.last:
            skipped = handle.readline(min(BLOCK_BYTES, part.last - position))
            position += len(skipped)
            if not skipped:
                return
    while position < part.stop:
        # Room for the line end, so that a line of just ``most`` bytes is whole.
        raw = handle.readline(min(most + 2, part.last - position))
        if not raw:
            return
        text = raw.removesuffix(b"\n")
        if len(text.removesuffix(b"\r")) <= most and (raw.endswith(b"\n") or position + len(raw) >= part.last):
            yield position, text, True
            position += len(raw)
            continue
        begin, held = position, b""
        while raw:
            position += len(raw)
            ended = raw.endswith(b"\n")
            held += raw.removesuffix(b"\n").removesuffix(b"\r") if ended else raw
            while len(held) > most or (ended and held):
                yield begin, held[:most], False
                begin, held = begin + most, held[most:]
            raw = b"" if ended else handle.readline(min(most, part.last - position))
        if held:
            yield begin, held, False


def _after_last_newline(path: str, size: int, floor: int) -> int:
    """Offset after the last line feed before ``size``; ``floor`` when there is none."""
    with open(path, "rb") as handle:
        end = size
        while end > floor:
            start = max(end - BLOCK_BYTES, floor)
            handle.seek(start)
            found = handle.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return floor


def first_line_from(path: str, end: int, start: datetime, stamp: Callable[[bytes], datetime | None]) -> int:
    """Offset of the first line at ``start`` or later in a file whose times do not fall; ``end`` when there is none.

    Bisects on bytes and reads a line at each step. A line without a time goes with the one before.
    """

    def stamped(handle, at: int, stop: int) -> tuple[int, int, datetime] | None:
        """Begin, end and time of the first line with a time that begins in [at, stop)."""
        handle.seek(max(0, at - 1))
        if at:
            handle.readline()  # the rest of the line before, or only its line feed
        while (begin := handle.tell()) < stop:
            raw = handle.readline()
            if (found := stamp(raw)) is not None:
                return begin, begin + len(raw), found
        return None

    low, high, best = 0, end, end
    with open(path, "rb") as handle:
        while low < high:
            middle = (low + high) // 2
            line = stamped(handle, middle, high)
            if line is None or line[2] >= start:
                best = line[0] if line else best
                high = middle
            else:
                low = line[1]
    return best


def _head(path: str, end: int) -> int:
    """Checksum of the first bytes up to ``end``, HEAD_BYTES at most."""
    with open(path, "rb") as handle:
        return zlib.crc32(handle.read(min(end, HEAD_BYTES)))


def _line_start_by(path: str, start: int, wanted: int, end: int) -> int:
    """The last line start in (start, wanted], or else the first one after: a long line is taken whole."""
    found = _after_last_newline(path, wanted, start)
    if found > start:
        return found
    with open(path, "rb") as handle:
        handle.seek(wanted)
        at = wanted
        while at < end:
            raw = handle.read(min(BLOCK_BYTES, end - at))
            if not raw:
                break
            if (feed := raw.find(b"\n")) >= 0:
                return at + feed + 1
            at += len(raw)
    return end


class LogTailStreamReader(DataSourceStreamReader):
    def __init__(self, files: LogFiles):
        self.files = files
        self._seen: dict[str, tuple[int, int, list[int]]] = {}  # path -> inode, size, offset
        self._known: dict[str, list[int]] | None = None  # offsets given out, absent files included
        self._absent: dict[str, float] = {}  # when a file was first found absent

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(LOOKUPS) as pool:
            looked = pool.map(self._line_end, self.files.paths())
        found = {path: offset for path, offset in looked if offset}
        self._seen = {p: s for p, s in self._seen.items() if p in found}
        if self._known is None:
            self._known = self._stored()
        if self.files.budget is not None:
            found = self._admitted(found)
        here, now = {o[0] for o in found.values()}, time.time()
        absent = {p: o for p, o in self._known.items() if p not in found and o[0] not in here}
        self._absent = {p: self._absent.get(p, now) for p in absent}
        absent = {p: o for p, o in absent.items() if now - self._absent[p] < self.files.forget_s}
        self._known = absent | found
        return dict(self._known)

    def _stored(self) -> dict[str, list[int]]:
        try:
            with open(self.files.state_file) as handle:
                return json.load(handle)
        except FileNotFoundError:
            return {}

    def _line_end(self, path: str) -> tuple[str, list[int] | None]:
        """Inode, line end and checksum of a file; a file that did not change is not opened."""
        try:
            stat = os.stat(path)
            inode, size, offset = self._seen.get(path, (None, 0, [0, 0, 0]))
            if (inode, size) != (stat.st_ino, stat.st_size):
                grown = inode == stat.st_ino and stat.st_size > size
                if self.files.emit_partial:
                    end = stat.st_size
                else:
                    end = _after_last_newline(path, stat.st_size, offset[1] if grown else 0)
                offset = [stat.st_ino, end, _head(path, end)]
                self._seen[path] = (stat.st_ino, stat.st_size, offset)
        except FileNotFoundError:
            return path, None
        return path, offset

    def _admitted(self, found: dict[str, list[int]]) -> dict[str, list[int]]:
        """The offsets, moved back to line starts so that the batch takes about the budget.

        Files with the fewest new bytes come first; each takes what it has, or an equal share of
        what is left of the budget, and at least one line.
        """
        known = {inode: (done, head) for inode, done, head in self._known.values()}
        pending = {}
        for path, (inode, end, head) in found.items():
            done, before = known.get(inode, (0, None))
            if self._known.get(path) == [inode, end, head]:
                continue
            try:
                pending[path] = done if done <= end and _head(path, done) == before else 0
            except FileNotFoundError:
                pending[path] = 0
        left, out = self.files.budget, dict(found)
        order = sorted(pending, key=lambda p: (found[p][1] - pending[p], p))
        for i, path in enumerate(order):
            inode, end, _ = found[path]
            start, share = pending[path], max(0, left) // (len(order) - i)
            if end - start > share:
                try:
                    stop = _line_start_by(path, start, start + share, end) if left > 0 else start
                    if stop == start == 0 and path not in self._known:
                        del out[path]  # not begun yet
                        continue
                    out[path] = [inode, stop, _head(path, stop)]
                except FileNotFoundError:
                    del out[path]
                    continue
            left -= out[path][1] - start
        return out

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        if self.files.state_file:
            self._store(end)
        known = {inode: (done, head) for inode, done, head in start.values()}
        planned = []
        for path, offset in end.items():
            if start.get(path) == offset:
                continue
            inode, last, _ = offset
            done, head = known.get(inode, (0, None))
            same = done <= last and os.path.exists(path) and _head(path, done) == head
            planned += self.files.ranges(path, inode, done if same else self.files.begin(path, last), last)
        return planned

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.files.lines(partition)

    def _store(self, end: dict) -> None:
        """Once a batch is planned, its end is in the query's log and will be reached."""
        spare = f"{self.files.state_file}.new"
        with open(spare, "w") as handle:
            json.dump(end, handle)
        os.replace(spare, self.files.state_file)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LogFileReader(DataSourceReader):
    """Whole files once, an unterminated last line included."""

    def __init__(self, files: LogFiles):
        self.files = files

    def partitions(self) -> list[ByteRange]:
        planned = []
        for path in self.files.paths():
            stat = os.stat(path)
            planned += self.files.ranges(path, stat.st_ino, self.files.begin(path, stat.st_size), stat.st_size)
        return planned

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.files.lines(partition)
