"""Exact removal of byte strings that an earlier document holds, by sorting suffixes.

Two equal strings of 50 bytes have the same least hash of the 24-byte strings in them. Runs of
neighbouring strings with one least hash are the unit of work: first only hashes travel, to
find those that two documents have; then the runs that have such a hash travel with their
bytes, and their suffixes are sorted where all runs of a hash meet. Texts stay where they are:
what other tasks found about a stored part of the documents lies beside it in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.suffixes import deep_shallow
from hostweave.llm.tables import file_system, only, schema_with, set_aside
from hostweave.workspace import fresh_dir

#: Length of a repeated string; of the strings whose least hash stands for it.
LENGTH, GRAM = 50, 24
#: Strings of 50 bytes in a run, and bytes of a run, as stored: padded, the count in the last.
RUN = LENGTH - GRAM + 1
RUN_BYTES = 80
#: Bytes of text, runs with bytes, and runs of a slice that are worked on together.
SLICE, TOGETHER, HELD = 1 << 20, 50_000, 2_000_000
#: Bits of a hash that travel in the first round, besides its bucket: too few only add work.
TRAVELS = 40
FACTOR = 0x9FB21C651E98DF25
#: A null doc_id comes after all others.
LAST_ID = np.iinfo(np.int64).max


def _factor(power: int) -> np.uint64:
    return np.uint64(pow(FACTOR, power, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on, from those of 16 and 8."""
    hashes = [_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))[raw]]
    for span in (1, 2, 4, 8):
        last = hashes[-1]
        hashes.append(last[:-span] * _factor(span) + last[span:])
    sixteen, eight = hashes[4], hashes[3]
    n = len(raw) - GRAM + 1
    return _mixed(sixteen[:n] * _factor(8) + eight[16 : 16 + n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, text, place in ``raw`` and count of the runs of strings of 50 bytes within a text.

    A run longer than ``RUN`` is cut. A text beyond ``SLICE`` bytes is taken in overlapping parts.
    """
    for at in range(0, max(1, len(raw) - LENGTH + 1), SLICE):
        part = raw[at : at + SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        least = _least(_gram_hashes(part), RUN)
        bounds = np.clip(offsets - at, 0, len(part))
        text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(bounds))
        inside = np.flatnonzero(text[: len(least)] == text[LENGTH - 1 :])
        if not len(inside):
            continue
        value, own = least[inside], text[inside]
        begin = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (own[1:] != own[:-1]))))
        count = np.diff(np.append(begin, len(inside)))
        if count.max() > RUN:
            pieces = -(-count // RUN)
            nth = tx.spread(np.zeros(len(count), np.int64), pieces)
            begin, count = np.repeat(begin, pieces) + RUN * nth, np.minimum(np.repeat(count, pieces) - RUN * nth, RUN)
        yield value[begin], own[begin], inside[begin] + at, count


def run_bytes(raw: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bytes of runs, zero after their end; the last byte is the count, so runs are equal as rows."""
    column = np.arange(RUN_BYTES)
    rows = raw[np.minimum(place[:, None] + column, len(raw) - 1)]
    rows[column >= (count + LENGTH - 1)[:, None]] = 0
    rows[:, -1] = count
    return rows


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(blob: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of a blob: (type, columns) each, all with equally many rows."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize * c for k, c in kinds)
    out, at = [], 0
    for kind, columns in kinds:
        found = np.frombuffer(raw, kind, n * columns, at)
        out.append(found.reshape(n, columns) if columns > 1 else found)
        at += found.nbytes
    return out


def _concatenated(blobs: list[bytes], kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpacked(b, kinds) for b in blobs), strict=True)]


def _beside(folder: str, part: int) -> list[bytes]:
    """What was written about a stored part; a part about which nothing was has no folder."""
    system, path = file_system(f"{folder}/part={part}")
    if system.get_file_info(path).type != fs.FileType.Directory:
        if system.get_file_info(path.rpartition("/")[0]).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{folder} is not to be found from here: name the shared folder with its scheme")
        return []
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
    return [b for f in files for b in pq.ParquetFile(system.open_input_file(f)).read(["blob"])["blob"].to_pylist()]


def _write_beside(found: DataFrame, label: str) -> str:
    folder = fresh_dir(found.sparkSession, label)
    found.repartition("part").write.option("compression", "uncompressed").partitionBy("part").parquet(folder)
    return folder


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of stored documents, each of one part; a row number holds the part in its upper bits."""
    for batch in tx.sliced(batches, "text", SLICE):
        part = batch.column("_row").to_numpy() >> 33
        cuts = [0, *(1 + np.flatnonzero(np.diff(part))).tolist(), len(part)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield int(part[low]), batch.slice(low, high - low)


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _shared_hashes(stored: DataFrame, buckets: int) -> str:
    """Folder with, for each part, the hashes of its runs that another document has, too."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, current = [], 0, None

        def flush() -> pa.RecordBatch:
            key, row = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = key % np.uint64(buckets)
            order = np.lexsort((row, bucket))
            key, row, bucket = key[order] // np.uint64(buckets), row[order], bucket[order]
            low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint8)
            ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
            begins = np.concatenate(([0], ends[:-1]))
            blobs = [_packed(low[a:b], high[a:b], np.diff(row[a:b], prepend=0).astype(np.uint32)) for a, b in zip(begins, ends, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[begins].astype(np.int32)), pa.array(np.full(len(blobs), current, np.int64)), pa.array(blobs, pa.binary())], ["bucket", "part", "blob"]
            )

        for part, batch in _by_part(batches):
            if held and (part != current or size > HELD):
                yield flush()
                held, size = [], 0
            current = part
            row = batch.column("_row").to_numpy() & ((1 << 33) - 1)
            for value, text, _, _ in runs(*tx.buffer_of(tx.strings(batch.column("text")))):
                held.append((value % np.uint64(buckets << TRAVELS), row[text]))
                size += len(value)
        if held:
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for bucket, part, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "blob")), strict=True):
                by_bucket.setdefault(bucket, []).append((part, blob))
        for bucket, blobs in by_bucket.items():
            keys, rows, parts = [], [], []
            for part, blob in blobs:
                low, high, step = _unpacked(blob, [(np.uint32, 1), (np.uint8, 1), (np.uint32, 1)])
                keys.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
                rows.append(np.cumsum(step, dtype=np.int64) | (part << 33))
                parts.append(np.full(len(low), part))
            key, row, part = np.concatenate(keys), np.concatenate(rows), np.concatenate(parts)
            order = np.argsort(key, kind="stable")
            key, row, part = key[order], row[order], part[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            shared = np.repeat(np.minimum.reduceat(row, begin) != np.maximum.reduceat(row, begin), np.diff(np.append(begin, len(key))))
            key, part = key[shared], part[shared]
            order = np.lexsort((key, part))
            key, part = key[order] * np.uint64(buckets) + np.uint64(bucket), part[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            ends = np.append(begin[1:], len(part))[: len(begin)]
            blobs = [_packed(np.unique(key[a:b])) for a, b in zip(begin, ends, strict=True)]
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blobs, pa.binary())], ["part", "blob"])

    sent = stored.select("_row", "text").mapInArrow(send, "bucket int, part long, blob binary")
    return _write_beside(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "part long, blob binary"), "shared-hashes")


class _Intervals:
    """Removed bytes of stored rows, to be written beside their parts."""

    def __init__(self):
        self.rows, self.begin, self.end = [], [], []

    def add(self, row: np.ndarray, place: np.ndarray, covered: np.ndarray) -> None:
        """Strings to remove: ``covered`` has a row per run, and a column per string in it."""
        run, nth = np.nonzero(covered)
        if len(run):
            first = np.concatenate(([True], (run[1:] != run[:-1]) | (nth[1:] != nth[:-1] + 1)))
            last = np.append(first[1:], True)
            self.rows.append(row[run[first]])
            self.begin.append((place[run[first]] + nth[first]).astype(np.uint32))
            self.end.append((place[run[last]] + nth[last] + LENGTH).astype(np.uint32))

    def batch(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        row, begin, end = np.concatenate(self.rows), np.concatenate(self.begin), np.concatenate(self.end)
        self.__init__()
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        part = row >> 33
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(cut[1:], len(part))
        blobs = [_packed(row[a:b], begin[a:b], end[a:b]) for a, b in zip(cut, ends, strict=True)]
        none = pa.nulls(len(blobs), pa.int32())
        return pa.RecordBatch.from_arrays([none, pa.array(part[cut]), pa.array(blobs, pa.binary())], ["bucket", "part", "blob"])


RUN_KINDS = [(np.uint64, 1), (np.int64, 1), (np.int64, 1), (np.uint32, 1), (np.uint8, RUN_BYTES)]


def _alike(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct row, and for each row the smallest doc that has an equal one."""
    order, new = deep_shallow(rows)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(rows) else np.zeros(0, np.int64)
    return number, least[number] if len(rows) else least


def _covered(value: np.ndarray, doc: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For runs, and each string of 50 bytes in them: does a run of a smaller doc hold it?"""
    number, least = _alike(content, doc)
    count = content[:, -1].astype(np.int64)
    later = doc > least
    # One run of each kind from its smallest document, if its hash has runs of another kind.
    _, keep = np.unique(np.where(later, number.max(initial=0) + 1, number), return_index=True)
    keep = keep[~later[keep]]
    of_hash, many = np.unique(value[keep], return_inverse=True, return_counts=True)[1:]
    keep = keep[many[of_hash] > 1]
    run = np.repeat(np.arange(len(keep)), count[keep])
    nth = tx.spread(np.zeros(len(keep), np.int64), count[keep])
    suffix = np.zeros((len(run), 56), np.uint8)
    suffix[:, :LENGTH] = content[keep[run][:, None], nth[:, None] + np.arange(LENGTH)]
    first = _alike(suffix, doc[keep[run]])[1]
    kind = np.zeros((int(number.max(initial=-1)) + 1, RUN), bool)
    kind[number[keep[run]], nth] = doc[keep[run]] > first
    return np.where(later[:, None], np.arange(RUN) < count[:, None], kind[number])


def _removed_strings(stored: DataFrame, buckets: int, shared: str) -> str:
    """Folder with, for each part, the intervals of bytes to remove."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        local, held = _Intervals(), []

        def flush() -> Iterator[pa.RecordBatch]:
            value, row, doc, at, content = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # What an equal run here already settles need not travel.
            later = doc > _alike(content, doc)[1]
            local.add(row[later], at[later], np.arange(RUN) < content[later, -1:])
            value, row, doc, at, content = (x[~later] for x in (value, row, doc, at, content))
            if not len(value):
                return
            bucket = (value % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((value, bucket))
            cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            blobs = [_packed(value[k], row[k], doc[k], at[k].astype(np.uint32), content[k]) for k in np.split(order, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order[cut]]), pa.nulls(len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "part", "blob"]
            )

        for part, batch in _by_part(batches):
            if part not in known:
                blobs = _beside(shared, part)
                known = {part: np.unique(np.concatenate([_unpacked(b, [(np.uint64, 1)])[0] for b in blobs])) if blobs else np.zeros(0, np.uint64)}
            keys = known[part]
            if not len(keys):
                continue
            raw, offsets = tx.buffer_of(tx.strings(batch.column("text")))
            row, doc_id = batch.column("_row").to_numpy(), _doc_ids(batch.column("doc_id"))
            for value, text, place, count in runs(raw, offsets):
                key = value % np.uint64(buckets << TRAVELS)
                found = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                value, text, place, count = value[found], text[found], place[found], count[found]
                if not len(value):
                    continue
                held.append((value, row[text], doc_id[text], place - offsets[text], run_bytes(raw, place, count)))
            if sum(len(x[0]) for x in held) > 2 * TOGETHER:
                yield from flush()
            if sum(map(len, local.rows)) > 1 << 20:
                yield local.batch()
        if held:
            yield from flush()
        if (rest := local.batch()) is not None:
            yield rest

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, part, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "blob")), strict=True):
                if bucket is None:
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([blob], pa.binary())], ["part", "blob"])
                else:
                    blobs.setdefault(bucket, []).append(blob)
        out = _Intervals()
        while blobs:
            value, row, doc, place, content = _concatenated(blobs.popitem()[1], RUN_KINDS)
            order = np.argsort(value, kind="stable")
            begin = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0)))
            # Whole hashes, about TOGETHER runs at a time.
            marks = np.unique(np.searchsorted(begin, np.arange(0, len(value), TOGETHER), side="right") - 1)
            for low, high in zip(begin[marks], np.append(begin[marks[1:]], len(value)), strict=True):
                k = order[low:high]
                out.add(row[k], place[k], _covered(value[k], doc[k], content[k]))
                if (found := out.batch()) is not None:
                    yield found.select(["part", "blob"])

    sent = stored.select("_row", "doc_id", "text").mapInArrow(send, "bucket int, part long, blob binary")
    # Settled intervals have no bucket: they are dealt by part.
    dealt = sent.repartitionById(buckets, F.coalesce(F.col("bucket"), F.pmod(F.col("part"), F.lit(buckets)).cast("int")))
    return _write_beside(dealt.mapInArrow(meet, "part long, blob binary"), "removed-strings")


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all documents, and with ``with_text``
    the text that is left (a character that is cut in two goes whole).

    Every byte goes that is covered by a string of 50 bytes that also starts in a document with a
    smaller doc_id. All texts are judged as they came in, overlaps count, matches never cross
    documents. Null text is empty. A null doc_id is greater than all others; rows with one doc_id
    never remove from each other, so of repeated rows all stay. Other columns are not read. An
    empty table gives no row.
    """
    return _removed(only(documents, "doc_id", "text"), with_text)


def _removed(documents: DataFrame, with_text: bool) -> DataFrame:
    """The same, with all columns of documents that has doc_id, text and columns set aside."""
    spark = documents.sparkSession
    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    others = [f for f in rows.schema if f.name != "text"]
    own = [x.split()[0] for x in DIGEST.split(", ")]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_dir(spark, "stored-documents")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    removed = _removed_strings(stored, buckets, _shared_hashes(stored, buckets))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, ...]] = {}
        for part, batch in _by_part(batches):
            if part not in known:
                blobs = _beside(removed, part)
                kinds = [(np.int64, 1), (np.uint32, 1), (np.uint32, 1)]
                found = _concatenated(blobs, kinds) if blobs else [np.zeros(0, np.int64)] * 3
                order = np.argsort(found[0], kind="stable")
                known = {part: tuple(x[order].astype(np.int64) for x in found)}
            yield _finished(batch, *known[part])

    def _finished(batch: pa.RecordBatch, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        raw, offsets = tx.buffer_of(tx.strings(batch.column("text")))
        row = batch.column("_row").to_numpy()
        low, high = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
        chosen = tx.spread(low, high - low)
        base = np.repeat(offsets[:-1], high - low)
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, base + begin[chosen], 1)
        np.add.at(edge, base + end[chosen], -1)
        gone = np.cumsum(edge[:-1]) > 0
        starts = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
        starts[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
        total = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))[offsets]
        spans = np.concatenate(([0], np.cumsum(starts, dtype=np.int64)))[offsets]
        kept = raw[~gone].tobytes()
        at = offsets - total
        left = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        columns = [np.diff(offsets), np.diff(total), np.diff(spans)]
        arrays = [batch.column(f.name) for f in others] + [pa.array(c, pa.int64()) for c in columns]
        arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()))
        if with_text:
            null = batch.column("text").is_null().to_pylist()
            arrays.append(pa.array([None if n else x.decode("utf-8", "ignore") for x, n in zip(left, null, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in others] + own + ["text"] * with_text)

    return stored.mapInArrow(finish, schema_with(others, DIGEST + ", text string" * with_text))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with their own columns and what is left of their texts; n_chars, if there, is
    counted anew. A document of which no word is left, though it had some, goes."""
    counted = ["n_chars"] if "n_chars" in documents.columns else []
    documents, names = set_aside(documents, "doc_id", "text", *counted)
    left = _removed(documents, with_text=True)
    rows = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    for name in counted:
        length = F.char_length("text").cast(documents.schema[name].dataType)
        rows = rows.withColumn(name, F.when(F.col("n_removed") > 0, length).otherwise(F.col(name)))
    return rows.select(*documents.columns).toDF(*names)
