"""Token-id files in patched frame-of-reference blocks.

A file holds whole documents in order. Ids are cut into blocks of 512 across documents. A
block stores its minimum, the width that holds a chosen share of its differences to the
minimum, the packed low bits, and a list of exceptions (position, difference) for the rest.
An index of block starts lets a reader fetch any run of ids. Numbers are little-endian:

    "PFR1"  blocks  document table  block index  footer  "PFR1"
    block:  minimum u32, ids u16, exceptions u16, width u8, packed words u64 x 8 x width,
            exception positions u16, exception differences u32
    document table: ids of documents i64, 1 for a null id u8, ends in the file's ids u64
    block index: byte offset of each block u64
    footer: documents u64, ids u64, offset of the document table u64, offset of the index u64
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.tables import file_system, only, output_folder, written
from hostweave.llm.tokenizing import TextEncoder, with_end

MAGIC = b"PFR1"
BLOCK = 512
LANE = 64
HEAD, HEAD_BYTES = "<IHHB", 9
FOOT, FOOT_BYTES = "<QQQQ", 32
#: Share of a block's ids that fit the packed width.
PACKED_SHARE = 0.9
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 8_000_000


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 512 values below 2**width to rows of 8 * width 64-bit words."""
    lanes = values.reshape(-1, LANE).astype(np.uint64)
    out = np.zeros((len(lanes), width), np.uint64)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        out[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = packed.reshape(-1, width)
    out = np.zeros((len(words), LANE), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(len(packed), BLOCK)


def encode_blocks(ids: np.ndarray, share: float = PACKED_SHARE) -> list[bytes]:
    """Blocks of the ids; the last may hold fewer than 512."""
    if not len(ids):
        return []
    count = -(-len(ids) // BLOCK)
    rows = np.full(count * BLOCK, ids[-1], np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(count, BLOCK)
    held = np.full(count, BLOCK)
    held[-1] = len(ids) - (count - 1) * BLOCK
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    most = np.partition(diff, rank := min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1), axis=1)[:, rank]
    width = np.ceil(np.log2(most.astype(np.float64) + 1)).astype(np.int64)
    out: list[bytes] = [b""] * count
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        part = diff[chosen]
        over = part > np.uint32((1 << int(w)) - 1)
        body = _pack(np.where(over, 0, part), int(w)) if w else None
        at, position = np.nonzero(over)
        ends = np.searchsorted(at, np.arange(len(chosen) + 1))
        for k, block in enumerate(chosen):
            where = position[ends[k] : ends[k + 1]]
            out[block] = b"".join(
                (
                    struct.pack(HEAD, int(low[block]), int(held[block]), len(where), int(w)),
                    body[k].astype("<u8").tobytes() if body is not None else b"",
                    where.astype("<u2").tobytes(),
                    part[k, where].astype("<u4").tobytes(),
                )
            )
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``raw``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    heads = [struct.unpack_from(HEAD, raw, at) for at in starts]
    low = np.array([h[0] for h in heads], np.uint32)
    held = np.array([h[1] for h in heads])
    width = np.array([h[3] for h in heads])
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            chosen = np.flatnonzero(width == w)
            packed = np.stack([np.frombuffer(raw, "<u8", 8 * int(w), int(starts[k]) + HEAD_BYTES) for k in chosen])
            rows[chosen] = _unpack(packed, int(w)).astype(np.uint32)
    for k, (_, _, exceptions, w) in enumerate(heads):
        if exceptions:
            at = int(starts[k]) + HEAD_BYTES + 64 * w
            where = np.frombuffer(raw, "<u2", exceptions, at)
            rows[k, where] = np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions)
    rows += low[:, None]
    return rows[np.arange(BLOCK) < held[:, None]]


class IdFileWriter:
    """One file; documents come in order, a run of them at a time."""

    def __init__(self, uri: str, share: float = PACKED_SHARE):
        self.uri, self.share = uri, share
        system, path = file_system(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.starts = len(MAGIC), []
        self.doc_ids, self.nulls, self.ends = [], [], []
        self.n_ids = self.n_docs = 0
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.ends.append((self.n_ids + bounds[1:] - bounds[0]).astype("<u8"))
        self.n_ids += int(bounds[-1] - bounds[0])
        self.n_docs += len(doc_ids)
        ready = np.concatenate((self.rest, ids[bounds[0] : bounds[-1]]))
        whole = len(ready) // BLOCK * BLOCK
        self._write(ready[:whole])
        self.rest = ready[whole:]

    def _write(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids, self.share):
            self.starts.append(self.at)
            self.at += len(block)
            self.out.write(block)

    def close(self) -> None:
        self._write(self.rest)
        table = self.at
        body = b"".join(x.tobytes() for x in (*self.doc_ids, *self.nulls, *self.ends))
        self.out.write(body)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(struct.pack(FOOT, self.n_docs, self.n_ids, table, table + len(body)) + MAGIC)
        self.out.close()


class IdFile:
    """Reader of one file; ``ids(a, b)`` fetches only the blocks that hold them."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.source = system.open_input_file(path)
        size = self.source.size()
        tail = self.source.read_at(FOOT_BYTES + len(MAGIC), size - FOOT_BYTES - len(MAGIC))
        if tail[FOOT_BYTES :] != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        self.n_docs, self.n_ids, table, index = struct.unpack_from(FOOT, tail)
        body = self.source.read_at(index - table, table)
        n = self.n_docs
        self.doc_ids = np.frombuffer(body, "<i8", n)
        self.null_ids = np.frombuffer(body, np.uint8, n, 8 * n).astype(bool)
        self.bounds = np.concatenate(([0], np.frombuffer(body, "<u8", n, 9 * n).astype(np.int64)))
        blocks = -(-self.n_ids // BLOCK)
        self.starts = np.append(np.frombuffer(self.source.read_at(8 * blocks, index), "<u8").astype(np.int64), table)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        origin = self.starts[first]
        raw = self.source.read_at(int(self.starts[last] - origin), int(origin))
        return decode_blocks(raw, self.starts[first:last] - origin)[begin - first * BLOCK : end - first * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, fetching about ``most`` ids at a time."""
        at = 0
        while at < self.n_docs:
            stop = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + most, side="right")) - 1)
            ids = self.ids(int(self.bounds[at]), int(self.bounds[stop]))
            for k in range(at, stop):
                begin, end = self.bounds[k : k + 2] - self.bounds[at]
                yield None if self.null_ids[k] else int(self.doc_ids[k]), int(self.bounds[k]), ids[begin:end]
            at = stop

    def close(self) -> None:
        self.source.close()


def write_token_files(
    documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_ids: int = FILE_IDS,
    share: float = PACKED_SHARE,
) -> DataFrame:
    """Encode ``text`` of all documents, append ``end_id`` to each and write the ids to files.

    Files hold documents in ascending (doc_id, hash of text) order, null doc_ids first, equal
    rows side by side. Null text counts as empty: its document is ``end_id`` alone. Other
    columns are not read, whatever their names. Returns the stored list of files, a row
    each: path, part and piece (their order), start (ids in earlier files), n_docs, n_ids.
    An empty table gives no file. A task that is repeated writes files of new names, and only
    those of the attempt that Spark committed are in the list.
    """
    spark = documents.sparkSession
    target = output_folder(spark, "token-files", folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = TextEncoder.of(tokenizer), TaskContext.get()
        part, writer, rows = task.partitionId(), None, []

        def finish(writer: IdFileWriter) -> None:
            writer.close()
            rows.append((writer.uri, part, len(rows), writer.n_docs, writer.n_ids))

        for batch in tx.sliced(batches, "text", 2 * tx.SLICE_BYTES):
            ids, bounds = with_end(*encoder.encode(tx.strings(batch.column("text"))), end_id)
            at = 0
            while at < batch.num_rows:
                writer = writer or IdFileWriter(f"{target}/{part:06d}-{len(rows):04d}-{task.taskAttemptId()}.pfr", share)
                room = file_ids - writer.n_ids
                stop = min(batch.num_rows, max(at + 1, int(np.searchsorted(bounds, bounds[at] + room))))
                writer.add(batch.column("doc_id").slice(at, stop - at), ids, bounds[at : stop + 1])
                at = stop
                if writer.n_ids >= file_ids:
                    finish(writer)
                    writer = None
        if writer:
            finish(writer)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "part", "piece", "n_docs", "n_ids"])

    order = ["doc_id", "_tie"]
    files = (
        only(documents, "doc_id", "text")
        .select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(write, "path string, part long, piece long, n_docs long, n_ids long")
    )
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    listed = written(files, "token-file-list")
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents in listed files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian 32-bit integers), and with ``with_ids`` the ids."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                source = IdFile(path)
                rows = []
                for doc_id, at, ids in source.documents():
                    raw = ids.astype("<u4")
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(raw)) + ((raw.tolist(),) if with_ids else ()))
                    if len(rows) == (64 if with_ids else 4096):
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)
                source.close()

    def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    # A file is a task's work, so they are dealt out one by one, not gathered by their few bytes.
    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(read, schema)
