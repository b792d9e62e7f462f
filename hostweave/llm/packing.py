"""Best-fit packing of tokenized documents by exact complements of their lengths.

Lengths lie in 1..capacity, so how many pieces there are of each length is a table of at most
``capacity`` rows at any size of the data. The plan is made on these counts: templates (lists
of lengths that share a sequence) and how often each is used. Pieces then take the slots of
their length by rank, where a rank is an offset per input task plus a count inside it: no
length, however frequent, is gathered or sorted in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.tables import only, written
from hostweave.llm.tokenizing import TextEncoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


@dataclass
class PackingPlan:
    """Slots by length: those of length x are begin[x] to begin[x + 1] in the arrays. Slot i takes
    the pieces of ranks rank[i] to rank[i + 1], puts them at offset[i], in sequences from first[i] on."""

    begin: np.ndarray
    rank: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces with these lengths and ranks among their length."""
        slot = np.empty(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            low, high = self.begin[x], self.begin[x + 1]
            slot[own] = low + np.searchsorted(self.rank[low:high], rank[own], side="right") - 1
        return self.first[slot] + rank - self.rank[slot], self.offset[slot]


class _Stock:
    """Counts of lengths, and for every sum in how many ways two lengths in stock make it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        held = (counts > 0).astype(np.float64)
        n = 1 << int(2 * len(counts)).bit_length()
        self.pairs = np.rint(np.fft.irfft(np.fft.rfft(held, n) ** 2, n)).astype(np.int64)[: len(counts)]

    def most(self, lengths: tuple[int, ...]) -> int:
        """How many times all these lengths can be taken together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.counts[x] -= times
        for x in set(lengths):
            if self.counts[x] == 0:
                held = np.flatnonzero(self.counts[: len(self.pairs) - x])
                self.pairs[x + held] -= 2
                if 2 * x < len(self.pairs):
                    self.pairs[2 * x] -= 1

    def halves(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs in stock with this sum, the largest length first."""
        if total < 2 or total >= len(self.pairs) or self.pairs[total] <= 0:
            return
        high = np.arange(total - 1, (total - 1) // 2, -1)
        for a in high[(self.counts[high] > 0) & (self.counts[total - high] > 0)]:
            yield int(a), int(total - a)

    def thirds(self, total: int) -> Iterator[tuple[int, int, int]]:
        if total < 3:
            return
        high = np.arange(total - 2, 0, -1)
        for a in high[(self.counts[high] > 0) & (self.pairs[total - high] > 0)]:
            for b, c in self.halves(int(total - a)):
                if b <= a:
                    yield int(a), b, c


def _complement(stock: _Stock, length: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths in stock beside ``length`` that fill its gap exactly."""
    if stock.most((length, gap)) > 0:
        return (length, gap)
    for more in (stock.halves(gap), stock.thirds(gap)):
        for found in more:
            if stock.most((length, *found)) > 0:
                return (length, *found)
    return None


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: (lengths, times). Alike open sequences stay one entry."""
    opened: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in opened if g >= length), default=0)
            if gap:
                group = opened[gap][-1]
                used = min(left, group[1])
                group[1] -= used
                if not group[1]:
                    opened[gap].pop()
                    if not opened[gap]:
                        del opened[gap]
                made = [[*group[0], length], used]
                left -= used
                rest = gap - length
            else:
                fit = capacity // length
                if left >= fit:
                    made, rest = [[length] * fit, left // fit], capacity - fit * length
                    left %= fit
                else:
                    made, rest, left = [[length] * left, 1], capacity - left * length, 0
            opened.setdefault(rest, []).append(made)
    return [(lengths, times) for groups in opened.values() for lengths, times in groups]


def plan_packing(counts: np.ndarray, capacity: int) -> PackingPlan:
    """Plan for ``counts[x]`` pieces of length x, by exact complements, then best fit of the rest.

    From the longest on, a length takes one, two or three lengths that complete it to the
    capacity, the longest first, as many times as the stock allows; each step uses one length
    up, so there are at most a few steps for each length, however many pieces there are.
    """
    stock, used = _Stock(counts), []
    rest = np.zeros_like(counts)
    for length in range(capacity, 0, -1):
        while stock.counts[length]:
            found = (length,) if length == capacity else _complement(stock, length, capacity - length)
            if found is None:
                rest[length] = stock.counts[length]
                stock.take((length,), int(rest[length]))
            else:
                times = stock.most(found)
                used.append((list(found), times))
                stock.take(found, times)
    used += _best_fit(rest, capacity)
    slots, first = [], 0
    for lengths, times in used:
        for x, offset in zip(lengths, np.cumsum([0, *lengths[:-1]]), strict=True):
            slots.append((x, times, int(offset), first))
        first += times
    slots.sort(key=lambda s: s[0])
    length, times, offset, firsts = (np.array(c, np.int64) for c in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 4
    begin = np.searchsorted(length, np.arange(capacity + 2))
    total = np.concatenate(([0], np.cumsum(times)))
    return PackingPlan(begin, total[:-1] - total[begin[length]], offset, firsts, first)


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and ``end_id``; null text is empty.

    A row per piece: doc_id, piece, start, length, ids_crc32, and its place in the work: task,
    nth (how many pieces of this length the task had before). Only documents longer than
    ``capacity`` have several. Every input row is a document of its own, repeated and null
    doc_ids too. Columns other than doc_id and text are not read.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = TextEncoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in tx.sliced(batches, "text", 2 * tx.SLICE_BYTES):
            ids, bounds = with_end(*encoder.encode(tx.strings(batch.column("text"))), end_id)
            raw, size = ids.astype("<u4"), np.diff(bounds)
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), many)
            piece = tx.spread(np.zeros(len(size), np.int64), many).astype(np.int64)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = bounds[doc] + start
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.searchsorted(length[order], length[order])
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(length)) - runs
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length, task, nth and any other columns).

    The counts come to the driver: at most ``capacity`` rows.
    """
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("_n")).collect():
        counts[length] = n
    plan = plan_packing(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("_rank", F.col("nth") + F.col("_base"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = plan.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(x) for x in where], [*columns, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.mapInArrow(place, kinds + ", sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents with their place in as few sequences as best fit needs.

    Ties between pieces of equal length go by input task and order. An empty table gives no row.
    """
    return pack(written(token_pieces(documents, tokenizer, end_id, capacity), "pieces"), capacity)
