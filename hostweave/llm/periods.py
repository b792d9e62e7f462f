"""Runs of repeated words: every maximal stretch with a period, found tile by tile.

Periods are taken by octaves (P to 2P-1). An octave has a tile around each of many boundaries,
close enough for the repeated part of every run of that octave to hold a boundary, and each tile
so wide that it holds a square there. Tiles in which no block of words returns at a distance of
the octave are passed over; what is left goes, as strips of tiles that overlap, to tasks of their
own, which solve each boundary by Z-functions: how far the words after it, and before it, equal
those a period further on. The fragments are shuffled by document and period and stitched where
they share a period's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.tables import only, written

#: Least words of a run.
LEAST = 12
#: Words of a strip, about; one of long periods is at least two tiles wide.
STRIP = 1 << 16
#: Cells of boundary by period that are compared at once.
CELLS = 1 << 22
#: Odd factors of the block hashes; a hash only chooses tiles, words decide.
FACTOR, STEP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def block(octave: int) -> int:
    """Words between boundaries: of LEAST words or two periods, a run's part that returns a period
    later holds such a block in any position."""
    return {1: 4, 2: 4, 4: 3}.get(octave, octave // 2)


def reach(octave: int) -> tuple[int, int]:
    """Words of a tile before and after its boundary."""
    return max(2 * octave, 16), max(8 * octave, 64)


def block_hashes(words: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the single words, to start with."""
    one = (words.astype(np.uint32) + np.uint32(1)) * FACTOR
    return {1: one ^ (one >> np.uint32(15))}


def hashes_of(length: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """For each position the hash of ``length`` words from there on; shorter at the end."""
    if length not in held:
        half = 2 if length == 3 else length // 2
        first, rest = hashes_of(half, held), hashes_of(length - half, held)
        after = np.zeros_like(rest)
        after[: len(rest) - half] = rest[half:]
        whole = first * STEP + after * FACTOR + np.uint32(length)
        held[length] = whole ^ (whole >> np.uint32(16))
    return held[length]


def returning(hashes: np.ndarray, octave: int, phase: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Boundaries from ``phase`` on, and for each the periods of the octave after which its block's hash returns."""
    step = block(octave)
    padded = np.concatenate((hashes, np.zeros(2 * octave + step, np.uint32)))
    many, at_once = -(-(len(hashes) - phase) // step), max(1, CELLS // octave)
    for first in range(0, many, at_once):
        here = min(at_once, many - first)
        begin = phase + first * step
        grid = np.lib.stride_tricks.as_strided(padded[begin + octave :], (here, octave), (4 * step, 4))
        yield begin + step * np.arange(here), grid == padded[begin : begin + here * step : step, None]


def strips(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By octave: documents, the octave, begins and ends (places in ``words``) of strips, and the first boundary in each."""
    held, length, octave = block_hashes(words), np.diff(bounds), 1
    while (fit := np.flatnonzero(length >= max(LEAST, 2 * octave))).size:
        places = tx.spread(bounds[fit], length[fit])
        ends = np.cumsum(length[fit])
        found = [at[hit.any(axis=1)] for at, hit in returning(hashes_of(block(octave), held)[places], octave)]
        if (at := np.concatenate(found)).size:
            doc = np.searchsorted(ends, at, side="right")
            back, on = reach(octave)
            first = np.concatenate(([0], ends[:-1]))[doc]
            low, high = np.maximum(first, at - back), np.minimum(ends[doc], at + on)
            # A strip goes on while tiles overlap, and ends where it is long enough.
            starts, begin, last = [], -1, -1
            for i, (a, b, d) in enumerate(zip(low.tolist(), high.tolist(), doc.tolist(), strict=True)):
                if d != last or a > reached or reached - begin > max(STRIP, 12 * octave):
                    starts.append(i)
                    begin, last = a, d
                reached = b
            starts = np.array(starts)
            stops = np.append(starts[1:], len(at)) - 1
            shift = bounds[fit][doc[starts]] - first[starts]
            yield fit[doc[starts]], octave, low[starts] + shift, high[stops] + shift, (at[starts] - low[starts]) % block(octave)
        octave *= 2


def z_function(s: list[int]) -> list[int]:
    """For each place how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve(words: np.ndarray, octave: int, phase: int) -> Iterator[tuple[int, int, int]]:
    """(period, begin, end) of stretches in a strip that hold two periods, and no smaller one."""
    (back, on), step, n = reach(octave), block(octave), len(words)
    done = [-1] * octave  # end of the stretch last looked at, by period
    held = words.tolist()
    for boundaries, grid in returning(hashes_of(step, block_hashes(words)), octave, phase):
        rows, steps = np.nonzero(grid)
        cuts = np.flatnonzero(np.diff(rows, prepend=-1)).tolist()
        steps = steps.tolist()
        for at, low, high in zip(boundaries[rows[cuts]].tolist(), cuts, [*cuts[1:], len(steps)], strict=False):
            past = at + step + octave
            open_steps = [k for k in steps[low:high] if done[k] < past + k <= n]
            if open_steps:
                yield from _around(held, at, max(0, at - back), min(n, at + on), octave, open_steps, done)


def _around(held: list[int], at: int, low: int, high: int, octave: int, steps: list[int], done: list[int]) -> Iterator[tuple[int, int, int]]:
    """The stretches around a boundary with periods octave + each of ``steps``, as the tile low to high shows them."""
    top = min(high, at + 2 * octave)
    after = z_function(held[at:high])
    before = held[low:at][::-1]
    shifted = z_function([*before, -1, *held[low:top][::-1]])[len(before) + 1 :] if before else [0] * (top - low)
    squares = []
    for k in steps:
        q = octave + k
        end = q + after[q]
        done[k] = at + end - (block(octave) if at + end == high < len(held) else 0)  # what the tile cuts goes on in a later one
        if end + shifted[top - at - q] >= 2 * q:
            squares.append(q)
    if not squares:
        return
    # Of every distance up to the largest: words that stay equal up to there, and before the boundary.
    distance = np.arange(1, squares[-1] + 1)
    on_to = distance + np.array(after)[distance]
    back_to = np.array(shifted)[top - at - distance]
    square = on_to + back_to >= 2 * distance
    p = 1 + int(square.argmax())
    while 2 * p <= len(distance) and square[p - 1]:  # a multiple that reaches no further is no period of its own
        square[2 * p - 1 :: p] &= (on_to[2 * p - 1 :: p] > on_to[p - 1]) | (back_to[2 * p - 1 :: p] > back_to[p - 1])
        p += 1 + int(square[p:].argmax())
    for q in squares:
        if square[q - 1]:
            yield q, at - int(back_to[q - 1]), at + int(on_to[q - 1])


SCANNED = "_row long, doc_id long, n_words long, sha256 string, text string, octave int, begin long, phase int, words binary"


def _scan(documents: DataFrame, digest: bool) -> DataFrame:
    """A row for each document, with its words joined by a space (or their digest where nothing can
    be in it), and a row for each strip of it."""
    names = [f.split()[0] for f in SCANNED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.sliced(batches, "text"):
            found, bounds = tx.words(tx.strings(batch.column("text")))
            code, _ = tx.codes(found)
            rows, wanted = batch.column("_row"), np.full(batch.num_rows, not digest)
            for doc, octave, begin, end, phase in strips(code, bounds):
                wanted[doc] = True
                part = pa.array([code[a:b].astype("<i4").tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
                n = len(doc)
                columns = [rows.take(pa.array(doc)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
                           pa.array(np.full(n, octave, np.int32)), pa.array(begin - bounds[doc]), pa.array(phase.astype(np.int32)), part]
                yield pa.RecordBatch.from_arrays(columns, names)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found), " ")
            keep = pa.array(wanted)
            plain = [None if w else hashlib.sha256(t.as_buffer()).hexdigest() for t, w in zip(joined, wanted.tolist(), strict=True)]
            n = batch.num_rows
            columns = [rows, batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(plain, pa.string()), pc.if_else(keep, joined, pa.scalar(None, pa.string())),
                       *(pa.nulls(n, k) for k in kinds[5:])]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(scan, SCANNED)


def _fragments(strips_of: DataFrame) -> DataFrame:
    """_row, period, begin, end of what the strips hold."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, octave, begin, phase, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(solve(np.frombuffer(raw, "<i4"), octave, phase))
                if found:
                    period, low, high = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), row)), pa.array(period), pa.array(begin + low), pa.array(begin + high)], ["_row", "period", "begin", "end"]
                    )

    # Strips are few bytes and much work, so they are dealt to as many tasks as a shuffle has.
    tasks = int(strips_of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strips_of.select("_row", "octave", "begin", "phase", "words").repartition(tasks, "_row", "octave", "begin")
    return dealt.mapInArrow(work, "_row long, period long, begin long, end long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """_row, start, length, period of whole runs: fragments of a period that share at least its length are one."""
    order = Window.partitionBy("_row", "period").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("_before").isNull() | (F.col("begin") > F.col("_before") - F.col("period"))).cast("int")
    islands = fragments.withColumn("_before", before).withColumn("_island", F.sum(opens).over(order))
    whole = islands.groupBy("_row", "period", "_island").agg(F.min("begin").alias("start"), F.max("end").alias("_end"))
    runs = whole.select("_row", "start", (F.col("_end") - F.col("start")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _collapsed(found: DataFrame, digest: bool) -> DataFrame:
    """doc_id, n_words, runs and the words that no run repeats, joined by a space (or their digest)."""

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                if runs:
                    words = text.as_buffer().to_pybytes().split(b" ")
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        edge[r["start"] + r["period"]] += 1
                        edge[r["start"] + r["length"]] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    text = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                else:
                    text = text.as_buffer().to_pybytes()
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return found.select("doc_id", "n_words", "text", "runs").mapInArrow(collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def periodic_runs(documents: DataFrame, digest: bool = False) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_words, runs and collapsed.

    Words are what ASCII white space divides. A run is a stretch of at least ``LEAST`` words and two
    periods whose words equal those a period further on, that no neighbouring word extends, given
    by its smallest period; runs are sorted by start, then period. collapsed is the words that
    no run repeats, joined by a space, or with ``digest`` their lower-case hex SHA-256. Null and empty
    texts have no word, no run and an empty collapsed text. Texts of any length are taken whole, rows
    that repeat are judged each for itself, a null doc_id stays null, other columns are not read,
    whatever their names, and an empty table gives no row. A document's runs are fewer than its words.
    """
    scanned = written(_scan(documents, digest), "periods-scan")
    runs = _stitched(_fragments(scanned.where("octave IS NOT NULL")))
    sorted_runs = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    by_doc = runs.groupBy("_row").agg(sorted_runs.alias("_runs")).select(
        "_row", F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs")
    )
    docs = scanned.where("octave IS NULL")
    held = docs.where("text IS NOT NULL").join(by_doc, "_row", "left")
    held = held.withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    plain = docs.where("text IS NULL").select("doc_id", "n_words", F.array().cast(RUNS).alias("runs"), F.col("sha256").alias("collapsed"))
    return plain.unionByName(_collapsed(held, digest))


def with_periods(documents: DataFrame) -> DataFrame:
    """The documents, a tenth of them, by the CRC of their doc_id, ending in a period repeated from
    some word on: whole texts to find runs in. A null doc_id leaves its text as it is."""
    rows = only(documents, "doc_id", "text").withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    chosen = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, split)).withColumn("_n", F.size("_words").cast("long"))
    g = F.floor(F.col("_h") / 10)
    placed = chosen.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    placed = placed.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    ends = F.expr("array_join(transform(sequence(0L, _n - 1), i -> _words[int(if(i < _a, i, _a + (i - _a) % _p))]), ' ')")
    return placed.select("doc_id", F.when(F.col("_n") > 0, ends).otherwise(F.col("text")).alias("text"))
