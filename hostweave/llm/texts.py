"""Words and lines of Arrow string columns, by whole batches instead of by row."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space, x20 and x09 to x0D, by byte value.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and punctuation, by byte value.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Text of one slice of a batch; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Returns what Arrow and the C library hold of freed memory: a worker's next task may need none of it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def strings(column: pa.Array) -> pa.StringArray:
    """The column as strings with 32-bit offsets; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.string()), "")


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut into slices with about ``most`` bytes of ``column``.

    After the last, memory that Arrow holds for later goes back: workers outlive tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def buffer_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offsets of each text in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def from_buffer(raw: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))
    )


def _edges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White bytes; first bytes of texts."""
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    return WHITE[raw], first


def words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All runs of bytes other than white space; bounds: text i has words bounds[i] to bounds[i+1]."""
    raw, offsets = buffer_of(texts)
    white, first = _edges(raw, offsets)
    inside = ~white
    begins = inside & (first[:-1] | np.concatenate(([True], white[:-1]))) if len(raw) else inside
    begin = np.flatnonzero(begins)
    at = np.concatenate(([0], np.cumsum(inside)))
    word_offsets = np.append(at[begin], at[-1])
    return from_buffer(raw[inside], word_offsets), np.searchsorted(begin, offsets)


def chunks(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts cut before each run of white space that follows another byte, and between an
    ASCII letter and ASCII punctuation after it; bounds as in ``words``."""
    raw, offsets = buffer_of(texts)
    white, first = _edges(raw, offsets)
    begins = first[:-1]
    begins[1:] |= (white[1:] & ~white[:-1]) | (PUNCTUATION[raw[1:]] & LETTER[raw[:-1]])
    begin = np.flatnonzero(begins)
    return from_buffer(raw, np.append(begin, len(raw))), np.searchsorted(begin, offsets)


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal values, and the distinct values in that order."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, .. of length[0] numbers, then those of the next run."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(begin) or begin.max() < 1 << 31) else np.int64
    out = np.repeat((begin - (ends - length)).astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out
