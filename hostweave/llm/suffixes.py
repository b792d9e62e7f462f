"""Deep-shallow sorting of many short suffixes at once.

Multikey quicksort orders the suffixes by their first 16 bytes, eight at a time. Groups that
agree there are ordered by blind tries, all groups of a round together: the first suffix of a
group is a path, the others leave it where they first differ from it, and those that leave at
one place by one byte are a group of the next round. Bytes before that place are not looked at
again, and suffixes equal to the path are done.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 2
#: Parts up to this size are ordered directly.
SMALL = 512


def _multikey_quicksort(words: np.ndarray) -> np.ndarray:
    order = np.arange(len(words))
    parts = [(0, len(words), 0)]
    while parts:
        low, high, depth = parts.pop()
        own = order[low:high]
        key = words[own, depth]
        if high - low <= SMALL:
            order[low:high] = own[np.lexsort(words[own, depth:SHALLOW].T[::-1])]
            continue
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, equal = key < pivot, key == pivot
        more = ~(less | equal)
        order[low:high] = np.concatenate((own[less], own[equal], own[more]))
        first, second = low + int(less.sum()), high - int(more.sum())
        parts.append((low, first, depth))
        parts.append((second, high, depth))
        if depth + 1 < SHALLOW:
            parts.append((first, second, depth + 1))
    return order


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (equal widths, a multiple of eight of at least 16, fewer than 256), and
    for each place in that order whether a row begins there that differs from the one before."""
    n, width = rows.shape
    if n < 2:
        return np.arange(n), np.ones(n, dtype=bool)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = _multikey_quicksort(words[:, :SHALLOW])
    head = words[order, :SHALLOW]
    new = np.concatenate(([True], (head[1:] != head[:-1]).any(axis=1)))
    # Places in the order that belong to groups still open, and the place where each group begins.
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = np.flatnonzero(~new | np.append(~new[1:], False))
    start = start[place]
    while len(place):
        own, path = rows[order[place]], rows[order[start]]
        differs = own != path
        at = differs.argmax(axis=1)
        here = np.arange(len(place))
        byte, other = own[here, at].astype(np.int64), path[here, at].astype(np.int64)
        equal = ~differs[here, at]
        side = np.where(equal, 1, np.where(byte < other, 0, 2))
        # Before the path: those that leave it early first; after it: those that leave it late.
        leave = np.where(equal, 0, np.where(side == 0, at, width - at))
        way = ((start * 3 + side) * 256 + leave) * 256 + np.where(equal, 0, byte)
        sort = np.argsort(way, kind="stable")
        order[place] = order[place[sort]]
        way, equal = way[sort], equal[sort]
        begins = np.concatenate(([True], way[1:] != way[:-1]))
        new[place[begins]] = True
        start = place[np.maximum.accumulate(np.where(begins, here, 0))]
        open_ = ~equal & (~begins | np.append(~begins[1:], False))
        place, start = place[open_], start[open_]
    return order, new
