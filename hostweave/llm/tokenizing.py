"""Whole texts to token ids of a public tokenizer, encoding each distinct piece of text once."""

from __future__ import annotations

import itertools
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hostweave.llm import texts as tx

#: Bytes of distinct pieces, about, that a Python worker remembers before it drops those not met again, and
#: that it keeps for its next task: memory, not results. A piece takes its name, its ids and a slot.
REMEMBERED_BYTES = 48 << 20
SLOT_BYTES = 180
#: Texts with white space beyond ASCII or what may be a special token are encoded whole.
WHOLE = r"<\||[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces that stay apart when they are joined: a space and letters.
PLAIN = r"^ \p{L}+$"
JOINED = 1000


def _listed(texts: pa.StringArray) -> list[str]:
    """As to_pylist(), without an Arrow scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Ids of texts by the tokenizers library, add_special_tokens=False.

    The pre-tokenizers used here never join a letter with white space or punctuation that
    follows it, so a text's ids are those of its pieces (white space, then other bytes, cut
    between letter and punctuation). Distinct pieces are encoded once and remembered. Pieces
    of a space and letters are encoded many at a time and told apart by their last ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.size = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():  # a byte-level name has a character for each byte
            self.size[i] = name.endswith(self.suffix) if self.suffix else len(name)
        self.forget()

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        """One per tokenizer and Python worker process, kept from task to task."""
        held = sys.modules.setdefault("_encoders_of_this_worker", types.ModuleType("_encoders")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def forget(self) -> None:
        """Gives the remembered pieces' memory back."""
        self.held = 0
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def make_room(self) -> None:
        """Keeps the pieces met again since they were learned, or since room was last made: most new ones never are.
        Where these alone fill half of the room, the earliest learned stay."""
        kept = np.flatnonzero(self.again)
        names = list(itertools.compress(self.slots, self.again.tolist()))
        begin, length, ids = self.begin[kept], self.length[kept], self.ids
        size = SLOT_BYTES + np.fromiter(map(len, names), np.int64, len(names)) + 4 * length
        fit = int(np.searchsorted(np.cumsum(size), REMEMBERED_BYTES // 2, side="right"))
        del names[fit:]
        self.forget()
        self.length = length[:fit]
        self.begin = np.cumsum(self.length) - self.length
        self.ids = ids[tx.spread(begin[:fit], self.length)]
        self.again = np.zeros(fit, bool)
        self.held = int(size[:fit].sum())
        self.slots = dict(zip(names, range(fit), strict=True))

    def _each(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all names one after the other, and how many each has."""
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(length.sum())), length

    def _together(self, names: list[str], size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for names that match ``PLAIN``, of so many bytes: a name ends with the id that ends its bytes or word."""
        starts = range(0, len(names), JOINED)
        parts = [names[i : i + JOINED] for i in starts]
        coded = self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)
        ids, length = [], []
        for begin, part, x in zip(starts, parts, coded, strict=True):
            flat = np.array(x.ids, np.uint32)
            size = self.size[flat]
            wanted = np.ones(len(part), np.int64) if self.suffix else size_of[begin : begin + JOINED]
            at, done = np.cumsum(wanted), np.cumsum(size)
            ends = np.searchsorted(done, at)
            if not len(done) or done[-1] != at[-1] or (done[ends] != at).any():
                flat, many = self._each(part)
            else:
                many = np.diff(ends, prepend=-1)
            ids.append(flat)
            length.append(many)
        return np.concatenate(ids), np.concatenate(length)

    def _learn(self, new: pa.StringArray) -> None:
        plain = pc.match_substring_regex(new, PLAIN)
        for joined, own in ((True, plain), (False, pc.invert(plain))):
            found = new.filter(own)
            if names := _listed(found):
                ids, length = self._together(names, pc.binary_length(found).to_numpy().astype(np.int64)) if joined else self._each(names)
                self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(length) - length))
                self.length = np.concatenate((self.length, length))
                self.ids = np.concatenate((self.ids, ids))
                self.again = np.concatenate((self.again, np.zeros(len(names), bool)))
                self.held += SLOT_BYTES * len(names) + sum(map(len, names)) + 4 * len(ids)
                self.slots.update(zip(names, range(len(self.slots), len(self.slots) + len(names)), strict=True))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and bounds: text i has ids bounds[i] to bounds[i+1]."""
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        parts, size = [], []
        for i in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(whole)) + 1):  # runs of one kind
            run = texts.slice(int(i[0]), len(i))
            if whole[i[0]]:
                ids, length = self._each(run.to_pylist())
            else:
                ids, bounds = self._by_pieces(run)
                length = np.diff(bounds)
            parts.append(ids)
            size.append(length)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(size))))

    def _find(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.get, names, itertools.repeat(-1)), np.int64, len(names))

    def _by_pieces(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        pieces, bounds = tx.chunks(texts)
        code, distinct = tx.codes(pieces)
        names = _listed(distinct)
        if self.held + SLOT_BYTES * len(names) > REMEMBERED_BYTES:
            self.make_room()
        slot = self._find(names)
        self.again[slot[slot >= 0]] = True
        if (new := np.flatnonzero(slot < 0)).size:
            self._learn(distinct.take(pa.array(new)))
            slot[new] = self._find([names[i] for i in new.tolist()])
        slot = slot[code]
        length = self.length[slot]
        ids = self.ids[tx.spread(self.begin[slot], length)]
        return ids, np.concatenate(([0], np.cumsum(length)))[bounds]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
