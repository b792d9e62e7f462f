"""Token counts by unigram segmentation, computed once per distinct prefix of pre-tokens.

The distinct pre-tokens of a slice are put in a trie, which is walked depth first: in sorted
order, a pre-token keeps the forward scores of the prefix it shares with the one before, and
only its own rest is computed. The token count at its last character is stored for the
pre-token and looked up for every occurrence.
"""

from __future__ import annotations

import itertools
import math
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.tables import only

#: Stands for the white space before a word.
SPACE = "▁"
#: Distinct pre-tokens that a Python worker remembers before it starts anew: memory, not results.
REMEMBERED = 600_000
#: Log probability that a byte of a character outside the vocabulary costs beyond the rarest piece.
UNKNOWN = 10.0


def unigram_scores(model: str) -> dict[str, float]:
    """Log probabilities of a sentencepiece model's pieces.

    A unigram model's own scores; where scores are merge ranks, Zipf's law of the rank.
    """
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_byte(i) or pieces.is_unknown(i))]
    scores = {pieces.id_to_piece(i): pieces.get_score(i) for i in plain}
    if all(s == int(s) for s in scores.values()):
        total = math.log(sum(1 / (r + 1) for r in range(len(scores))))
        ranked = sorted(scores, key=lambda p: (-scores[p], p))
        scores = {p: -math.log(r + 1) - total for r, p in enumerate(ranked)}
    return scores


class UnigramTrie:
    """Token counts of pre-tokens: those of the segmentation with the highest score, the fewest
    tokens among equal ones. A character that no piece holds is as many tokens as it has bytes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.slots: dict[str, int] = {}
        self.count = np.zeros(0, np.int64)

    @classmethod
    def of(cls, model: str) -> UnigramTrie:
        """One per model and Python worker process, kept from task to task."""
        held = sys.modules.setdefault("_tries_of_this_worker", types.ModuleType("_tries")).__dict__
        if model not in held:
            held[model] = cls(unigram_scores(model))
        return held[model]

    def walk(self, words: list[str]) -> Iterator[int]:
        """Token counts of sorted pre-tokens."""
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        score, tokens, before = [0.0], [0], ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                best, fewest = score[end - 1] + unknown * size, tokens[end - 1] + size
                for begin in range(max(0, end - longest), end):
                    own = get(word[begin:end])
                    if own is not None:
                        own += score[begin]
                        if own > best or (own == best and tokens[begin] + 1 < fewest):
                            best, fewest = own, tokens[begin] + 1
                score.append(best)
                tokens.append(fewest)
            yield tokens[-1]
            before = word

    def counts(self, words: pa.StringArray) -> np.ndarray:
        """Token counts of words as they stand in a text, after white space."""
        code, distinct = tx.codes(words)
        names = distinct.to_pylist()
        if len(self.slots) + len(names) > REMEMBERED:
            self.slots, self.count = {}, np.zeros(0, np.int64)
        if new := sorted(n for n in names if n not in self.slots):
            found = np.fromiter(self.walk([SPACE + n for n in new]), np.int64, len(new))
            self.slots.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            self.count = np.concatenate((self.count, found))
        slot = np.fromiter(map(self.slots.get, names, itertools.repeat(-1)), np.int64, len(names))
        return self.count[slot][code]


def token_counts(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document's whole text.

    Pre-tokens are runs of characters other than ASCII white space; null and empty texts have
    none. Every row is counted on its own, repeated and null doc_ids too. A pre-token is scored
    in time proportional to its length, however long. Other columns are not read. An empty table
    gives no row.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie.of(model)
        for batch in tx.sliced(batches, "text", 2 * tx.SLICE_BYTES):
            words, bounds = tx.words(tx.strings(batch.column("text")))
            total = np.concatenate(([0], np.cumsum(trie.counts(words))))[bounds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(total), pa.int64())],
                ["doc_id", "n_pretokens", "n_tokens"],
            )

    rows = only(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
