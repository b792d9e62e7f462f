import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import ODD, check_packing, crc, odd_documents, result
from tokenizers import Tokenizer

from hostweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(lengths, capacity):
    lengths = np.array(lengths, np.int64)
    plan = packing.plan_packing(np.bincount(lengths, minlength=capacity + 1), capacity)
    rank, order = np.zeros(len(lengths), np.int64), np.argsort(lengths, kind="stable")
    rank[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
    sequence, offset = plan.place(lengths, rank)
    assert plan.sequences == check_packing(zip(sequence.tolist(), offset.tolist(), lengths.tolist()), capacity)
    return plan.sequences


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_every_piece_has_a_place(lengths):
    used = placed(lengths, 20)
    assert -(-sum(lengths) // 20) <= used <= len(lengths)


def test_exact_complements_fill_sequences():
    assert placed([60, 40] * 50, 100) == 50
    assert placed([50, 30, 20] * 40, 100) == 40
    assert placed([40, 30, 20, 10] * 30, 100) == 30
    assert placed([100] * 7 + [50] * 6, 100) == 10


def test_many_lengths_come_near_the_bound():
    lengths = np.clip(np.random.default_rng(2).lognormal(6, 1, 20_000), 1, 4096).astype(int)
    assert placed(lengths, 4096) <= 1.001 * -(-lengths.sum() // 4096) + 1


def test_odd_documents(spark):
    found = packing.pack_documents(odd_documents(spark), PATH, 1, 64).collect()
    own, want = Tokenizer.from_file(PATH), []
    for doc, text, _, _ in ODD:
        ids = own.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, p // 64, p, len(ids[p : p + 64]), crc(ids[p : p + 64])) for p in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    check_packing([(r.sequence_id, r.offset, r.length) for r in found], 64)


def test_no_documents(spark):
    assert result(packing.pack_documents(odd_documents(spark, []), PATH, 1, 64)) == []
