import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from plain import ODD, crc, odd_documents, result
from tokenizers import Tokenizer

from hostweave.llm import pfor
from hostweave.llm.tokenizing import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("count", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("high", [1, 2, 1000, 2**32 - 1])
def test_blocks_come_back(count, high):
    ids = np.random.default_rng(count).integers(0, high, count, dtype=np.uint32)
    ids[::97] = high - 1
    blocks = pfor.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert pfor.decode_blocks(b"".join(blocks), starts).tolist() == ids.tolist()


def test_outliers_do_not_widen_a_block():
    even = np.arange(512, dtype=np.uint32) % 16
    few = even.copy()
    few[[5, 300]] = 40_000
    assert len(pfor.encode_blocks(few)[0]) == len(pfor.encode_blocks(even)[0]) + 2 * 6


def test_file_gives_any_run_of_ids(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000, dtype=np.uint32)
    writer = pfor.IdFileWriter(f"file://{tmp_path}/a.pfr")
    bounds = np.array([0, 0, 7, 19_000, 20_000])
    writer.add(pa.array([None, 1, 2, 3]), ids, bounds)
    writer.close()
    read = pfor.IdFile(f"{tmp_path}/a.pfr")
    for a, b in ((0, 20_000), (511, 513), (700, 700), (19_999, 20_000)):
        assert read.ids(a, b).tolist() == ids[a:b].tolist()
    assert [(d, s, len(x)) for d, s, x in read.documents(most=100)] == [(None, 0, 0), (1, 0, 7), (2, 7, 18_993), (3, 19_000, 1_000)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_tokenizers_ids(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t, _, _ in ODD] + ["don't 'tis x's  y \n\n\tz ", "foo   bar", "ﬁ Ⅷ ½ ǅ İ", "abc,def.ghi'jkl", "a  b  c"]
    ids, bounds = TextEncoder(path).encode(pa.array(texts))
    own = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark, tmp_path):
    files = pfor.write_token_files(odd_documents(spark), PATH, 0, f"file://{tmp_path}/out", file_ids=1000)
    assert files.count() > 2
    found = sorted(pfor.read_token_files(files, with_ids=True).collect(), key=lambda r: r.start)
    own = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, own.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _, _ in ODD)
    assert [r.doc_id if r.doc_id is not None else 0 for r in found] == [d for _, d, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in found) == want
    start = 0
    for r in found:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc(r.ids))
        start += r.n_tokens


def test_no_documents_no_file(spark):
    files = pfor.write_token_files(odd_documents(spark, []), PATH, 0)
    assert files.count() == 0 and result(pfor.read_token_files(files)) == []


def test_pieces_met_again_are_not_encoded_anew(monkeypatch):
    from hostweave.llm import tokenizing

    monkeypatch.setattr(tokenizing, "REMEMBERED_BYTES", 400 * tokenizing.SLOT_BYTES)
    encoder, own, learned = TextEncoder(PATH), Tokenizer.from_file(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(new.to_pylist()), learn(new)))
    often = "".join(f" of{chr(97 + i)}ten" for i in range(20)) + "\né, ü."
    for i in range(12):
        texts = ["", often, "".join(f" {chr(97 + i)}rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)), "x" * 50 * i]
        ids, bounds = encoder.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == own.encode(text, add_special_tokens=False).ids
    assert encoder.held <= 400 * tokenizing.SLOT_BYTES + 200 * 12
    assert learned.count(" ofaten") == 1 and learned.count(" arareaa") == 1


def test_room_is_made_when_all_pieces_are_met_again(monkeypatch):
    from hostweave.llm import tokenizing

    monkeypatch.setattr(tokenizing, "REMEMBERED_BYTES", 100 * tokenizing.SLOT_BYTES)
    encoder, own = TextEncoder(PATH), Tokenizer.from_file(PATH)
    for i in range(8):
        text = "".join(f" w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90 + i // 2))
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids
        encoder.make_room()
        assert encoder.held <= 50 * tokenizing.SLOT_BYTES and len(encoder.slots) == len(encoder.length) == len(encoder.again)
