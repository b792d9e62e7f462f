import hashlib

import numpy as np
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import CLASHES, NAMES, ODD, odd_documents, result, without_repeats

from hostweave.llm import passages, tables
from hostweave.llm.suffixes import deep_shallow


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=24, max_size=24), max_size=40), st.integers(0, 23))
def test_order_is_that_of_bytes(rows, same):
    matrix = np.array(rows, np.uint8).reshape(-1, 24)
    matrix[:, :same] = 1
    order, new = deep_shallow(matrix)
    found, want = [bytes(matrix[i]) for i in order], sorted(map(bytes, matrix))
    assert found == want and new.tolist() == [i == 0 or want[i] != want[i - 1] for i in range(len(want))]


def test_large_input_goes_through_every_step():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 3, (200, 56)).astype(np.uint8)
    rows = base[rng.integers(0, 200, 8000)]
    rows[rng.random(rows.shape) < 0.01] = 3
    order, new = deep_shallow(rows)
    assert [bytes(rows[i]) for i in order] == sorted(map(bytes, rows)) and new.sum() == len(set(map(bytes, rows)))


def expected(rows):
    out = []
    for (doc, *_), (raw, gone) in zip(rows, without_repeats([r[:2] for r in rows]), strict=True):
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


P = "the quick brown fox jumps over the lazy dog near the old river bank today, said nobody"
OVERLAPS = [
    (1, "start " + P + " end of the first text which goes on for a while longer", "en", "a"),
    (2, P[:50], "en", "a"),
    (3, P[:49] + "#", "en", "a"),
    (4, "other " + P[10:75] + " | " + P[:60] + P[20:] + "!", "en", "a"),
    (5, "é" * 80, "en", "a"),
    (6, "x" + "é" * 30 + "y", "en", "a"),
    (7, "abcab" * 100, "en", "a"),
    (8, "cabab" + "abcab" * 60 + "zz", "en", "a"),
    (8, "abcab" * 100, "en", "a"),
    (None, P, "en", "a"),
    (None, P, "en", "a"),
    (0, "own " + P, "en", "a"),
]


@pytest.mark.parametrize("sizes", [(1 << 20, 50_000, 2_000_000), (200, 10, 50)])
def test_every_repeated_byte_goes(spark, monkeypatch, sizes):
    for name, value in zip(("SLICE", "TOGETHER", "HELD"), sizes, strict=True):
        monkeypatch.setattr(passages, name, value)
    rows = OVERLAPS + [r for r in ODD if len(r[1] or "") < 10_000]
    found = passages.remove_repeats(odd_documents(spark, rows))
    assert result(found) == expected(rows)


def test_table_agrees_with_all_strings(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(passages.remove_repeats(documents)) == expected(rows)


def test_pipeline_form_keeps_columns_and_whole_characters(spark):
    left = passages.without_repeats(odd_documents(spark, OVERLAPS + ODD))
    assert left.columns == NAMES + CLASHES
    texts = [(r[0], r[1]) for r in left.collect()]
    assert (0, OVERLAPS[-1][1]) in texts and (6, "xy") in texts
    assert not any(d == 2 and t is not None for d, t in texts)  # all of it is in text 0
    assert all("\ufffd" not in (t or "") for _, t in texts)
    assert [t for d, t in texts if d == -8] == [ODD[-2][1]]


def test_no_documents(spark):
    assert result(passages.remove_repeats(odd_documents(spark, []))) == []
    assert result(passages.without_repeats(odd_documents(spark, [])), *NAMES[:1]) == []


def test_a_folder_out_of_reach_is_an_error(tmp_path):
    (tmp_path / "shared").mkdir()
    assert passages._beside(f"file://{tmp_path}/shared", 3) == []  # nothing was written about this part
    with pytest.raises(FileNotFoundError, match="scheme"):
        passages._beside(f"file://{tmp_path}/elsewhere", 3)


def test_file_system_takes_sparks_names_of_s3(monkeypatch):
    class Named:
        @staticmethod
        def from_uri(uri):
            return uri

    monkeypatch.setattr(tables.fs, "FileSystem", Named)
    assert {tables.file_system(f"{scheme}://bucket/key") for scheme in ("s3", "s3a", "s3n")} == {"s3://bucket/key"}
