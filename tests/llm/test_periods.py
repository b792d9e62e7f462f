import hashlib
import random

import numpy as np
import pytest
from conftest import SF_DIR
from plain import ODD, WORD, collapsed, odd_documents, periodic, result, runs

from hostweave.llm import periods, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(doc_id, words):
    found = runs(words)
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc_id, len(found), s, length, q, 1000 * length // q if found else None, sha(lines), sha(" ".join(collapsed(words, found))))


def test_query_on_whole_table(spark):
    want = [digests(r.doc_id, periodic(r.doc_id, r.text)) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op12_tiled_runs(spark, SF_DIR)) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 20 and max(r[3] or 0 for r in want) > 100


def noisy(rng):
    n, letters = rng.choice([0, 5, 11, 12, 13, 40, 150, 400]), rng.choice([1, 2, 3, 40])
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 20 else 0):
        a, p = rng.randrange(n - 5), rng.randint(1, n // 3)
        for i in range(a + p, rng.randint(a, n)):
            words[i] = words[i - p]
    return [f"w{w}" for w in words]


@pytest.mark.parametrize("strip", [1 << 16, 48])  # short strips: runs go over many, and are stitched
def test_random_texts(spark, monkeypatch, strip):
    monkeypatch.setattr(periods, "STRIP", strip)
    rng = random.Random(strip)
    texts = [noisy(rng) for _ in range(200)]
    made = spark.createDataFrame([(i, " \n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in periods.periodic_runs(made).collect()}
    for i, words in enumerate(texts):
        want = runs(words)
        assert [tuple(r) for r in found[i].runs] == want
        assert found[i].collapsed == " ".join(collapsed(words, want)) and found[i].n_words == len(words)


def test_odd_documents(spark):
    found = periods.periodic_runs(odd_documents(spark))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for doc_id, text, *_ in ODD:
        words = WORD.findall(text or "")
        known = [(0, 120_000, 3)] if doc_id == 7 else runs(words)
        want.append((doc_id, len(words), [tuple(r) for r in known], " ".join(collapsed(words, known))))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert result(periods.periodic_runs(odd_documents(spark, []))) == []


def test_tiles_of_one_word_and_of_long_periods():
    words = np.concatenate((np.zeros(3000, np.int64), np.tile(np.arange(1, 701), 5)))
    found = set()
    for doc, octave, begin, end, phase in periods.strips(words, np.array([0, len(words)])):
        for a, b, first in zip(begin.tolist(), end.tolist(), phase.tolist(), strict=True):
            found |= {(q, x + a, y + a) for q, x, y in periods.solve(words[a:b], octave, first)}
    assert {q for q, _, _ in found} == {1, 700}
    assert min(x for q, x, _ in found if q == 700) == 3000 and max(y for *_, y in found) == len(words)
