import functools

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import ODD, WORD, odd_documents, result

from hostweave.llm import tokencounts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCORES = tokencounts.unigram_scores(MODEL)


def plain_count(word, scores):
    longest, unknown = max(map(len, scores)), min(scores.values()) - tokencounts.UNKNOWN
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + unknown * size, best[end - 1][1] + size)]
        ways += [(best[b][0] + scores[word[b:end]], best[b][1] + 1) for b in range(max(0, end - longest), end) if word[b:end] in scores]
        most = max(s for s, _ in ways)
        best.append((most, min(n for s, n in ways if s == most)))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcz", min_size=1, max_size=9), min_size=1, max_size=20, unique=True))
def test_shared_prefixes_change_nothing(words):
    scores = {"a": -1.0, "b": -2.0, "ab": -2.0, "abc": -3.0, "bc": -1.5, "ca": -2.5, "cab": -3.0}
    assert list(tokencounts.UnigramTrie(scores).walk(sorted(words))) == [plain_count(w, scores) for w in sorted(words)]


def test_scores_are_probabilities():
    import math

    assert len(SCORES) > 30_000 and abs(sum(map(math.exp, SCORES.values())) - 1) < 1e-6


def test_odd_documents(spark):
    count = functools.cache(lambda w: plain_count(tokencounts.SPACE + w, SCORES))
    found = result(tokencounts.token_counts(odd_documents(spark), MODEL))
    want = [(d, len(w := WORD.findall(t or "")), sum(map(count, w))) for d, t, _, _ in ODD]
    assert found == sorted(want, key=repr)
    assert result(tokencounts.token_counts(odd_documents(spark, []), MODEL)) == []
