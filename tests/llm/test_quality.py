import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import CLASHES, NAMES, ODD, odd_documents, result, statistics

from hostweave.llm import quality
from hostweave.llm.tables import only


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\té", max_size=200), max_size=6))
def test_statistics_are_the_plain_ones(texts):
    found = quality.statistics(pa.array(texts, pa.string()))
    assert [tuple(int(found[s][i]) for s in quality.STATS) for i in range(len(texts))] == [statistics(t) for t in texts]


def test_repeated_windows():
    text = " ".join(f"w{i % 11}" for i in range(40)) + " " + " ".join(f"v{i}" for i in range(9))
    assert quality.statistics(pa.array([text]))["n_repeat_words"][0] == statistics(text)[4] > 0


def test_chi_square_quantiles():
    assert abs(quality.chi_square(4, 0.95) - 9.4877) < 1e-3
    assert abs(quality.chi_square(4, 0.5) - 3.3567) < 1e-3


def documents(spark, clean=300, junk=60):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(2, 9, 400)]
    rows = []
    for i in range(clean):
        rows.append((i, " ".join(rng.choice(words, rng.integers(30, 400))), "en", "a"))
    for i in range(junk):
        rows.append((1000 + i, " ".join(w + "$$$###" for w in rng.choice(words, 80)), "en", "a"))
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(odd_documents(spark, documents(spark))).collect()}
    assert all(verdicts[i].kept for i in range(300))
    assert not any(verdicts[1000 + i].kept or verdicts[1000 + i].base_failed for i in range(60))


def test_each_statistic_rejects_by_itself(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(2, 9, 4000)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(rng.integers(100, 400)), "en", "a") for i in range(400)]
    own = [text(8) for _ in range(7)]
    rows += [
        (1000, "\n".join([*rng.choice(words, 40), *["a b"] * 180, *["c d"] * 180]), "en", "a"),  # repeated lines
        (1001, " ".join([*rng.choice(words, 280), *own, *own]), "en", "a"),  # repeated words, below the base rule
        (1002, " ".join(w + "$#*" for w in rng.choice(words, 200)), "en", "a"),  # symbols
        (1003, " ".join("x" * 60 for _ in range(3)) + " " + " ".join(f"{'y' * 50}{i}" for i in range(150)), "en", "a"),  # word length
    ]
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(odd_documents(spark, rows)).collect()}
    for i in range(1000, 1004):
        assert not verdicts[i].kept, (i, verdicts[i])
    assert not verdicts[1001].base_failed and sum(verdicts[i].kept for i in range(400)) >= 396


def test_fit_is_the_minimum_determinant_of_a_plain_search(spark):
    """Concentration steps on all rows by numpy reach the same centre."""
    rows = documents(spark)
    measured = quality.with_statistics(only(odd_documents(spark, rows), *NAMES)).drop("text")
    _, estimates, _ = quality.fit(measured)
    found = estimates.collect()
    assert len(found) == 1
    s = np.array([statistics(t) for _, t, _, _ in rows], float)
    n = s[:, 0] + quality.PRIOR_WORDS
    x = np.stack([np.log((s[:, 1] + 5 * quality.PRIOR_WORDS) / n), np.log1p(100 * s[:, 2] / n), np.log1p(100 * s[:, 3] / n), s[:, 4] / n], 1)
    x = x[(s[:, 0] >= 20) & (100 * s[:, 4] <= 30 * s[:, 0])]
    half = quality.chi_square(4, 0.5)
    scale, floors = 0.5 / quality.chi_square_share(6, half), np.diag(np.square(quality.FLOORS))
    centre, cov = np.median(x, axis=0), floors + np.diag(np.square(1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)))

    def distance(centre, cov):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)

    for _ in range(60):
        near = np.argsort(distance(centre, cov), kind="stable")[: (len(x) + 5) // 2]
        centre, cov = x[near].mean(axis=0), scale * np.cov(x[near].T, bias=True) + floors
    inside = x[distance(centre, cov) <= quality.chi_square(4, quality.COUNTED)]
    assert np.allclose(found[0]["_centre"], inside.mean(axis=0), atol=0.01)


def test_odd_documents(spark):
    found = result(quality.quality_verdicts(odd_documents(spark)), "doc_id", *quality.STATS, "base_failed", "kept")
    want = []
    for doc, text, _, _ in ODD:
        s = statistics(text)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((doc, *s, failed, not failed))
    assert found == sorted(want, key=repr)
    kept = quality.keep_good(odd_documents(spark))
    assert kept.columns == NAMES + CLASHES
    assert sorted(r[0] for r in kept.collect() if r[0] is not None) == [r[0] for r in want if r[-1] and r[0] is not None]


def test_no_documents(spark):
    assert result(quality.quality_verdicts(odd_documents(spark, []))) == []
    assert result(quality.keep_good(odd_documents(spark, []))) == []
