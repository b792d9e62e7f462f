import duckdb
import numpy as np
import pandas as pd
import pytest
from plain import result

from hostweave.llm import topk


def plain(rows, k, every):
    points = [(i, np.floor(256 * np.array(v, np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(p) for _, p in points), default=0)
    points = [(i, np.pad(p, (0, width - len(p))).astype(int)) for i, p in points]
    out = set()
    for q in {i for i, _ in points if i % every == 0}:
        scores = [(-int(p @ np.array(own)), i) for own in {tuple(p) for o, p in points if o == q} for i, p in points if i != q]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return sorted(out, key=repr)


def vectors(spark, rows):
    made = spark.createDataFrame([(*r, "clash", 1) for r in rows], "a long, b array<float>, c string, d int")
    return made.toDF("vec_id", "embedding", "EMBEDDING", "cell")


def test_trees_cover_their_rows():
    points = np.random.default_rng(0).normal(size=(500, 3)) * 100
    ids, ordered, root = topk.cover_tree(np.arange(500), points)
    assert sorted(ids.tolist()) == list(range(500)) and (ordered == points[ids]).all()

    def check(node):
        own = ordered[node.low : node.high]
        assert np.sqrt(((own - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert not node.children or (node.children[0].low, node.children[-1].high) == (node.low, node.high)
        for child in node.children:
            check(child)

    check(root)
    again = topk.loaded(topk.stored((ids, ordered, root)))
    assert (again[0] == ids).all() and again[2].children[0].high == root.children[0].high


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 4)) * 2000
    points = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 4)) * 5)
    rows, queries = topk.cover_tree(np.arange(4000), points), topk.cover_tree(np.arange(0, 4000, 40), points[::40])
    best = topk.Best(100, 5)
    looked = topk.dual_search(queries, rows, best, 0)
    assert looked < 0.75 * 100 * 4000
    for n, q in enumerate(queries[0]):
        want = sorted((-int(points[q] @ points[i]), i) for i in range(4000) if i != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[n], best.id[n])] == want


@pytest.mark.parametrize("block", [3, 2048])
def test_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(30, 60)] + [(40, [0.5, 0.5, 0.5]), (40, [0.1, 0.0, 9.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (70, None), (80, [1.0, None, 0.0]), (90, [float("nan"), 0.0, 0.0]), (100, [float("inf"), 0.0, 0.0])]
    rows += [(110, []), (120, [1.0]), (-10, [0.0, -0.001, 2.0, 3.0])]
    assert result(topk.top_k(vectors(spark, rows), 5, 10)) == plain(rows, 5, 10)


def test_repeated_rows_are_listed_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [9.0, 0.0]), (7, [9.0, 0.0]), *((i, [float(i), 0.0]) for i in range(7))]
    found = topk.top_k(vectors(spark, rows), 5, 50).where("query_id = 50").orderBy("rank")
    assert [r.vec_id for r in found.collect()] == [7, 7, 6, 5, 4]
    database = duckdb.connect()
    database.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    names = "query_id, rank, vec_id, score"
    assert result(topk.top_k(vectors(spark, rows), 5, 50)) == sorted(database.sql(f"SELECT {names} FROM ({topk.SQL})").fetchall(), key=repr)


def test_few_and_no_vectors(spark):
    assert result(topk.top_k(vectors(spark, [(0, [1.0]), (1, [2.0])]), 5, 50)) == [(0, 1, 1, 131072)]
    assert result(topk.top_k(vectors(spark, [(0, [1.0])]), 5, 50)) == []
    assert result(topk.top_k(vectors(spark, []), 5, 50)) == []


def test_components_too_large_for_exact_scores(spark):
    with pytest.raises(ValueError, match="exact"):
        topk.top_k(vectors(spark, [(0, [1e9]), (1, [1e9])]), 5, 50)
