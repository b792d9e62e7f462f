import numpy as np
import pytest
import pyarrow as pa
from conftest import SF_DIR
from plain import CLASHES, NAMES, ODD, components, odd_documents, result, shingles

from hostweave.llm import neardup
from hostweave.llm.components import components as connected


def words(seed, count):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 30, count)]


def changed(text, seed, share):
    rng, out = np.random.default_rng(seed), list(text)
    for i in rng.choice(len(out), max(1, int(len(out) * share)), replace=False):
        out[i] = f"x{rng.integers(1 << 30)}"
    return " ".join(out)


def test_sets_are_the_distinct_shingles():
    texts = [t or "" for _, t, _, _ in ODD] + ["A b C d E f", "a B c D e F", "a b", "a", "a a a a a a a"]
    sets = list(neardup.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[-5].tolist() == sets[-4].tolist() and sets[-3].tolist() != sets[-2].tolist()


def test_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(3)
    multiplier = neardup.multipliers(2000)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.concatenate((a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    same = (neardup.signature(a, multiplier) == neardup.signature(b, multiplier)).mean()
    assert abs(same - 0.6) < 0.05


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(900, 1100) if x != 1000] + [(70, 71), (71, 72), (72, 70), (80, 80)]
    found = dict(result(connected(spark.createDataFrame(edges, "a long, b long"))))
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(900, 1100)} == {900} and found[72] == 70 and 80 not in found
    assert result(connected(spark.createDataFrame([], "a long, b long"))) == []


def expected(rows):
    return sorted(((d, n, c, d == c) for d, n, c in components([r[:2] for r in rows])), key=repr)


def test_table_agrees_with_all_pairs(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(neardup.near_duplicates(documents).drop("_text")) == expected(rows)


def test_large_group_around_one_text(spark):
    """Most copies are linked with the original only, and there are more than a region compares whole."""
    base = words(1, 200)
    rows = [(500, " ".join(base), "en", "a")] + [(1000 + i, changed(base, i, 0.025), "en", "a") for i in range(250)]
    rows += [(i, " ".join(words(10 + i, 80)), "en", "a") for i in range(60)] + [(2000, " ".join(base), "en", "a")]
    assert result(neardup.near_duplicates(odd_documents(spark, rows)).drop("_text")) == expected(rows)


def test_region_cut_by_partitions(spark):
    base = words(2, 150)
    rows = [(i, changed(base, i, 0.01), "en", "a") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert {r.component_id for r in neardup.near_duplicates(odd_documents(spark, rows)).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def chain(seed, count, size, step):
    """Texts that each change a few words in place of the one before, so that only close ones are linked."""
    rng, now = np.random.default_rng(seed), words(seed, size)
    out = []
    for _ in range(count):
        at = int(rng.integers(0, size - step))
        now[at : at + step] = [f"y{x}" for x in rng.integers(0, 1 << 30, step)]
        out.append(" ".join(now))
    return out


def family(seed, count, size, own, linked):
    """Pages of one template with ``own`` words in a row of their own, and every tenth a near copy of the page before."""
    base, out = words(seed, size), []
    for i in range(count):
        if i % 10 == 9:
            last = out[-1].split(" ")
            last[:linked] = [f"z{i}.{k}" for k in range(linked)]
            out.append(" ".join(last))
        else:
            out.append(" ".join(base[:-own] + [f"v{i}.{k}" for k in range(own)]))
    return out


def test_large_regions_are_compared_whole(spark, monkeypatch):
    """A chain of drifting copies and a family of templated pages, over 1,000 texts each."""
    rows = [(i, t, "en", "a") for i, t in enumerate(chain(5, 1100, 150, 14))]
    rows += [(5000 + i, t, "en", "a") for i, t in enumerate(family(6, 1100, 160, 24, 20))]
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 300_000)  # about 200 rows
    assert result(neardup.near_duplicates(odd_documents(spark, rows)).drop("_text")) == expected(rows)


def test_candidates_do_not_depend_on_partitions(spark):
    """A family small enough to be compared whole, in one partition and cut by many."""
    rows = [(i, t, "en", "a") for i, t in enumerate(family(7, 60, 160, 24, 20))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert result(neardup.near_duplicates(odd_documents(spark, rows)).drop("_text")) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block_bytes", [8 << 20, 40_000])
def test_links_apart_join_what_all_pairs_would(spark, monkeypatch, block_bytes):
    """Rows of many sizes, each a component of its own: links between blocks join what brute force joins, with less than a link a row."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", block_bytes)
    rows = [(i, t, "en", "a") for i, t in enumerate(family(8, 150, 160, 24, 20))]
    rows += [(1000 + i, " ".join(words(9, 120 + 3 * i)), "en", "a") for i in range(60)]  # each the next one's beginning
    signed = neardup.with_signatures(odd_documents(spark, rows)).withColumnRenamed("doc_id", "node")
    classes = neardup.written(signed.select("node", "n_shingles", "_sign", "_text"), "classes")
    sets = neardup._sets(odd_documents(spark, rows), classes.selectExpr("node", "node AS doc_id", "_text"))
    alone = classes.selectExpr("-1L AS area", "node", "node AS component")
    links = neardup.written(neardup.links_apart(neardup._sketches(classes).join(alone, "node").join(sets, "node")), "links")
    found = {r.node: r.component for r in neardup.components(links).collect()}
    assert {r[0]: found.get(r[0], r[0]) for r in rows} == {r[0]: r[2] for r in expected(rows)}
    if block_bytes > 1 << 20:
        assert links.count() < 2 * len(rows)


def test_odd_documents(spark):
    assert result(neardup.near_duplicates(odd_documents(spark)).drop("_text")) == expected(ODD)
    left = neardup.without_duplicates(odd_documents(spark))
    assert left.columns == NAMES + CLASHES
    assert result(left.select(*left.columns[:1], "lang", "source")) == sorted(
        [(1, "en", "a"), (2, None, None), (None, "en", "a"), (3, "en", None), (4, "de", "b"), (None, "fr", "b"), (6, "de", ""), (7, "la", "b"), (-8, "la", "a"), (9, "en", "a")],
        key=repr,
    )


def test_null_ids_are_smallest_only_among_themselves(spark):
    text = " ".join(words(4, 30))
    rows = [(None, text, "en", "a"), (7, text, "en", "a"), (None, text + " x", "en", "a")]
    assert result(neardup.near_duplicates(odd_documents(spark, rows)).select("doc_id", "component_id", "kept")) == sorted(
        [(None, 7, False), (7, 7, True), (None, 7, False)], key=repr
    )


def test_no_documents(spark):
    assert result(neardup.near_duplicates(odd_documents(spark, []))) == []
    assert result(neardup.without_duplicates(odd_documents(spark, [])), *NAMES[:1]) == []
