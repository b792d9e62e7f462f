import duckdb
import pandas as pd
import pytest
from conftest import SF_DIR
from plain import CLASHES, NAMES, ODD, odd_documents, result

from hostweave.llm import mixing

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def by_sql(rows):
    database = duckdb.connect()
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    database.register("documents", documents)
    return sorted(database.sql(f"SELECT {', '.join(COLUMNS)} FROM ({mixing.SQL})").fetchall(), key=repr)


def test_table_agrees_with_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = sorted(database.sql(f"SELECT {', '.join(COLUMNS)} FROM ({mixing.SQL})").fetchall(), key=repr)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = mixing.mix_documents(documents)
    assert result(found, *COLUMNS) == want == result(mixing.mix_documents(documents.repartition(5)), *COLUMNS)
    by_source = found.groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 1 for r in by_source)
    assert found.where("taken > 2 * size").isEmpty()


def test_odd_documents(spark):
    found = mixing.mix_documents(odd_documents(spark))
    assert result(found, *COLUMNS) == by_sql(ODD)
    copies = mixing.mixed_copies(odd_documents(spark))
    assert copies.columns == NAMES + CLASHES
    taken = {(r.doc_id, r.size): r.taken for r in found.collect()}
    count = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(count.get(d, 0) == int(taken[d, s] / s + 0.5) for d, s in taken if s and d in (1, 4, 6, 7))


def test_schedule_is_spread_evenly(spark):
    rows = [(i, "w " * 500, "en", s) for i, s in enumerate("aabbbbccccc" * 20)]
    stored = odd_documents(spark, rows).select("doc_id", "source").toDF("doc_id", "source").selectExpr("*", "500L AS size")
    laid = stored.selectExpr("*", "concat('=', source) AS _source")
    targets = mixing.source_targets(laid)
    slots = mixing.mix_schedule(targets).orderBy("position").collect()
    share = {r._source: r.target for r in targets.collect()}
    total = sum(share.values())
    for upto in (len(slots) // 7, len(slots) // 3, len(slots) // 2):
        for source, target in share.items():
            got = sum(s._source == source for s in slots[:upto])
            assert abs(got - upto * target / total) <= 25
    for source in share:
        assert [s.rank for s in slots if s._source == source] == list(range(sum(s._source == source for s in slots)))


def test_stream_takes_blocks_in_the_schedules_order(spark):
    rows = [(i, "w " * (50 + 13 * i), "en", s) for i, s in enumerate("aabbbbccccc" * 6)]
    stream = mixing.mixed_stream(odd_documents(spark, rows)).collect()
    assert [(r.position, r.place) for r in stream] == sorted((r.position, r.place) for r in stream)
    sizes = {d: len(t.split()) for d, t, _, _ in rows}
    assert all(r.words > 0 and r.first_word + r.words <= sizes[r.doc_id] for r in stream)
    taken = {}
    for r in stream:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    mixed = mixing.mix_documents(odd_documents(spark, rows)).collect()
    assert {r.doc_id: r.taken for r in mixed if r.taken} == taken
    total, seen, share = sum(taken.values()), {}, {r.source: r.target for r in mixed}
    for n, r in enumerate(stream):  # at any point each source has about its share of what came so far
        seen[r.source] = seen.get(r.source, 0) + r.words
        if n > len(stream) // 10:
            so_far = sum(seen.values())
            assert all(abs(seen.get(x, 0) - so_far * share[x] / total) < 0.05 * total for x in share)
    for r in stream[:5]:  # the words of a block follow one another
        same = [x for x in stream if (x.position, x.source) == (r.position, r.source)]
        assert all(a.place + a.words == b.place for a, b in zip(same, same[1:]))


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a")], [(1, "one", None, None)]])
def test_small_tables(spark, rows):
    found = result(mixing.mix_documents(odd_documents(spark, rows)), "doc_id", "size", "target", "taken")
    assert found == [(1, 0, 0.0, 0), ] * (rows != [] and rows[0][1] is None) + [(1, 1, 1.5, 1)] * (rows != [] and rows[0][1] == "one")


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_documents(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
