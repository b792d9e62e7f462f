import duckdb
import pandas as pd
import pytest
from conftest import SF_DIR
from plain import ODD, odd_documents, result

from hostweave.llm import queries, streamdedup
from hostweave.workspace import fresh_dir

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def by_sql(rows):
    database = duckdb.connect()
    database.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    return sorted(database.sql(f"SELECT {', '.join(COLUMNS)} FROM ({streamdedup.SQL})").fetchall(), key=repr)


def test_table_agrees_with_sql(spark):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = sorted(database.sql(f"SELECT {', '.join(COLUMNS)} FROM ({streamdedup.SQL})").fetchall(), key=repr)
    assert result(queries.op11_streaming_exact_dedup(spark, SF_DIR), *COLUMNS) == want


@pytest.mark.parametrize("key_bytes", [32, 1])  # one byte: most digests are shared by different texts
def test_odd_documents(spark, key_bytes):
    assert result(streamdedup.deduplicate_rows(odd_documents(spark), key_bytes), *COLUMNS) == by_sql(ODD)
    assert result(streamdedup.deduplicate_rows(odd_documents(spark, []), key_bytes)) == []


@pytest.mark.parametrize("key_bytes", [32, 1])
def test_state_goes_on_over_batches_and_restarts(spark, key_bytes):
    folder, state = fresh_dir(spark, "grown"), fresh_dir(spark, "state")
    rows = [(i * 7 % 100, f"text  {i % 9}\n{'again' * (i % 3)}", "en", "a") for i in range(100)]
    for begin, end in ((60, 100), (20, 60), (0, 20)):  # later rows have the smaller ids as often as not
        for part in (rows[begin : (begin + end) // 2], rows[(begin + end) // 2 : end]):
            spark.createDataFrame([r[:2] for r in part], "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
        found = streamdedup.deduplicate(spark, folder, state, batch_bytes=1, key_bytes=key_bytes)  # a file is a batch
        assert result(found, *COLUMNS) == by_sql(rows[begin:])
    held = streamdedup.ledger(spark, state)
    assert held.agg({"n": "sum"}).collect()[0][0] == 100
    again = streamdedup.deduplicate(spark, folder, state, key_bytes=key_bytes)  # nothing new: the state stays
    assert result(again, *COLUMNS) == by_sql(rows)


def test_no_python_in_the_plan(spark):
    plan = queries.op11_streaming_exact_dedup(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
