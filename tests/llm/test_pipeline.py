import duckdb
import numpy as np
import public_tokenizers
from conftest import SF_DIR
from plain import CLASHES, ODD, check_packing, components, crc, odd_documents, without_repeats
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from hostweave.llm import mixing, quality
from hostweave.llm.tables import written


def test_run_is_the_plain_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_verdicts(documents).where("kept").collect()}
    rows = [r for r in documents.collect() if r.doc_id in kept]
    of = {d: c for d, _, c in components([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if of[r.doc_id] == r.doc_id]
    texts = {}
    for r, (raw, gone) in zip(rows, without_repeats([(r.doc_id, r.text) for r in rows]), strict=True):
        text = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
        if text.strip(" \t\n\v\f\r"):
            texts[r.doc_id] = (text, r.source)
    database = duckdb.connect()
    database.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    database.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, *v) for d, v in texts.items()])
    own, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), []
    for doc, size, taken in database.sql(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall():
        ids = own.encode(texts[doc][0], add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        pieces = [(doc, p // 4096, p, len(ids[p : p + 4096]), crc(ids[p : p + 4096])) for p in range(0, len(ids), 4096)]
        want += pieces * int(taken / size + 0.5)
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    used = check_packing([(r.sequence_id, r.offset, r.length) for r in found], 4096)
    assert used <= 1.01 * -(-sum(r.length for r in found) // 4096) + 1


def test_stages_keep_columns_and_bear_anything(spark):
    for rows in (ODD, []):
        # Files cannot hold names that differ in case only; all other clashing names stay.
        docs = written(odd_documents(spark, rows).toDF("doc_id", "text", "lang", "source", *["TEXT_" if c == "TEXT" else c for c in CLASHES]), "odd")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs.columns, written(stage(spark, docs, SF_DIR), "odd")
            assert docs.columns == before
        assert written(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR), "odd").count() >= docs.count()


def test_registered():
    found, sql = entry_point.queries(), entry_point.oracle_sql()
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in found) == 1] == list(range(1, 14))
    assert "pipeline" in found and sql.keys() <= found.keys()
