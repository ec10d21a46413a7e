from __future__ import annotations

import duckdb
from texts import SMALL

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlane.llm import queries
from ledgerlane.llm.packing import Limits


def test_all_text_queries_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries()) and len(queries.QUERIES) == 14
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_oracles_agree(spark):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = sorted(tuple(r) for r in entry.queries()[name](spark, SMALL).collect())
        assert got == sorted(con.execute(sql).fetchall()) and got


def test_pipeline_stages_keep_columns_and_run_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SMALL)
        assert left.schema.names == docs.schema.names and left.dtypes == docs.dtypes
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[4] > 0.5 * counts[0]
    made = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in made} == {r.doc_id for r in left.select("doc_id").collect()}
    filled = {}
    for r in made:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= Limits().tokens
