"""Stages one by one on odd rows; the whole on a small table is in test_entry."""

from __future__ import annotations

import pytest
from texts import SMALL, documents

import corpus_pipeline as pipeline

WORDS = "a plain sentence with enough words in it to be told from any other sentence that stands here"
OTHER = "quite another text which says nothing that the first one says and is not a copy of it either"


def kept(df) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_near_copies_go_by_id_and_text(spark):
    rows = [(1, WORDS), (5, WORDS), (5, OTHER), (None, WORDS), (7, None), (8, ""), (9, OTHER + " indeed"), (1, WORDS)]
    docs = documents(spark, rows, extra="row kept component_id")
    left = pipeline.drop_near_copies(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert kept(left) == sorted([(1, WORDS), (1, WORDS), (5, OTHER), (None, WORDS), (7, None), (8, "")], key=repr)


def test_benchmark_passages_go_by_id_and_text(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, f"{WORDS} {item} {OTHER}"), (1, WORDS), (2, None), (None, item), (None, OTHER), (3, "")]
    docs = documents(spark, rows, extra="row item_id")
    left = pipeline.drop_benchmark_passages(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert kept(left) == sorted([(1, WORDS), (2, None), (None, OTHER), (3, "")], key=repr)


def test_personal_data_and_packing_keep_every_row(spark):
    rows = [(1, "mail a@b.cd"), (1, WORDS), (None, "10.0.0.1"), (2, None), (3, ""), (1, WORDS)]
    docs = documents(spark, rows, extra="row marks")
    masked = pipeline.mask_personal_data(spark, docs, SMALL)
    assert masked.columns == docs.columns
    assert kept(masked) == sorted([(1, "mail [email]"), (1, WORDS), (None, "[ip]"), (2, None), (3, ""), (1, WORDS)], key=repr)
    assert pipeline.pack(spark, masked, SMALL).count() == len(rows)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_no_rows(spark, stage):
    docs = documents(spark, [])
    assert stage(spark, docs, SMALL).count() == 0


def test_quality_judges_row_by_row(spark):
    rows = [(1, WORDS), (1, None), (None, WORDS), (2, ""), (2, WORDS)]
    docs = documents(spark, rows, extra="score row")
    left = kept(pipeline.keep_quality(spark, docs, SMALL))
    assert len([t for _, t in left if t == WORDS]) in (0, 3)
    assert len([t for _, t in left if not t]) in (0, 2)
