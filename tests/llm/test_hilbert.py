from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import SMALL, documents

from ledgerlane.llm import hilbert
from ledgerlane.llm.tables import read, scratch


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(spark, n, bits):
    side = 1 << bits
    df = spark.range(side ** n).select(*(
        F.expr(f"cast(pmod(id div {side ** i}, {side}) as int)").alias(f"c{i}") for i in range(n)))
    cells = [F.col(f"c{i}") for i in range(n)]
    rows = df.select(*cells, hilbert.curve_index(cells, bits).alias("at")).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side ** n))
    steps = [sum(abs(a[i] - b[i]) for i in range(n)) for a, b in zip(rows, rows[1:], strict=False)]
    assert set(steps) == {1}


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1


def test_whole_small_table_and_pruning(spark):
    docs = read(spark, SMALL, "documents")
    placed = hilbert.sharded(docs, 24, scratch(spark, "t"))
    got = placed.collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got, 24)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    bounds = hilbert.shard_bounds(docs, placed).collect()
    total = docs.agg(F.max("doc_id") - F.min("doc_id")).first()[0]
    spans = [(r.max_doc_id - r.min_doc_id) / total for r in bounds]
    langs = [r.min_lang == r.max_lang for r in bounds]
    # 8 documents drawn at random span 0.78 of the ids and nearly never have one language
    assert sum(spans) / len(spans) < 0.5 and sum(langs) >= 3


def test_nulls_ties_repeats_few_and_no_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "é"), (3, "x" * 100_000)]
    docs = documents(spark, rows, extra="shard slot place part rank d0 curve")
    check(rows, hilbert.sharded(docs, 3, scratch(spark, "t")).collect(), 3)
    check(rows, hilbert.sharded(docs, 24, scratch(spark, "t")).collect(), 24)
    assert hilbert.sharded(documents(spark, []), 24, scratch(spark, "t")).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}", "en" if i % 2 else "de", f"s{i % 5}", i) for i in range(50)])
    hilbert.write_shards(docs, 4, scratch(spark, "t"), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [
        f"shard={k}" for k in range(4)]
