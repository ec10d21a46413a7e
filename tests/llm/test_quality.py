from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SMALL, documents

from ledgerlane.llm import quality
from ledgerlane.llm.quality import Settings, features, fitted, margins, rows_of, scored
from ledgerlane.llm.tables import read


def test_features_stay_within_texts():
    texts = ["a b c", "", "X y Z!! q", None, "one"]
    for n, (places, counts) in zip((1, 2, 1, 2, 3, 1), features(texts, 18), strict=True):
        assert counts.tolist() == [max(0, k - n + 1) for k in (3, 0, 4, 0, 1)] and len(places) == counts.sum()
    alone = [features([t], 18) for t in texts]
    for g, (places, _) in enumerate(features(texts, 18)):
        assert places.tolist() == [x for own in alone for x in own[g][0].tolist()]


def test_shapes_tell_kinds_not_words():
    a, b, c, d = quality.shape_hashes(["Bravo Tango! TANGO! ÉTÉ"]).tolist()
    assert len({a, b, c}) == 3
    assert quality.shape_hashes(["Oscar Kilo!"]).tolist() == [a, b] and quality.shape_hashes(["LIMA!"]).tolist() == [c]
    assert quality.shape_hashes(["XYZ"]).tolist() == [d]


def test_margin_is_the_sparse_product():
    rng = random.Random(2)
    s = Settings(bits=12)
    texts = [" ".join(rng.choice(["the", "The", "x!!", "12", "and,"]) for _ in range(rng.randrange(30))) for _ in range(40)]
    weights = np.random.default_rng(1).normal(size=(1 << 12) + 1)
    slow = [float(weights[at] @ x) for at, x in rows_of(texts, s)]
    assert np.allclose(margins(texts, weights, s), slow)


def test_learner_parts_two_kinds():
    good = [f"Plain words number{i} and others follow." for i in range(60)]
    bad = [f"BUY{i}!! NOW!! word{i}!! NOW!!" for i in range(60)]
    w = fitted(good[:40] + bad[:40], [1.0] * 40 + [0.0] * 40, Settings(bits=14, passes=6))
    assert (margins(good[40:], w, Settings(bits=14)) > 0).all() and (margins(bad[40:], w, Settings(bits=14)) < 0).all()


def test_held_out_accuracy_on_a_table(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = read(spark, root, "documents"), read(spark, root, "labels")
    got = scored(docs, labels, Settings(), 0.3)
    rows = got.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert got.count() == docs.count()


def test_labels_of_the_held_out_fold_are_never_learned(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    flipped = labels.withColumn("quality", F.when(
        quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels, Settings()), quality.fit(docs, flipped, Settings()))


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "fine words"), (2, None), (2, ""), (None, "x"), (3, "y " * 200_000), (3, "y " * 200_000)]
    got = scored(documents(spark, rows, extra="score label part"), labels, Settings(bits=10), 0.3).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert got[1].score == got[2].score and got[4].score == got[5].score
    assert [r.held_out for r in got] == [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got]
    none = scored(documents(spark, rows), labels.limit(0), Settings(bits=10), 0.3).collect()
    assert {r.score for r in none} == {0.5}
    assert scored(documents(spark, []), labels, Settings(bits=10), 0.3).count() == 0
    assert math.isclose(sum(r.score for r in none), 3.0)
    assert pytest.approx(0.5) == none[0].score
