"""Quality of texts: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

A text's words count twice: as they are, and as shapes (runs of small letters, capitals and digits by kind, marks by
themselves), so that words never seen before still tell.  Features are the n-grams of both and whether a word repeats
the one before it; each group of features is weighed by its share of the text, so long texts count as much as short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.words import UNSPACED, mix, odd_weights, steps, windows, word_hashes


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the sample of labelled rows that is fitted (about; chosen by a hash of the id, any size of input).

    The rest: bits of the feature space, passes over the sample, parts that are fitted apart and averaged, and the
    learner's rate (alpha, beta) and regularisation (l1, l2).
    """

    fit_rows: int = 9_000
    bits: int = 18
    passes: int = 2
    parts: int = 6
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    #: scale of a group's shares
    scale: float = 16.0


def _kinds() -> np.ndarray:
    """For each byte: 0 none, 1 small letter, 2 capital, 3 digit, marks by themselves from 16."""
    kinds = np.zeros(256, np.uint64)
    for b in range(256):
        char = chr(b)
        if b >= 0xC0:
            continue  # the first byte of a letter: the next one tells
        if b >= 0x80:
            kinds[b] = 2 if b < 0x9F else 1
        elif char.isalpha():
            kinds[b] = 1 if char.islower() else 2
        elif char.isdigit():
            kinds[b] = 3
        elif UNSPACED[b]:
            kinds[b] = 16 + b
    return kinds


_KINDS = _kinds()


def shape_hashes(texts: list[str | None]) -> np.ndarray:
    """A hash of the shape of each word, in the order of word_hashes."""
    blob = np.frombuffer(b" ".join(t.encode("utf-8", "surrogatepass") if t else b"" for t in texts) + b" ", np.uint8)
    inside = UNSPACED[blob]
    starts = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)) == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    kinds = _KINDS[blob]
    kinds = np.where(blob >= 0xC0, np.roll(kinds, -1), kinds)  # all bytes of a letter are of one kind
    kept = inside & (kinds > 0) & (np.concatenate([[0], kinds[:-1]]) != kinds)
    # runs of marks count up to three
    again = inside & (kinds >= 16) & ~kept
    first = np.concatenate([[False], kept[:-1]])
    kept |= again & (first | np.concatenate([[False], first[:-1]]))
    order = np.cumsum(kept)
    place = order - (order - kept)[starts][np.cumsum(inside & np.concatenate([[True], ~inside[:-1]])) - 1] - 1
    values = np.where(kept, (kinds + np.uint64(1)) * odd_weights(64, 21)[np.clip(place, 0, 63)], np.uint64(0))
    return mix(np.add.reduceat(values, starts) + np.uint64(7))


def features(texts: list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of features its places in the weights, text after text, and how many each text has."""
    words, counts = word_hashes(texts)
    shapes = shape_hashes(texts)
    ends = np.cumsum(counts)
    shift = np.uint64(64 - bits)
    out = []
    for group, (values, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams = windows(values, n)
        inner = np.ones(len(values), bool)
        for k in range(1, n):  # n-grams never cross the end of a text
            inner[ends[ends >= k] - k] = False
        inner = inner[:len(grams)]
        places = (mix(grams + np.uint64(group + 1)) >> shift).astype(np.int64)
        out.append((places[inner], np.maximum(counts - n + 1, 0)))
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    firsts = (ends - counts)[counts > 0]
    same[firsts] = False
    told = (mix(np.array([101, 102], np.uint64)) >> shift).astype(np.int64)
    out.append((told[same.astype(int)], counts))
    return out


def margins(texts: list[str | None], weights: np.ndarray, settings: Settings) -> np.ndarray:
    """The linear score of each text; the last weight is the bias."""
    total = np.full(len(texts), weights[-1])
    for places, counts in features(texts, settings.bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[places])])
        ends = np.cumsum(counts)
        total += settings.scale * (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)
    return total


class Learner:
    """Follow the regularised leader, with a rate for each feature."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros_like(self.z)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def rows_of(texts: list[str | None], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as its places and values, the bias last."""
    bias = 1 << settings.bits
    groups = [(p, np.cumsum(c), c) for p, c in features(texts, settings.bits)]
    out = []
    for i in range(len(texts)):
        places, values = [], []
        for all_places, ends, counts in groups:
            own, n = np.unique(all_places[ends[i] - counts[i]:ends[i]], return_counts=True)
            places.append(own)
            values.append(settings.scale * n / max(1, counts[i]))
        at, back = np.unique(np.concatenate([*places, [bias]]), return_inverse=True)
        out.append((at, np.bincount(back, np.concatenate([*values, [1.0]]), len(at))))
    return out


def fitted(texts: list[str | None], labels: list[float], settings: Settings) -> np.ndarray:
    """Weights after some passes over the texts, in an order shuffled anew but always the same."""
    learner = Learner(settings)
    rows = [row for part in steps(texts) for row in rows_of(texts[part], settings)]
    shuffle = np.random.default_rng(11)
    for _ in range(settings.passes):
        for i in shuffle.permutation(len(rows)).tolist():
            learner.learn(*rows[i], labels[i])
    return learner.weights()


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, settings: Settings) -> np.ndarray:
    """Weights learned from labelled documents of folds 1 to 4; null labels and ids aren't used.

    A document with several label rows has the largest.  The parts' weights are averaged by Spark; what comes to the
    driver is one number for each feature in use, 2**bits at most.
    """
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    scale = 1 << 20
    share = min(scale, settings.fit_rows * scale // max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(settings.parts))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("part", part)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        weights = fitted(group["text"].tolist(), group["label"].tolist(), settings)
        at = np.flatnonzero(weights)
        return pd.DataFrame({"feature": at, "weight": weights[at]})

    learned = sample.groupBy("part").applyInPandas(learn, "feature int, weight double")
    mean = learned.groupBy("feature").agg((F.sum("weight") / settings.parts).alias("weight")).toPandas()
    weights = np.zeros((1 << settings.bits) + 1)
    weights[mean["feature"].to_numpy(np.int64)] = mean["weight"].to_numpy(float)
    return weights


def score_column(weights: np.ndarray, settings: Settings, spark) -> Column:
    """The probability of label 1 for column text."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in text.tolist()]
        margin = [margins(texts[part], shared.value, settings) for part in steps(texts)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(margin), -35, 35))) if margin else [], dtype=float)

    return score("text")


def scored(docs: DataFrame, labels: DataFrame, settings: Settings, threshold: float) -> DataFrame:
    """The rows of docs with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Only doc_id and text of docs are used; its other columns stay, but those of the three names are replaced.  A row's
    score depends on its text alone, so repeated rows get the same; null and empty texts get the score of the bias.  A
    null doc_id is in no fold: held_out is false.  Without labelled rows every score is 0.5.  No rows: an empty result.
    """
    weights = fit(docs, labels, settings)
    return docs.withColumns({
        "held_out": F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)),
        "score": score_column(weights, settings, docs.sparkSession),
    }).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
