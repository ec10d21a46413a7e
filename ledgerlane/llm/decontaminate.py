"""Finding passages of benchmark items in documents: CGK embedding, bit sampling, exact edit verification.

The CGK embedding walks along a text: at each step it writes the word it stands on, and a random function of step and
word says whether it moves on.  Two texts at a small edit distance write rows of small Hamming distance, because their
walks meet again after an edit.  Sampling a few steps of a row gives a key; several walks with own samples give
several keys, and equal keys make a candidate.

Windows start at every word of a document and at every word of an item, and a walk covers a few words only, so a window of
an item's size is found by any of its stretches that has few edits: with an item of m words and at most m / 5 edits,
m - 4 windows or more of 4 to 5 words hold one edit at most.  Candidates are aligned with the whole item, and the
edit distance in words of the item to its best window decides.

Short items hold too few words for a walk.  Those of up to SHORT words are found without one, and without loss: an item
that may have k edits is cut into k + 1 parts, and in each of its passages one part at least stands word for word; an
item that may have none is one part.  For longer items the walks aim at TARGET_RECALL of the passages with as many edits
as are allowed; tests hold both by length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.tables import row_key, spare
from ledgerlane.llm.words import LETTERS, mix, odd_weights, steps, windows, word_hashes

#: Items are taken in blocks of so many characters, each a pass over the documents; a block is what is broadcast.
BLOCK_CHARS = 8_000_000
#: Words that a walk moves on at least, all its steps together, to count.
LEAST_MOVED = 3
#: Items of up to so many words are found by their parts.  In simulations with every allowed edit, evenly spaced, the walks
#: found 0 % of 1 or 2 words, 64 % of 4, 22 % of 5, 90 % of 10, 99.4 % of 15, 99.7 % of 16, and 99.9 % or more from 18 words on.
SHORT = 17
TARGET_RECALL = 0.99
#: Candidates of short items that one numpy step filters.
STEP_TRIES = 20_000


@dataclass(frozen=True)
class Settings:
    """Edits of up to ``edits`` of an item's words are found; walks as (steps, sampled steps)."""

    edits: float = 0.2
    walks: tuple[tuple[int, tuple[int, ...]], ...] = (
        (7, (0, 2, 4, 6)), (9, (1, 3, 5, 6, 8)), (12, (0, 3, 6, 9, 11)), (14, (2, 5, 8, 11, 13)),
    )


def keys(words: np.ndarray, walk: int, settings: Settings) -> np.ndarray:
    """The key of the walk from each word; the array must go on for as many steps behind the last start.

    A walk that has hardly moved tells nothing; its key is 0, which is looked up nowhere.
    """
    length, sample = settings.walks[walk]
    starts = len(words) - length
    at, key = np.arange(starts), np.zeros(starts, np.uint64)
    coins = odd_weights(length, 1000 + walk)
    for step in range(length):
        now = words[at]
        if step in sample:
            key = key * np.uint64(0x9E3779B97F4A7C15) + now
        at += ((now * coins[step]) >> np.uint64(63)).astype(np.int64)
    moved = at - np.arange(starts) >= LEAST_MOVED
    return np.where(moved, mix(key + np.uint64(walk)), np.uint64(0))


def edit_row(item: np.ndarray, window: np.ndarray, free: bool = True) -> np.ndarray:
    """For each end in the window: the least edit distance of the item to what ends there, begun anywhere if free."""
    across = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64) if free else across.copy()
    for n, word in enumerate(item.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (window != word))
        new = np.concatenate([[n], best])
        row = np.minimum.accumulate(new - across) + across
    return row


def match(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Begin, end and distance of the best match in the window, None if it has more edits than that."""
    ends = edit_row(item, window)
    distance = int(ends.min())
    if distance > most:
        return None
    end = int(np.flatnonzero(ends == distance)[-1])
    back = edit_row(item[::-1], window[:end][::-1], free=False)
    length = int(np.flatnonzero(back == distance)[-1])
    return end - length, end, distance


def parts(words: int, most: int) -> list[tuple[int, int]]:
    """Begins and ends of most + 1 parts of so many words, about as long as each other; of fewer if words don't suffice."""
    n = min(most + 1, words)
    cuts = [words * k // n for k in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Table:
    """Keys of items, sorted: (key, item, offset in the item)."""

    def __init__(self, found: list[tuple[int, int, int]]):
        order = np.array(sorted(found), dtype=np.uint64).reshape(-1, 3)
        self.known, self.items, self.offsets = order[:, 0], order[:, 1].astype(np.int64), order[:, 2].astype(np.int64)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def places(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with a key among these, and the places where they would begin."""
        at = np.flatnonzero(self.near[(own >> np.uint64(44)).astype(np.int64)] & (own != 0))
        low = np.searchsorted(self.known, own[at], "left")
        many = np.searchsorted(self.known, own[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        pick = np.repeat(low, many) + within
        return self.items[pick], np.repeat(at, many) - self.offsets[pick]


class Items:
    """Items ready for searching; sent to each task."""

    def __init__(self, rows: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        hashes, counts = word_hashes([t.lower() for _, t in rows], LETTERS)
        ends = np.cumsum(counts)
        self.ids = [i for i, _ in rows]
        self.words = [hashes[e - c:e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        self.most = [int(settings.edits * len(w)) for w in self.words]
        self.tables = []
        gap = max(length for length, _ in settings.walks)
        for walk in range(len(settings.walks)):
            self.tables.append(Table([
                (k, i, o) for i, w in enumerate(self.words) if len(w) > SHORT
                for o, k in enumerate(keys(np.concatenate([w, np.zeros(gap, np.uint64)]), walk, settings)[:len(w)].tolist()) if k]))
        told: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) <= SHORT:
                for a, b in parts(len(w), self.most[i]):
                    told.setdefault(b - a, []).append((int(windows(w[a:b], b - a)[0]), i, a))
        self.parts = {length: Table(found) for length, found in told.items()}

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items longer than SHORT and the places in ``words`` where they would begin."""
        for walk, table in enumerate(self.tables):
            yield table.places(keys(words, walk, self.settings))

    def short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of up to SHORT words and the places where they would begin, each pair once.

        Where edits are allowed, a place needs as many of the item's words as must be left, around it.
        """
        sets = [table.places(windows(words, length)) for length, table in sorted(self.parts.items())]
        if not sets:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        item, place = (np.concatenate(x) for x in zip(*sets, strict=True))
        span = len(words) + 2 * SHORT
        item, place = np.divmod(np.unique(item * span + place + SHORT), span)
        place -= SHORT
        size, most = np.array([len(w) for w in self.words])[item], np.array(self.most)[item]
        keep = most == 0
        for m, k in {*zip(size[~keep].tolist(), most[~keep].tolist(), strict=True)}:
            own = np.flatnonzero((size == m) & (most == k))
            for begin in range(0, len(own), STEP_TRIES):
                some = own[begin:begin + STEP_TRIES]
                around = place[some, None] + np.arange(-k, m + k)
                there = np.where((around >= 0) & (around < len(words)), words[np.clip(around, 0, len(words) - 1)], np.uint64(0))
                wanted = np.stack([self.words[i] for i in item[some].tolist()])
                left = sum((there == wanted[:, j, None]).any(axis=1).astype(np.int64) for j in range(m))
                keep[some] = left >= m - k
        return item[keep], place[keep]

    def found(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item id, first word, word behind the last, distance), the best match at a place only."""
        gap = max(length for length, _ in self.settings.walks) + 1
        hashes, counts = word_hashes([t.lower() if t else t for t in texts], LETTERS)
        ends = np.cumsum(counts)
        spaced = np.zeros(len(hashes) + gap * (len(texts) + 1), np.uint64)
        spaced[np.arange(len(hashes)) + gap * np.repeat(np.arange(len(texts)), counts)] = hashes
        first = ends - counts + gap * np.arange(len(texts))
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for i, place in zip(*(x.tolist() for x in self.short(spaced)), strict=True):
            size, most = len(self.words[i]), self.most[i]
            # a passage begins up to ``most`` words from the place, and most is less than the gap
            d = max(0, int(np.searchsorted(first, place + most, "right")) - 1)
            low, high = max(place - most, int(first[d])), min(place + size + most, int(first[d] + counts[d]))
            hit = match(self.words[i], spaced[low:high], most) if most else (place - low, place - low + size, 0)
            if hit:
                out[d].append((self.ids[i], low - int(first[d]) + hit[0], low - int(first[d]) + hit[1], hit[2]))
        sets = [np.concatenate(x) for x in zip(*self.candidates(spaced), strict=True)]
        item, place = sets
        # one candidate for each item and place, give or take a few words
        tries = np.unique(np.stack([item, place // 3], axis=1), axis=0) if len(item) else np.empty((0, 2), np.int64)
        for i, third in tries.tolist():
            words = self.words[i]
            most = self.most[i]
            begin = 3 * third
            doc = int(np.searchsorted(first, max(begin, 0) + 2 + most, "right")) - 1
            doc = max(0, min(doc, len(texts) - 1))
            for d in {doc, max(0, doc - 1)}:
                low = max(begin - most, int(first[d]))
                high = min(begin + 3 + len(words) + most, int(first[d] + counts[d]))
                window = spaced[low:high]
                if high - low < len(words) - most or np.isin(words, window).sum() < len(words) - most:
                    continue
                hit = match(words, window, most)
                if hit:
                    a, b = low - int(first[d]) + hit[0], low - int(first[d]) + hit[1]
                    out[d].append((self.ids[i], a, b, hit[2]))
        return [_best(own) for own in out]


def _best(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of an item's overlapping matches the one with the fewest edits, then the first."""
    kept: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, a, b, distance in sorted(set(hits), key=lambda h: (h[3], h[1], h[2])):
        # kept matches don't overlap, so only the neighbours in order can
        own = kept.setdefault(i, [])
        at = bisect_left(own, (a, b))
        if (at == 0 or own[at - 1][1] <= a) and (at == len(own) or own[at][0] >= b):
            own.insert(at, (a, b, i, distance))
    return sorted(((i, a, b, distance) for own in kept.values() for a, b, i, distance in own), key=lambda h: (h[1], h[0] is None, h[0]))


def passages(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance for every passage of an item in a document.

    Words are runs of letters, digits and non-ASCII characters in lower case; whatever stands between them doesn't
    count.  Null and empty texts hold nothing; null, empty or wordless items match nothing; null ids are returned as null.
    Repeated rows are each searched and reported.  Other columns aren't read.  No rows on either side: an empty result.

    There is no least length: items of up to SHORT words are found without loss, longer ones at TARGET_RECALL or better.

    Items are the smaller side by nature.  They are read in blocks of bounded size, one pass over the documents for each,
    so nothing of unbounded size is sent to the tasks; texts aren't shuffled.
    """
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word int, end_word int, distance int"
    out = None
    for block in range(blocks):
        own = [(r.item_id, r.text) for r in rows.where(F.col("block") == block).orderBy("item_id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Items(own, settings))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
                hits = [h for part in steps(texts) for h in shared.value.found(texts[part])]
                flat = [(None if pd.isna(i) else int(i), *h) for i, own in zip(ids, hits, strict=True) for h in own]
                made = pd.DataFrame(flat, columns=["doc_id", "item_id", "first_word", "end_word", "distance"])
                yield made.astype({"doc_id": "Int64", "item_id": "Int64"})

        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings) -> DataFrame:
    """The rows of docs without a passage of an item, by id and text: rows that share an id are judged one by one.

    Null and empty texts hold nothing and stay; null ids are no matter.  Repeated rows stay or go together.  Columns of any
    name are kept.  No documents: an empty result; no items: all rows.
    """
    key = spare("row", docs.columns)
    keyed = docs.withColumn(key, row_key())
    held = passages(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, settings)
    return keyed.join(held.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
