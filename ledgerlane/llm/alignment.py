"""Alignment of two tokenisations of a text, and how firmly tokens of one belong to tokens of the other.

Both tokenisations cover the same bytes.  Places where a token of either ends are shared cuts.  They are found by dividing:
the end of a middle token of A is looked for among the ends of B by bisection, then that of its neighbours, and the interval
falls into two at the first that both have; intervals without a cut inside are groups.  All intervals of a level are
divided together.

Two tokens are linked where their bytes overlap.  How often a pair of ids is linked in the corpus must be known before a
document's links can be rated.  Documents are read once, in chunks of about ``chunk`` links; a chunk keeps its documents as
places in its own list of distinct pairs.  Only those lists are shuffled for the sums; a chunk then gets the sums of its own
list back, so nothing that is sent to a task grows with the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.words import steps
from ledgerlane.session import Scratch


@dataclass(frozen=True)
class Settings:
    """Files as executors see them: A as tokenizers' .json and the same as tiktoken's ranks, B as a sentencepiece model.

    The ranks are what encodes A, being faster; texts of ``long_text`` characters go to the .json form.  A chunk is closed
    at ``chunk`` links.
    """

    json: str
    ranks: str
    pattern: str
    model: str
    long_text: int = 200_000
    chunk: int = 4_000_000


def _table(entries: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    return entries, np.array([len(e) for e in entries], np.int64)


class Tokenizers:
    """Both encodings, and the bytes of each id."""

    def __init__(self, settings: Settings):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.long_text = settings.long_text
        with open(settings.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=settings.pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(settings.json)
        self.whole.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=settings.model)
        a = [b""] * self.whole.get_vocab_size()
        for entry, i in ranks.items():
            a[i] = entry
        self.a_bytes, self.a_size = _table(a)
        self.b_bytes, self.b_size = _table([self._piece(i) for i in range(self.pieces.get_piece_size())])
        #: Each id as it is written: of A before another of A, of A before B, of B before another of B, of B at a group's end.
        written = [(len(a), b","), (len(a), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")]
        self.written = [b"%d%s" % (i, mark) for n, mark in written for i in range(n)]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A (of a space and the text) and of B; both empty where they don't give the text's own bytes."""
        none = np.empty(0, np.int64)
        wanted = [t for t in texts if t]
        found = iter(self.pieces.encode(wanted, num_threads=1) if wanted else ())
        for text in texts:
            if not text:
                yield none, none
                continue
            b, spaced = next(found), " " + text
            if len(text) >= self.long_text:
                a = self.whole.encode(spaced, add_special_tokens=False).ids
            else:
                a = self.fast.encode_ordinary(spaced)
            own = spaced.encode("utf-8", "surrogatepass")
            if b"".join(map(self.b_bytes.__getitem__, b)) == own and b"".join(map(self.a_bytes.__getitem__, a)) == own:
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield none, none


@cache
def tokenizers(settings: Settings) -> Tokenizers:
    return Tokenizers(settings)


#: Neighbours of the middle that are tried for all intervals at once, before an interval is searched by itself.
NEAR = (0, 1, -1, 2, -2, 3, -3)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group in order: its last token of A and of B.

    ``a`` and ``b`` are the ends of all tokens, growing; ``a_from`` and ``b_from`` the first tokens of each interval to
    divide, and the number of tokens.  Intervals begin and end together in A and B and aren't empty.
    """
    lo, hi, low, high = a_from[:-1], a_from[1:], b_from[:-1], b_from[1:]
    done_a, done_b = [], []
    while len(lo):
        leaf = (hi - lo == 1) | (high - low == 1)
        done_a.append(hi[leaf] - 1)
        done_b.append(high[leaf] - 1)
        lo, hi, low, high = (x[~leaf] for x in (lo, hi, low, high))
        at, to = _cut_near_middle(a, b, lo, hi, low, high)
        cut = at >= 0
        done_a.append(hi[~cut] - 1)  # no cut inside
        done_b.append(high[~cut] - 1)
        lo, hi, low, high, at, to = (x[cut] for x in (lo, hi, low, high, at, to))
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at + 1, hi])
        low, high = np.concatenate([low, to + 1]), np.concatenate([to + 1, high])
    ends_a, ends_b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_a, done_b))
    return np.sort(ends_a), np.sort(ends_b)


def _cut_near_middle(a, b, lo, hi, low, high) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the tokens of A and B that end at a shared cut inside, near the middle; -1 where there is none."""
    at, to = np.full(len(lo), -1), np.full(len(lo), -1)
    open_ = np.arange(len(lo))
    middle = (lo + hi - 2) // 2
    for away in NEAR:
        tried = middle[open_] + away
        inside = (tried >= lo[open_]) & (tried < hi[open_] - 1)
        who, tried = open_[inside], tried[inside]
        place = np.searchsorted(b, a[tried])
        hit = b[place] == a[tried]
        at[who[hit]], to[who[hit]] = tried[hit], place[hit]
        open_ = open_[at[open_] < 0]
    small = hi - lo - 1 <= (len(NEAR) + 1) // 2  # all its ends have been tried
    for k in open_[~small[open_]].tolist():
        at[k], to[k] = _search_outward(a, b, int(lo[k]), int(hi[k]), int(middle[k]))
    return at, to


def _search_outward(a, b, lo: int, hi: int, middle: int) -> tuple[int, int]:
    """The shared end nearest the middle, looked for in windows of doubling width."""
    width = 8
    while True:
        first, last = max(lo, middle - width), min(hi - 1, middle + width + 1)
        place = np.searchsorted(b, a[first:last])
        hits = np.flatnonzero(b[place] == a[first:last])
        if len(hits):
            best = hits[np.argmin(np.abs(first + hits - middle))]
            return first + int(best), int(place[best])
        if first == lo and last == hi - 1:
            return -1, -1
        width *= 2


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of A and B of every overlap, in order of the bytes: one for each stretch between neighbouring ends."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")  # two sorted runs: a merge
    both, of_a = both[order], order < len(a)
    first = np.flatnonzero(np.diff(both, prepend=-1))
    return (np.cumsum(of_a) - of_a)[first], (np.cumsum(~of_a) - ~of_a)[first]


@dataclass
class Aligned:
    """Documents of a batch, each with its counts, the written groups, and its id pairs with how often they are linked."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pair_doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def aligned(texts: list[str | None], own: Tokenizers) -> Aligned:
    """All texts at once: tokens of the batch stand one behind the other, and every text with tokens is an interval."""
    encoded = list(own.encode(texts))
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([e[k] for e in encoded] or [np.empty(0, np.int64)]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(own.a_size[ids_a]), np.cumsum(own.b_size[ids_b])
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    some = n_a > 0
    last_a, last_b = shared_cuts(ends_a, ends_b, np.append(0, to_a[some]), np.append(0, to_b[some]))
    n_groups = np.diff(np.searchsorted(last_a, to_a), prepend=0)

    # ids as written, group by group: those of A, then those of B
    size_a, size_b = len(own.a_bytes), len(own.b_bytes)
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    code_a, code_b = ids_a.copy(), ids_b + 2 * size_a
    code_a[last_a] += size_a
    code_b[last_b] += size_b
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.repeat(last_b + 1 - in_b, in_a)] = code_a
    order[np.arange(len(ids_b)) + np.repeat(last_a + 1, in_b)] = code_b
    words = list(map(own.written.__getitem__, order.tolist()))
    bounds = np.append(0, to_a + to_b).tolist()
    groups = [b"".join(words[i:j])[:-1] for i, j in zip(bounds, bounds[1:], strict=False)]

    of_a, of_b = links(ends_a, ends_b)
    doc = np.repeat(np.arange(len(texts)), n_a)[of_a]
    n_links = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    # one number for document and pair, so that sorting brings equal ones together
    coded = np.sort((doc * size_a + ids_a[of_a]) * size_b + ids_b[of_b])
    first = np.flatnonzero(np.diff(coded, prepend=-1))
    pair = coded[first] % (size_a * size_b)
    return Aligned(
        n_a, n_b, n_groups, n_links, groups, coded[first] // (size_a * size_b), pair, np.diff(first, append=len(coded)))


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


CHUNKS = (
    "chunk long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, counts array<long>")
NAMES = [field.split()[0] for field in CHUNKS.split(", ")]


def chunks(docs: DataFrame, settings: Settings) -> DataFrame:
    """A row for each document, and for each chunk one with its pairs and their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizers(settings)
        part, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pd.DataFrame, Aligned]] = []

        def closed() -> Iterator[pd.DataFrame]:
            nonlocal made
            every = [x for _, x in held]
            pairs, place = np.unique(np.concatenate([x.pair for x in every]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([x.times for x in every]), len(pairs)).astype(np.int64)
            # frequent pairs first, so that places are small numbers
            rank = np.argsort(-counts, kind="stable")
            rank_of = np.empty_like(rank)
            rank_of[rank] = np.arange(len(rank))
            place, begin = rank_of[place], 0
            for frame, x in held:
                cuts = np.searchsorted(x.pair_doc, np.arange(len(frame) + 1))
                mine = place[begin:begin + len(x.pair)]
                begin += len(x.pair)
                yield frame.assign(
                    chunk=part + made,
                    places=[_packed(mine[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)],
                    times=[_packed(x.times[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)],
                    pairs=None, counts=None)[NAMES]
            listed = pd.DataFrame({"chunk": [part + made], "pairs": [pairs[rank]], "counts": [counts[rank]]})
            none = pd.array([None], "Int64")
            yield listed.assign(
                doc_id=None, n_a=none, n_b=none, n_groups=none, n_links=none, groups_sha256=None, places=None, times=None)[NAMES]
            made += 1
            held.clear()

        links_held = 0
        for batch in batches:
            texts = batch["text"].tolist()
            for part_of in steps(texts):
                x = aligned(texts[part_of], own)
                held.append((pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[part_of].to_numpy(), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups,
                    "n_links": x.n_links, "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups],
                }), x))
                x.groups = []
                links_held += len(x.pair)
                if links_held >= settings.chunk:
                    yield from closed()
                    links_held = 0
        if held:
            yield from closed()

    # ids go as text: beside nulls, pandas would make them floats
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, CHUNKS)


def pair_counts(cut: DataFrame, n_b: int) -> DataFrame:
    """pair, n (its links in the corpus) and best: whether no pair with the same id of B has more."""
    listed = cut.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("own"))
    summed = listed.groupBy(F.col("own.pairs").alias("pair")).agg(F.sum("own.counts").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % n_b))  # as many rows as ids of A at most
    return summed.select("pair", "n", (F.col("n") == most).alias("best"))


def alignment(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose id pair is the most frequent one of its id of B in all docs, ties included, and
    ``count_sum`` adds up the corpus-wide counts of the pairs of all links.  Null and empty texts, and texts whose tokens
    don't give back a space and the text, have no tokens: zeros, and '' for the groups.  Null and repeated ids and repeated
    rows are all returned, and repeated rows count each time.  Other columns are not read and may have any name.  A text is
    one value in memory; work on it grows little more than with its length.  No rows: an empty result.
    """
    cut = scratch.save(chunks(docs, settings), "chunks")
    counts = scratch.save(pair_counts(cut, tokenizers(settings).pieces.get_piece_size()), "pairs")
    asked = cut.where("pairs is not null").select("chunk", F.posexplode("pairs").alias("place", "pair"))
    # under another name: both sides come from one table
    answered = asked.join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    rated = cut.where("pairs is null").drop("pairs", "counts")

    def rate(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        place = known["place"].to_numpy(np.int64)
        n[place], best[place] = known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
        best_links, sums = [], []
        for places, times in zip(mine["places"], mine["times"], strict=True):
            at, often = _unpacked(places), _unpacked(times)
            best_links.append(int(often[best[at]].sum()))
            sums.append(int((n[at] * often).sum()))
        return mine.assign(n_best=best_links, count_sum=sums)[[field.split()[0] for field in out.split(", ")]]

    out = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
    done = rated.groupBy("chunk").cogroup(answered.groupBy("of")).applyInPandas(rate, out)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
