"""Vector best-fit packing of token sequences.

A piece asks for tokens, for one place and for attention (its length squared).  Pieces go, longest first, into the open
sequence that has all of that left and then scores best: by the weighted norm of what remains, or by the weighted dot
product of what is left and what is asked for.

Documents are cut into pieces where Spark reads them.  Full pieces are sequences of their own.  The others are dealt into
groups of about ``group_rows``, so a task holds that many lengths at most, at any size of the input; only numbers are
shuffled, no texts or ids.  A group can waste at most the room of its last sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.session import Scratch

END = "<|endoftext|>"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, the weights of tokens, places and attention, and the rule: "norm" or "dot"."""

    tokens: int = 2048
    places: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "norm"
    group_rows: int = 8192

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.places, self.attention], np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """The same vocabulary in two forms, as files that the executors see: tokenizers' .json and tiktoken's ranks.

    The ranks are what encodes, being four times as fast; a text that they can't take goes to the .json form.
    """

    json: str
    ranks: str
    pattern: str


@cache
def _encoders(vocabulary: Vocabulary):
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = Tokenizer.from_file(vocabulary.json)
    fast = tiktoken.Encoding(
        "ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={END: whole.token_to_id(END)})
    return fast, whole


#: Characters from which a text goes to the .json form: the other's matching is recursive.
LONG_RUN = 200_000


def token_ids(text: str | None, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of the text, without begin and end; empty for null.  The end token's own string gives its id."""
    fast, whole = _encoders(vocabulary)
    if not text:
        return np.empty(0, np.uint32)
    if len(text) >= LONG_RUN:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)


def pieces(docs: DataFrame, vocabulary: Vocabulary, most: int, with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    A document is its ids and then id 0, so an empty or null text is one token.  Only longer ones are cut; the first
    piece takes what is over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.append(token_ids(text, vocabulary), np.uint32(0)).astype("<u4")
                starts = [0, *range(len(ids) % most or most, len(ids), most)] if len(ids) > most else [0]
                for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    own = ids[start:end]
                    row = (None if pd.isna(doc_id) else int(doc_id), k, start, end - start, zlib.crc32(own.tobytes()))
                    out.append((*row, own.astype(np.int64)) if with_ids else row)
            made = pd.DataFrame(out, columns=[*names, *["ids"] * with_ids])
            yield made.astype({"doc_id": "Int64"})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def best_fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece.  A piece that no empty sequence can hold gets one of its own."""
    capacity, weights = limits.capacity, np.array(limits.weights)
    scale = (weights / capacity.astype(float) ** 2)[:, None]
    asked = np.stack([lengths, np.ones_like(lengths), lengths * lengths])
    least = asked.min(axis=1, initial=np.iinfo(np.int64).max)[:, None] if len(lengths) else None
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, number, filled = np.empty((3, 64), np.int64), np.empty(64, np.int64), np.empty(64, np.int64)
    open_, made = 0, 0
    for step, i in enumerate(np.argsort(-lengths, kind="stable").tolist()):
        if step % 128 == 127:  # what can hold no piece any more is closed
            keep = np.flatnonzero((left[:, :open_] >= least).all(axis=0))
            left[:, :len(keep)], number[:len(keep)], filled[:len(keep)] = left[:, keep], number[keep], filled[keep]
            open_ = len(keep)
        ask = asked[:, i:i + 1]
        room = left[:, :open_] - ask
        can = np.flatnonzero((room >= 0).all(axis=0))
        if len(can):
            if limits.rule == "dot":
                at = can[np.argmax((scale * (left[:, can] * ask)).sum(axis=0))]
            else:
                at = can[np.argmin((scale * room[:, can].astype(float) ** 2).sum(axis=0))]
        else:
            if open_ == left.shape[1]:
                left, number, filled = (np.concatenate([x, np.empty_like(x)], axis=-1) for x in (left, number, filled))
            at, open_, made = open_, open_ + 1, made + 1
            left[:, at], number[at], filled[at] = capacity, made - 1, 0
        left[:, at] -= ask[:, 0]
        sequence[i], offset[i] = number[at], filled[at]
        filled[at] += lengths[i]
    return sequence, offset


def packed(docs: DataFrame, vocabulary: Vocabulary, limits: Limits, scratch: Scratch) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs(doc_id, text, ...) is packed, those with null or repeated ids and equal texts too; other columns
    are not read.  Equal lengths are taken in order of id and piece.  No rows: an empty result.
    """
    cut = scratch.save(pieces(docs, vocabulary, limits.tokens), "pieces")
    # a row's place in the written table decides its group, so that no id is hot
    numbered = cut.withColumn("row", F.monotonically_increasing_id())
    open_ = numbered.where(F.col("length") < limits.tokens)
    groups = max(1, -(-open_.count() // limits.group_rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "row"], kind="stable")
        sequence, offset = best_fit(group["length"].to_numpy(np.int64), limits)
        group["sequence_id"], group["offset"] = sequence + (group["group"].to_numpy(np.int64) << 32), offset
        return group[names]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    shared = open_.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInPandas(
        pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = numbered.where(F.col("length") >= limits.tokens).select(
        *names[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(full)
