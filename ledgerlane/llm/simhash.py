"""Near-duplicates by SimHash, with distances counted over bit planes.

A fingerprint has a bit where more than half of the text's shingle hashes have it.  Fingerprints are compared in buckets
that agree on some of their bits: cut into r + 1 parts, two that differ in r bits at most agree on a part.  Of a bucket of
more than ``bucket`` members, the bits not yet agreed on are cut again in the same way, so every pair within the radius
stays together in some smaller bucket; as members differ from each other, that ends at the latest where few bits are left.

Within buckets the bits stand in vertical planes, one bit of 64 members in a word.  A plane against itself moved by d
members tells where members d apart differ in that bit.  Bitwise full adders add seven planes at a time to counters of
all pairs; a block is abandoned once all its counters exceed the radius.

Of the links of a bucket only those go on that connect members not connected before, so a family of copies gives as many
edges as it has members, whatever the number of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators.components import components
from ledgerlane.session import Scratch

BITS = 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingle hashes whose bits are spread out at a time.
STEP = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Shingles of so many words, links at ``radius`` differing bits or fewer, buckets of at most so many members."""

    words: int = 4
    seed: int = 42
    radius: int = 4
    bucket: int = 4096


def shingle_hashes(text: bytes, settings: Settings) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; of the whole sequence if there are fewer words."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(settings.words, len(parts))
    digest, seed = xxhash.xxh64_intdigest, settings.seed
    spans = zip(starts[:len(parts) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    held = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), STEP):
        own = hashes[part:part + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        held += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * held > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id and node: the fingerprint as a signed number."""

    @F.pandas_udf("long")
    def node(texts: pd.Series) -> pd.Series:
        own = [fingerprint(shingle_hashes(t, settings)) for t in texts]
        return pd.Series(np.array(own, np.uint64).view(np.int64))

    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node(whole).alias("node"))


# Bit planes

def planes(values: np.ndarray) -> np.ndarray:
    """Plane b has bit b of value i as bit i % 64 of its word i // 64; one word of zeros more at the end."""
    words = -(-len(values) // 64) + 1
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _add(a, b, c):
    """A full adder: sum and carry of three bits each."""
    half = a ^ b
    return half ^ c, (a & b) | (c & half)


def _wordwise(mask: np.ndarray) -> np.ndarray:
    """Flags as bits of words."""
    return np.packbits(np.pad(mask, (0, -len(mask) % 64)), bitorder="little").view("<u8")


def beyond(x: np.ndarray, radius: int, skip: np.ndarray) -> np.ndarray | None:
    """Where more than ``radius`` planes of x (a multiple of seven) are set or ``skip`` is; None if that is everywhere.

    The counter has as many bits as the radius; what goes past it is remembered in ``out``, which starts as ``skip``.
    """
    width = max(3, (radius + 1).bit_length())
    counter = [np.zeros_like(skip) for _ in range(width)]
    out = skip.copy()
    for k in range(0, len(x), 7):
        s1, k1 = _add(x[k], x[k + 1], x[k + 2])
        s2, k2 = _add(x[k + 3], x[k + 4], x[k + 5])
        s3, k3 = _add(s1, s2, x[k + 6])
        number = [s3, *_add(k1, k2, k3)]
        carry = np.zeros_like(skip)
        for bit in range(width):
            if bit < 3:
                counter[bit], carry = _add(counter[bit], number[bit], carry)
            else:
                counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry
        out |= carry
        over = _exceeds(counter, radius) | out
        if not (~over).any():
            return None
    return over


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the number in the counter is greater than the radius, from its highest bit down."""
    more = np.zeros_like(counter[0])
    equal = ~more
    for bit in range(len(counter) - 1, -1, -1):
        if radius >> bit & 1:
            equal = equal & counter[bit]
        else:
            more |= equal & counter[bit]
            equal = equal & ~counter[bit]
    return more


class Joined:
    """Which of n members are connected so far; ``root`` is the least of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def add(self, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that connect what wasn't connected before."""
        new = []
        open_ = self.root[u] != self.root[v]
        for a, b in zip(u[open_].tolist(), v[open_].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                new.append((a, b))
        if new:
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
        return new


def linked(values: np.ndarray, bucket: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of links within the radius that connect the members of each bucket; ``bucket`` counts from 0 in order."""
    size = np.bincount(bucket)
    first = np.cumsum(size) - size
    # largest bucket first, so members with another one d places on in their bucket are always the first ones
    order = np.argsort(-size, kind="stable")
    size = size[order]
    place = np.repeat(first[order] - (np.cumsum(size) - size), size) + np.arange(len(values))
    own = values[place]
    left = np.repeat(size, size) - (np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size))  # to its bucket's end
    joined, u, v = Joined(len(own)), [], []
    most = int(size[0]) if len(size) else 0
    plane = np.zeros((-(-BITS // 7) * 7, -(-len(own) // 64) + 1), np.uint64)
    plane[:BITS] = planes(own)
    members = np.cumsum(size)
    for turn in range(min(64, most)):
        if turn:
            moved = plane >> np.uint64(turn)
            moved[:, :-1] |= plane[:, 1:] << np.uint64(64 - turn)
        else:
            moved = plane
        for d in range(turn, most, 64):
            if not d:
                continue
            lanes = int(members[np.searchsorted(-size, -d, "left") - 1])  # of buckets of more than d members
            words = -(-lanes // 64)
            at = d // 64
            other = moved[:, at:at + words]
            alone = ~_wordwise(left[:words * 64] > d)
            words = min(words, other.shape[1], len(alone))
            over = beyond(plane[:, :words] ^ other[:, :words], settings.radius, alone[:words])
            if over is not None:
                hits = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
                for a, b in joined.add(hits, hits + d):
                    u.append(a)
                    v.append(b)
    return place[np.array(u, np.int64)], place[np.array(v, np.int64)]


# Buckets

def parts(bits: int, settings: Settings) -> list[list[int]]:
    """The bits that are set in a mask, in radius + 1 runs of about equal length."""
    held = [b for b in range(BITS) if bits >> b & 1]
    n = settings.radius + 1
    ends = [len(held) * k // n for k in range(n + 1)]
    return [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def refined(rows: DataFrame, settings: Settings) -> DataFrame:
    """(node, agreed) of each way to agree on one more part of the bits that aren't agreed on yet.

    ``agreed`` is a mask; a bucket is a mask with the node's bits under it.
    """
    every = (1 << BITS) - 1
    ways = {}
    for row in rows.select("agreed").distinct().collect():  # (radius + 1) ** level masks at most, whatever the rows
        mask = row.agreed & every
        ways[row.agreed] = [_signed(mask | sum(1 << b for b in part)) for part in parts(~mask & every, settings) if part]
    if not ways:
        return rows
    more = F.create_map(*[x for mask, w in ways.items() for x in (F.lit(mask), F.array(*map(F.lit, w)))])
    made = rows.select("node", F.explode(more[F.col("agreed")]).alias("agreed"))
    masks = [mask for w in ways.values() for mask in w]
    return made if len(set(masks)) == len(masks) else made.distinct()


def _compared(settings: Settings):
    """Links of sorted rows, bucket by bucket; a bucket may go on in the next batch."""

    def links(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
        values = rows["node"].to_numpy(np.int64).view(np.uint64)
        u, v = linked(values, np.cumsum(begins) - 1, settings)
        return pd.DataFrame({"u": values[u].view(np.int64), "v": values[v].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest.empty:
                continue
            agreed, key = rest["agreed"].to_numpy(), rest["key"].to_numpy()
            begins = np.ones(len(rest), bool)
            begins[1:] = (agreed[1:] != agreed[:-1]) | (key[1:] != key[:-1])
            last = int(np.flatnonzero(begins)[-1])
            if last:
                yield links(rest.iloc[:last], begins[:last])
            rest = rest.iloc[last:]
        if rest is not None and len(rest):
            yield links(rest, np.arange(len(rest)) == 0)

    return run


def edges(nodes: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """(u, v): links that connect every two nodes within the radius, directly or over others."""
    rows = nodes.select("node", F.lit(0).cast("long").alias("agreed"))
    # one agreed part makes about 2 ** 12 buckets; where that leaves more in them than fit, cut twice from the start
    full = math.log2(max(2, nodes.count()) / settings.bucket)
    for _ in range(max(0, math.ceil(full / 12) - 1)):
        rows = refined(rows, settings)
    level, found = 0, []
    while level == 0 or not rows.isEmpty():
        rows = refined(rows, settings).withColumn("key", F.col("node").bitwiseAND(F.col("agreed")))
        rows = scratch.save(rows, f"buckets-{level}")
        sizes = rows.groupBy("agreed", "key").agg(F.count("*").alias("members"))
        large = scratch.save(sizes.where(F.col("members") > settings.bucket).select("agreed", "key"), f"large-{level}")
        fit = rows.join(large, ["agreed", "key"], "left_anti").select("agreed", "key", "node")
        fit = fit.repartition("agreed", "key").sortWithinPartitions("agreed", "key", "node")
        found.append(scratch.save(fit.mapInPandas(_compared(settings), "u long, v long"), f"links-{level}"))
        rows = rows.join(large, ["agreed", "key"], "left_semi").select("node", "agreed")
        level += 1
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs(doc_id, text, ...).

    ``component_id`` is the smallest doc_id that links reach.  Null and empty texts and texts without words have
    fingerprint zero and are linked like any other.  Rows with a null doc_id are returned with the component of their
    fingerprint, null where it has no doc_id.  Repeated rows are all returned.  Other columns are not read and may have
    any name.  A text is one value in memory; work on it is linear in its length.  No rows: an empty result.
    """
    rows = scratch.save(fingerprints(docs, settings), "rows")
    nodes = scratch.save(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    joined = components(edges(nodes.select("node"), settings, scratch), scratch, "components")
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = scratch.save(placed.join(lead, "component").select("node", "component_id"), "classes")
    return rows.join(classes, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
