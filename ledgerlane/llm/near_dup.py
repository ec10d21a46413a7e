"""Near-duplicates by circulant MinHash.

Two permutations make the whole signature: one scatters the shingles of a text over a circle, the other orders the
circle, and coordinate k reads that order shifted by k.  Coordinates are cut into bands; texts that share a band meet in a
bucket; links are confirmed on full shingle sets.

Work per bucket is kept linear without losing links:

1. Texts with the same set are one node from the start.
2. Every node of a bucket is compared with the bucket's hub, the node that meets most others over all its bands.
   In a family of copies that is the original or what is closest to it.
3. What is connected by these links needs no more comparing.  Of the other pairs of a bucket, those are compared
   that can be links: in small buckets by their sizes, in buckets of more than ``crowd`` nodes by how their sets
   differ from the hub's, which in a family of copies is little.  Both rules only leave out pairs that are no links.
4. Components of all confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.tables import row_key
from ledgerlane.llm.words import mix, odd_weights, shingle_sets
from ledgerlane.operators.components import components
from ledgerlane.session import Scratch

#: Places on the circle; far more than a text has shingles.
CIRCLE = 1 << 20
#: Parts into which the nodes of a hub are dealt where they are joined with its set.
SALTS = 32
#: About so many differences from a hub are counted by one task.
COUNTED = 16_384
#: Differences that one numpy step deals, unless a single node has more.
STEP = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Shingles of so many words; links at ``percent`` of Jaccard similarity or more; bands of rows.

    With similarity s a link is met in some band but for (1 - s**rows)**bands: 4e-7 at 0.85 with 25 bands of 5 rows,
    8e-8 at 0.8 with 31 bands of 4.
    """

    words: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 5
    crowd: int = 32


AT_80 = Settings(percent=80, bands=31, rows=4)


@cache
def _order(coordinates: int) -> np.ndarray:
    """The order of the circle's places, continued past its end by as many places as there are coordinates."""
    order = np.argsort(mix(np.arange(CIRCLE, dtype=np.uint64) + np.uint64(77)), kind="stable").astype(np.uint32)
    return np.concatenate([order, order[:coordinates]])


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least rank on the circle turned by k.  The shingles' own hash is the first permutation."""
    turns = np.lib.stride_tricks.sliding_window_view(_order(coordinates), coordinates)
    places = (mix(shingles) >> np.uint64(44)).astype(np.int64)
    least = np.full(coordinates, CIRCLE, np.uint32)
    for part in range(0, len(places), 4096):
        np.minimum(least, turns[places[part:part + 4096]].min(axis=0), out=least)
    return least


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit hash of the set."""
    return int(mix(np.array([mix(shingles ^ np.uint64(5)).sum() + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def band_keys(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    table = signature(shingles, settings.bands * settings.rows).reshape(settings.bands, settings.rows)
    mixed = (mix(table.astype(np.uint64) + np.uint64(1)) * odd_weights(settings.rows, 9)).sum(axis=1, dtype=np.uint64)
    return mix(mixed + odd_weights(settings.bands, 10)).view(np.int64)


def described(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, and for texts with words the node (hash of the set) and its bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), settings.words)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "row": batch["row"],
                "n_shingles": [len(s) for s in sets],
                "node": pd.array([set_key(s) if len(s) else None for s in sets], dtype="Int64"),
                "bands": [band_keys(s, settings) if len(s) else None for s in sets],
            })

    schema = "doc_id long, row long, n_shingles long, node long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").mapInPandas(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, set) of the wanted (node, doc_id): the texts are read again, so that no sets of others are stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), settings.words)
            right = [bool(len(s)) and set_key(s) == n for s, n in zip(sets, batch["node"].tolist(), strict=True)]
            own = [s.view(np.int64) for s, ok in zip(sets, right, strict=True) if ok]
            yield pd.DataFrame({"node": batch["node"][right].to_numpy(), "set": pd.Series(own, dtype=object)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(wanted, "doc_id").select("node", "text").mapInPandas(run, "node long, set array<long>")
    return found.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    either = F.size("set_u") + F.size("set_v") - F.col("both")
    return (
        pairs.join(a, "u").join(b, "v")
        .select("u", "v", both.alias("both"), "set_u", "set_v")
        .where(100 * F.col("both") >= settings.percent * either).select("u", "v")
    )


def _size_class(n):
    """Sizes within about 2 % of each other."""
    return F.floor(F.log(n.cast("double")) * 50).cast("int")


def _few(entries: DataFrame, percent: int) -> DataFrame:
    """The pairs of small buckets that their sizes allow, by classes of size."""
    p = percent
    seekers = entries.where("label != main").select(
        "key", F.col("node").alias("u"), F.col("label").alias("label_u"), F.col("size").alias("size_u"),
        F.explode(F.sequence(
            _size_class(F.ceil(F.col("size") * p / 100)), _size_class(F.floor(F.col("size") * 100 / p)))).alias("class"),
    )
    sought = entries.select(
        "key", F.col("node").alias("v"), F.col("label").alias("label_v"), F.col("size").alias("size_v"), "main",
        _size_class(F.col("size")).alias("class"),
    )
    fits = 100 * F.least("size_u", "size_v") >= p * F.greatest("size_u", "size_v")
    other = (F.col("label_u") != F.col("label_v")) & ((F.col("label_v") == F.col("main")) | (F.col("u") < F.col("v")))
    return seekers.join(sought, ["key", "class"]).where(fits & other).select("u", "v")


def _ranked(apart: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, node, found): the differences that some seeker has and nodes of two components, by rising number of seekers.

    ``found`` is an array of (often, part).  A hub's differences are dealt by hash, about ``COUNTED`` to a task, and stay in
    arrays by node: most differences in a family of copies are one node's own, and need no row to find that out.
    """
    shares = scratch.save(apart.groupBy("hub").agg(F.ceil(F.sum("n") / COUNTED).alias("shares")), "shares")
    every = apart.where("n > 0").join(shares, "hub").select("hub", "node", "label", "seeks", "shares", "parts")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby(batch["parts"].map(len).cumsum() // STEP):
                row = np.repeat(np.arange(len(some)), some["parts"].map(len).to_numpy(np.int64))
                parts = np.concatenate(some["parts"].tolist())
                share = (mix(parts.view(np.uint64)) % some["shares"].to_numpy(np.uint64)[row]).astype(np.int64)
                order = np.lexsort((share, row))
                row, share, parts = row[order], share[order], parts[order]
                starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0))
                out = some[["hub", "node", "label", "seeks"]].iloc[row[starts]].reset_index(drop=True)
                yield out.assign(share=share[starts], parts=pd.Series(np.split(parts, starts[1:]), dtype=object))

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        row = np.repeat(np.arange(len(group)), group["parts"].map(len).to_numpy(np.int64))
        values, of = np.unique(np.concatenate(group["parts"].tolist()), return_inverse=True)
        often = np.bincount(of, group["seeks"].to_numpy(np.float64)[row]).astype(np.int64)
        label = group["label"].to_numpy(np.int64)[row]
        least, most = label[np.unique(of, return_index=True)[1]], np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(least, of, label)
        np.maximum.at(most, of, label)
        useful = ((often > 0) & (least != most))[of]
        row, of = row[useful], of[useful]
        starts = np.flatnonzero(np.diff(row, prepend=-1) != 0)
        cut = lambda x: pd.Series(np.split(x, starts[1:]) if len(starts) else [], dtype=object)
        out = group[["hub", "node"]].iloc[row[starts]].reset_index(drop=True)
        return out.assign(often=cut(often[of]), part=cut(values[of]))

    fields = "hub long, node long, label long, seeks boolean, share long, parts array<long>"
    found = every.mapInPandas(dealt, fields).groupBy("hub", "share").applyInPandas(
        counted, "hub long, node long, often array<long>, part array<long>")
    return found.groupBy("hub", "node").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("often", "part")))).alias("found"))


def _many(entries: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs of crowded buckets that can still be links, by how their sets differ from one common set, the hub's.

    The hub is here the node that meets most others in the bucket's main component, so that a family of copies has one.
    With d of the hub's h shingles missing and u others instead, a node weighs w = (100 d + p u) / (100 + p); it is linked
    with the hub if w <= h (100 - p) / (100 + p), and two nodes only if their differences share w + w' - h (100 - p) / (100 + p)
    shingles or more.  Nodes of other components that are linked with the hub go with it.  The others seek among all nodes:
    only pairs that share an early one of their differences, with enough others behind it, need comparing.  Two nodes of the
    main component, or two linked with the hub, are connected already.
    """
    p = percent
    own = sets.select("node", F.col("set").alias("own"))
    entries = entries.select("node", "hub", "label", "main", "size").distinct().withColumn(
        "salt", F.pmod("node", F.lit(SALTS)))
    # a hub's set is copied for each salt, so that a large family isn't one task
    hubs = sets.join(entries.select(F.col("hub").alias("node")).distinct(), "node").select(
        F.col("node").alias("hub"), F.col("set").alias("common"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    apart = (
        entries.join(own, "node").join(hubs, ["hub", "salt"])
        .select("node", "hub", "label", "main", "size", F.size("common").alias("h"),
                F.array_except("common", "own").alias("missing"), F.array_except("own", "common").alias("instead"))
        .withColumn("w", 100 * F.size("missing") + p * F.size("instead"))  # weights times 100 + p, in whole numbers
        .withColumn("over", F.col("w") - F.col("h") * (100 - p))
        .withColumn("n", F.size("missing") + F.size("instead"))
        .withColumn("seeks", (F.col("over") > 0) & (F.col("label") != F.col("main")))
        .withColumn("seek_reach", F.when(F.col("seeks"), F.col("n") + 1 - F.ceil(F.col("over") / (100 + p))).otherwise(0))
        .withColumn("reach", F.col("n") - F.floor(F.col("w") / (100 + p)))
        .withColumn("parts", F.concat("instead", "missing"))
        .drop("missing", "instead")
    )
    # written, since all that follows reads it: one plan for all of this costs the driver much memory
    apart = scratch.save(apart, "differences")
    with_hub = apart.where((F.col("over") <= 0) & (F.col("label") != F.col("main"))).select(
        F.col("node").alias("u"), F.col("hub").alias("v"))

    # One order of differences for all nodes of a hub: those that lead to no pair first, which are left out, then by how many
    # seekers have them, then by their hash.
    ranked = scratch.save(_ranked(apart, scratch), "ranked").join(apart.drop("parts"), ["hub", "node"])

    def placed(rows: DataFrame, reach: str) -> DataFrame:
        """Of the first ``reach`` differences of each node those that may lead to a pair, with their places."""
        numbered = F.transform("found", lambda x, at: F.struct(
            x["part"].alias("part"), (F.col("n") - F.size("found") + at + 1).alias("place")))
        return rows.select("hub", "node", "label", "size", "h", "w", "n", F.inline(
            F.filter(numbered, lambda x: x["place"] <= F.col(reach))))

    seekers = scratch.save(placed(ranked.where("seek_reach > 0"), "seek_reach"), "seekers")
    sought = scratch.save(placed(ranked, "reach"), "sought")
    side = lambda rows, name: rows.select(
        "hub", "part", F.col("node").alias(name), "h", *(F.col(c).alias(f"{c}_{name}") for c in ("label", "size", "w", "n", "place"))
    )
    found = side(seekers, "u").join(side(sought, "v").drop("h"), ["hub", "part"])
    fits = 100 * F.least("size_u", "size_v") >= p * F.greatest("size_u", "size_v")
    # the first difference that a pair shares leaves so many at most that it can share
    rest = 1 + F.least(F.col("n_u") - F.col("place_u"), F.col("n_v") - F.col("place_v"))
    enough = (100 + p) * rest >= F.col("w_u") + F.col("w_v") - F.col("h") * (100 - p)
    found = found.where((F.col("label_u") != F.col("label_v")) & fits & enough)
    return found.select("u", "v").unionByName(with_hub)


def _open_pairs(
    met: DataFrame, fame: DataFrame, labels: DataFrame, sets: DataFrame, settings: Settings, scratch: Scratch,
) -> DataFrame:
    """The pairs of each bucket that are not yet connected and that can be links; each step is a written table."""
    known = labels.select("node", F.col("component").alias("label"))
    entries = met.select("key", "node", "size").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shares = entries.groupBy("key", "label").agg(F.count("*").alias("n"))
    buckets = shares.groupBy("key").agg(
        F.max(F.struct("n", F.col("label").alias("main"))).alias("most"), F.sum("n").alias("members"),
        F.count("*").alias("labels"),
    ).where("labels > 1").select("key", "most.main", "members")
    leads = fame.join(labels, "node").groupBy(F.col("component").alias("main")).agg(
        F.max(F.struct("fame", F.col("node").alias("hub"))).alias("most")).select("main", "most.hub")
    # hubs join the buckets, of which a large family has far fewer than entries
    buckets = buckets.join(leads, "main", "left").withColumn("hub", F.coalesce("hub", "main"))
    entries = scratch.save(entries.join(buckets, "key"), "open")
    few = _few(entries.where(F.col("members") <= settings.crowd), settings.percent)
    many = _many(entries.where(F.col("members") > settings.crowd), sets, settings.percent, scratch)
    either = few.unionByName(many)
    return scratch.save(
        either.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "open-pairs")


def near_duplicates(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """doc_id, row, n_shingles, links, component_id and kept for every row of docs(doc_id, text, ...).

    ``row`` is ``row_key()``, which tells apart rows that share an id.
    ``links`` counts the confirmed links of the row's set with other sets that were needed to connect its component;
    copies with an equal set count as one.  Only doc_id and text are read, so other columns may have any name.
    Null and empty texts have no shingles and stand alone.  Rows with a null doc_id stand alone with a null component_id
    and are kept.  Repeated rows are all returned, with the same component.  No rows: an empty result.
    """
    rows = scratch.save(described(docs, settings), "rows")
    worded = rows.where("node is not null and doc_id is not null")
    nodes = scratch.save(worded.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"),
    ), "nodes")

    entries = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    meetings = scratch.save(entries.join(shared, "key"), "meetings")
    fame = scratch.save(meetings.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    hubs = meetings.join(fame, "node").groupBy("key").agg(
        F.max(F.struct("fame", F.col("node").alias("hub"), F.col("size").alias("hub_size"))).alias("top"))
    met = scratch.save(meetings.join(hubs.select("key", "top.hub", "top.hub_size"), "key"), "met")
    p = settings.percent
    first = (
        met.where("node != hub")
        .where(100 * F.least("size", "hub_size") >= p * F.greatest("size", "hub_size"))
        .select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    )
    wanted = nodes.join(met.select("node").distinct(), "node").select("node", "doc_id")
    sets = scratch.save(_sets(docs, wanted, settings), "sets")
    links = scratch.save(_confirmed(first, sets, settings), "links")
    labels = scratch.save(components(links, scratch, "first"), "labels")
    more = scratch.save(
        _confirmed(_open_pairs(met, fame, labels, sets, settings, scratch), sets, settings), "more")
    stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = components(stars.unionByName(more), scratch, "all")

    every = links.unionByName(more)
    degree = every.unionByName(every.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = degree.distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("links"))
    placed = nodes.select("node", "doc_id").join(joined, "node", "left").join(degree, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lead = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(lead, "component").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    # Rows without words stand alone; they are dealt by their id, not by the one null.
    out = rows.where("node is not null and doc_id is not null").drop("bands").join(placed, "node")
    alone = rows.where("node is null or doc_id is null").select(
        "doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).alias("links"))
    out = out.select("doc_id", "row", "n_shingles", "component_id", "links").unionByName(alone)
    return out.select(
        "doc_id", "row", "n_shingles", "component_id", "links",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def expected_miss(similarity: float, settings: Settings) -> float:
    """The chance that no band of two texts of that similarity is equal."""
    return math.pow(1 - similarity ** settings.rows, settings.bands)
