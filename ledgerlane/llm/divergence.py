"""How far the word use of sources lies apart, over run-length columns.

The kept terms of a language are put into an order in which terms with the same counts stand together: by the first source
that has them, its count, the next source that has them, and so on.  That order is cut into blocks.  In a block, each
source's counts are a column of runs.  Two sources are compared by cutting the block where a run of either begins, so
the difference of their shares is worked out once for each common run and multiplied by its length.

A share is p = 1 + floor(scale * (count + extra) / (N + extra * V)), N the group's occurrences of kept terms and V the number
of kept terms of its language.  All arithmetic is in whole numbers.

Only tables of a term and source, of a block and source, or of a pair are ever shuffled.  A block holds ``block`` terms at
most, a cell of the comparison ``2 * tile`` columns of it, whatever the size of the corpus.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.session import Scratch

#: Each byte of UTF-8 as it counts in a term: A-Z as a-z, other ASCII but a-z as a space.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Terms in ``least_docs`` documents of a language count; ``top`` terms a group; sizes of blocks, tiles, counters."""

    least_docs: int = 30
    scale: int = 1_000_000_000
    extra: int = 5
    top: int = 50
    block: int = 8192
    tile: int = 48
    held: int = 400_000


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, in order."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); and a row without term for each group.

    A task adds up before it shuffles, and hands on what it has whenever it holds more than ``held`` terms.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def held() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, in_docs) in found.items():
                yield pd.DataFrame({
                    "lang": lang, "source": source,
                    "term": [None, *(t.decode("utf-8", "surrogatepass") for t in n)],
                    "n": [0, *n.values()], "docs": [0, *(in_docs[t] for t in n)],
                })
            found.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                n, in_docs = found[lang, source]
                words = terms(text)
                n.update(words)
                in_docs.update(set(words))
                if len(n) > settings.held:
                    yield from held()
            if sum(len(n) for n, _ in found.values()) > settings.held:
                yield from held()
        yield from held()

    whole = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*whole, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = texts.mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, settings: Settings):
    """p of a count, in decimals wide enough for any count that is a long."""
    big = lambda x: f"cast({x} as decimal(20, 0))"
    return F.expr(
        f"1 + (cast({settings.scale} as decimal(18, 0)) * {big(f'{n} + {settings.extra}')}) "
        f"div {big(f'{total} + {settings.extra} * v')}")


def kept_terms(counts: DataFrame, settings: Settings) -> DataFrame:
    """lang, term, n, and held: the sources that have the term with their counts, by name of source."""
    return counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"),
    ).where(F.col("docs") >= settings.least_docs).drop("docs")


def groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), lang_total (N of the language), v (kept terms of the language)."""
    totals = kept.select("lang", F.explode("held").alias("own")).groupBy("lang", F.col("own.source").alias("source")).agg(
        F.sum("own.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(
        langs, "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("v"))


def ordered_terms(kept: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The kept terms with block and place in it.  Written, so that places stay as they are.

    Each task of the sort numbers its own terms, and blocks are cut there, so no task sees a whole language.
    """
    order = ["lang", "held", "term"]
    # more parts than one a task: a block can't be longer than the part that it lies in
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = scratch.save(placed.withColumn("at", F.monotonically_increasing_id()), "order")
    return numbered.select(
        "lang", "held", F.floor(F.col("at") / settings.block).cast("long").alias("block"),
        F.pmod("at", F.lit(settings.block)).cast("int").alias("place"))


def columns(placed: DataFrame, group: DataFrame) -> DataFrame:
    """A row for each source and block of its language: size, total, v, and the runs as starts and counts.

    A block of a language begins at the first of its places and is ``size`` places long.  Languages without kept terms have
    one empty block, so that their sources meet as well.
    """

    @F.pandas_udf("starts array<int>, counts array<long>")
    def runs(first: pd.Series, size: pd.Series, own: pd.Series) -> pd.DataFrame:
        starts, counts = [], []
        for begin, length, cells in zip(first, size, own, strict=True):
            column = np.zeros(int(length), np.int64)
            for cell in cells if cells is not None else ():
                column[cell["place"] - int(begin)] = cell["n"]
            edge = np.flatnonzero(np.diff(column, prepend=column[:1] - 1)) if len(column) else np.empty(0, np.int64)
            starts.append(edge.astype(np.int32))
            counts.append(column[edge])
        return pd.DataFrame({"starts": starts, "counts": counts})

    blocks = placed.groupBy("lang", "block").agg(F.min("place").alias("first"), F.count("*").cast("int").alias("size"))
    bare = group.where("v = 0").select(
        "lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("first"), F.lit(0).alias("size")).distinct()
    cells = placed.select("lang", "block", "place", F.explode("held").alias("own")).groupBy(
        "lang", "block", F.col("own.source").alias("source")).agg(
        F.collect_list(F.struct("place", F.col("own.n").alias("n"))).alias("own"))
    wide = group.select("lang", "source", "total", "v").join(blocks.unionByName(bare), "lang")
    filled = wide.join(cells, ["lang", "block", "source"], "left")
    return filled.select("lang", "block", "source", "size", "total", "v", runs("first", "size", "own").alias("runs")).select(
        "lang", "block", "source", "size", "total", "v", "runs.*")


def _shares(column, settings: Settings) -> np.ndarray:
    """p of each run; Python's own numbers where 64 bits could be too few."""
    below = int(column.total) + settings.extra * int(column.v)
    counts = np.asarray(column.counts, np.int64)
    if len(counts) and settings.scale * (int(counts.max()) + settings.extra) >= 1 << 63:
        return np.array([1 + settings.scale * (int(c) + settings.extra) // below for c in counts], np.int64)
    return 1 + settings.scale * (counts + settings.extra) // max(below, 1)


def apart(starts_a: np.ndarray, shares_a: np.ndarray, starts_b: np.ndarray, shares_b: np.ndarray, size: int) -> int:
    """The sum of |p - q| over a block, run by common run."""
    cuts = np.union1d(starts_a, starts_b)
    a = shares_a[np.searchsorted(starts_a, cuts, "right") - 1]
    b = shares_b[np.searchsorted(starts_b, cuts, "right") - 1]
    return int((np.abs(a - b) * np.diff(cuts, append=size)).sum())


def pairs(column: DataFrame, group: DataFrame, settings: Settings) -> DataFrame:
    """lang, source, item (the other source), value: both ways.

    Sources are dealt into tiles of about ``tile``; each pair of tiles of a block is a cell of its own.
    """
    tiles = group.groupBy("lang").agg(F.ceil(F.count("*") / settings.tile).alias("tiles"))
    dealt = column.join(tiles, "lang").withColumn("mine", F.pmod(F.xxhash64("source"), F.col("tiles")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({
        "low": F.least("mine", "other"), "high": F.greatest("mine", "other")})

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("source", kind="stable")
        shares = [_shares(c, settings) for c in cell.itertuples()]
        starts = [np.asarray(s, np.int64) for s in cell["starts"]]
        names, mine, size = cell["source"].tolist(), cell["mine"].tolist(), int(cell["size"].iloc[0])
        same = cell["low"].iloc[0] == cell["high"].iloc[0]
        out = [
            (names[i], names[j], apart(starts[i], shares[i], starts[j], shares[j], size) if size else 0)
            for i in range(len(names)) for j in range(i) if same or mine[i] != mine[j]
        ]
        made = pd.DataFrame(out, columns=["a", "b", "value"])
        made.insert(0, "lang", cell["lang"].iloc[0])
        return made

    parts = met.groupBy("lang", "block", "low", "high").applyInPandas(compare, "lang string, a string, b string, value long")
    one_way = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    return one_way.select("lang", both, "value").select("lang", "way.source", "way.item", "value")


def leading_terms(kept: DataFrame, group: DataFrame, settings: Settings) -> DataFrame:
    """lang, source, item (a term that the group uses more than its language does), value."""
    own = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("own")).select(
        "lang", F.col("own.source").alias("source"), F.col("term").alias("item"), "lang_n", F.col("own.n").alias("n"))
    value = _share("n", "total", settings) - _share("lang_n", "lang_total", settings)
    return own.join(group, ["lang", "source"]).select("lang", "source", "item", value.alias("value")).where("value > 0")


def divergence(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that docs(text, lang, source, ...) holds.

    Part ``pair``: every other source of the language, with the sum of |p - q| over the kept terms; part ``term``: the
    ``top`` terms that the group uses more than its language.  Rank 1 has the greatest value; ties go by the item's bytes.
    Null text, lang and source count as empty, repeated rows each time they occur; a group without terms has all counts 0;
    a language without kept terms gives pairs of value 0 and no terms.  Other columns are not read, and may have any name.
    No rows: an empty result.
    """
    counts = scratch.save(term_counts(docs, settings), "counts")
    kept = scratch.save(kept_terms(counts, settings), "kept")
    group = scratch.save(groups(counts, kept), "groups")
    placed = ordered_terms(kept, settings, scratch)
    order = [F.col("value").desc(), F.col("item")]
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank"))
    pair = ranked(pairs(columns(placed, group), group, settings), "pair")
    term = ranked(leading_terms(kept, group, settings), "term").where(F.col("rank") <= settings.top)
    return pair.unionByName(term)
