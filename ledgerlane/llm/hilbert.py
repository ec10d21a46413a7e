"""Sharding along a Hilbert curve over several metadata columns, with built-in functions only.

Each column is cut into 2**bits cells of about equal numbers of rows, the cells' place on the curve orders the rows, and
runs of that order are the shards.  A shard is then a compact region: its least and greatest values of every column
are close together, so a reader that filters on any of them skips most shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.tables import whole
from ledgerlane.session import Scratch

BITS = 5


def curve_index(cells: list[Column], bits: int) -> Column:
    """The place on the curve of a cell given by one number of so many bits for each dimension.

    From the highest bit down, the cube that holds the cell is one of 2**n sub-cubes.  Turned back into the curve's basic
    position by its entry corner and direction, Gray code gives the sub-cube's rank; the rank gives the next entry and
    direction.
    """
    n = len(cells)
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = [gray.index(i) for i in range(size)]
    entry = [0, *(gray[2 * ((i - 1) // 2)] for i in range(1, size))]
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    turn = [0, *(ones(i - 1) % n if i % 2 == 0 else ones(i) % n for i in range(1, size))]
    table = lambda values: F.array(*(F.lit(v) for v in values))
    pick = lambda values, at: F.element_at(table(values), (at + 1).cast("int"))
    #: all rotations, by amount and number, so that no shift has a column as its width
    rotated = [((x >> k) | (x << (n - k))) & (size - 1) for k in range(n) for x in range(size)]
    right = lambda x, k: pick(rotated, F.pmod(k, F.lit(n)) * size + x)
    left = lambda x, k: pick(rotated, F.pmod(-k, F.lit(n)) * size + x)

    def step(state: Column, power: Column) -> Column:
        corner = sum((F.pmod(F.floor(c / power), F.lit(2)) * (1 << i) for i, c in enumerate(cells)), F.lit(0)).cast("int")
        at = pick(rank, right(corner.bitwiseXOR(state["entry"]), state["turn"] + 1))
        return F.struct(
            (state["index"] * size + at).cast("long").alias("index"),
            state["entry"].bitwiseXOR(left(pick(entry, at), state["turn"] + 1)).cast("int").alias("entry"),
            F.pmod(state["turn"] + pick(turn, at) + 1, F.lit(n)).cast("int").alias("turn"),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("turn"))
    powers = table([1 << k for k in reversed(range(bits))])
    return F.aggregate(powers, start, step, lambda state: state["index"])


def ordered_number(text: Column) -> Column:
    """A number that orders texts as their first seven bytes do; 0 for null."""
    digits = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, 7)), 14, "0")
    return F.conv(digits, 16, 10).cast("long")


def cell(value: Column, cuts: list) -> Column:
    """How many of the cuts are below the value; a cut that a frequent value repeats counts each time, so cells stay spread."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < value))


def sharded(docs: DataFrame, shards: int, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law "rows", shard, slot, grown_shard (null), curve.

    The dimensions are lang, source, n_chars and doc_id.  Shards differ by one row at most; slots count from 0 along the
    curve.  Null lang and source count as empty, a null n_chars as the text's length, a null doc_id as 0 on the curve,
    a null text as empty with size 8.  Rows at one place of the curve are ordered by checksum, so equal texts of equal
    metadata are neighbours, then by id; repeated rows get slots of their own.  Further columns are not read.  No rows:
    an empty result; with fewer rows than shards some shards are empty.

    The cut points are quantiles of all rows: 2**bits - 1 numbers a dimension.  The order is a range partitioning of
    (id, size, checksum, place); texts aren't shuffled.  Ranks follow from row counts of its partitions.
    """
    text = whole()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ordered_number(F.col("lang")).alias("d0"), ordered_number(F.col("source")).alias("d1"),
        F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")).alias("d2"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d3"),
    )
    dims = ["d0", "d1", "d2", "d3"]
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = rows.select(*(F.percentile_approx(d, at, 10_000).alias(d) for d in dims)).first()
    cells = [cell(F.col(d), cuts[d] or []).alias(f"c{i}") for i, d in enumerate(dims)]
    placed = rows.select("doc_id", "size", "text_crc32", *cells).select(
        "doc_id", "size", "text_crc32", curve_index([F.col(f"c{i}") for i in range(len(dims))], bits).alias("curve"))
    order = ["curve", "text_crc32", "doc_id", "size"]
    line = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    line = scratch.save(line.withColumn("place", F.monotonically_increasing_id()), "line")

    part = F.shiftright("place", 33)
    parts = line.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each partition of the order, however many documents there are
    whole_line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(whole_line).alias("total"))
    rank = F.col("before") + F.col("place") - F.shiftleft(F.col("part"), 33)
    ranked = line.withColumn("part", part).join(F.broadcast(parts), "part").withColumn("rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, shards: int, scratch: Scratch, path: str) -> None:
    """Writes the documents' rows into one folder for each shard, in the order of the curve, sorted within files.

    Documents are matched with their shards by doc_id, which must be unique and not null here.
    """
    placed = sharded(docs, shards, scratch).select("doc_id", "shard", "slot")
    rows = docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_bounds(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Least and greatest values of each column in each shard: what a reader needs for skipping."""
    joined = docs.select("doc_id", "lang", "source", "n_chars").join(placed.select("doc_id", "shard"), "doc_id")
    return joined.groupBy("shard").agg(
        *(f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars", "doc_id")
          for n, f in (("min", F.min), ("max", F.max))))
