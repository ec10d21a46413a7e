"""Personal data: four fixed patterns, and identifiers found by bootstrapping from them.  Built-in functions only.

Matches of the fixed patterns are the seeds.  The word before a token with a digit or an @ and the token's shape make a
lexical pattern; pattern and token are the two sides of a graph.  A pattern's score is the share of known identifiers
among what it stands with, a token's the share of good patterns among where it stands.  Tokens with a high score become
known and count for further patterns, until nothing new is found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.tables import spare, whole
from ledgerlane.session import Scratch

# The four patterns.  \G and the look-behind only spare the search its hopeless starts inside a run of
# characters that has failed as a whole; possessive repeats match the same and need no stack for long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
FOUND = "found"

#: What ends a token.
_ENDS = "\t\n\x0b\f\r=\"'(),;:<>[]{}|"
#: A token that has a digit or an @, between white space, brackets, quotes and the like.
TOKEN = r"""(?<![^\s="'(),;:<>\[\]{}|])(?=[^\s="'(),;:<>\[\]{}|0-9@]*+[0-9@])[^\s="'(),;:<>\[\]{}|]++"""


@dataclass(frozen=True)
class Settings:
    """The score that a pattern and a token need; known identifiers that a pattern needs; digits of a new identifier."""

    pattern_score: float = 0.9
    token_score: float = 0.5
    seeds: int = 20
    digits: int = 4


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    place = F.sequence(F.lit(1), F.length(digits))
    turned = F.reverse(digits)
    doubled = lambda k: F.substring(turned, k, F.lit(1)).cast("int") * (2 - k % 2)
    total = F.aggregate(place, F.lit(0), lambda s, k: s + F.when(doubled(k) > 9, doubled(k) - 9).otherwise(doubled(k)))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(_digits(hit))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _bound(value: Column, then) -> Column:
    """``then`` of the value, which is worked out once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _spans(text: Column, pattern: str, keep, extra) -> Column:
    """Array of (start, end, *extra) of the pattern's matches that are kept, in code points.

    What stands between matches and the matches themselves, laid end to end, give the places.  An array that grows is copied
    at each step, so matches are taken in runs of about the root of their number, each counting from its own begin.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    row = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"])).cast("long").alias("start"),
        (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).cast("long").alias("end"), *extra(x))
    kept = lambda s, x: F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(s["rows"], F.array(row(s, x)))).otherwise(s["rows"])
    kind = "array<struct<start:bigint,end:bigint" + "".join(f",{name}:string" for name in extra.names) + ">>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("rows"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long").alias("at"),
        F.coalesce(kept(s, x), s["rows"]).cast(kind).alias("rows"))

    def runs(p: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(p))), F.lit(1)).cast("int")
        firsts = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), size)
        return F.transform(firsts, lambda k: F.aggregate(F.slice(p, k, size), start, step))

    moved = lambda s, r: F.struct(
        (s["at"] + r["start"]).cast("long").alias("start"), (s["at"] + r["end"]).cast("long").alias("end"),
        *(r[name].alias(name) for name in extra.names))
    whole_start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("rows"))
    joined = lambda s, run: F.struct(
        (s["at"] + run["at"]).cast("long").alias("at"),
        F.concat(s["rows"], F.array(F.transform(run["rows"], lambda r: moved(s, r)).cast(kind))).alias("rows"))
    return F.aggregate(_bound(pairs, runs), whole_start, joined, lambda s: F.flatten(s["rows"]))


class _Extra:
    """Further string columns of a span, made from the match and what stands before it."""

    def __init__(self, **columns):
        self.names, self.columns = list(columns), columns

    def __call__(self, x: Column) -> list[Column]:
        return [make(x).alias(name) for name, make in self.columns.items()]


def base_spans(text: Column) -> dict[str, Column]:
    """For each of the four kinds the array of (start, end)."""
    plan = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+")}
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = {}
    for kind, (pattern, sign) in plan.items():
        can = F.contains(text, F.lit(sign)) if sign else F.lit(True)
        if kind != "email":
            can = can & text.rlike("[0-9]")
        spans = _spans(text, pattern, lambda hit, kind=kind: _valid(kind, hit), _Extra())
        out[kind] = F.when(can, spans).otherwise(none)
    return out


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(
        F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _tokens(text: Column) -> Column:
    """Tokens with a digit or an @, with their places, the word before and the shape."""
    spaced = lambda x: F.rtrim(F.translate(x["gap"], _ENDS, " " * len(_ENDS)))
    last = lambda x: F.lower(F.substring_index(spaced(x), " ", -1))
    shape = lambda x: F.regexp_replace(F.regexp_replace(x["hit"], r"\p{L}+", "a"), "[0-9]+", "9")
    extra = _Extra(before=last, shape=shape, token=lambda x: F.lower(x["hit"]))
    spans = _spans(text, TOKEN, lambda hit: F.lit(True), extra)
    none = F.array().cast("array<struct<start:bigint,end:bigint,before:string,shape:string,token:string>>")
    return F.when(text.rlike("[0-9@]"), spans).otherwise(none)


def _marked(tokens: str, seeds: str) -> Column:
    """The tokens, each with ``seed``: whether a seed overlaps it.

    Tokens are taken in runs of about the root of their number, each with the seeds of its stretch of the text.
    """
    # also right for no tokens: the optimizer may try this before rows without any are left out
    size = F.greatest(F.ceil(F.sqrt(F.size(tokens))), F.lit(1)).cast("int")
    firsts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), size)
    over = lambda s, a, b: (s["start"] < b) & (a < s["end"])

    def told(run: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.try_element_at(run, F.lit(-1))
        near = F.filter(seeds, lambda s: over(s, first["start"], last["end"]))
        return _bound(near, lambda own: F.transform(run, lambda t: F.struct(
            *(t[c].alias(c) for c in ("start", "end", "before", "shape", "token")),
            F.exists(own, lambda s: over(s, t["start"], t["end"])).alias("seed"))))

    return F.flatten(F.transform(firsts, lambda k: _bound(F.slice(tokens, k, size), told)))


def _grown(edges: DataFrame, settings: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Good patterns (before, shape) and known tokens (token), from (before, shape, token, n, seed).

    Known tokens and good patterns only ever get more, so the rounds end; each is a written table.  Edges are counted
    before, so that a frequent pattern or token is one row for each pair; sums have a partial step.
    """
    pattern = ["before", "shape"]
    known = scratch.save(edges.where("seed").select("token").distinct(), "known-0")
    stands = scratch.save(edges.groupBy("token").agg(F.sum("n").alias("everywhere")), "stands")
    size, step = known.count(), 0
    while True:
        step += 1
        marked = edges.join(known.withColumn("known", F.lit(True)), "token", "left")
        good = scratch.save(marked.groupBy(*pattern).agg(
            (F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / (F.sum("n") + 1)).alias("score"),
            F.count("known").alias("support"),
        ).where((F.col("score") >= settings.pattern_score) & (F.col("support") >= settings.seeds)).select(*pattern), f"good-{step}")
        told = edges.join(good, pattern).groupBy("token").agg(F.sum("n").alias("here")).join(stands, "token")
        likely = told.where(
            (F.col("here") >= settings.token_score * F.col("everywhere"))
            & (F.length(_digits(F.col("token"))) >= settings.digits)).select("token")
        known = scratch.save(known.unionByName(likely).distinct(), f"known-{step}")
        before, size = size, known.count()
        if size == before:
            return good, known


def personal_data(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """doc_id, base (kind and array of (start, end)), found (array of (start, end)) and row for every row of docs.

    ``row`` tells rows apart by id and text; repeated rows share it and have the same spans.  Null texts are empty
    and hold nothing; null ids are kept.  Only doc_id and text are read.  The graph and its scores cover all documents,
    and what is joined to a row are its own spans.  No rows: an empty result.
    """
    text = whole()
    base = base_spans(F.col("text"))
    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    looked = looked.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), *(spans.alias(kind) for kind, spans in base.items()),
        _tokens(F.col("text")).alias("tokens"))
    looked = scratch.save(looked, "spans")

    seeds = F.flatten(F.array(*(F.col(kind) for kind in KINDS)))
    each = looked.where(F.size("tokens") > 0).withColumn("seeds", seeds).select(
        "row", _marked("tokens", "seeds").alias("tokens")).select("row", F.inline("tokens"))
    each = each.where("before != ''")
    edges = scratch.save(each.groupBy("before", "shape", "token").agg(
        F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    good, known = _grown(edges, settings, scratch)
    new = (
        each.where(~F.col("seed") & (F.length(_digits(F.col("token"))) >= settings.digits))
        .join(good, ["before", "shape"]).join(known, "token")
        .select("row", "start", "end").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return looked.drop("tokens").join(new, "row", "left").withColumn("found", F.coalesce("found", none))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the four kinds, sha256 of the base spans as text, and all spans as text."""
    base = F.array_join(F.flatten(F.array(*(_written(kind, F.col(kind)) for kind in KINDS))), ",")
    new = F.array_join(_written(FOUND, F.col("found")), ",")
    return spans.select(
        "doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(base != "", base), F.when(new != "", new)).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )


def masked(docs: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The rows of docs, spans replaced by their kind in brackets; n_chars, where it is a column, is the new length.

    Where spans overlap, the first one's name stands for both.  Null texts stay null.
    """
    spans = personal_data(docs, settings, scratch)
    def tagged(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("tag")))

    row, mark = spare("row", docs.columns), spare("marks", docs.columns)
    every = F.array_sort(F.flatten(F.array(*(tagged(kind) for kind in (*KINDS, FOUND)))))
    marks = spans.select(F.col("row").alias(row), every.alias(mark)).where(F.size(mark) > 0).dropDuplicates([row])
    # what begins before an earlier span's end goes with it; then each span with the end of the one before
    turn = Window.partitionBy(row).orderBy("start", "end", "tag")
    each = marks.select(row, F.inline(mark))
    each = each.withColumn("past", F.max("end").over(turn.rowsBetween(Window.unboundedPreceding, -1)))
    each = each.where(F.col("past").isNull() | (F.col("start") >= F.col("past")))
    each = each.withColumn("past", F.coalesce(F.lag("end").over(turn), F.lit(0)))
    marks = each.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "past", "end", "tag"))).alias(mark))

    def without(chars: Column) -> Column:
        stretch = lambda first, last: F.array_join(F.slice(chars, (first + 1).cast("int"), (last - first).cast("int")), "")
        parts = F.transform(F.col(mark), lambda m: F.concat(stretch(m["past"], m["start"]), m["tag"]))
        length = F.length("text").cast("long")
        rest = stretch(F.least(F.element_at(mark, -1)["end"], length), length)
        return F.concat(F.array_join(parts, ""), rest)

    has = F.col(mark).isNotNull()
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), whole()))
    out = keyed.join(marks, row, "left").withColumn(
        "text", F.when(has, _bound(F.split("text", ""), without)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
