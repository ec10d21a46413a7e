from __future__ import annotations

import random
import re

import pytest
from texts import SMALL, collected, documents

from ledgerlane.llm import near_dup
from ledgerlane.operators.components import components
from ledgerlane.llm.near_dup import AT_80, Settings, near_duplicates
from ledgerlane.llm.tables import read, scratch
from ledgerlane.llm.words import shingle_sets


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows: list[tuple[int, str | None]], percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, settings):
    got = near_duplicates(documents(spark, rows), settings, scratch(spark, "t")).collect()
    want = brute(rows, settings.percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(rng: random.Random, first: int, size: int, most_edits: int) -> list[tuple[int, str]]:
    """Copies of one text with words replaced here and there."""
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
        out.append((first + i, " ".join(words)))
    return out


@pytest.mark.parametrize("settings", [Settings(), AT_80, Settings(crowd=2)])
def test_families_of_copies_like_brute_force(spark, settings):
    rng = random.Random(settings.percent + settings.crowd)
    rows = family(rng, 0, 70, 4) + family(rng, 200, 25, 12) + family(rng, 400, 2, 1)
    # a chain in which only neighbours are similar
    words = [f"c{i}" for i in range(150)]
    rows += [(600 + k, " ".join(words[6 * k:6 * k + 90])) for k in range(9)]
    rows += [(700 + k, f"alone {k} " + " ".join(f"u{k}-{i}" for i in range(20))) for k in range(20)]
    check(spark, rows, settings)


def test_words_case_and_short_texts(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"), (7, "ÉTÉ été"),
        (8, "été été"), (9, "a b c d e"), (10, "a b c d e f"), (11, "A B C D E"), (12, "one"), (13, "ONE"),
    ]
    check(spark, rows, Settings())


def test_whole_small_table_like_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], Settings())


def test_null_ids_repeated_rows_extra_columns_and_no_rows(spark):
    text = "the same words again and again in a row"
    rows = [(None, text), (3, text), (3, text), (2, text), (None, None), (5, "x")]
    docs = documents(spark, rows, extra="node bands links component_id")
    got = near_duplicates(docs, Settings(), scratch(spark, "t"))
    assert collected(got, "doc_id", "component_id", "kept") == sorted(
        [(None, None, True), (None, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (5, 5, True)], key=repr)
    assert near_duplicates(documents(spark, []), Settings(), scratch(spark, "t")).count() == 0


def test_long_text_is_read_to_its_end(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " and more"), (3, long[:len(long) // 2])]
    check(spark, rows, Settings())


def test_signature_estimates_similarity():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    a, b = shingle_sets([" ".join(words[:2500]), " ".join(words[500:])], 5)
    same = (near_dup.signature(a, 500) == near_dup.signature(b, 500)).mean()
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs(same - true) < 0.08
    assert near_dup.expected_miss(0.85, Settings()) < 1e-6
    assert near_dup.expected_miss(0.80, AT_80) < 1e-6


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(collected(components(df, scratch(spark, "t"), "c"), "node", "component"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert components(df.where("u < 0"), scratch(spark, "t"), "c").count() == 0


def test_a_crowded_bucket_may_have_another_components_hub(spark):
    """A node of another component that is near the hub is a link, though it has no difference that leads to it."""
    hub = list(range(1000, 1200))
    sets = {1: hub, 2: [*hub[:199], 7], 3: [*hub[:198], 8, 9], 4: [*hub[:150], *range(50)], 5: [*hub[:150], *range(49), 77], 6: list(range(300))}
    frame = spark.createDataFrame([(n, own) for n, own in sets.items()], "node long, set array<long>")
    labels = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    entries = spark.createDataFrame([(n, 1, labels[n], 1, len(sets[n])) for n in sets], "node long, hub long, label long, main long, size int")
    got = {tuple(sorted((r.u, r.v))) for r in near_dup._many(entries, frame, 80, scratch(spark, "t")).collect()}
    assert {(1, 3), (4, 5)} <= got and not any(6 in pair for pair in got)


def test_families_in_buckets_with_foreign_hubs(spark):
    """Families over one shared passage, so that buckets hold several of them."""
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(6):
        own = [f"f{k}w{rng.randrange(300)}" for _ in range(70)]
        for i in range(14):
            words = [*own[:rng.choice([8, 30, 70])], *passage]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((100 * k + i, " ".join(words)))
    for settings in (Settings(crowd=3), Settings(percent=80, bands=31, rows=4, crowd=2)):
        check(spark, rows, settings)


def test_rows_that_share_an_id_are_told_apart(spark):
    text, other = "the same words again and again in a row", "something else that nobody has copied so far"
    found = near_duplicates(documents(spark, [(1, text), (5, text), (5, other)]), Settings(), scratch(spark, "t"))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(1, 1), (5, 1), (5, 5)]
    assert found.select("row").distinct().count() == 3


def test_differences_of_one_node_alone_get_no_row(spark, monkeypatch):
    """Most differences in a family are one node's own; only those that lead to a pair are spread out."""
    rng = random.Random(9)
    hub = list(range(1000, 1100))
    sets = {1: hub}
    for node in range(2, 80):
        gone = set(rng.sample(hub, 25))
        sets[node] = [x for x in hub if x not in gone] + [10_000 * node + i for i in range(25)]
    sets[80] = [*sets[7][:-2], 5, 6]
    sets[81] = [*sets[80][:-1], 8]
    frame = spark.createDataFrame([(n, own) for n, own in sets.items()], "node long, set array<long>")
    entries = spark.createDataFrame([(n, 1, n, 1, len(own)) for n, own in sets.items()], "node long, hub long, label long, main long, size int")
    similar = lambda a, b: 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
    want = {(u, v) for u in sets for v in sets if u < v and similar(sets[u], sets[v])}
    assert {(7, 80), (80, 81)} <= want
    for counted in (near_dup.COUNTED, 50):
        monkeypatch.setattr(near_dup, "COUNTED", counted)
        tables = scratch(spark, "t")
        got = {tuple(sorted((r.u, r.v))) for r in near_dup._many(entries, frame, 80, tables).collect()}
        assert want <= got
        # own differences, 25 of each node's 50, come first in the order and would be most of the rows
        spread = spark.read.parquet(f"{tables.path}/seekers")
        assert spread.where("part >= 20000").select("node").distinct().count() <= 3
        assert spread.where("place <= 22").select("node").distinct().count() <= 3
