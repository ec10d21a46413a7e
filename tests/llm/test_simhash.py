from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from texts import SMALL, collected, documents

from ledgerlane.llm.simhash import BITS, Settings, beyond, edges, fingerprint, linked, near_duplicates, parts, planes, shingle_hashes
from ledgerlane.llm.tables import read, scratch


def plain(text: str | None) -> int:
    """The fingerprint by its definition."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    own = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in own) > len(own))


def classes(values: list[int], radius: int, key=lambda i: 0) -> list[int]:
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= radius).tolist():
            if key(i) == key(j):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def family(rng: random.Random, size: int, flips: int) -> list[int]:
    base, out = rng.getrandbits(BITS), set()
    while len(out) < size:
        x = base
        for _ in range(rng.randrange(flips + 1)):
            x ^= 1 << rng.randrange(BITS)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 12])
def test_links_of_buckets_like_brute_force(radius):
    rng = random.Random(radius)
    values, bucket = [], []
    for b in range(12):
        own = family(rng, rng.choice([1, 2, 5, 70, 150]), 9)
        values += own
        bucket += [b] * len(own)
    u, v = linked(np.array(values, np.uint64), np.array(bucket), Settings(radius=radius))
    assert all(bucket[a] == bucket[b] and (values[a] ^ values[b]).bit_count() <= radius for a, b in zip(u, v, strict=True))
    want = classes(values, radius, lambda i: bucket[i])
    got = list(range(len(values)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):  # few enough to do it the slow way
        x, y = got[a], got[b]
        assert x != y  # only links that connect something new
        got = [min(x, y) if g in (x, y) else g for g in got]
    assert got == want


def test_planes_and_counters():
    rng = random.Random(2)
    values = [rng.getrandbits(BITS) for _ in range(130)]
    plane = planes(np.array(values, np.uint64))
    assert all(int(plane[b][i // 64]) >> (i % 64) & 1 == values[i] >> b & 1 for i in range(130) for b in range(BITS))
    x = np.zeros((70, 2), np.uint64)
    x[:BITS] = plane[:, :2]
    few = [v if i % 3 else v & 0x8421 for i, v in enumerate(values[:128])]
    x[:BITS] = planes(np.array(few, np.uint64))[:, :2]
    over = beyond(x, 4, np.zeros(2, np.uint64))
    assert [int(over[i // 64]) >> (i % 64) & 1 for i in range(128)] == [int(v.bit_count() > 4) for v in few]
    assert beyond(np.full((70, 2), ~np.uint64(0)), 4, np.zeros(2, np.uint64)) is None


def test_two_within_the_radius_agree_on_a_part():
    settings = Settings()
    own = parts((1 << BITS) - 1, settings)
    assert len(own) == 5 and sorted(b for p in own for b in p) == list(range(BITS))


@pytest.mark.parametrize("bucket", [4096, 150, 40])
def test_edges_connect_what_brute_force_connects(spark, bucket):
    rng = random.Random(bucket)
    values = sorted({*family(rng, 400, 6), *family(rng, 60, 10), *(rng.getrandbits(BITS) for _ in range(200)), 0, 1, 3})
    rng.shuffle(values)
    signed = [(v - (1 << BITS) if v >> 63 else v,) for v in values]
    found = edges(spark.createDataFrame(signed, "node long"), Settings(bucket=bucket), scratch(spark, "t")).collect()
    at = {v: i for i, (v,) in enumerate(signed)}
    got = list(range(len(values)))
    for a, b in found:
        assert (values[at[a]] ^ values[at[b]]).bit_count() <= 4
        x, y = got[at[a]], got[at[b]]
        got = [min(x, y) if g in (x, y) else g for g in got] if x != y else got
    assert got == classes(values, 4)


def check(spark, rows: list[tuple], docs=None):
    got = collected(near_duplicates(docs or documents(spark, rows), Settings(), scratch(spark, "t")), "doc_id", "fingerprint", "component_id")
    prints = [plain(t) for _, t in rows]
    of = classes(prints, 4)
    least = {c: min((i for (i, _), k in zip(rows, of, strict=True) if k == c and i is not None), default=None) for c in of}
    assert got == sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, of, strict=True)), key=repr)


def test_whole_small_table_like_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], docs)


def test_nulls_empty_short_long_and_repeated_texts(spark):
    long = " ".join(f"w{i * 7919 % 4000}" for i in range(60_000))
    rows = [
        (5, None), (4, ""), (3, " \t\n\x0b"), (7, "One"), (8, "one"), (9, "one two  THREE"), (10, "One two three"),
        (None, "one"), (None, None), (None, "nobody has this one text"), (8, "one"), (8, "another text of the same id"),
        (2 ** 60 + 1, "ÉTÉ été"), (11, "été ÉTÉ"), (20, long), (21, long + " end"), (22, long[:1000]),
    ]
    check(spark, rows)


def test_extra_columns_and_no_rows(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e")]
    check(spark, rows, documents(spark, rows, extra="node key agreed component_id fingerprint"))
    assert near_duplicates(documents(spark, []), Settings(), scratch(spark, "t")).count() == 0


def test_fingerprint_of_many_hashes_is_counted_in_steps(monkeypatch):
    hashes = shingle_hashes(" ".join(map(str, range(500))).encode(), Settings())
    want = fingerprint(hashes)
    monkeypatch.setattr("ledgerlane.llm.simhash.STEP", 7)
    assert fingerprint(hashes) == want == plain(" ".join(map(str, range(500))))
