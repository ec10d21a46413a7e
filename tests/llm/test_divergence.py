from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from texts import collected, documents

from ledgerlane.llm.divergence import Settings, apart, columns, divergence, groups, kept_terms, ordered_terms, term_counts
from ledgerlane.llm.tables import scratch

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows: list[tuple], s: Settings) -> list[tuple]:
    n, docs, names = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang, source].update(found)
        docs[lang].update(set(found))
        names[lang].add(source)
    out = []
    for lang, sources in names.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= s.least_docs)
        total = {x: sum(n[lang, x][t] for t in kept) for x in sources}
        p = lambda count, below: 1 + s.scale * (count + s.extra) // (below + s.extra * len(kept))
        whole = {t: p(sum(n[lang, x][t] for x in sources), sum(total.values())) for t in kept}
        share = {x: {t: p(n[lang, x][t], total[x]) for t in kept} for x in sources}
        for x in sources:
            pair = [(-sum(abs(share[x][t] - share[y][t]) for t in kept), y.encode(), y) for y in sources if y != x]
            term = [(whole[t] - share[x][t], t.encode(), t) for t in kept if n[lang, x][t] and share[x][t] > whole[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, s.top)):
                out += [(lang, x, part, name, -v, k) for k, (v, _, name) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=repr)


def made(rng: random.Random, n: int) -> list[tuple]:
    words = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60)] + ["été", "ÉTÉ", "漢字", "Große"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "", None, "Z", "é", "only"])
        text = " ".join(rng.choice(words[:1 + rng.randrange(64)]) for _ in range(rng.randrange(40)))
        rows.append((i, text.upper() if i % 7 == 0 else text.replace(" ", rng.choice([" ", "-3_", "\x00", "\n"])), lang, source))
    return rows + [(n, None, "xx", "s"), (n + 1, "", "xx", "t"), (n + 2, "rare", "yy", "s"), (n + 2, "rare", "yy", "s")]


@pytest.mark.parametrize("settings", [
    Settings(least_docs=2), Settings(least_docs=5, top=3, block=32, tile=4, held=10), Settings(least_docs=1, block=64, tile=3),
    Settings(least_docs=10 ** 6), Settings(least_docs=2, scale=10 ** 17),
])
def test_like_brute_force(spark, settings):
    rows = made(random.Random(settings.block), 300)
    got = divergence(documents(spark, rows), settings, scratch(spark, "t"))
    assert collected(got, *COLUMNS) == brute(rows, settings)


def test_extra_columns_repeats_and_no_rows(spark):
    rows = made(random.Random(3), 40)
    rows += rows[:5] + [(None, "wak wal", "en", "a")]
    docs = documents(spark, rows, extra="term n docs held block place value rank")
    settings = Settings(least_docs=2)
    assert collected(divergence(docs, settings, scratch(spark, "t")), *COLUMNS) == brute(rows, settings)
    assert divergence(documents(spark, []), settings, scratch(spark, "t")).count() == 0


def test_long_text_is_read_to_its_end(spark):
    rows = [(1, "aa " * 300_000 + "zz", "en", "a"), (2, "zz bb", "en", "b"), (3, "aa bb", "en", "b")]
    settings = Settings(least_docs=2)
    assert collected(divergence(documents(spark, rows), settings, scratch(spark, "t")), *COLUMNS) == brute(rows, settings)


def test_runs_give_the_counts_back_and_equal_counts_stand_together(spark):
    rows = made(random.Random(4), 200)
    settings, tables = Settings(least_docs=2, block=32), scratch(spark, "t")
    counts = term_counts(documents(spark, rows), settings)
    kept = kept_terms(counts, settings)
    column = columns(ordered_terms(kept, settings, tables), groups(counts, kept)).collect()
    held = defaultdict(list)
    for c in column:
        ends = [*c.starts[1:], c.size] if c.size else []
        held[c.lang, c.source] += [n for n, a, b in zip(c.counts, c.starts, ends, strict=True) for _ in range(a, b)]
        assert all(x != y for x, y in zip(c.counts, c.counts[1:], strict=False))
    want = defaultdict(Counter)
    for r in kept.collect():
        for own in r.held:
            want[r.lang, own.source][own.n] += 1
    for key, numbers in held.items():
        assert Counter(x for x in numbers if x) == want[key]


def test_common_runs_of_two_columns():
    a, b = np.array([0, 3, 7]), np.array([0, 5])
    p, q = np.array([10, 20, 5]), np.array([12, 6])
    assert apart(a, p, b, q, 9) == 3 * 2 + 2 * 8 + 2 * 14 + 2 * 1
