from __future__ import annotations

import random
import re

from texts import SMALL, collected, documents

from ledgerlane.llm import decontaminate
from ledgerlane.llm.decontaminate import Items, Settings, clean, passages
from ledgerlane.llm.tables import read


def norm(text: str | None) -> list[str]:
    return re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7F])+", (text or "").lower())


def least_edits(item: list[str], words: list[str]) -> int:
    row = [0] * (len(words) + 1)
    for n, a in enumerate(item, 1):
        new = [n]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def brute(docs, items, share=0.2):
    """(doc, item) pairs; words in common are counted first, as edits need them."""
    out = set()
    for d, text in docs:
        words = norm(text)
        have = set(words)
        for i, item in items:
            own = norm(item)
            most = int(share * len(own))
            if own and sum(w in have for w in own) >= len(own) - most and least_edits(own, words) <= most:
                out.add((d, i))
    return out


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"z{rng.randrange(10 ** 6)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"y{rng.randrange(10 ** 6)}")
    return " ".join(words)


def test_whole_small_table_like_brute_force(spark):
    docs, items = read(spark, SMALL, "documents"), read(spark, SMALL, "benchmark")
    got = {(r.doc_id, r.item_id) for r in passages(docs, items, Settings()).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want


def test_recall_of_edited_passages():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 55)))) for i in range(120)]
    docs, want = [], []
    for n in range(240):
        i, text = rng.choice(items)
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(400))]
        cut = rng.randrange(len(around) + 1)
        own = edited(rng, text, rng.randrange(int(0.2 * len(text.split())) + 1))
        docs.append(" ".join([*around[:cut], own, *around[cut:]]))
        want.append(i)
    found = Items(items, Settings()).found(docs)
    hit = sum(any(h[0] == i for h in own) for i, own in zip(want, found, strict=True))
    assert hit >= 0.98 * len(docs)
    pairs = {(d, h[0]) for d, own in enumerate(found) for h in own}
    assert pairs <= brute(list(enumerate(docs)), items)


def test_places_distances_case_and_marks():
    item = "One two three four five six seven eight nine ten"
    text = "Before it. ONE, two - three four FIVE changed seven eight\nnine ten! After."
    assert Items([(7, item)], Settings()).found([text, None, "", item, "one two three"]) == [
        [(7, 2, 12, 1)], [], [], [(7, 0, 10, 0)], []]


def test_odd_rows_blocks_and_empty_tables(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame(
        [(1, item), (2, None), (3, ""), (4, "?!"), (None, "uno dos tres cuatro cinco seis siete")], "item_id long, text string")
    rows = [(1, f"x {item} y"), (1, f"x {item} y"), (2, None), (3, ""), (None, item), (4, "w " * 150_000 + item), (5, "uno dos tres cuatro cinco seis siete")]
    docs = documents(spark, rows, extra="item_id distance block")
    want = sorted([(1, 1, 1, 9, 0), (1, 1, 1, 9, 0), (None, 1, 0, 8, 0), (4, 1, 150_000, 150_008, 0), (5, None, 0, 7, 0)], key=repr)
    columns = ["doc_id", "item_id", "first_word", "end_word", "distance"]
    assert collected(passages(docs, items, Settings()), *columns) == want
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 20)
    assert collected(passages(docs, items, Settings()), *columns) == want
    assert collected(clean(docs, items, Settings()), "doc_id") == [(2,), (3,), (None,)]
    assert passages(docs, items.limit(0), Settings()).count() == 0
    assert passages(documents(spark, []), items, Settings()).count() == 0


def spoiled(rng: random.Random, words: list[str], edits: int) -> list[str]:
    """With edits of all kinds, evenly spaced, which leave the shortest stretches."""
    words, size = list(words), len(words)
    for j in reversed(range(edits)):
        at = (2 * j + 1) * size // (2 * edits)
        words[at:at + 1] = [[f"z{rng.randrange(10 ** 6)}"], [], [f"y{rng.randrange(10 ** 6)}", words[at]]][rng.randrange(3)]
    return words


def test_recall_by_length():
    rng = random.Random(4)
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 18, 20, 25, 30):
        items = [[f"i{i}x{j}" for j in range(size)] for i in range(200)]
        around = lambda: [f"a{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(30))]
        searched = Items([(i, " ".join(w)) for i, w in enumerate(items)], Settings())
        for edits in {0, int(0.2 * size)}:
            docs = [" ".join([*around(), *spoiled(rng, w, edits), *around()]) for w in items]
            hit = sum(any(h[0] == i for h in own) for i, own in enumerate(searched.found(docs)))
            least = len(items) if size <= decontaminate.SHORT else decontaminate.TARGET_RECALL * len(items)
            assert hit >= least, (size, edits, hit)


def test_short_items_like_brute_force():
    rng = random.Random(6)
    for vocabulary in (list("ab"), [f"w{i}" for i in range(12)]):
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(1 + i % 17))) for i in range(68)]
        docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25))) for _ in range(150)]
        docs += [edited(rng, rng.choice(items)[1], rng.randrange(4)) for _ in range(150)]
        found = Items(items, Settings()).found(docs)
        assert {(d, h[0]) for d, own in enumerate(found) for h in own} == brute(list(enumerate(docs)), items)


def test_every_place_of_short_items():
    items = [(1, "the"), (None, "to be"), (2, "one two three four five")]
    text = "The cat, to be the THE one two three four and one two three four five to be"
    assert Items(items, Settings()).found([text, "to", "", "be"]) == [
        [(1, 0, 1, 0), (None, 2, 4, 0), (1, 4, 5, 0), (1, 5, 6, 0), (2, 6, 11, 1), (2, 11, 16, 0), (None, 16, 18, 0)], [], [], []]
