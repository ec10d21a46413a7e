from __future__ import annotations

import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import sentencepiece
from texts import SMALL, collected, documents
from tokenizers import Tokenizer

from ledgerlane.llm import alignment
from ledgerlane.llm.alignment import links, shared_cuts
from ledgerlane.llm.queries import tokenizer_files
from ledgerlane.llm.tables import read, scratch

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    """Ids and bytes of both sides straight from the libraries that define them."""
    files = tokenizer_files()
    whole, pieces = Tokenizer.from_file(files.json), sentencepiece.SentencePieceProcessor(model_file=files.model)
    whole.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    entry = {i: bytes(byte[c] for c in token) for token, i in whole.get_vocab().items() if i != 50256}

    def of_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        a = [(i, entry[i]) for i in whole.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, of_b(i)) for i in pieces.encode(text)]
        same = all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b))
        return (a, b) if same else ([], [])

    return encode


def brute(rows: list[tuple], encode) -> list[tuple]:
    """Walks both sides token by token."""
    found = []
    for doc_id, text in rows:
        a, b = encode(text)
        groups, own, i, j, end_a, end_b = [], [], 0, 0, 0, 0
        while i < len(a):
            group = ([a[i][0]], [b[j][0]])
            own.append((a[i][0], b[j][0]))
            end_a, end_b = end_a + len(a[i][1]), end_b + len(b[j][1])
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a += len(a[i][1])
                    group[0].append(a[i][0])
                else:
                    j += 1
                    end_b += len(b[j][1])
                    group[1].append(b[j][0])
                own.append((a[i][0], b[j][0]))
            groups.append("|".join(",".join(map(str, side)) for side in group))
            i, j = i + 1, j + 1
        found.append((doc_id, len(a), len(b), groups, own))
    counts, most = Counter(pair for *_, own in found for pair in own), Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((
        (doc_id, a, b, len(groups), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, a, b, groups, own in found), key=repr)


HARD = [
    None, "", " ", "  two  spaces ", "a▁b", "x\x00y <|endoftext|> </s> <s> <unk>", "漢字" * 300 + "\U0001f642" * 40, "a" * 3000, "ﬁ ² ℌ",
    "été ́", "tab\tand\r\nlines\n\n\n", "<0x41> <0x0A>", "éÉßı Жизнь שלום", "1234567890 3.14159", "​﻿ ",
]


@pytest.mark.parametrize("chunk", [1, 500, 4_000_000])
def test_hard_texts_like_the_libraries(spark, libraries, chunk):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3]), (None, "the same id"), (None, None), (2 ** 60 + 1, "a big id")]
    docs = documents(spark, rows, extra="chunk pair places n best n_a")
    got = alignment.alignment(docs, replace(tokenizer_files(), chunk=chunk), scratch(spark, "t"))
    assert collected(got, *COLUMNS) == brute(rows, libraries)


def test_small_table_like_the_libraries(spark, libraries):
    docs = read(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = alignment.alignment(docs, replace(tokenizer_files(), chunk=20_000, long_text=5_000), scratch(spark, "t"))
    assert collected(got, *COLUMNS) == brute(rows, libraries)


def test_long_text_to_its_end_and_no_rows(spark, libraries):
    rng = random.Random(6)
    rows = [(1, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(60_000)))]
    got = alignment.alignment(documents(spark, rows), tokenizer_files(), scratch(spark, "t"))
    assert collected(got, *COLUMNS) == brute(rows, libraries)
    assert alignment.alignment(documents(spark, []), tokenizer_files(), scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_dividing_finds_every_shared_cut(seed):
    """Also in long stretches without one."""
    rng = random.Random(seed)
    a, b, from_a, from_b, at = [], [], [0], [0], 0
    for _ in range(rng.randrange(1, 5)):
        size = rng.choice([1, 2, 30, 3000])
        bare = range(size // 3, size // 3 + rng.randrange(size))
        for x in range(1, size + 1):
            here = rng.random()
            if x == size:
                a.append(at + x)
                b.append(at + x)
            elif x in bare:
                (a if x % 2 else b).append(at + x)
            else:
                a.extend([at + x] * (here < 0.6))
                b.extend([at + x] * (here > 0.3))
        at += size
        from_a.append(len(a))
        from_b.append(len(b))
    a, b = np.array(a), np.array(b)
    last_a, last_b = shared_cuts(a, b, np.array(from_a), np.array(from_b))
    assert a[last_a].tolist() == b[last_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    of_a, of_b = links(a, b)
    start_a, start_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    want = {(i, j) for i in range(len(a)) for j in np.flatnonzero((start_b < a[i]) & (b > start_a[i])).tolist()}
    assert len(of_a) == len(want) and set(zip(of_a.tolist(), of_b.tolist(), strict=True)) == want
