"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix is that of a shorter prefix plus one last token, and the last token is the only piece
that ends there and fits the last token before it, that is, that pairwise merging of the two pieces' characters
leaves as those two.  So count[i] = count[i - len(last[i])] + 1, and no prefix is encoded again.

Pieces of the model never hold a space after another character, so the merging never crosses the beginning of a word
with its spaces, nor some other places between kinds of characters; the counts of the segments between such places
add up, and are remembered for words that come again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments, their prefixes, and pairs of pieces remembered in a task; the greatest length of such a segment.
REMEMBERED, SHORT = 600_000, 48


class PrefixCounter:
    """Counts as the sentencepiece model of that file gives them (BPE with byte fallback, a space put in front)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        self.score = {
            model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)
        }
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("a piece of the model crosses the beginning of a word")
        #: Every ending of a piece; pieces by a number from 1, endings that are no piece as 0.
        self.pieces = dict.fromkeys((piece[i:] for piece in self.score for i in range(len(piece))), 0)
        self.pieces |= {piece: i for i, piece in enumerate(self.score, 1)}
        self.names = ["", *self.score]
        self.segment = self._segments()
        self.fits: dict[int, bool] = {}
        self.words = Remembered(self._word)
        self.segments = Remembered(self._steps)
        self._forget()

    def _segments(self) -> re.Pattern:
        """Spaces with what follows, cut where no piece crosses: before marks that no piece has after a letter."""
        chars = {char for piece in self.score for char in piece}
        alone = {c for c in "\n\r\t" if c not in chars}
        marks = {c for c in chars if not c.isalnum() and c != SPACE}
        while joined := {
            b for piece in self.score for a, b in zip(piece, piece[1:], strict=False)
            if b in marks and a not in marks and a != SPACE
        }:
            marks -= joined
        m, a = ("".join(re.escape(c) for c in sorted(x)) for x in (marks, alone))
        mark = f"[{m}]+" if marks else "(?!)"
        rest = f"[^ {m}{a}]"
        return re.compile(f" *(?:{rest}+|{mark}{rest}*)| +" + (f"|[{a}]" if alone else ""))

    def _forget(self) -> None:
        """Prefixes by number: where each goes on with a character, its count, the number of its last piece."""
        self.next: dict[tuple[int, str], int] = {}
        self.counts, self.last = [0], [0]

    def merged(self, text: str) -> list[str]:
        """Pairwise merging, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces as they are; left is 0 where none can join."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        pair = [self.names[n] for n in (left, right) if n]
        fits = self.fits[left << 20 | right] = self.merged("".join(pair)) == pair
        return fits

    def _steps(self, segment: str) -> bytes:
        """By how much the count changes from each prefix of the segment to the next, as signed bytes.

        Prefixes that earlier segments had are not worked out again.
        """
        if len(self.counts) > REMEMBERED:
            self._forget()
        segment = segment.replace(" ", SPACE)
        path, counts, last, follow = [0], self.counts, self.last, self.next
        at = 0
        for end, char in enumerate(segment, 1):
            step = (at, char)
            at = follow.get(step)
            if at is None:
                count, piece = self._ending(segment, end, path)
                at = follow[step] = len(counts)
                counts.append(count)
                last.append(piece)
            path.append(at)
        marks = [counts[at] for at in path]
        return bytes([(b - a) & 255 for a, b in zip(marks, marks[1:], strict=False)])

    def _ending(self, segment: str, end: int, path: list[int]) -> tuple[int, int]:
        """Count and last piece of the prefix up to ``end``; ``path`` has the numbers of all shorter prefixes."""
        pieces, fits, last = self.pieces, self.fits, self.last
        for begin in range(end - 1, -1, -1):
            piece = pieces.get(segment[begin:end])
            if piece is None:
                break
            if piece:
                left = last[path[begin]]
                fit = fits.get(left << 20 | piece)
                if self._fit(left, piece) if fit is None else fit:
                    return self.counts[path[begin]] + 1, piece
        char = segment[end - 1]  # the model lacks it: it becomes its bytes
        return self.counts[path[-1]] + len(char.encode("utf-8", "surrogatepass")), 0

    def _word(self, word: str) -> bytes:
        """The steps of a space and the word behind it."""
        return b"".join(map(self.segments.__getitem__, self.segment.findall(" " + word)))

    def prefix_steps(self, text: str | None) -> bytes:
        """For every prefix of the text by one character more: the change of its count.  Empty for no text."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")  # the model takes both for the same
        if text[0] == " " or text[-1] == " " or "  " in text:
            changes = b"".join(map(self.segments.__getitem__, self.segment.findall(" " + text)))
        else:
            changes = b"".join(map(self.words.__getitem__, text.split(" ")))
        return bytes([(changes[0] + changes[1]) & 255]) + changes[2:]  # the space in front is no character of the text


class Remembered(dict):
    """Answers worked out before, in two generations; the older goes when the newer is full.  Long questions aren't kept."""

    def __init__(self, answer: Callable[[str], bytes]):
        super().__init__()
        self.answer = answer
        self.older: dict[str, bytes] = {}

    def __missing__(self, question: str) -> bytes:
        found = self.older.get(question)
        if found is None:
            found = self.answer(question)
        if len(question) <= SHORT:
            if 2 * len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[question] = found
        return found


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, and prefix_steps: for each character the change of the prefix's count.

    ``path`` is the model's file as the executors see it.  Null texts count as empty: no bytes, no tokens, no
    steps.  Every row of docs gives one row, repeated ids and null ids too; columns besides doc_id and text are not
    read.  A text is one value in memory; work on it is linear in its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            steps = [own.prefix_steps(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in batch["text"]],
                "n_tokens": [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps],
                "prefix_steps": steps,
            })

    schema = "doc_id long, n_bytes long, n_tokens long, prefix_steps binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def tokens_at(length: Column, steps: str = "prefix_steps") -> Column:
    """The exact number of tokens of the text's first ``length`` characters; all its tokens beyond its end."""
    @F.pandas_udf("long")
    def at(lengths: pd.Series, all_steps: pd.Series) -> pd.Series:
        return pd.Series([
            None if s is None or pd.isna(n) else int(np.frombuffer(s, np.int8)[:max(0, int(n))].sum(dtype=np.int64))
            for n, s in zip(lengths, all_steps, strict=True)
        ], dtype="Int64")
    return at(length, F.col(steps))


def longest_within(budget: Column, steps: str = "prefix_steps") -> Column:
    """The length of the longest prefix of at most ``budget`` tokens."""
    @F.pandas_udf("long")
    def within(budgets: pd.Series, all_steps: pd.Series) -> pd.Series:
        out = []
        for most, s in zip(budgets, all_steps, strict=True):
            if s is None or pd.isna(most):
                out.append(None)
                continue
            counts = np.concatenate([[0], np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64)])
            out.append(int(np.flatnonzero(counts <= max(0, int(most)))[-1]))
        return pd.Series(out, dtype="Int64")
    return within(budget, F.col(steps))
