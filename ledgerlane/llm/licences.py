"""Licence scans: TF-IDF cosine of a page's lines to templates, then inheritance from the nearest directory above.

Weights come from document counts of all pages.  A statement found on a page holds for the page's path and everything
below it, and a statement in a licence file for the file's directory; a page without a statement of its own takes that
of the nearest path above, found by joins of paths.

Short notices are compared with whole lines.  Notices, file headers, SPDX tags and the licences' own texts are also
compared with windows of their size over all words of a page, whatever lines and paragraphs these stand in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.session import Scratch

# Short notices by which licences are stated.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "reserved": "All rights reserved.",
}
# Usual headers of files and pages.
_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published"
    " by the Free Software Foundation; {2}, or (at your option) any later version.")
HEADERS = {
    "AGPL-3.0": [_GNU.format("program", "Affero General", "either version 3 of the License")],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file"
        " to you under the Apache License, Version 2.0",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": [_GNU.format("program", "General", "either version 2 of the License")],
    "GPL-3.0": [_GNU.format("program", "General", "either version 3 of the License")],
    "LGPL-2.1": [_GNU.format("library", "Lesser General", "either version 2.1 of the License")],
    "LGPL-3.0": [_GNU.format("library", "Lesser General", "either version 3 of the License")],
    "MIT": ["This project is licensed under the MIT License - see the LICENSE file for details."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
# A tag holds word for word only: names differ in a word or number.
TAGS = {name: f"SPDX-License-Identifier: {name}" for name in (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")}
TAG_COSINE = 0.999999
TEXTS = Path(__file__).with_name("licence_texts")
LICENCE_FILES = ("licence", "license", "copying", "notice", "unlicense")


@dataclass(frozen=True)
class Settings:
    """The least cosine of a statement."""

    cosine: float = 0.75


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^\\p{L}\\p{N}.]+|\\.(?![0-9])"), lambda t: t != "")


def lines(html: Column) -> Column:
    """Texts between tags and line ends."""
    return F.filter(F.split(F.coalesce(html, F.lit("")), "<[^<>]*+>|[\\r\\n]+"), lambda x: F.trim(x) != "")


def path_of(url: Column) -> Column:
    """Host and folders of a URL, without scheme, query, fragment, last slash and .html; empty for null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "/+$", ""), "\\.html?$", ""))


def covered(path: Column) -> Column:
    """The path for which a statement on the page holds."""
    name = F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), "\\.[a-z]+$", "")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(name.isin(*LICENCE_FILES) & path.contains("/"), folder).otherwise(path)


@dataclass(frozen=True)
class Window:
    """A template for windows: licence, tokens, least cosine, and whether it outranks short notices."""

    licence: str
    tokens: list[str]
    least: float
    full: bool


def window_templates(settings: Settings) -> list[Window]:
    out = [Window(name, _plain(text), settings.cosine, False) for name, text in TEMPLATES.items()]
    out += [Window(name, _plain(text), settings.cosine, True) for name, own in HEADERS.items() for text in own]
    out += [Window(name, _plain(text), max(settings.cosine, TAG_COSINE), True) for name, text in TAGS.items()]
    return out + [
        Window(path.stem, _plain(path.read_text("utf-8")), settings.cosine, True) for path in sorted(TEXTS.glob("*.txt"))]


class Windows:
    """Finds windows that may be near enough to a template; sent to each task.

    Bounds of the cosine: words of no template have weight 1 or more, and a window's length is at least that of its words
    counted one by one.
    """

    def __init__(self, templates: list[Window], hashes: dict[str, int], idf: dict[str, float]):
        order = sorted(hashes, key=hashes.get)
        self.known = np.array([hashes[t] for t in order], np.int64)
        self.idf = np.array([*(idf[t] for t in order), 1.0])
        place = {t: k for k, t in enumerate(order)}
        self.templates = []
        for own in templates:
            unit = np.zeros(len(order) + 1)
            for t in own.tokens:
                unit[place[t]] += idf[t]
            self.templates.append((len(own.tokens), own.least, unit / np.sqrt(np.sum(unit * unit)), not own.full))
        self.squares = np.stack([unit for _, _, unit, _ in self.templates]) ** 2
        self.least = np.array([(own.least - 1e-6) ** 2 for own in templates])

    def found(self, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Template, begin, and tokens with their counts, of each template's most similar stretch of a page's tokens.

        A stretch is a window of the template's length at any token, or for a short notice a whole line as well.  The
        cosine of every stretch whose bound allows it is worked out, by letting tokens in and out one at a time.
        """
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        at = np.where(self.known[at] == words, at, len(self.known))
        # a cosine is at most the norm of that part of the template whose tokens the page has
        can = self.squares[:, np.unique(at)].sum(axis=1) >= self.least
        if not can.any():
            return
        square, starts = np.concatenate([[0.0], np.cumsum(self.idf[at] ** 2)]), np.arange(len(words))
        line_end = np.cumsum(sizes)
        line_start = line_end - sizes
        for k in np.flatnonzero(can).tolist():
            size, least, unit, whole_lines = self.templates[k]
            dots = np.concatenate([[0.0], np.cumsum((unit * self.idf)[at])])
            begin, end = starts, np.minimum(starts + size, len(words))
            if whole_lines:
                some = sizes > 0
                begin, end = np.concatenate([begin, line_start[some]]), np.concatenate([end, line_end[some]])
            bound = (dots[end] - dots[begin]) / np.sqrt(square[end] - square[begin])
            near = np.flatnonzero(bound >= least - 1e-6)
            if not len(near):
                continue
            length = self._lengths(words, self.idf[at], begin[near], end[near])
            cosine = np.round((dots[end[near]] - dots[begin[near]]) / length, 6)
            best = near[np.lexsort((begin[near], -cosine))[0]]
            token, tf = np.unique(words[begin[best]:end[best]], return_counts=True)
            yield k, int(begin[best]), token, tf

    @staticmethod
    def _lengths(words: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The norm of each stretch, its ends moving on from those of the stretch before."""
        token, weight = words.tolist(), (weight ** 2).tolist()
        held: dict[int, int] = {}
        square, lo, hi, out = 0.0, 0, 0, []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if a >= hi or a < lo or b < hi:  # nothing in common, or back to the front
                held, square, lo, hi = {}, 0.0, a, a
            for i in range(hi, b):
                tf = held.get(token[i], 0)
                held[token[i]] = tf + 1
                square += (2 * tf + 1) * weight[i]
            for i in range(lo, a):
                tf = held[token[i]]
                held[token[i]] = tf - 1
                square -= (2 * tf - 1) * weight[i]
            lo, hi = a, b
            out.append(square)
        return np.sqrt(np.maximum(out, 1e-12))


def _near_windows(told: DataFrame, windows: Windows) -> DataFrame:
    """row, line, template, start, token and tf of the most similar stretch for each template."""
    shared = told.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, words, sizes in zip(batch["row"].tolist(), batch["words"], batch["sizes"], strict=True):
                sizes = np.asarray(sizes, np.int64)
                for template, begin, token, tf in shared.value.found(np.asarray(words, np.int64), sizes) if len(words) else ():
                    line = int(np.searchsorted(np.cumsum(sizes), begin, "right"))
                    out.append((np.broadcast_to([[row], [line], [template], [begin]], (4, len(token))), token, tf))
            if out:
                row, line, template, start = np.concatenate([x[0] for x in out], axis=1)
                yield pd.DataFrame({
                    "row": row, "line": line.astype(np.int32), "template": template.astype(np.int32), "start": start.astype(np.int32),
                    "token": np.concatenate([x[1] for x in out]), "tf": np.concatenate([x[2] for x in out])})

    return told.mapInPandas(run, "row long, line int, template int, start int, token long, tf long")


def statements(pages: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """(row, licence, cosine): the best statement of each row that has one; ``row`` and html as in the given rows.

    Headers, tags and whole texts come before short notices: a licence's text often stands below "All rights reserved."

    Pages are cut into lines and tokens once; tokens are kept and counted as 64-bit hashes.
    """
    cut = F.transform(lines(F.col("html")), tokens)
    told = pages.select("row", F.explode(F.array(cut)).alias("cut")).select(
        "row", F.transform(F.flatten("cut"), lambda t: F.xxhash64(t)).alias("words"), F.transform("cut", lambda x: F.size(x)).alias("sizes"))
    told = scratch.save(told, "words")
    counts = told.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("pages"))
    counts = scratch.save(counts, "counts")
    total = max(1, told.count())

    # the templates' own tokens: some thousands of numbers, however many pages there are
    wide = window_templates(settings)
    every = sorted({t for own in wide for t in own.tokens})
    keys = pages.sparkSession.createDataFrame([(t,) for t in every], "text string").select("text", F.xxhash64("text").alias("token"))
    seen = {r.text: (r.token, r.pages) for r in keys.join(counts, "token", "left").select("text", "token", "pages").collect()}
    idf = {t: math.log((total + 1) / ((seen[t][1] or 0) + 1)) + 1 for t in every}

    near = scratch.save(_near_windows(told, Windows(wide, {t: h for t, (h, _) in seen.items()}, idf)), "windows")
    near = near.groupBy("row", "line", "template", "start", "token").agg(F.max("tf").alias("tf")).join(counts, "token")
    square = {k: sum((own.tokens.count(t) * idf[t]) ** 2 for t in set(own.tokens)) for k, own in enumerate(wide)}
    units = pages.sparkSession.createDataFrame(
        [(k, seen[t][0], own.tokens.count(t) * idf[t] / math.sqrt(square[k])) for k, own in enumerate(wide) for t in sorted(set(own.tokens))],
        "template int, token long, share double")
    kinds = pages.sparkSession.createDataFrame(
        [(k, own.licence, own.full, own.least) for k, own in enumerate(wide)], "template int, licence string, full boolean, least double")
    w = F.col("tf") * (F.log(F.lit(float(total + 1)) / (F.col("pages") + 1)) + 1)
    compared = near.withColumn("w", w).join(F.broadcast(units), ["template", "token"], "left").groupBy(
        "row", "line", "template", "start").agg(
            F.sum(F.col("w") * F.col("share")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    found = compared.join(F.broadcast(kinds), "template").select(
        "row", "full", "line", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "least")
    best = F.max(F.struct("full", "cosine", -F.col("line"), "licence"))
    return found.where(F.col("cosine") >= F.col("least")).groupBy("row").agg(best.alias("best")).select(
        "row", "best.licence", "best.cosine")


def _plain(text: str) -> list[str]:
    """The tokens of a template, as tokens() gives them."""
    return [t for t in re.split(r"[^\w.]+|_|\.(?![0-9])", text.lower()) if t]


def licences(pages: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """page_id, licence, origin ("own", "inherited" or "none"), from_path and cosine for every row of pages(page_id, url, html).

    Of several statements on a page headers, tags and whole texts count before notices, then the most similar, then the
    first.  Where several pages state a licence for one
    path, the most similar counts, then the first name.  Null html states nothing, a null url is an empty path that
    inherits and bequeaths nothing; null and repeated ids are kept row by row.  Other columns aren't read.  No rows: an
    empty result.  A path that many pages share is one row before it is joined.
    """
    # rows that repeat in all of these have the same statements
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), path_of(F.col("url")).alias("path"), "html",
        F.xxhash64(F.col("page_id").cast("long"), "url", "html").alias("row"))
    own = scratch.save(statements(rows.select("row", "html").where("html is not null"), settings, scratch), "statements")
    given = scratch.save(rows.select("row", "page_id", "path").join(own, "row", "left"), "given")
    roots = given.where(F.col("licence").isNotNull() & (F.col("path") != "")).groupBy(covered(F.col("path")).alias("above")).agg(
        F.max(F.struct("cosine", "licence")).alias("top"), F.min("licence").alias("first"))
    best = given.where("licence is not null").select(covered(F.col("path")).alias("above"), "cosine", "licence").join(
        roots.select("above", F.col("top.cosine").alias("cosine")), ["above", "cosine"])
    best = best.groupBy("above", "cosine").agg(F.min("licence").alias("licence"))
    without = given.where(F.col("licence").isNull() & (F.col("path") != ""))
    parts = F.split("path", "/")
    # one row for each path without statement and each folder above it
    above = without.select("path").distinct().select("path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above"))
    nearest = above.join(best, "above").groupBy("path").agg(
        F.max(F.struct(F.length("above").alias("depth"), "above", "licence", "cosine")).alias("near"))
    taken = without.select("page_id", "path").join(nearest, "path", "left").select(
        "page_id", "near.licence", F.when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("near.above").alias("from_path"), "near.cosine")
    stated = given.where("licence is not null").select(
        "page_id", "licence", F.lit("own").alias("origin"), covered(F.col("path")).alias("from_path"), "cosine")
    bare = given.where(F.col("licence").isNull() & (F.col("path") == "")).select(
        "page_id", "licence", F.lit("none").alias("origin"), F.lit(None).cast("string").alias("from_path"), "cosine")
    return stated.unionByName(taken).unionByName(bare)
