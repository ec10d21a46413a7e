"""Exact search for the largest inner products with segment statistics at several resolutions.

A vector is cut into 1, 2, 4, ... segments.  With means m and deviations s of the segments of length w,

    |q - x|**2 >= sum w * ((mq - mx)**2 + (sq - sx)**2),    that is    q.x <= sum w * (mq * mx + sq * sx),

and each finer cut only tightens the bound.  Candidates that a coarse bound rules out never reach the finer ones;
exact products are taken of what is left.  The least score that must be beaten comes from exact products of the candidates
with the best finest bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and candidates that meet in one task at most (on average; blocks are dealt by hash).
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Candidates are dealt into so many blocks at least, so that small inputs use all tasks.
LEAST_BLOCKS = 24
#: Queries whose bounds are worked out at once.
STEP = 64
#: Products of such numbers are exact as 64-bit sums over 2**20 components.
GREATEST = 2.0 ** 21


def statistics(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length, side by side."""
    edges = np.linspace(0, vectors.shape[1], parts + 1).astype(int)
    columns = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            own = vectors[:, a:b]
            columns += [own.mean(axis=1) * np.sqrt(b - a), own.std(axis=1) * np.sqrt(b - a)]
    return np.stack(columns, axis=1)


def levels(dimension: int) -> list[int]:
    """1, 4, 16, ... segments, of four components at least."""
    return [p for p in (4 ** k for k in range(12)) if p == 1 or 4 * p <= dimension]


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k best candidates' ids and exact scores, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    floats, cuts = vectors.astype(float), levels(vectors.shape[1])
    theirs = [statistics(floats, p) for p in cuts]
    for first in range(0, len(queries), STEP):
        own = queries[first:first + STEP]
        ours = [statistics(own.astype(float), p) for p in cuts]
        coarse = ours[0] @ theirs[0].T
        for row, query in enumerate(own):
            others = np.flatnonzero(ids != query_ids[first + row])
            alive = others
            if len(others) > k:
                # exact scores of a few promising candidates give a score that must be reached
                probe = others[np.argpartition(-coarse[row, others], min(4 * k, len(others) - 1))[:4 * k]]
                reach = np.sort(vectors[probe] @ query)[-k]
                slack = 1e-9 * (1 + abs(float(reach)) + np.abs(coarse[row]).max())
                alive = others[coarse[row, others] >= reach - slack]
                for level in range(1, len(cuts)):
                    if len(alive) <= k:
                        break
                    bounds = theirs[level][alive] @ ours[level][row]
                    best = alive[np.argpartition(-bounds, k - 1)[:k]]
                    reach = max(reach, (vectors[best] @ query).min())
                    alive = alive[bounds >= reach - slack]
            scores = vectors[alive] @ query
            top = np.lexsort((ids[alive], -scores))[:k]
            yield int(query_ids[first + row]), ids[alive][top], scores[top]


def scaled(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and the whole-number vector; rows whose vector is null or has null or non-finite components are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        embeddings.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"),
                F.transform(x, lambda c: F.floor(c * scale)).alias("vector"))
        .where(F.size("vector") > 0)
    )


def top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products for each row that is a query.

    ``vectors`` has vec_id and vector (array of long).  A query's own rows (equal vec_id) are no candidates of its own; other
    equal vectors are.  Only vectors of the same length are compared.  Fewer than k candidates: all of them.  Repeated
    rows of one vec_id count each; a query given twice is answered once, for its first vector by order.  No vectors: no rows.

    Queries in blocks meet candidates in blocks: each pair of blocks is a task's group, sized by row counts.  Every group
    gives at most k rows a query, and the best of those are the result.
    """
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-m // QUERY_BLOCK)), max(LEAST_BLOCKS, -(-n // CANDIDATE_BLOCK))
    # the keys of both sides are of one type: groups are met by the hash of their keys
    block = lambda of, n: F.pmod(of, F.lit(n)).cast("int")
    own = F.xxhash64("vec_id", F.lit(3))
    asked = queries.select(
        F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("dim"),
        block(own, rows).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    # the row's own contents deal it, so that one repeated id isn't one block
    given = vectors.select(
        "vec_id", "vector", F.size("vector").alias("dim"),
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"),
        block(F.xxhash64("vec_id", F.monotonically_increasing_id()), columns).alias("column"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            a, b = np.stack(left["vector"].tolist()), np.stack(right["vector"].tolist())
            if max(np.abs(a.astype(float)).max(), np.abs(b.astype(float)).max()) >= GREATEST:
                a, b = a.astype(object), b.astype(object)
            found = best_of_block(left["query_id"].to_numpy(), a, right["vec_id"].to_numpy(), b, k)
            out = [pd.DataFrame({"query_id": q, "vec_id": ids, "score": s.astype(np.int64)}) for q, ids, s in found]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["row", "column", "dim"]
    near = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
