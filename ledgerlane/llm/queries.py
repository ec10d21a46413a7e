"""The registered queries of this package: operators with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import alignment, decontaminate, divergence, hilbert, licences, near_dup, packing, personal, quality
from ledgerlane.llm import quotes, search, simhash, token_counts
from ledgerlane.llm.tables import read, scratch

SHARDS = 24
TOKEN_LIMIT = 4096
QUALITY_SCORE = 0.3


def byte_vocabulary() -> packing.Vocabulary:
    path = public_tokenizers.path
    return packing.Vocabulary(
        path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scored(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), quality.Settings(), QUALITY_SCORE)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = search.scaled(read(spark, sf_dir, "embeddings"), 256)
    return search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.sharded(read(spark, sf_dir, "documents"), SHARDS, scratch(spark, "op3"))


def op4_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(
        read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(read(spark, sf_dir, "pages"), licences.Settings(), scratch(spark, "op5"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        read(spark, sf_dir, "documents"), byte_vocabulary(), packing.Limits(), scratch(spark, "op6"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(read(spark, sf_dir, "conversations"), scratch(spark, "op7"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), decontaminate.Settings())


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read(spark, sf_dir, "documents"), near_dup.Settings(), scratch(spark, "op9"))
    return found.drop("row")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(read(spark, sf_dir, "documents"), personal.Settings(), scratch(spark, "op10"))
    return personal.digest(found)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"), divergence.Settings(), scratch(spark, "op11"))


def tokenizer_files() -> alignment.Settings:
    path = public_tokenizers.path
    return alignment.Settings(
        path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"), tokenizer_files(), scratch(spark, "op12"))


def op13_simhash_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), simhash.Settings(), scratch(spark, "op13"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_ftrl_quality, op2_segment_search, op3_hilbert_shards, op4_prefix_counts, op5_licence_scan,
        op6_vector_packing, op7_quotation_links, op8_cgk_decontamination, op9_circulant_minhash, op10_personal_data,
        op11_source_divergence, op12_token_alignment, op13_simhash_planes, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op2_segment_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                   translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), w AS (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), own AS (
            SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
        ), kept AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
        ), sums AS (
            SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM own JOIN kept USING (lang, term) GROUP BY ALL
        ), langs AS (
            SELECT d.lang, COALESCE(s.n, 0) AS n, COALESCE(s.v, 0) AS v
            FROM (SELECT DISTINCT lang FROM d) d
            LEFT JOIN (SELECT lang, CAST(sum(n) AS HUGEINT) AS n, CAST(count(*) AS HUGEINT) AS v FROM sums GROUP BY lang) s USING (lang)
        ), totals AS (
            SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM own JOIN kept USING (lang, term) GROUP BY ALL
        ), grp AS (
            SELECT g.lang, g.source, COALESCE(t.n, 0) AS n, l.n AS lang_n, l.v
            FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
        ), shares AS (
            SELECT g.lang, g.source, k.term, COALESCE(o.n, 0) AS n,
                   1 + (1000000000 * (COALESCE(o.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS p,
                   1 + (1000000000 * (s.n + 5)) // (g.lang_n + 5 * g.v) AS q
            FROM grp g JOIN kept k USING (lang) JOIN sums s USING (lang, term)
            LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
        ), met AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, CAST(COALESCE(m.value, 0) AS BIGINT) AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
        ), term AS (
            SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q
        ), both_parts AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL
            SELECT lang, source, 'term' AS part, item, value FROM term
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
        )
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
