"""Registered queries of the subpackage: name -> function of (spark, sf_dir),
and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import (
    bpe, decontaminate, exact_dedup, html_extract, langid, licenses, lm_scoring, periodic, quality, secret_scan,
    simhash, token_counts, vector_codes,
)
from loanlens.llm.common import read_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train_model(pages))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(
        token_counts.length_histogram(read_table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.learn(docs))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(*vector_codes.compress(read_table(spark, sf_dir, "embeddings")))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.find_runs(
        read_table(spark, sf_dir, "documents"), prepare=periodic.planted_words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_byte_bpe, op3_html_extraction, op4_token_counts, op5_language_id,
        op6_exact_dedup, op7_license_scan, op8_quality_resampling, op9_simhash, op10_secret_scan,
        op11_vector_codes, op12_lm_scoring, op13_periodic_runs)
}


def vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES,
                     rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """The rounds of ``vector_codes.compress`` one after the other: every part
    against every entry. Numbers are whole and below 2^53, so sums of doubles are
    exact; ``dist * entries + entry`` orders by distance, then index."""
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
                   list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS MATERIALIZED (
            SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x
            FROM kept, (SELECT unnest(range({parts})) AS part)),
        book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS y FROM cut WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT rid, part, min((list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y))
                                  * {entries} + entry)::BIGINT AS best
            FROM cut JOIN book{k} USING (part) GROUP BY rid, part)""")
        if k < rounds:
            steps.append(f"""
        mean{k} AS (
            SELECT part, entry, list(m ORDER BY pos) AS y
            FROM (SELECT part, best % {entries} AS entry, pos, floor(sum(x[pos]) / count(*)) AS m
                  FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS pos
                        FROM near{k} JOIN cut USING (rid, part))
                  GROUP BY part, entry, pos)
            GROUP BY part, entry),
        book{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.y, b.y) AS y
            FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
        WITH {','.join(steps)},
        coded AS (
            SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code,
                   sum(best // {entries})::BIGINT AS error
            FROM near{rounds} GROUP BY rid),
        digest AS (
            SELECT coalesce(sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)), '') AS d
            FROM (SELECT part, entry, unnest(y) AS c, unnest(range(len(y))) AS pos FROM book{rounds}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               d AS codebooks_sha256
        FROM kept JOIN coded USING (rid), digest"""

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
              FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op11_vector_codes": vector_codes_sql(),
}
