"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import chat, exact_dedup, flac, html_extract, language_id, licenses, mixing, near_join, packing, quality
from foliospark.llm.runtime import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.Join(table(spark, sf_dir, "documents")).summary()


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(table(spark, sf_dir, "documents"), WEIGHTS).schedule()


def op7_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.decode_media(flac.media_of(table(spark, sf_dir, "embeddings")))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, near=near_join.Join(docs).groups())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Target weights; every other source has 1.
WEIGHTS = {"src0": 4.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scans": op5_license_scans,
    "op6_mixing_weights": op6_mixing_weights,
    "op7_media_flac": op7_media_flac,
    "op8_bestfit_packing": op8_bestfit_packing,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), p AS (
            SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
                string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
            FROM t
        ), w AS (
            SELECT conv_id, max(pos) AS n_turns, string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
            FROM t GROUP BY conv_id
        ), g AS (
            SELECT prefix, max(n) AS most, min(CASE WHEN n = pos THEN conv_id END) AS first FROM p GROUP BY prefix, pos
        )
        SELECT w.conv_id, w.n_turns, w.rendered
        FROM w JOIN p ON p.conv_id = w.conv_id AND p.pos = w.n_turns JOIN g USING (prefix)
        WHERE g.most = w.n_turns AND g.first = w.conv_id
    """,
    "op6_mixing_weights": r"""
        WITH t AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '\S+')) AS BIGINT) AS tokens, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents
        ), v AS (
            SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CASE WHEN source = 'src0' THEN CAST(4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS finish FROM t
        ), r AS (
            SELECT *, sum(tokens) OVER (ORDER BY finish, draw, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS run FROM v
        )
        SELECT doc_id, source, tokens, finish FROM r WHERE run <= (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) FROM t)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM documents
        QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
    """,
}
