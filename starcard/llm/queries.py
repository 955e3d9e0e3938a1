"""The operators bound to ``documents``, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcard.llm.deleted_interpolation import score_corpus
from starcard.llm.exact_dedup import exact_groups
from starcard.llm.language_id import identify
from starcard.llm.line_dedup import line_report
from starcard.llm.mixing import label_domains, mix
from starcard.llm.packing import pack_documents
from starcard.llm.prefix_trie import conversation_trie
from starcard.llm.secrets import scan
from starcard.llm.sentencepieces import round_trip
from starcard.llm.simhash import near_groups
from starcard.llm.sketches import fingerprint_edits
from starcard.llm.suffix_dedup import remove_repeats
from starcard.llm.whitening import whiten

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_CHECKS[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@_query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_documents(spark, folder)).drop("kept")


@_query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_documents(spark, folder))


@_query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256,
           CAST(octet_length(encode(norm)) AS BIGINT) AS n_bytes
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
    WINDOW same AS (PARTITION BY norm)
    """,
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_documents(spark, folder))


@_query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_corpus(_documents(spark, folder))


@_query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(_documents(spark, folder))


@_query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(_documents(spark, folder))


#: Target shares of tokens: no toxic text, and rough text about as it comes.
WEIGHTS = {"clean": 0.88, "rough": 0.12, "toxic": 0.0}


@_query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    labels = label_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    rated, model = mix(_documents(spark, folder).select("doc_id", "text"), labels, WEIGHTS)
    of = [F.col("_mix.p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    fitted = [F.lit(x).alias(f"{n}_{d}") for d, both in (model.reached or {}).items() for n, x in zip(("target", "reached"), both, strict=True)]
    return rated.select("doc_id", F.col("_mix.tokens").alias("n_tokens"), *of, "_mix.rate", "_mix.copies", *fitted)


@_query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(_documents(spark, folder))


@_query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(_documents(spark, folder))


@_query("op10_sentencepiece_round_trip")
def op10_sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(_documents(spark, folder))


@_query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@_query("op12_cost_balanced_packing")
def op12_cost_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_documents(spark, folder))


#: crc32 of a text's bytes, a bit at a time: DuckDB has no such function.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))
))"""


@_query(
    "op13_conversation_prefix_trie",
    f"""
    WITH turn AS (
        SELECT conv_id, turn, sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS hash,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hash) AS rank FROM turn
    ), conv AS (
        SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("(conv_id::VARCHAR)")} % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turn)
    ), begun AS (
        SELECT c.conv_id, r.rank, 0 AS part, r.hash, r.words FROM conv c JOIN ranked r ON r.conv_id = c.base AND r.rank <= c.h
        UNION ALL
        SELECT c.conv_id, r.rank, 1, r.hash, r.words FROM conv c JOIN ranked r ON r.conv_id = c.conv_id AND r.rank > c.h
    ), seq AS (
        SELECT conv_id, hash, words, row_number() OVER turns AS depth, count(*) OVER (PARTITION BY conv_id) AS total,
               string_agg(hash, '') OVER (turns ROWS UNBOUNDED PRECEDING) AS prefix
        FROM begun WINDOW turns AS (PARTITION BY conv_id ORDER BY part, rank)
    ), member AS (
        SELECT conv_id, prefix, depth, words, depth = total AS last FROM seq
        UNION ALL
        SELECT conv_id, '', 0, 0, conv_id NOT IN (SELECT conv_id FROM seq) FROM conv
    ), node AS (
        SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
        FROM member GROUP BY prefix, depth
    ), child AS (
        SELECT left(prefix, -64) AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
    )
    SELECT any_value(n.conv_id) AS conv_id, any_value(n.depth) AS depth, any_value(p.conv_id) AS parent_conv_id,
           any_value(n.n_convs) AS n_convs, coalesce(any_value(c.n), 0) AS n_children,
           CAST(sum(CASE WHEN e.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
           CAST(sum((s.n_convs - 1) * s.words) AS BIGINT) AS saved_tokens, any_value(n.ends_sha256) AS ends_sha256
    FROM node n JOIN node s ON starts_with(s.prefix, n.prefix) LEFT JOIN child c ON c.prefix = n.prefix
         LEFT JOIN child e ON e.prefix = s.prefix LEFT JOIN node p ON n.depth > 0 AND p.prefix = left(n.prefix, -64)
    GROUP BY n.prefix
    """,
)
def op13_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{folder}/conversations.parquet"))
