"""Rank lists of many queries at once: the best per query, fusion, rerank, lookup, fallback. The index itself is in ``fielded``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcard.functions.text import tokens
from starcard.rules import CORE_COUNT, RRF_K, TOP_K
from starcard.session import shuffled


def best(scored: DataFrame, k: int, key: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best items per query; ties go to the smaller id. Cut to k before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(*lists: DataFrame, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rank lists (query_id, doc_id, rank)."""
    one = lists[0].select("query_id", "doc_id", "rank")
    for other in lists[1:]:
        one = one.unionByName(other.select("query_id", "doc_id", "rank"))
    scored = one.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score")
    )
    return best(scored, k).select("query_id", "doc_id", "score", "rank")


def rerank(
    hits: DataFrame, docs: DataFrame, queries: DataFrame, fields: dict[str, int], k: int = TOP_K
) -> DataFrame:
    """Reorder hits by weighted overlap of query terms with document fields, then by old rank."""
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    # only documents that are hits are tokenized, each once
    found = docs.join(hits.filter(F.col("rank") <= k).select("doc_id").distinct(), "doc_id", "left_semi")
    fielded = found.select(
        "doc_id", *[F.array_distinct(tokens(F.col(f))).alias(f"_{f}") for f in fields]
    )
    score = sum(
        (F.size(F.array_intersect("q", f"_{f}")) * weight for f, weight in fields.items()), F.lit(0)
    )
    joined = hits.filter(F.col("rank") <= k).join(fielded, "doc_id").join(terms, "query_id")
    scored = joined.select("query_id", "doc_id", F.col("rank").alias("old_rank"), score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "old_rank")
    return scored.withColumn("rank", F.row_number().over(order))


def core_slice(ranked: DataFrame, count: int = CORE_COUNT) -> DataFrame:
    return ranked.filter(F.col("rank") <= count)


def look_up(hits: DataFrame, cards: DataFrame, on: str) -> DataFrame:
    """Hits in rank order with ``found``: hits without a card stay visible as found = false."""
    have = cards.select(on).distinct().withColumn("found", F.lit(True))
    return hits.join(have, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_fallback(queries: DataFrame, hits: DataFrame, cards: DataFrame, schema: str = "owner") -> DataFrame:
    """Hits, and for a query without any the whole catalog of its schema.

    ``queries``: query_id, schema. ``hits``: query_id, qualified_name. ``cards``: schema,
    qualified_name. The catalog is joined by schema, so the result is as long as what is returned.
    """
    missed = queries.join(shuffled(hits.select("query_id").distinct()), "query_id", "left_anti")
    rest = missed.join(shuffled(cards), schema).select("query_id", "qualified_name", F.lit("all").alias("how"))
    return hits.select("query_id", "qualified_name", F.lit("hit").alias("how")).unionByName(rest)


def card_hits(queries: DataFrame, cards: DataFrame, text: Column, schema: str = "owner") -> DataFrame:
    """Cards of a query's schema that share a term with it."""
    words = queries.select(
        "query_id", schema, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")
    )
    held = cards.select(schema, "qualified_name", F.explode(F.array_distinct(tokens(text))).alias("term"))
    return words.join(shuffled(held), [schema, "term"]).select("query_id", "qualified_name").distinct()
