"""From questions to table cards: filtered hybrid search, rerank, lookup of cards, core, expansion along foreign keys.

Every step works on all questions at once and keeps at most k rows a question, so what travels between steps grows with the
questions, not with the catalog. A question's schemas are applied before anything is scored: blocks of postings of other schemas
stay closed, and vectors are compared within the question's schemas alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starcard.operators import expand as X
from starcard.operators import fielded as S
from starcard.operators import search as R
from starcard.operators import vectors as N
from starcard.rules import CORE_COUNT, LOOKUP_SCHEMA, MAX_TOTAL, SEED_COUNT, TOP_K
from starcard.session import shuffled, stored

#: Fields of a card's search document; names of columns are matched as they are.
CARD_FIELDS = (
    S.Field("schema_name"), S.Field("table_name", 2.0), S.Field("qualified_name"), S.Field("description"),
    S.Field("normalized_column_names"), S.Field("column_descriptions"), S.Field("searchable_content"),
    S.Field("column_names", 1.0, "keyword"),
)
#: Weights of the rerank: title before content before keywords.
RERANK_FIELDS = {
    "qualified_name": 3, "searchable_content": 2, "normalized_column_names": 2, "column_descriptions": 2, "table_name": 1, "schema_name": 1,
}


@dataclass(frozen=True)
class Settings:
    top_k: int = TOP_K
    core_count: int = CORE_COUNT
    seed_count: int = SEED_COUNT
    max_total: int = MAX_TOTAL
    expansion: bool = True
    reverse: bool = False
    hybrid: bool = True
    lookup_schema: str = LOOKUP_SCHEMA
    rerank_fields: dict[str, int] = field(default_factory=lambda: dict(RERANK_FIELDS))


def hybrid_search(index: S.FieldedIndex, vectors: DataFrame, documents: DataFrame, questions: DataFrame, settings: Settings) -> DataFrame:
    """query_id, doc_id, rank of the ``top_k`` documents: text and vector lists, fused, then reranked.

    ``questions``: query_id, text, schemas, vector. ``documents``: doc_id and the rerank's fields. ``vectors``: doc_id, vector, schema.
    """
    k = settings.top_k
    lists = [S.search(index, questions.select("query_id", "text", "schemas"), k)]
    if settings.hybrid:
        lists.append(N.knn_within(questions.select("query_id", "vector", "schemas"), vectors, k))
    hits = stored(R.fuse(*lists, k=k), "fused-hits")
    return R.rerank(hits, documents, questions.select("query_id", "text"), settings.rerank_fields, k).select("query_id", "doc_id", "rank")


def retrieve_cards(
    index: S.FieldedIndex, vectors: DataFrame, documents: DataFrame, cards: DataFrame, edges: DataFrame, questions: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """query_id, pos, name, kind (core, lookup, other, all): the cards that answer each question.

    ``cards``: name, schema of all cards there are. ``documents``: doc_id, name and the rerank's fields, one per indexed card. Hits
    whose card is gone are left out before the core is cut. A question without any hit gets all cards of its schemas,
    alphabetically and beyond any cap; without schemas that is one row named "*", to be resolved on use. A question without text
    gets nothing, and so does an empty list of schemas.
    """
    asked = questions.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    asked = stored(asked.select("query_id", "text", "schemas", "vector"), "questions")
    hits = stored(hybrid_search(index, vectors, documents, asked, settings), "hits")
    named = hits.join(shuffled(documents.select("doc_id", "name")), "doc_id").join(shuffled(cards.select("name")), "name", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")  # at most top_k rows a question
    core = named.withColumn("rank", F.row_number().over(order)).select("query_id", "name", "rank")
    core = stored(R.core_slice(core, settings.core_count), "core-cards")
    found = X.expand(
        core, edges, cards, settings.seed_count, settings.max_total, settings.reverse, settings.expansion, settings.lookup_schema, asked
    )
    missed = asked.join(shuffled(hits.select("query_id").distinct()), "query_id", "left_anti")
    whole = missed.select("query_id", F.explode(F.array_distinct("schemas")).alias("schema")).join(shuffled(cards.select("schema", "name")), "schema")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("name"))  # the cards of a few schemas
    kind = F.lit("all").alias("kind")
    return (
        found.select("query_id", "pos", "name", "kind")
        .unionByName(whole.select("query_id", place.alias("pos"), "name", kind))
        .unionByName(missed.filter(F.col("schemas").isNull()).select("query_id", F.lit(1).alias("pos"), F.lit("*").alias("name"), kind))
    )
