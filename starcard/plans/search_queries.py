"""Search and foreign-key expansion queries over documents, embeddings and the star tables."""

from __future__ import annotations

from collections import Counter
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starcard.functions.text import fk_table, tokens
from starcard.operators import cards as C
from starcard.operators import catalog as K
from starcard.operators import expand as X
from starcard.operators import fielded as S
from starcard.operators import quantized as Z
from starcard.operators import retrieval as V
from starcard.operators import search as R
from starcard.operators import vectors as N
from starcard.operators.segments import dense_number, running_sums
from starcard.plans.catalog_queries import CARD_PARTS, DOC_SQL, _cat, _fk_map, cards
from starcard.plans.readonly import run_readonly
from starcard.plans.registry import query, table
from starcard.plans.tenants import FK_SQL, LOOKUPS, cat_columns, cat_tables
from starcard.rules import STOP_WORDS, TOKEN
from starcard.session import cut, kept_path, scratch_path, stored
from starcard.sources.files import content_name

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _words_sql(name: str, source: str, key: str, text: str = "text") -> str:
    return f"""{name} AS (SELECT * FROM (
      SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS term FROM {source})
      WHERE term NOT IN ({_STOPS}))"""


def _stems_sql(name: str, source: str, key: str, text: str) -> str:
    """(key, term): stems of the tokens of ``text``."""

    def ends(*endings: str) -> str:
        return "(" + " OR ".join(f"ends_with(w, '{e}')" for e in endings) + ")"

    return f"""{name} AS (SELECT * FROM (
      SELECT {key}, CASE WHEN {ends('ies')} AND NOT {ends('eies', 'aies')} THEN left(w, len(w) - 3) || 'y'
        WHEN {ends('es')} AND NOT {ends('aes', 'ees', 'oes')} THEN left(w, len(w) - 1)
        WHEN {ends('s')} AND NOT {ends('us', 'ss')} THEN left(w, len(w) - 1) ELSE w END AS term
      FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS w FROM {source}) WHERE w NOT IN ({_STOPS}))
      WHERE term <> '')"""


def _fielded_sql(fields: tuple[S.Field, ...], source: str, key: str, asked: str, questions: str = "") -> str:
    """CTEs that score ``source`` (key, a column per field) for the questions ``asked`` (query_id, text): posts, lens, dfs, scored.

    ``questions``: CTEs that may use the counts, for questions made of them.
    """
    english = [f for f in fields if f.analyzer == "english"]
    words = [_stems_sql(f"w_{f.name}", source, key, f.name) for f in english]
    words += [
        f"w_{f.name} AS (SELECT * FROM (SELECT {key}, '=' || unnest({f.name}) AS term FROM {source}) WHERE term IS NOT NULL)"
        for f in fields if f.analyzer == "keyword"
    ]
    each = " UNION ALL ".join(f"SELECT {key}, term, '{f.name}' AS f FROM w_{f.name}" for f in fields)
    tf = ", ".join(f"count(*) FILTER (f = '{f.name}') AS tf_{f.name}" for f in fields)
    lens = ", ".join(f"count(*) FILTER (f = '{f.name}') AS len_{f.name}" for f in fields)
    means = ", ".join(
        f"(SELECT greatest(count(*) / (SELECT count(*) FROM {source}), 1e-9) FROM w_{f.name}) AS mean_{f.name}" for f in fields
    )
    weight = " + ".join(f"{f.weight} * tf_{f.name} / (1 - {f.b} + {f.b} * len_{f.name} / mean_{f.name})" for f in fields)
    whole = f"UNION SELECT query_id, '=' || text FROM {asked}" if len(english) < len(fields) else ""
    return f"""{', '.join(words)},
each AS ({each}),
lens AS (SELECT {key}, {lens} FROM each GROUP BY 1),
posts AS (SELECT {key}, term, {tf} FROM each GROUP BY 1, 2),
stats AS (SELECT (SELECT count(*) FROM {source}) AS n, {means}),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
{questions}
{_stems_sql('qwords', asked, 'query_id', 'text')},
qterms AS (SELECT DISTINCT query_id, term FROM qwords {whole}),
parts AS (
  SELECT query_id, {key}, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, {weight} AS x
  FROM qterms JOIN posts USING (term) JOIN dfs USING (term) JOIN lens USING ({key}), stats
),
scored AS (SELECT query_id, {key}, round(sum(idf * x * 2.2 / (x + 1.2)), 6) AS score FROM parts GROUP BY 1, 2)"""


#: Documents by two fields; what stands in the title stands in the text as well.
TITLE_WORDS = 8
DOC_FIELDS = (S.Field("title", 2.0, b=0.5), S.Field("text", 1.0))
INDEX_SQL = f"""
titled AS (SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, {TITLE_WORDS}), ' ') AS title, text FROM documents),
asked AS (SELECT item_id AS query_id, text FROM benchmark),
{_fielded_sql(DOC_FIELDS, 'titled', 'doc_id', 'asked')}"""

BM25_SQL = f"""{INDEX_SQL},
bm AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
  WHERE rank <= 50
)"""

KNN_SQL = """
kn AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT b.item_id AS query_id, v.vec_id AS doc_id,
             round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
      FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v))
  WHERE rank <= 50
)"""

RRF_SQL = """
rrf AS (
  SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score
      FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM kn)
      GROUP BY 1, 2))
  WHERE rank <= 50
)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")
    )


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark text's query vector is the embedding of the same number."""
    vectors = _vectors(spark, d).withColumnRenamed("doc_id", "query_id")
    return vectors.join(_texts(spark, d).select("query_id"), "query_id", "left_semi")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    title = F.array_join(F.slice(F.split("text", " "), 1, TITLE_WORDS), " ")
    return _docs(spark, d).select("doc_id", title.alias("title"), "text")


def _built(spark: SparkSession, d: str, path: str) -> S.FieldedIndex:
    return S.add_documents(S.create_index(spark, path, DOC_FIELDS), _titled(spark, d))


def _index(spark: SparkSession, d: str) -> S.FieldedIndex:
    """The index of the documents, kept under a name made of their files: changed files are another index."""
    path = kept_path(spark, f"index-{content_name(spark, f'{d}/documents.parquet')}")
    index = S.open_index(spark, path) if S.is_index(spark, path) else None
    return index if index is not None and index.segments else _built(spark, d, path)


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_index(spark, d), _texts(spark, d))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    near = N.knn(_asked_vectors(spark, d), _vectors(spark, d))
    return R.fuse(_bm25(spark, d), near)


@query(
    "inverted_index",
    f"""WITH {INDEX_SQL} SELECT doc_id, term, tf_title, tf_text, len_title, len_text FROM posts JOIN lens USING (doc_id)""",
)
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings of both fields, as an index built now holds them."""
    rows = S.postings(_built(spark, d, scratch_path(spark, "index")), spark)
    each = [F.get(a, F.lit(i)).cast("long").alias(f"{n}_{f.name}") for a, n in (("tf", "tf"), ("lens", "len")) for i, f in enumerate(DOC_FIELDS)]
    return rows.select("doc_id", "term", *each)


@query("bm25_topk", f"WITH {BM25_SQL} SELECT * FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


@query("knn_exact", f"WITH {KNN_SQL} SELECT * FROM kn")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return N.knn(_asked_vectors(spark, d), _vectors(spark, d))


@query(
    "knn_ann",
    """SELECT item_id AS query_id, (SELECT least(50, count(*)) FROM embeddings) AS hits, true AS recall_reached
       FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)""",
)
def knn_ann(spark: SparkSession, d: str) -> DataFrame:
    """Hits per query on compressed vectors, and whether they hold nine tenths of the exact ones over all queries."""
    asked, vectors = _asked_vectors(spark, d), _vectors(spark, d)
    near = cut(Z.search(Z.fit(vectors, scratch_path(spark, "quantized")), asked))
    exact = N.knn(asked, vectors).select("query_id", "doc_id")
    reached = near.join(exact, ["query_id", "doc_id"]).count() >= 0.9 * exact.count()
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits")).withColumn("recall_reached", F.lit(reached))


@query("rrf_fusion", f"WITH {BM25_SQL}, {KNN_SQL}, {RRF_SQL} SELECT * FROM rrf")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query("core_slice", f"WITH {BM25_SQL}, {KNN_SQL}, {RRF_SQL} SELECT * FROM rrf WHERE rank <= 10")
def core_slice(spark: SparkSession, d: str) -> DataFrame:
    return R.core_slice(_fused(spark, d))


@query(
    "rank_lookup",
    f"""WITH {BM25_SQL}, {KNN_SQL}, {RRF_SQL}
        SELECT query_id, doc_id, rank, doc_id IN (SELECT doc_id FROM labels) AS found FROM rrf""",
)
def rank_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d).select("query_id", "doc_id", "rank")
    return R.look_up(hits, table(spark, d, "labels"), "doc_id")


FIELD_WEIGHTS = {"source": 3, "text": 2, "lang": 1}


def _overlap_sql(field: str) -> str:
    return f"""len(list_intersect(q, list_filter(list_distinct(regexp_extract_all(lower({field}), '{TOKEN}')),
               lambda x: x NOT IN ({_STOPS}))))"""


@query(
    "field_rerank",
    f"""WITH {BM25_SQL}, {_words_sql('plain', 'asked', 'query_id')},
        lists AS (SELECT query_id, list(DISTINCT term) AS q FROM plain GROUP BY 1)
        SELECT query_id, doc_id, old_rank, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank
        FROM (SELECT query_id, doc_id, rank AS old_rank,
                CAST({' + '.join(f'{w} * {_overlap_sql(f)}' for f, w in FIELD_WEIGHTS.items())} AS INTEGER) AS score
              FROM bm JOIN documents USING (doc_id) JOIN lists USING (query_id))""",
)
def field_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = stored(_bm25(spark, d), "hits")  # read twice
    return R.rerank(hits, table(spark, d, "documents"), _texts(spark, d), FIELD_WEIGHTS)


_TOP_SQL = """top AS (SELECT term FROM dfs ORDER BY df DESC, term LIMIT 1),
asked AS (SELECT 0 AS query_id, term AS text FROM top),"""
_FRESH_SQL = """
fresh AS (
  SELECT doc_id, title, text FROM titled WHERE doc_id % 10 <> 3
  UNION ALL SELECT doc_id, title, 'again ' || title FROM titled WHERE doc_id % 10 = 4
), kept AS (SELECT * FROM fresh WHERE NOT (doc_id % 10 = 4 AND text NOT LIKE 'again %'))"""


@query(
    "index_stats",
    f"""WITH titled AS (SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, {TITLE_WORDS}), ' ') AS title, text
                        FROM documents), {_FRESH_SQL},
          {_fielded_sql(DOC_FIELDS, 'kept', 'doc_id', 'asked', _TOP_SQL)},
          three AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 3)
        SELECT (SELECT term FROM top) AS sample_word,
          (SELECT string_agg(doc_id, ',' ORDER BY score DESC, doc_id) FROM three) AS sample_hits,
          (SELECT count(*) FROM kept) AS n_docs, (SELECT count(*) FROM titled WHERE doc_id % 10 = 5) + 25 AS failed,
          (SELECT count(*) FROM posts) AS n_postings, (SELECT count(*) FROM w_title) AS title_tokens,
          (SELECT count(*) FROM w_text) AS text_tokens, (SELECT count(DISTINCT term) FROM posts) AS n_terms""",
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """An index after upkeep: a tenth of the documents deleted, a tenth replaced; of the uploads repeated ids and rows without an id fail."""
    rows, tenth = _titled(spark, d), F.col("doc_id") % 10
    twice = rows.filter(tenth == 5)
    lost = table(spark, d, "nation").select(F.lit(None).cast("long").alias("doc_id"), F.col("n_name").alias("title"), F.col("n_name").alias("text"))
    index = S.create_index(spark, scratch_path(spark, "index"), DOC_FIELDS)
    index = S.add_documents(index, rows.unionByName(twice).unionByName(lost))
    again = rows.filter(tenth == 4).withColumn("text", F.concat(F.lit("again "), "title"))
    index = S.delete_documents(S.add_documents(index, again), rows.filter(tenth == 3).select("doc_id"))
    counts = S.statistics(index, spark, sample=3)
    return counts.select(
        "sample_word", "sample_hits", "n_docs", "failed", "n_postings", F.get("n_tokens", F.lit(0)).alias("title_tokens"),
        F.get("n_tokens", F.lit(1)).alias("text_tokens"), "n_terms",
    )


def letter_classes(texts: list[str]) -> list[list[float]]:
    """An embedder that SQL can repeat: counts of vowels, digits, spaces and capitals per text."""
    kinds = [set("aeiou"), set("0123456789"), {" "}, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    return [[float(sum(n for c, n in Counter(t).items() if c in kind)) for kind in kinds] for t in texts]


def _count_sql(kind: str) -> str:
    return f"CAST(length(text) - length(regexp_replace(text, '{kind}', '', 'g')) AS DOUBLE)"


@query(
    "embed_batches",
    f"""SELECT doc_id, [{', '.join(_count_sql(k) for k in ('[aeiou]', '[0-9]', ' ', '[A-Z]'))}] AS vector
        FROM documents""",
)
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    return N.embed_batches(_docs(spark, d), letter_classes)


# --- catalog search -----------------------------------------------------------------------------

CARD_TEXT_SQL = "coalesce(any_value(table_description), '')"


@query(
    "empty_search_fallback",
    _cat(
        f"""SELECT query_id, qualified_name, 'hit' AS how FROM hits
            UNION ALL
            SELECT a.query_id, h.qualified_name, 'all' FROM asked a JOIN heads h USING (owner)
            WHERE a.query_id NOT IN (SELECT query_id FROM hits)""",
        *CARD_PARTS,
        f"heads AS (SELECT owner, qualified_name, {CARD_TEXT_SQL} AS text FROM card GROUP BY 1, 2)",
        "asked AS (SELECT c_custkey AS query_id, 'T' || c_custkey AS owner, c_mktsegment AS text FROM customer)",
        f"""hits AS (SELECT DISTINCT query_id, qualified_name FROM asked a JOIN (
              SELECT owner, qualified_name, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM heads) h
            ON a.owner = h.owner AND lower(a.text) = h.term)""",
    ),
)
def empty_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    heads = K.table_heads(cat_tables(spark, d), cat_columns(spark, d))
    asked = table(spark, d, "customer").select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("T"), "c_custkey").alias("owner"),
        F.col("c_mktsegment").alias("text"),
    )
    heads = cut(heads.select("owner", "qualified_name", "description"))
    hits = cut(R.card_hits(asked, heads, F.col("description")))
    return R.with_fallback(asked.select("query_id", "owner"), hits, heads.drop("description"))


def _card_edges(spark: SparkSession, d: str) -> DataFrame:
    return _fk_map(spark, d).select(
        "owner", F.concat_ws(".", "owner", "table_name").alias("src"), fk_table(F.col("fk")).alias("dst")
    )


_CARD_EDGE_SQL = """
card_edges AS (
  SELECT DISTINCT owner, owner || '.' || table_name AS src,
         split_part(fk, '.', 1) || '.' || split_part(fk, '.', 2) AS dst FROM fk_map
)"""


def letter_counts(text: Column) -> Column:
    """An embedding that SQL can repeat: how often each letter occurs."""
    lower = F.lower(text)
    return F.array(*[(F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("double") for c in ascii_lowercase])


def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(len(lower({text})) - len(replace(lower({text}), '{c}', '')) AS DOUBLE)" for c in ascii_lowercase) + "]"


#: Texts that customers ask, by customer number; the third is unknown to the catalog and has no vector, the last is none.
_ASKED = ["'price of orders placed by ' || lower(c_mktsegment) || ' customers'", "'languages of the documents'", "'qqqq ' || c_custkey", "'L_SHIPDATE'", "NULL"]
_QUESTIONS_SQL = f"""
asked AS (
  SELECT c_custkey AS query_id, CASE {' '.join(f'WHEN c_custkey % 5 = {i} THEN {t}' for i, t in enumerate(_ASKED))} END AS text,
         CASE WHEN c_custkey % 7 = 3 THEN ['T' || c_custkey] ELSE ['T' || c_custkey, '{LOOKUPS}'] END AS schemas FROM customer
), known AS (SELECT * FROM asked WHERE text IS NOT NULL)"""
RETRIEVAL = V.Settings(top_k=14, core_count=8, max_total=11, lookup_schema=LOOKUPS)
GONE = ["LABELS", "PAGES"]


def _questions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        key.alias("query_id"), F.expr("CASE " + " ".join(f"WHEN c_custkey % 5 = {i} THEN {t}" for i, t in enumerate(_ASKED)) + " END").alias("text"),
        F.when(key % 7 == 3, F.array(F.concat(F.lit("T"), key))).otherwise(F.array(F.concat(F.lit("T"), key), F.lit(LOOKUPS))).alias("schemas"),
    )
    return rows.withColumn("vector", F.when(F.col("query_id") % 5 != 2, letter_counts(F.col("text"))))


def _field_column(field: S.Field) -> str:
    names = {"schema_name": "owner", "normalized_column_names": "names", "column_descriptions": "texts", "searchable_content": "content"}
    return f"{names.get(field.name, field.name)} AS {field.name}"


@query(
    "retrieve_cards",
    _cat(
        f"""SELECT query_id, pos, name, kind FROM (
              SELECT query_id, CAST(rank AS INTEGER) AS pos, name, 'core' AS kind FROM core WHERE rank <= {RETRIEVAL.max_total}
              UNION ALL
              SELECT query_id, CAST(core_n + row_number() OVER (PARTITION BY query_id ORDER BY n) AS INTEGER), name,
                     CASE WHEN starts_with(name, '{LOOKUPS}.') THEN 'lookup' ELSE 'other' END FROM real
              UNION ALL
              SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY name) AS INTEGER), name, 'all'
              FROM known JOIN there ON list_contains(schemas, schema) WHERE query_id NOT IN (SELECT query_id FROM fused))""",
        *CARD_PARTS, DOC_SQL, _CARD_EDGE_SQL,
        "listed AS (SELECT owner, table_name, list(column_name ORDER BY pos) AS column_names FROM card GROUP BY 1, 2)",
        f"""cdocs AS (SELECT row_number() OVER (ORDER BY owner, table_name) - 1 AS doc_id, owner AS schema, qualified_name AS name, content AS body,
              {', '.join(_field_column(f) for f in V.CARD_FIELDS)} FROM search_docs JOIN listed USING (owner, table_name))""",
        f"there AS (SELECT name, schema FROM cdocs WHERE table_name NOT IN ({', '.join(repr(g) for g in GONE)}))",
        _QUESTIONS_SQL,
        _fielded_sql(V.CARD_FIELDS, "cdocs", "doc_id", "known"),
        f"""bm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
              FROM scored JOIN known USING (query_id) JOIN cdocs USING (doc_id) WHERE list_contains(schemas, schema)
              QUALIFY rank <= {RETRIEVAL.top_k})""",
        f"""kn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
              SELECT query_id, doc_id, round(list_cosine_similarity({_letters_sql('k.text')}, {_letters_sql('c.body')}), 6) AS score
              FROM (SELECT query_id, text, unnest(schemas) AS schema FROM known WHERE query_id % 5 <> 2) k JOIN cdocs c USING (schema))
              QUALIFY rank <= {RETRIEVAL.top_k})""",
        f"""fused AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
              SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score
              FROM (SELECT * FROM bm UNION ALL SELECT * FROM kn) GROUP BY 1, 2) QUALIFY rank <= {RETRIEVAL.top_k})""",
        _words_sql("plain", "known", "query_id"),
        "lists AS (SELECT query_id, list(DISTINCT term) AS q FROM plain GROUP BY 1)",
        f"""reranked AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM (
              SELECT query_id, name, f.rank AS old, {' + '.join(f'{w} * {_overlap_sql(f)}' for f, w in V.RERANK_FIELDS.items())} AS score
              FROM fused f JOIN cdocs USING (doc_id) JOIN lists USING (query_id)))""",
        f"""core AS (SELECT query_id, name, place AS rank FROM (
              SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
              FROM reranked WHERE name IN (SELECT name FROM there)) WHERE place <= {RETRIEVAL.core_count})""",
        "sizes AS (SELECT query_id, count(*) AS core_n FROM core GROUP BY 1)",
        f"""near AS (SELECT DISTINCT c.query_id, dst AS name FROM core c JOIN card_edges ON src = c.name
              WHERE c.rank <= {RETRIEVAL.seed_count} AND (c.query_id, dst) NOT IN (SELECT (query_id, name) FROM core))""",
        f"""real AS (SELECT query_id, name, n, core_n FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT starts_with(name, '{LOOKUPS}.'), name) AS n FROM near)
              JOIN sizes USING (query_id) JOIN there t USING (name) JOIN known USING (query_id)
              WHERE n + core_n <= {RETRIEVAL.max_total} AND list_contains(schemas, t.schema))""",
    ),
)
def retrieve_cards(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from every customer's question to cards; two tables of every schema are indexed but have lost their card."""
    documents = C.search_documents(cards(spark, d)).withColumn("name", F.col("qualified_name"))
    documents = cut(dense_number(documents, ["schema_name", "table_name"], "doc_id", start=0))
    index = S.add_documents(S.create_index(spark, scratch_path(spark, "card-index"), V.CARD_FIELDS), documents, "schema_name")
    vectors = documents.select("doc_id", letter_counts(F.col("searchable_content")).alias("vector"), F.col("schema_name").alias("schema"))
    there = documents.filter(~F.col("table_name").isin(GONE)).select("name", F.col("schema_name").alias("schema"))
    return V.retrieve_cards(index, vectors, documents, there, _card_edges(spark, d).select("src", "dst"), _questions(spark, d), RETRIEVAL)


# --- expansion along references -----------------------------------------------------------------


def _dearest(spark: SparkSession, d: str, count: int) -> DataFrame:
    """Core list of every customer: its dearest orders."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey").withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= count).select(
        F.col("o_custkey").alias("query_id"), F.concat(F.lit("ORDERS."), "o_orderkey").alias("name"), "rank"
    )


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of edges from one scan; what is joined to them removes repeated ones."""
    ends = F.array(F.concat(F.lit("PART."), "l_partkey"), F.concat(F.lit(LOOKUPS + "."), "l_suppkey"))
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("ORDERS."), "l_orderkey").alias("src"), F.explode(ends).alias("dst")
    )


_CORE_SQL = """
core AS (
  SELECT o_custkey AS query_id, 'ORDERS.' || o_orderkey AS name, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
    FROM orders) WHERE rank <= {count}
)"""
_EDGE_SQL = f"""
edges AS (
  SELECT 'ORDERS.' || l_orderkey AS src, 'PART.' || l_partkey AS dst FROM lineitem
  UNION SELECT 'ORDERS.' || l_orderkey, '{LOOKUPS}.' || l_suppkey FROM lineitem
)"""


@query(
    "fk_expand",
    f"""WITH {_CORE_SQL.format(count=10)}, {_EDGE_SQL},
        near AS (SELECT DISTINCT query_id, dst AS name FROM core JOIN edges ON name = src WHERE rank <= 3),
        sizes AS (SELECT query_id, count(*) AS core_n FROM core GROUP BY 1),
        placed AS (SELECT query_id, name, starts_with(name, '{LOOKUPS}.') AS lookup,
            row_number() OVER (PARTITION BY query_id ORDER BY NOT starts_with(name, '{LOOKUPS}.'), name) AS n FROM near),
        real AS (SELECT p.*, core_n FROM placed p JOIN sizes USING (query_id)
            WHERE n + core_n <= 25 AND (lookup OR name IN (SELECT 'PART.' || p_partkey FROM part WHERE p_size <= 40)))
        SELECT query_id, name, rank AS pos, 'core' AS kind FROM core
        UNION ALL
        SELECT query_id, name, CAST(core_n + row_number() OVER (PARTITION BY query_id ORDER BY n) AS INTEGER),
               CASE WHEN lookup THEN 'lookup' ELSE 'other' END FROM real""",
)
def fk_expand(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").filter("p_size <= 40").select(F.concat(F.lit("PART."), "p_partkey").alias("name"))
    sellers = table(spark, d, "supplier").select(F.concat(F.lit(LOOKUPS + "."), "s_suppkey").alias("name"))
    return X.expand(
        cut(_dearest(spark, d, 10)), _order_edges(spark, d), parts.unionByName(sellers), lookup_schema=LOOKUPS
    )


_LINE_EDGES_SQL = """
back AS (SELECT DISTINCT 'LINE.' || l_orderkey || '-' || l_linenumber AS src, 'ORDERS.' || l_orderkey AS dst
         FROM lineitem)"""


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Seeds, and what is one edge away from them in either direction, from one scan of the lines."""
    seeds = cut(_dearest(spark, d, 3))
    order = F.concat(F.lit("ORDERS."), "l_orderkey")
    ends = F.array(
        F.concat(F.lit("PART."), "l_partkey"), F.concat(F.lit(LOOKUPS + "."), "l_suppkey"),
        F.concat_ws("-", F.concat(F.lit("LINE."), "l_orderkey"), "l_linenumber"),
    )
    lines = table(spark, d, "lineitem").select(order.alias("src"), F.explode(ends).alias("dst"))
    return seeds, X.neighbours_of(seeds, lines)


_NEAR_SQL = f"""{_CORE_SQL.format(count=3)}, {_EDGE_SQL}, {_LINE_EDGES_SQL},
near AS (SELECT query_id, dst AS name FROM core JOIN edges ON name = src
         UNION SELECT query_id, src FROM core JOIN back ON name = dst)"""


@query("neighbour_union", f"WITH {_NEAR_SQL} SELECT query_id, name FROM near")
def neighbour_union(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)[1]


def _class() -> Column:
    return F.when(F.col("name").startswith(LOOKUPS + "."), 0).otherwise(1)


@query(
    "priority_sort",
    f"""WITH {_NEAR_SQL} SELECT query_id, name, row_number() OVER (
          PARTITION BY query_id ORDER BY NOT starts_with(name, '{LOOKUPS}.'), name) AS pos FROM near""",
)
def priority_sort(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)[1].withColumn("class", _class())
    return running_sums(near, "query_id", ["class", "name"], {"pos": F.lit(1)}).drop("class")


@query(
    "ordered_concat",
    f"""WITH {_NEAR_SQL} SELECT query_id, name, row_number() OVER (
          PARTITION BY query_id ORDER BY part, r, name) AS pos FROM (
          SELECT query_id, name, 0 AS part, rank AS r FROM core
          UNION ALL SELECT query_id, name, CASE WHEN starts_with(name, '{LOOKUPS}.') THEN 1 ELSE 2 END, 0 FROM near)""",
)
def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    seeds, near = _near(spark, d)
    parts = seeds.select("query_id", "name", F.lit(0).alias("part"), F.col("rank").alias("r")).unionByName(
        near.select("query_id", "name", (_class() + 1).alias("part"), F.lit(0).alias("r"))
    )
    return running_sums(parts, "query_id", ["part", "r", "name"], {"pos": F.lit(1)}).drop("part", "r")


_CHAIN_SQL = """
chained AS (
  SELECT owner, src, dst FROM card_edges
  UNION ALL SELECT 'CHAIN', 'CHAIN.N' || n_nationkey, 'CHAIN.N' || (n_nationkey + 4) FROM nation
)"""


@query(
    "join_path",
    _cat(
        f"""SELECT owner, start, target, CAST(min(hops) AS INTEGER) AS hops,
                   split_part(min(printf('%02d', hops) || ' ' || path), ' ', 2) AS path
            FROM walk WHERE hops > 0 AND target <> start GROUP BY 1, 2, 3""",
        FK_SQL, _CARD_EDGE_SQL, _CHAIN_SQL,
        f"""walk AS (
          SELECT owner, start, start AS target, 0 AS hops, start AS path FROM (
            SELECT 'T' || c_custkey AS owner, 'T' || c_custkey || '.LINEITEM' AS start FROM customer
            UNION ALL SELECT 'CHAIN', 'CHAIN.N' || n_nationkey FROM nation)
          UNION ALL
          SELECT w.owner, start, e.dst, hops + 1, path || '>' || e.dst FROM walk w
          JOIN chained e ON e.src = w.target AND (e.owner = w.owner OR e.owner = '{LOOKUPS}')
          WHERE NOT list_contains(string_split(path, '>'), e.dst))""",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def join_path(spark: SparkSession, d: str) -> DataFrame:
    """Chains from every schema's line items, and chains of six hops through the nations."""
    nation = table(spark, d, "nation").select(F.lit("CHAIN").alias("owner"), "n_nationkey")
    step = F.concat(F.lit("CHAIN.N"), "n_nationkey")
    starts = table(spark, d, "customer").select(
        F.concat(F.lit("T"), "c_custkey").alias("owner"),
        F.concat(F.lit("T"), "c_custkey", F.lit(".LINEITEM")).alias("name"),
    ).unionByName(nation.select("owner", step.alias("name")))
    chain = nation.select("owner", step.alias("src"), F.concat(F.lit("CHAIN.N"), F.col("n_nationkey") + 4).alias("dst"))
    return X.join_paths(starts, _card_edges(spark, d).unionByName(chain), LOOKUPS)


#: A walk goes on as long as it meets tables that it has not passed.
RECURSIVE_TEXT = """WITH RECURSIVE walk(start, target, hops, path) AS (
  SELECT DISTINCT src, src, 0, concat('>', src, '>') FROM {edges}
  UNION ALL
  SELECT w.start, e.dst, w.hops + 1, concat(w.path, e.dst, '>') FROM walk w JOIN {edges} e ON w.target = e.src
  WHERE instr(w.path, concat('>', e.dst, '>')) = 0
)
SELECT start, target, min(hops) AS hops, count(*) AS n_paths FROM walk WHERE hops > 0 GROUP BY start, target"""


@query(
    "q31_recursive",
    _cat(
        """SELECT start, target, CAST(min(hops) AS INTEGER) AS hops, count(*) AS n_paths
           FROM walk WHERE hops > 0 GROUP BY 1, 2""",
        FK_SQL,
        """shape AS (SELECT DISTINCT table_name AS src, split_part(fk, '.', 2) AS dst FROM fk_map
                     WHERE table_name <> split_part(fk, '.', 2)
                     UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 4) FROM nation)""",
        """walk AS (SELECT DISTINCT src AS start, src AS target, 0 AS hops, [src] AS path FROM shape
           UNION ALL SELECT w.start, e.dst, hops + 1, list_append(path, e.dst) FROM walk w JOIN shape e ON w.target = e.src
           WHERE NOT list_contains(path, e.dst))""",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    """Paths over table names: the edges of all schemas fold into a few before the recursion."""
    fk = F.split("fk", r"\.")
    shape = _fk_map(spark, d).select(F.col("table_name").alias("src"), fk[1].alias("dst"))
    step = table(spark, d, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("N"), F.col("n_nationkey") + 4).alias("dst")
    )
    shape = cut(shape.filter("src <> dst").distinct().unionByName(step))
    df, _ = run_readonly(spark, RECURSIVE_TEXT, edges=shape)
    return df


VALUE_EDGES = [
    ("PART", "P_TYPE", "TYPE"), ("PROMOTION", "TYPE_ID", "TYPE"), ("CUSTOMER", "C_MKTSEGMENT", "SEGMENT"), ("PART", "P_NAME", "NAME"),
    ("PROMOTION", "OFFER_ID", "OFFER"),
]
_SAID = "concat('list ', p_type, ' -- ', p_name, CASE p_partkey % 3 WHEN 0 THEN ' for machinery' WHEN 1 THEN ', buildings' ELSE '' END)"
_OFFER = "concat(p_type, ' ', p_name)"


@query(
    "value_to_table",
    f"""WITH toks AS (SELECT p_partkey AS query_id, regexp_extract_all(lower({_SAID}), '{TOKEN}') AS w FROM part),
        labels AS (SELECT DISTINCT 'TYPE' AS ref_table, p_type AS map_key FROM part
                   UNION SELECT 'SEGMENT', c_mktsegment FROM customer UNION SELECT 'NAME', p_name FROM part
                   UNION SELECT 'OFFER', {_OFFER} FROM part WHERE p_partkey % 10 = 0),
        held AS (SELECT *, array_to_string(regexp_extract_all(lower(map_key), '{TOKEN}'), ' ') AS term FROM labels),
        spans AS (SELECT query_id, i AS s, i + l AS e, array_to_string(list_slice(w, i + 1, i + l), ' ') AS term
                  FROM (SELECT query_id, w, unnest(range(len(w))) AS i FROM toks), (VALUES (1), (2), (3)) v(l) WHERE i + l <= len(w)),
        found AS (SELECT DISTINCT query_id, s, e, term FROM spans WHERE term IN (SELECT term FROM held)),
        kept AS (SELECT DISTINCT query_id, term FROM found f WHERE NOT EXISTS (
          SELECT 1 FROM found g WHERE g.query_id = f.query_id AND g.s <= f.s AND g.e >= f.e AND g.e - g.s > f.e - f.s))
        SELECT query_id, term, ref_table, map_key, table_name, column_name FROM kept JOIN held USING (term)
        JOIN (VALUES {', '.join(str(e) for e in VALUE_EDGES)}) e(table_name, column_name, ref_table) USING (ref_table)""",
)
def value_to_table(spark: SparkSession, d: str) -> DataFrame:
    """Labels of one, two and three words, some inside others."""
    part = table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.expr(_SAID).alias("text"))
    values = part.select(F.lit("TYPE").alias("ref_table"), F.col("p_type").alias("map_key")).union(
        table(spark, d, "customer").select(F.lit("SEGMENT"), "c_mktsegment")
    ).union(part.select(F.lit("NAME"), "p_name")).union(part.filter("p_partkey % 10 = 0").select(F.lit("OFFER"), F.expr(_OFFER)))
    values = cut(values.distinct().withColumn("map_value", F.col("map_key")))
    edges = spark.createDataFrame(VALUE_EDGES, "table_name string, column_name string, ref_table string")
    return X.tables_for_values(X.value_mentions(asked, values), values, edges)


_CORE_NAMES = ["ORDERS", "LINEITEM", "PART", "CUSTOMER"]


@query(
    "core_safety_net",
    _cat(
        f"""SELECT DISTINCT owner, table_name FROM card
            WHERE table_name IN ({', '.join(f"'{n}'" for n in _CORE_NAMES)})
              AND (row_count IS NULL OR row_count <= 20000)""",
        *CARD_PARTS,
    ),
)
def core_safety_net(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved are the big tables; core tables not among them are offered besides."""
    heads = K.table_heads(cat_tables(spark, d), cat_columns(spark, d))
    heads = cut(heads.select("owner", "table_name", "row_count"))
    retrieved = heads.filter(F.col("row_count") > 20000)
    return X.safety_net(_CORE_NAMES, heads.select("owner", "table_name"), retrieved, ["owner", "table_name"])


@query(
    "select_resolve",
    """WITH said AS (SELECT user_id AS run_id, json_extract_string(props, '$.k') AS name, min((ts, event_id)) AS first_said
                     FROM events GROUP BY 1, 2),
            known AS (SELECT s.* FROM said s JOIN nation ON name = CAST(n_nationkey AS VARCHAR))
       SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY first_said) AS INTEGER) AS pos, name,
              'selected' AS status FROM known
       UNION ALL SELECT DISTINCT run_id, 0, NULL, 'empty' FROM said WHERE run_id NOT IN (SELECT run_id FROM known)""",
)
def select_resolve(spark: SparkSession, d: str) -> DataFrame:
    decisions = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").alias("name"), "ts", "event_id"
    )
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"))
    return X.resolve_selection(decisions, known)
