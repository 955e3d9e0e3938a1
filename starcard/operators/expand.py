"""Working along foreign keys: neighbours of search hits, join paths, values to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcard.rules import LOOKUP_SCHEMA, MAX_TOTAL, SEED_COUNT, TOKEN
from starcard.session import broadcast_if_small, cut, shuffled


def neighbours_of(seeds: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """query_id, name of tables one edge away, distinct. ``edges``: src, dst, repeated ones do no harm."""
    edges = shuffled(edges)
    out = seeds.join(edges, seeds["name"] == edges["src"]).select("query_id", F.col("dst").alias("name"))
    if reverse:
        back = seeds.join(edges, seeds["name"] == edges["dst"]).select(
            "query_id", F.col("src").alias("name")
        )
        out = out.unionByName(back)
    return out.distinct()


def expand(
    core: DataFrame,
    edges: DataFrame,
    cards: DataFrame,
    seed_count: int = SEED_COUNT,
    max_total: int = MAX_TOTAL,
    reverse: bool = False,
    enabled: bool = True,
    lookup_schema: str = LOOKUP_SCHEMA,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Core tables of a query, then lookups, then other neighbours, at most ``max_total`` names.

    ``core``: query_id, name, rank (1, 2, ...). ``edges``: src, dst. ``cards``: name. A neighbour
    without a card takes one of the places and is then left out, as is one whose schema isn't among those
    ``allowed`` (query_id, schemas; null: all). Result: query_id, name, pos, kind.
    """
    kept_core = core.select("query_id", "name", "rank")
    if enabled:
        kept_core = kept_core.filter(F.col("rank") <= max_total)
    first = kept_core.select("query_id", "name", F.col("rank").alias("pos"), F.lit("core").alias("kind"))
    if not enabled or seed_count == 0:
        return first
    near = neighbours_of(core.filter(F.col("rank") <= seed_count), edges, reverse)
    fresh = near.join(shuffled(core.select("query_id", "name")), ["query_id", "name"], "left_anti")
    lookup: Column = F.col("name").startswith(lookup_schema + ".")
    order = Window.partitionBy("query_id").orderBy(F.when(lookup, 0).otherwise(1), "name")
    placed = fresh.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_total)
    sizes = core.groupBy("query_id").agg(F.count(F.lit(1)).alias("core_n"))
    room = placed.join(shuffled(sizes), "query_id").filter(F.col("n") + F.col("core_n") <= max_total)
    real = room.join(shuffled(cards.select("name")), "name", "left_semi")
    if allowed is not None:
        mine = F.array_contains("schemas", F.substring_index("name", ".", 1))
        real = real.join(shuffled(allowed.select("query_id", "schemas")), "query_id").filter(F.col("schemas").isNull() | mine)
    after = Window.partitionBy("query_id").orderBy("n")
    rest = real.select(
        "query_id", "name", (F.row_number().over(after) + F.col("core_n")).cast("int").alias("pos"),
        F.when(lookup, "lookup").otherwise("other").alias("kind"),
    )
    return first.unionByName(rest)


def join_paths(starts: DataFrame, edges: DataFrame, shared: str) -> DataFrame:
    """Shortest reference chain from each start table to every table it can reach, however long.

    ``starts``: owner, name. ``edges``: owner, src, dst. Edges of the ``shared`` schema may be
    followed from every owner; they are few (checked) and travel to the rest.
    """
    edges = cut(edges.select("owner", "src", "dst").distinct())
    own = shuffled(edges.filter(F.col("owner") != shared))
    common, _ = broadcast_if_small(edges.filter(F.col("owner") == shared).select("src", "dst"))
    reached = starts.select(
        "owner", F.col("name").alias("start"), F.col("name").alias("target"), F.lit(0).alias("hops"),
        F.col("name").alias("path"),
    )
    front = reached
    hop = 0
    while not front.isEmpty():  # a table is reached once, so chains end even where references form a circle
        hop += 1
        local = front.join(own, (front["target"] == own["src"]) & (front["owner"] == own["owner"])).select(
            front["owner"], "start", "dst", "path"
        )
        across = front.join(common, front["target"] == common["src"]).select("owner", "start", "dst", "path")
        step = local.unionByName(across).select(
            "owner", "start", F.col("dst").alias("target"), F.lit(hop).alias("hops"),
            F.concat_ws(">", "path", "dst").alias("path"),
        )
        best = step.groupBy("owner", "start", "target", "hops").agg(F.min("path").alias("path"))
        seen = shuffled(reached.select("owner", "start", "target"))
        front = cut(best.join(seen, ["owner", "start", "target"], "left_anti"))
        reached = reached.unionByName(front)
    return reached.filter(F.col("hops") > 0)


def label_term(label: Column) -> Column:
    """A label as its words: lower case, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(label), F.lit(TOKEN), F.lit(0)), " ")


def value_mentions(queries: DataFrame, values: DataFrame) -> DataFrame:
    """query_id, term, start, stop: runs of words in a query's text that are a label, the longest ones.

    ``queries``: query_id, text. ``values``: map_value. A run inside a longer one is left out; runs that overlap otherwise stay.
    Windows are only as long as some label, and meet the labels by an equi-join, so no query is held against the catalog.
    """
    labels = values.select(label_term(F.col("map_value")).alias("term")).filter("term <> ''").distinct()
    labels = cut(labels.withColumn("n", F.size(F.split("term", " "))))
    sizes = sorted(r["n"] for r in labels.select("n").distinct().collect())  # lengths of labels, a handful
    if not sizes:
        return queries.select("query_id", F.lit("").alias("term"), F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    words = queries.select("query_id", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w"))
    starts = words.select("query_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start")).filter(F.size("w") > 0)
    runs = starts.select("query_id", "w", "start", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    runs = runs.filter(F.col("start") + F.col("n") <= F.size("w")).select(
        "query_id", "start", (F.col("start") + F.col("n")).alias("stop"), F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("term")
    )
    few, _ = broadcast_if_small(labels.select("term"))
    found = runs.join(few, "term", "left_semi")
    before = Window.partitionBy("query_id").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)  # one text's runs
    reach = F.max("stop").over(before)
    return found.withColumn("r", reach).filter(F.coalesce("r", F.lit(-1)) < F.col("stop")).select("query_id", "term", "start", "stop")


def tables_for_values(mentions: DataFrame, values: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels that a query mentions -> lookups holding them -> columns referencing those lookups.

    ``mentions``: query_id, term. ``values``: ref_table, map_key, map_value. ``edges``: table_name,
    column_name, ref_table.
    """
    named = values.select("ref_table", "map_key", label_term(F.col("map_value")).alias("term")).distinct()
    targets = named.join(edges, "ref_table")
    return mentions.select("query_id", "term").distinct().join(targets, "term").select(
        "query_id", "term", "ref_table", "map_key", "table_name", "column_name"
    )


def safety_net(core_names: list[str], cards: DataFrame, retrieved: DataFrame, on: list[str]) -> DataFrame:
    """Core tables that exist in the catalog and were not retrieved."""
    return cards.filter(F.col(on[-1]).isin(core_names)).join(shuffled(retrieved.select(*on)), on, "left_anti")


def resolve_selection(decisions: DataFrame, cards: DataFrame) -> DataFrame:
    """Decisions of a run against the catalog: first of a repeated name, unknown names out.

    ``decisions``: run_id, name, place columns ``ts`` and ``event_id``. ``cards``: name. Result:
    run_id, pos, name, status; a run left with nothing is one row with status "empty".
    """
    once = decisions.groupBy("run_id", "name").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    known = once.join(cards.select("name").distinct(), "name")
    order = Window.partitionBy("run_id").orderBy("at")
    kept = known.select(
        "run_id", F.row_number().over(order).alias("pos"), "name", F.lit("selected").alias("status")
    )
    runs = once.select("run_id").distinct()
    nothing = runs.join(known.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("name"),
        F.lit("empty").alias("status"),
    )
    return kept.unionByName(nothing)
