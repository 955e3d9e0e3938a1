"""Connected components of a link table, by alternating large and small stars.

Every round rewires links towards the smallest id in reach; rounds are few as chains shorten by
halves. What a hub has to tell its links reaches them in shares, so no task holds all of them. Links and labels stay in tables, each round is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.operators.segments import spread_join
from starcard.session import stored


def _signature(edges: DataFrame) -> tuple:
    found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return found[0], found[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(both, least, ["u"], by="v", nulls=False).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(edges, least, ["u"], by="v", nulls=False).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every id that occurs in a link to another id; root is the smallest id of its component."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = stored(pairs, "links")
    before, after = None, _signature(now)
    while after[0] and before != after:
        now = stored(_small_star(_large_star(now)), "stars")
        before, after = after, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
