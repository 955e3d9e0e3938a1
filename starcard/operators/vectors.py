"""Nearest neighbours by cosine and text embedding.

Vectors are compared block against block with numpy inside the tasks; each block keeps its best k
per query, so no pair table is ever written. Small query sets (checked) travel to the vectors;
larger ones are cut into blocks on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.functions.text import tokens
from starcard.operators.search import best
from starcard.rules import TOP_K
from starcard.session import broadcast_if_small, scratch_path, shuffle_width, stored

CARRIED_QUERIES = 4096
BLOCK_QUERIES = 2048
BLOCK_VECTORS = 50_000
#: Scores that are held at once, 32 MB.
SCORES = 4_000_000
HIT_SCHEMA = "query_id bigint, doc_id bigint, score double"


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """Best k vectors per query: score down, then id up; all ties at the border are weighed.

    So many queries are scored at a time that their scores take ``SCORES`` numbers.
    """
    q, v = _unit(q), _unit(v).T
    step = max(1, SCORES // max(1, len(ids)))
    out_q, out_d, out_s = [], [], []
    for at in range(0, len(query_ids), step):
        score = q[at : at + step] @ v
        np.round(score, 6, out=score)
        for row, qid in zip(score, query_ids[at : at + step]):
            if len(ids) > k:
                keep = np.flatnonzero(row >= np.partition(row, len(ids) - k)[len(ids) - k])
            else:
                keep = np.arange(len(ids))
            keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
            out_q.append(np.full(len(keep), qid))
            out_d.append(ids[keep])
            out_s.append(row[keep])
    return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_s)


def _merged(a: tuple | None, b: tuple, k: int) -> tuple:
    """The k best per query of two lists (query ids, ids, scores)."""
    if a is None:
        return b
    q, d, s = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], d[place < k], s[place < k]


def _matrix(rows: np.ndarray) -> np.ndarray:
    """Rows that are arrays to a matrix."""
    return np.stack(rows).astype(np.float64)


def _carried(queries: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Every vector partition scores the whole (small) query matrix in place."""
    query_ids, q = queries["query_id"].to_numpy(), _matrix(queries["vector"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            v = flat.astype(np.float64).reshape(batch.num_rows, -1)
            found = _merged(found, _top(query_ids, q, ids, v, k), k)
        if found is not None:  # k rows a query and partition, not a batch
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2])],
                names=["query_id", "doc_id", "score"],
            )

    return vectors.select("doc_id", "vector").mapInArrow(score, HIT_SCHEMA)


def _blocked(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Cells of queries against the same cells of vectors, both cut into blocks of bounded size.

    Both sides carry ``cell``. A cell with many vectors or many queries becomes many groups, small cells share one.
    """
    q_sizes = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    v_sizes = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("nv"))
    sizes = q_sizes.join(v_sizes, "cell").select(
        "cell",
        F.ceil(F.col("nq") / BLOCK_QUERIES).cast("int").alias("qb"),
        F.ceil(F.col("nv") / BLOCK_VECTORS).cast("int").alias("vb"), "nq", "nv",
    )
    sizes = stored(sizes, "cell-sizes")
    little = (F.col("nq") <= BLOCK_QUERIES // 8) & (F.col("nv") <= BLOCK_VECTORS // 8)
    nq, nv = sizes.filter(little).agg(F.coalesce(F.sum("nq"), F.lit(0)), F.coalesce(F.sum("nv"), F.lit(0))).first()
    packs = 1 + max(nq // (BLOCK_QUERIES // 2), nv // (BLOCK_VECTORS // 2))
    # Whichever cells a pack holds, they are told apart in it.
    pack = F.when(little, F.pmod(F.xxhash64("cell"), F.lit(packs))).otherwise(F.xxhash64("cell"))
    # One row of sizes per cell. Every query-side column is renamed, as both sides may come from one table.
    sizes, _ = broadcast_if_small(sizes.select("cell", "qb", "vb", pack.alias("pack")))
    q = queries.join(sizes, "cell").select(
        F.col("cell").alias("q_cell"), F.col("pack").alias("q_pack"),
        F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("q_qblock"),
        F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("q_vblock"),
        F.col("query_id").alias("q_id"), F.col("vector").alias("q_vector"),
    )
    v = vectors.join(sizes, "cell").select(
        "cell", "pack", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qblock"),
        F.pmod(F.xxhash64("doc_id"), F.col("vb")).cast("int").alias("vblock"), "doc_id", "vector",
    )
    keys = ["pack", "qblock", "vblock"]

    def by_cell(cells: pd.Series) -> dict:
        codes, names = pd.factorize(cells)
        order = np.argsort(codes, kind="stable")
        return dict(zip(names, np.split(order, np.cumsum(np.bincount(codes, minlength=len(names)))[:-1]), strict=True))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if not left.empty and not right.empty:
            q_ids, q, ids, v = (x.to_numpy() for x in (left["q_id"], left["q_vector"], right["doc_id"], right["vector"]))
            held = by_cell(right["cell"])
            for cell, mine in by_cell(left["q_cell"]).items():
                if cell in held:
                    other = held[cell]
                    found.append(_top(q_ids[mine], _matrix(q[mine]), ids[other], _matrix(v[other]), k))
        told = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), told, strict=True)))

    left_groups, right_groups = q.groupBy("q_pack", "q_qblock", "q_vblock"), v.groupBy(*keys)
    return left_groups.cogroup(right_groups).applyInPandas(score, HIT_SCHEMA)


def knn(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, carried: int = CARRIED_QUERIES) -> DataFrame:
    """Exact: query_id, doc_id, score, rank of the k nearest vectors per query.

    ``queries``: query_id, vector. ``vectors``: doc_id, vector.
    """
    few = queries.select("query_id", "vector").limit(carried + 1).toPandas()
    if few.empty:
        return vectors.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    if len(few) <= carried:
        scored = _carried(few, vectors, k)
    else:
        one = F.lit(0).alias("cell")
        scored = _blocked(queries.select("*", one), vectors.select("*", one), k)
    return best(scored, k).select("query_id", "doc_id", "score", "rank")


def knn_within(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, carried: int = CARRIED_QUERIES) -> DataFrame:
    """Exact neighbours among the vectors of a query's own schemas, the filter coming before any comparison.

    ``queries``: query_id, vector (null: no neighbours), schemas (null: all). ``vectors``: doc_id, vector, schema. A schema's vectors
    are one cell, dealt to blocks where it is large; a query meets the cells of its schemas alone.
    """
    asked = queries.filter(F.col("vector").isNotNull())
    limited = asked.filter(F.col("schemas").isNotNull()).select("query_id", "vector", F.explode(F.array_distinct("schemas")).alias("cell"))
    held = vectors.select("doc_id", "vector", F.col("schema").alias("cell"))
    near = best(_blocked(limited.filter(F.col("cell").isNotNull()), held, k), k)
    free = knn(asked.filter(F.col("schemas").isNull()), vectors, k, carried)
    return near.select("query_id", "doc_id", "score", "rank").unionByName(free.select("query_id", "doc_id", "score", "rank"))


@dataclass(frozen=True)
class Cells:
    """Vectors dealt to k-means cells, with the cells' centers: folders ``vectors`` and ``centers`` below ``path``."""

    path: str
    n: int


def fit_cells(vectors: DataFrame, path: str, cells: int | None = None, sample: int = 200_000) -> Cells:
    """Fit cells on about ``sample`` vectors, by default as many as the root of their number, and deal all vectors to them."""
    total = vectors.count()
    n = max(1, min(total, cells or max(4, int(math.sqrt(total)) // 2)))
    rows = vectors.select("doc_id", "vector", array_to_vector("vector").alias("v"))
    placed = Normalizer(inputCol="v", outputCol="u").transform(rows)
    some = placed if total <= sample else placed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (sample << 20) // total)
    model = KMeans(k=n, seed=7, featuresCol="u", predictionCol="cell", maxIter=10).fit(some)
    # a cell is written by a few tasks: neither a file per task and cell nor one task for a hot cell
    share = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, shuffle_width(vectors.sparkSession) // 8)))
    dealt = model.transform(placed).select("doc_id", "vector", "cell").repartition("cell", share)
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    vectors.sparkSession.createDataFrame(centers, "doc_id bigint, vector array<double>").write.parquet(f"{path}/centers")
    return Cells(path, len(centers))


def search_cells(
    index: Cells, queries: DataFrame, k: int = TOP_K, probes: int | None = None, recall: float = 0.9, tried: int = 64
) -> DataFrame:
    """Approximate: only the ``probes`` cells nearest to a query are searched.

    Without ``probes`` their number is doubled until about ``tried`` of the queries, chosen by a hash, find a share of
    ``recall`` of their exact neighbours; with all cells the result is exact.
    """
    spark = queries.sparkSession
    held = spark.read.parquet(f"{index.path}/vectors")
    centers = spark.read.parquet(f"{index.path}/centers")

    def found(asked: DataFrame, n: int) -> DataFrame:
        near = knn(asked, centers, min(n, index.n)).select("query_id", F.col("doc_id").cast("int").alias("cell"))
        return best(_blocked(asked.select("query_id", "vector").join(near, "query_id"), held, k), k)

    if probes is None:
        total = queries.count()
        share = (tried << 20) // max(1, total)
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) < share)
        exact = stored(knn(some, held, k).select("query_id", "doc_id"), "exact-neighbours")
        wanted, probes = exact.count(), 4
        while probes < index.n and found(some, probes).join(exact, ["query_id", "doc_id"]).count() < recall * wanted:
            probes *= 2
    return found(queries, probes).select("query_id", "doc_id", "score", "rank")


def knn_cells(
    queries: DataFrame, vectors: DataFrame, k: int = TOP_K, cells: int | None = None, probes: int | None = 4
) -> DataFrame:
    """Fit and search in one go, for vectors that are searched once."""
    return search_cells(fit_cells(vectors, scratch_path(vectors.sparkSession, "cells"), cells), queries, k, probes)


def hashed_embedding(texts: DataFrame, size: int = 64) -> DataFrame:
    """doc_id, vector: unit vectors of hashed term counts, computed without Python."""
    words = texts.select("doc_id", tokens(F.col("text")).alias("w"))
    counted = HashingTF(inputCol="w", outputCol="tf", numFeatures=size).transform(words)
    unit = Normalizer(inputCol="tf", outputCol="u").transform(counted)
    return unit.select("doc_id", vector_to_array("u").alias("vector"))


def embed_batches(
    texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch_size: int = 16
) -> DataFrame:
    """doc_id, vector from any embedder, called with ``batch_size`` texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].to_numpy(), "vector": list(embedder(part["text"].tolist()))}
                )

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id bigint, vector array<double>")
