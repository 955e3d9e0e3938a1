"""Whitening of embeddings by the leading eigenvectors of their covariance, found by contour integration (FEAST).

Moments are added up in two distributed passes: exact integer sums, then products of values centred on the exact mean. What reaches
the driver is one matrix of the vectors' dimension, whose bound is ``MAX_DIMENSION``.

The wanted eigenvalues are located by inertia: a tridiagonal form of the matrix has as many eigenvalues above a shift as its
LDL' pivots at that shift are positive. Bisection on that count cuts the upper end of the spectrum into intervals of few
eigenvalues, and Spark works on the intervals side by side. In each, a subspace is filtered by the rational function that a Gauss
quadrature on a circle around the interval yields: complex shifted solves, summed with the quadrature's weights. Rayleigh-Ritz in the
filtered subspace gives the eigenpairs, round after round until their residuals are at rounding level, and the count says
how many there have to be. A last Rayleigh-Ritz over all intervals makes neighbours orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcard.session import stored

#: What an entry c becomes: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A matrix of this dimension has 128 MB; longer vectors are refused.
MAX_DIMENSION = 4096
#: Eigenvalues to an interval where they can be told apart; points on the upper half of a circle; rounds at most.
PER_INTERVAL, POINTS, ROUNDS = 12, 8, 40
#: Vectors that are worked on at a time, tasks whose sums are added in one group.
ROWS, FAN_IN = 4096, 64
LARGEST = (1 << 63) - 1
KIND = (
    "vec_id long, component int, n long, deviation long, whitened double, eigenvalue double, explained double, identity_error double"
)


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) without null vectors and vectors that hold a null, NaN or infinite entry, or one whose value
    doesn't fit a long."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float(1 << 56)), F.lit(False)))  # NaN is larger than any number
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine)


def _matrices(batches: Iterable[pa.RecordBatch], d: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut small, with their vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            c = part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def _added(parts: DataFrame, kind: str) -> DataFrame:
    """Sum of (row, total array<double>) over tasks, in two steps so that no group grows with the number of tasks alone."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1].copy()
        out["total"] = [np.sum(np.stack(group["total"].to_numpy()), axis=0)]
        return out

    some = parts.groupBy("row", F.expr(f"task DIV {FAN_IN}").alias("task")).applyInPandas(add, kind)
    return some.groupBy("row").applyInPandas(add, kind)


class Moments(NamedTuple):
    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)


def _pivot(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole part and a rest, so that centring loses nothing to the size of the values."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


def _gram(rows: DataFrame, d: int, width: int, values) -> np.ndarray:
    """Sum of y'y over all rows, ``values`` making the matrix y (rows x ``width``) of a batch."""
    kind = "row int, task long, total array<double>"

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _matrices(batches, d, 0):
            y = values(x)
            total += y.T @ y
        task = TaskContext.get()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([task.partitionId() if task else 0] * width, pa.int64()),
             pa.array(list(total), pa.list_(pa.float64()))], ["row", "task", "total"],
        )

    found = _added(rows.select("v").mapInArrow(products, kind), kind).toPandas()
    return np.stack(found.sort_values("row")["total"].to_numpy()) if len(found) else np.zeros((width, width))


def moments(rows: DataFrame) -> Moments | None:
    """Count, exact sums and centred covariance (divisor n) of the scaled vectors; None for an empty table."""
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not sizes["most"]:
        return None
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors differ in length: {sizes['least']} to {sizes['most']} entries")
    d = sizes["most"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors have {d} entries; at most {MAX_DIMENSION} are supported")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _matrices(batches, d, 0):
            n += len(x)
            safe = float(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist() if safe else x.astype(object).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))],
                ["place", "n", "s"],
            )

    found = rows.select("v").mapInArrow(sums, "place int, n long, s decimal(38,0)").groupBy("place").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")
    ).orderBy("place").collect()
    n, total = found[0]["n"], [int(r["s"]) for r in found]
    whole, rest = _pivot(n, total)
    return Moments(n, total, _gram(rows, d, d, lambda x: (x - whole) - rest) / n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared neighbours of a tridiagonal matrix with the eigenvalues of the symmetric ``a`` (Householder)."""
    a = a.copy()
    n = len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        off[k] = alpha
        v = x.copy()
        v[0] -= alpha
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * np.outer(v, w) + 2 * np.outer(w, v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off**2


def count_above(diagonal: np.ndarray, off2: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of LDL' of the shifted tridiagonal matrix (Sylvester)."""
    least = float(np.finfo(float).tiny)
    above, pivot = 0, 1.0
    for x, off in zip(diagonal.tolist(), [0.0, *off2.tolist()], strict=True):
        pivot = x - shift - off / pivot
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


class Interval(NamedTuple):
    low: float
    high: float
    count: int


def intervals(diagonal: np.ndarray, off2: np.ndarray, wanted: int, per: int = PER_INTERVAL) -> list[Interval]:
    """Intervals that hold the ``wanted`` largest eigenvalues, each with its inertia count, the largest first.

    They are cut by bisection until ``per`` eigenvalues are left or the interval is so narrow that those in it are one value.
    """
    reach = np.sqrt(np.append(off2, 0.0)) + np.sqrt(np.append(0.0, off2))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(low), abs(high))
    found, stack, have = [], [(low - 1e-3 * norm, high + 1e-3 * norm, len(diagonal), 0)], 0
    while stack and have < wanted:
        low, high, count, above_high = stack.pop()
        if count == 0:
            continue
        narrow = high - low <= 1e-10 * norm
        if not narrow and (count > per or above_high + count > wanted + per):
            middle = (low + high) / 2
            upper = count_above(diagonal, off2, middle) - above_high
            stack.append((low, middle, count - upper, above_high + upper))
            stack.append((middle, high, upper, above_high))
            continue
        found.append(Interval(low, high, count))
        have += count
    return found


def feast(a: np.ndarray, interval: Interval, points: int = POINTS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``a`` in an interval that is known to hold ``interval.count`` of them.

    Rounds go on until the residuals are at rounding level and don't halve any more. Raises if not all are found, after a wider
    subspace and then the whole space was tried.
    """
    n, want = len(a), interval.count
    scale = float(np.linalg.norm(a)) or 1.0
    level = 4 * n * np.finfo(float).eps * scale
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2
    radius = max(radius, 1e-9 * scale)  # a circle around one multiple value still has to keep off it
    nodes, weights = np.polynomial.legendre.leggauss(points)
    filters = []
    for angle, weight in zip(np.pi / 2 * (1 - nodes), weights, strict=True):  # the lower half of the circle is its conjugate
        z = radius * np.exp(1j * angle)
        filters.append((np.linalg.inv((centre + z) * np.eye(n) - a), weight * z / 2))
    rng = np.random.default_rng(seed)
    for width in dict.fromkeys(min(n, w) for w in (int(1.5 * want) + 4, 3 * want + 8, n)):
        y, best, last = rng.standard_normal((n, width)), None, np.inf
        for _ in range(rounds):
            q, _ = np.linalg.qr(sum((w * (inverse @ y)).real for inverse, w in filters))
            values, turn = np.linalg.eigh(q.T @ a @ q)
            y = q @ turn
            gaps = np.linalg.norm(a @ y - y * values, axis=0)
            off = np.maximum(np.maximum(interval.low - values, values - interval.high), 0)
            near = np.sort(np.argsort(off + gaps, kind="stable")[:want])  # a value on the border may fall to either side by rounding
            size = float(gaps[near].max(initial=0))
            fine = size <= level and float(off[near].max(initial=0)) <= level
            if best is not None and (not fine or size > last / 2):
                break
            if fine:
                best, last = (values[near][::-1], y[:, near][:, ::-1]), size
        if best is not None:
            return best
    raise ArithmeticError(f"{want} eigenvalues were counted between {interval.low} and {interval.high}, not all were found")


class Components(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    counted: int


def components(spark, covariance: np.ndarray, wanted: int = COMPONENTS) -> Components:
    """The ``wanted`` leading eigenpairs (fewer if the rank is lower), one interval of the spectrum to a task."""
    wanted = min(wanted, len(covariance))
    diagonal, off2 = tridiagonal(covariance)
    cuts = intervals(diagonal, off2, wanted)
    shared = spark.sparkContext.broadcast(covariance)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, high, count in zip(batch["low"], batch["high"], batch["count"], strict=True):
                values, vectors = feast(shared.value, Interval(low, high, int(count)))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    tasks = spark.createDataFrame([tuple(c) for c in cuts], "low double, high double, count int").repartition(len(cuts), "low")
    found = tasks.mapInPandas(solve, "value double, vector array<double>").toPandas()
    shared.destroy()
    q, _ = np.linalg.qr(np.stack(found.sort_values("value", ascending=False)["vector"].to_numpy()).T)
    values, turn = np.linalg.eigh(q.T @ covariance @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], (q @ turn)[:, order]
    real = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0), np.finfo(float).tiny)
    return Components(values[real], vectors[:, real], sum(c.count for c in cuts))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and leading component: the vector's exact squared deviation and its whitened coordinate.

    Rows without an id, and repeated ids, stay rows of their own. Vectors of different lengths raise, as they have no covariance. A
    component without variance has no whitened coordinate and no row, so equal vectors alone, like an empty table, give no rows.
    A deviation beyond a long is null. ``identity_error`` is measured over all whitened vectors in a pass of its own.
    """
    spark, rows = df.sparkSession, stored(usable(df, id_col, vector_col), "vectors")
    found = moments(rows)
    basis = components(spark, found.covariance, wanted) if found and np.trace(found.covariance) > 0 else None
    if basis is None:
        return spark.createDataFrame([], KIND)
    n, sums, d, k = found.n, found.sums, found.d, len(basis.values)
    whole, rest = _pivot(n, sums)
    project, trace = basis.vectors / np.sqrt(basis.values), float(np.trace(found.covariance))

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ project

    error = float(np.abs(_gram(rows, d, k, whitened) / n - np.eye(k)).max())  # centred, as x is
    left = [s - w * n for s, w in zip(sums, whole.tolist(), strict=True)]
    rest_square = sum(r * r for r in left)
    explained = basis.values / trace

    def deviations(x: np.ndarray) -> list[int | None]:
        off, most = x - whole, int(np.abs(x - whole).max(initial=0))
        kind = np.int64 if most * max(most, n) * d < 2**62 else object
        square = (off.astype(kind) ** 2).sum(axis=1).tolist()
        cross = (off.astype(kind) @ np.array(left, kind)).tolist()
        exact = (n * n * s - 2 * n * c + rest_square for s, c in zip(square, cross, strict=True))
        return [y if y <= LARGEST else None for y in exact]

    def project_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, d, 1):
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array(whitened(x).ravel()), pa.array(np.tile(basis.values, m)),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [c.split()[0] for c in KIND.split(", ")],
            )

    return rows.select("vec_id", "v").mapInArrow(project_all, KIND)
