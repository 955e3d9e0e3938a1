"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starcard.llm import whitening
from starcard.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"
KIND = "vec_id long, embedding array<float>"


def plain(vectors, wanted=32):
    """x, n, exact deviations, eigenvalues, projections."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:wanted], turn[:, ::-1][:, :wanted]
    return n, deviation, values, centred @ turn / np.sqrt(values), np.trace(centred.T @ centred / n)


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    return np.abs(got * sign - want).max()


def test_query_against_a_plain_eigendecomposition(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, values, white, trace = plain(df["embedding"])
    found = LLM_QUERIES["op11_embedding_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(found) == 32 * len(df) and set(found["n"]) == {n}
    assert found["deviation"].tolist() == [d for d in deviation for _ in range(32)]
    assert same_up_to_sign(found["whitened"].to_numpy().reshape(-1, 32), white) < 1e-9
    assert found["explained"].to_numpy()[:32] == pytest.approx(values / trace, rel=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values", [
    np.arange(1, 101), np.geomspace(1e-9, 1e6, 64), [5.0] * 20 + [3.0] * 30 + [1.0] * 14, [1e12, 1.0, 1.0, 1e-12], [0.0] * 50 + list(range(1, 11)),
    [2.0], [1.0, 1.0 + 1e-13, 7.0], np.r_[np.full(40, 4.0), np.full(40, 4.0 + 1e-6)],
])
def test_components_of_many_spectra(spark, values):
    a, _ = spectrum(values)
    found = whitening.components(spark, a)
    want = np.sort(np.asarray(values, float))[::-1][:32]
    want = want[want > len(a) * np.finfo(float).eps * want.max()]
    norm = want.max()
    assert found.values == pytest.approx(want, abs=1e-12 * norm * len(a), rel=1e-10)
    assert np.abs(found.vectors.T @ found.vectors - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-12 * norm * len(a)


def test_inertia_counts_and_intervals():
    values = np.r_[np.full(15, 2.0), np.linspace(-3, 9, 40)]
    a, _ = spectrum(values)
    diagonal, off2 = whitening.tridiagonal(a)
    for shift in (-4, -2.99, 0.1, 1.99, 2.01, 8.9, 10):
        assert whitening.count_above(diagonal, off2, shift) == (values > shift).sum()
    cuts = whitening.intervals(diagonal, off2, 32, per=4)
    assert sum(c.count for c in cuts) >= 32
    for c in cuts:
        assert ((values > c.low) & (values <= c.high)).sum() == c.count
        assert c.count <= 4 or c.high - c.low < 1e-8


def test_a_lost_eigenvalue_is_noticed():
    a, _ = spectrum([1.0, 2.0, 3.0, 9.0])
    with pytest.raises(ArithmeticError):
        whitening.feast(a, whitening.Interval(2.5, 3.5, 2))


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i % 40, rng.normal(size=5).astype("f4").tolist()) for i in range(80)] + [(None, [1.0, -0.0, 3e4, 2.0, 1e-9])]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [1.0, float("nan"), 0.0, 0.0, 0.0]), (93, [float("inf")] * 5), (94, [3e38] * 5)]
    df = spark.createDataFrame(good + bad, KIND).withColumn("v", F.lit("clash")).withColumn("n", F.lit(1)).repartition(7)
    found = whitening.whiten(df).toPandas()
    n, deviation, values, white, trace = plain([v for _, v in good])
    assert n == 81 and len(found) == 81 * 5 and sorted(found["deviation"]) == sorted(d for d in deviation for _ in range(5))
    assert found["vec_id"].isna().sum() == 5 and found["identity_error"].max() < 1e-9
    assert sorted(found.loc[found["component"] == 1, "whitened"].abs()) == pytest.approx(sorted(np.abs(white[:, 0])), abs=1e-9)


def test_exact_far_from_zero(spark):
    rows = [(i, [2.0**40 + i, float(i * i), 5.0]) for i in range(20)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    n, deviation, *_ = plain([v for _, v in rows])
    assert dict(zip(found["vec_id"], found["deviation"])) == dict(enumerate(deviation))
    assert sorted(found["component"].unique()) == [1, 2]  # the constant entry has no variance
    huge = whitening.whiten(spark.createDataFrame([(i, [float(i) * 2**50]) for i in range(20)], "vec_id long, embedding array<double>"))
    assert huge.filter("deviation IS NULL").count() > 0


def test_empty_equal_and_ragged(spark):
    assert whitening.whiten(spark.createDataFrame([], KIND)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, KIND)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], KIND)).collect() == []
    with pytest.raises(ValueError, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], KIND))
