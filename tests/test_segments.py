"""Ordered operators against plain Python, with one key holding most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from starcard.operators.segments import (
    SEG, dense_number, neighbours, range_frame_sums, range_segments, recent_sums, running_sums, spread_join,
)


def rows(n=600):
    rnd = random.Random(3)
    return [(rnd.choice([1, 1, 1, 1, 2, 3, 4, 9]), rnd.randint(0, 90), i, rnd.randint(-5, 9)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k bigint, t int, id bigint, v bigint").repartition(5)


def grouped(data):
    groups = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups[r[0]].append(r)
    return groups


def test_hot_key_is_spread(spark):
    seg = range_segments(frame(spark, [(1, i % 7, i, 1) for i in range(4000)]), ["k", "t", "id"])
    assert seg.select(SEG).distinct().count() > 4


def test_running_sums(spark):
    data = rows()
    got = running_sums(frame(spark, data), "k", ["t", "id"], {"s": F.col("v"), "n": F.lit(1)})
    want = {}
    for members in grouped(data).values():
        total = 0
        for n, r in enumerate(members, 1):
            total += r[3]
            want[r[2]] = (total, n)
    assert {r["id"]: (r["s"], r["n"]) for r in got.collect()} == want


def test_running_sums_descending(spark):
    data = rows()
    got = running_sums(frame(spark, data), "k", [F.col("t").desc(), "id"], {"n": F.lit(1)})
    groups = defaultdict(list)
    for r in data:
        groups[r[0]].append(r)
    want = {}
    for members in groups.values():
        for n, r in enumerate(sorted(members, key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_neighbours(spark):
    data = rows()
    got = neighbours(frame(spark, data), "k", ["t", "id"], "v")
    want = {}
    for members in grouped(data).values():
        for i, r in enumerate(members):
            want[r[2]] = (
                members[i - 1][3] if i else None, members[i + 1][3] if i + 1 < len(members) else None,
            )
    assert {r["id"]: (r["lag"], r["lead"]) for r in got.collect()} == want


def test_dense_number(spark):
    data = rows()
    got = dense_number(frame(spark, data), ["t", "id"], "n", start=5)
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])), 5)}
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_range_frames(spark):
    data = rows()
    df = frame(spark, data)
    for open_start in (False, True):
        got = range_frame_sums(df, "k", "t", F.col("v"), F.lit(-10), F.lit(3), "s", open_start)
        want = {}
        for k, t, *_ in data:
            low = (lambda x: x > t - 10) if open_start else (lambda x: x >= t - 10)
            want[(k, t)] = sum(r[3] for r in data if r[0] == k and low(r[1]) and r[1] <= t + 3)
        assert {(r["k"], r["t"]): r["s"] for r in got.collect()} == want


def test_spread_join(spark):
    data = rows()
    df = frame(spark, data)
    sums = df.groupBy("k").agg(F.sum("v").alias("total"))
    totals = {r["k"]: r["total"] for r in sums.collect()}
    got = spread_join(df, sums, ["k"], by="id").collect()
    assert len(got) == len(data) and all(r["total"] == totals[r["k"]] for r in got)


def gapped(n=400):
    rnd = random.Random(4)
    data = [(rnd.choice([None, None, 1, 1, 1, 2, 9]), rnd.randint(0, 90), i, rnd.choice([None, 0.1, 1e9 + 0.01, 7.25])) for i in range(n)]
    return data + [(5, i, 1000 + i, None) for i in range(60)] + [(5, 61 + i, 2000 + i, 1.5) for i in range(20)]


def windowed(spark, data, sql):
    spark.createDataFrame(data, "k bigint, t int, id bigint, v double").createOrReplaceTempView("gapped")
    return {r["id"]: r["s"] for r in spark.sql(f"SELECT id, {sql} AS s FROM gapped").collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert (got[i] is None) == (s is None) and (s is None or abs(got[i] - s) < 1e-4), (i, got[i], s)


def test_null_keys_and_values_as_a_window_has_them(spark):
    data = gapped()
    df = spark.createDataFrame(data, "k bigint, t int, id bigint, v double").repartition(5)
    over = "OVER (PARTITION BY k ORDER BY t, id"
    for parts in (2, 7):
        got = running_sums(df, "k", ["t", "id"], {"s": F.col("v")}, parts=parts)
        close({r["id"]: r["s"] for r in got.collect()}, windowed(spark, data, f"sum(v) {over} ROWS UNBOUNDED PRECEDING)"))
        near = neighbours(df, "k", ["t", "id"], "id", parts=parts).collect()
        close({r["id"]: r["lag"] for r in near}, windowed(spark, data, f"lag(id) {over})"))
    for parts, width in ((3, 4), (200, 4)):
        last = recent_sums(df, "k", ["t", "id"], "v", width, "s", parts=parts)
        close({r["id"]: r["s"] for r in last.collect()}, windowed(spark, data, f"sum(v) {over} ROWS {width - 1} PRECEDING)"))
    frames = range_frame_sums(df, "k", "t", F.col("v"), F.lit(-5), F.lit(0), "s", by="id")
    close(
        {r["id"]: r["s"] for r in frames.collect()},
        windowed(spark, data, "sum(v) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    )
    sums = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert spread_join(df, sums, ["k"], by="id").count() == len(data)
    assert spread_join(df, sums, ["k"], by="id", nulls=False).count() == sum(r[0] is not None for r in data)


def test_long_sums_stay_exact_and_odd_numbers_stay_apart(spark):
    big = [(1, i, i, 1e9 + (i % 100) / 100) for i in range(20000)]
    df = spark.createDataFrame(big, "k bigint, t int, id bigint, v double")
    got = {r["id"]: r["s"] for r in range_frame_sums(df, "k", "t", F.col("v"), F.lit(-1), F.lit(0), "s", by="id").collect()}
    assert all(abs(got[i] - (2e9 + (i % 100) / 100 + ((i - 1) % 100) / 100)) < 1e-5 for i in range(1, 20000))
    odd = [(1, 0, 0, 1.0), (1, 10, 1, float("nan")), (1, 20, 2, 2.0), (1, 30, 3, float("inf")), (1, 40, 4, 3.0), (2, 0, 5, None)]
    df = spark.createDataFrame(odd, "k bigint, t int, id bigint, v double")
    got = {r["id"]: r["s"] for r in range_frame_sums(df, "k", "t", F.col("v"), F.lit(-3), F.lit(0), "s", by="id").collect()}
    assert got[0] == 1.0 and got[1] != got[1] and got[2] == 2.0 and got[3] == float("inf") and got[4] == 3.0 and got[5] is None
