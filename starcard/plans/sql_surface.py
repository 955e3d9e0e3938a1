"""Query shapes users run through the read-only surface, over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starcard.operators.segments import neighbours, range_frame_sums, recent_sums, running_sums, spread_join, SEG
from starcard.operators.value_maps import full_map, resolve_keys
from starcard.plans.readonly import run_readonly
from starcard.plans.registry import query, table


@query("q01_count_all", "SELECT count(*) AS n FROM lineitem")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q02_count_distinct_pk",
    "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R'",
)
def q02(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    return hit.agg(F.countDistinct("l_orderkey").alias("n"))


@query(
    "q03_count_by_year",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders
       WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def q03(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return done.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q04_project_filter",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def q04(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "customer")
        .filter(F.col("c_mktsegment") == "BUILDING")
        .select("c_custkey", "c_name")
    )


@query(
    "q05_fk_decode",
    """SELECT c_custkey, c_name, n_name FROM customer
       JOIN nation ON c_nationkey = n_nationkey""",
)
def q05(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return (
        table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "n_name")
    )


@query(
    "q06_fk_chain",
    """SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n,
              round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       GROUP BY 1, 2""",
)
def q06(spark: SparkSession, d: str) -> DataFrame:
    # The lines of one order are added up before the join, so a hot order is one row in it.
    per_order = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        )
    )
    place = (
        table(spark, d, "nation")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    return (
        per_order.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", F.year("o_orderdate").alias("y"))
        .agg(F.sum("lines").alias("n"), F.round(F.sum("amount"), 4).alias("revenue"))
    )


@query(
    "q07_value_map_filter",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')
       GROUP BY 1""",
)
def q07(spark: SparkSession, d: str) -> DataFrame:
    names = full_map(table(spark, d, "nation"), "NATION", "n_nationkey", "n_name")
    keys = resolve_keys(names, "NATION_7").select(F.col("map_key").cast("int").alias("c_nationkey"))
    mine = table(spark, d, "customer").join(keys, "c_nationkey", "left_semi")
    return (
        table(spark, d, "orders")
        .join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .groupBy(F.year("o_orderdate").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "q07b_lookup_like",
    """SELECT p_brand, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
       JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%BOLT%' GROUP BY 1""",
)
def q07b(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").filter(F.col("p_name").ilike("%BOLT%")).select("p_partkey", "p_brand")
    per_part = (  # the fact is cut to the named parts before it is grouped
        table(spark, d, "lineitem")
        .join(named, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("q"))
    )
    return (
        per_part.join(named, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand")
        .agg(F.sum("c").alias("n"), F.sum("q").alias("qty"))
    )


@query(
    "q08_in_list",
    """SELECT p_type, count(*) AS n FROM part
       WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') GROUP BY 1""",
)
def q08(spark: SparkSession, d: str) -> DataFrame:
    picked = table(spark, d, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL"))
    return picked.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q09_unit_range",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
       WHERE l_linenumber = 1 AND l_quantity > 30 GROUP BY 1""",
)
def q09(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "lineitem").filter(
        (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 30)
    )
    return hit.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )


@query(
    "q10_null_inclusive",
    """SELECT lang, count(*) FILTER (WHERE quality IN (0, 1)) AS strict_n,
              count(*) FILTER (WHERE quality IN (0, 1) OR quality IS NULL) AS inclusive_n
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def q10(spark: SparkSession, d: str) -> DataFrame:
    coded = F.col("quality").isin(0, 1)
    return (
        table(spark, d, "documents")
        .select("doc_id", "lang")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count_if(coded).alias("strict_n"),
            F.count_if(coded | F.col("quality").isNull()).alias("inclusive_n"),
        )
    )


@query(
    "q11_date_basis",
    """SELECT 'record' AS basis, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n
       FROM orders GROUP BY 2
       UNION ALL
       SELECT 'event', CAST(year(l_shipdate) AS INTEGER), count(DISTINCT o_orderkey)
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 2""",
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    record = orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    shipped = (
        table(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("y")).distinct()
    )
    event = (
        shipped.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .groupBy("y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return record.select(F.lit("record").alias("basis"), "y", "n").union(
        event.select(F.lit("event"), "y", "n")
    )


CTE_TEXT = """WITH spend AS (
  SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey
)
SELECT o_custkey, n, round(total, 2) AS total FROM spend WHERE n >= 10;"""


@query(
    "q12_cte",
    """WITH spend AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total
                      FROM orders GROUP BY o_custkey)
       SELECT o_custkey, n, round(total, 2) AS total FROM spend WHERE n >= 10""",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    df, _ = run_readonly(spark, CTE_TEXT, orders=table(spark, d, "orders"))
    return df


@query(
    "q13_limit",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def q13(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey")
        .limit(10)
    )


@query("q14_select_star", "SELECT * FROM nation")
def q14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


@query(
    "q15_left_join",
    """SELECT c_custkey, c_name, count(o_orderkey) AS n_orders
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
)
def q15(spark: SparkSession, d: str) -> DataFrame:
    per_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        table(spark, d, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))
    )


@query(
    "q15_full_join",
    """SELECT coalesce(a.k, b.k) AS nationkey, a.n AS rich_customers, b.n AS rich_suppliers
       FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 7000 GROUP BY 1) b
       ON a.k = b.k""",
)
def q15_full(spark: SparkSession, d: str) -> DataFrame:
    rich = (
        table(spark, d, "customer").filter("c_acctbal > 9000")
        .groupBy(F.col("c_nationkey").alias("nationkey"))
        .agg(F.count(F.lit(1)).alias("rich_customers"))
    )
    sold = (
        table(spark, d, "supplier").filter("s_acctbal > 7000")
        .groupBy(F.col("s_nationkey").alias("nationkey"))
        .agg(F.count(F.lit(1)).alias("rich_suppliers"))
    )
    return rich.join(sold, "nationkey", "full")


@query(
    "q15_right_join",
    """SELECT r_name, n_nationkey, n_name FROM region
       RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_name <> 'ASIA'""",
)
def q15_right(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").filter("r_name <> 'ASIA'")
    return region.join(
        table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "right"
    ).select("r_name", "n_nationkey", "n_name")


@query(
    "q16_semi",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
def q16(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct()
    return (
        table(spark, d, "customer")
        .join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .select("c_custkey", "c_name")
    )


@query(
    "q17_anti",
    """SELECT c_custkey, c_name FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select("o_custkey").distinct()
    return (
        table(spark, d, "customer")
        .join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .select("c_custkey", "c_name")
    )


_GAPPED_EVENTS_SQL = """(SELECT event_id, ts, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"""
_GAPPED_ORDERS_SQL = """(SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"""


def _gapped(df: DataFrame, row: str, key: str, value: str) -> DataFrame:
    """Windows are checked with rows without a key and rows without a value among the others."""
    return df.withColumn(key, F.when(F.col(row) % 50 != 0, F.col(key))).withColumn(
        value, F.when(F.col(row) % 7 != 0, F.col(value))
    )


def _gapped_events(spark: SparkSession, d: str) -> DataFrame:
    return _gapped(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "event_id", "user_id", "value")


def _gapped_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return _gapped(orders, "o_orderkey", "o_custkey", "o_totalprice")


@query(
    "q18_theta",
    f"""SELECT a.event_id, count(b.event_id) AS followers FROM {_GAPPED_EVENTS_SQL} a
       LEFT JOIN {_GAPPED_EVENTS_SQL} b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
       GROUP BY 1""",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    """A join never matches a null key, so events without a user have no followers."""
    events = _gapped_events(spark, d).select("event_id", "user_id", "ts")
    after = range_frame_sums(
        events.filter("user_id IS NOT NULL"), "user_id", "ts", F.lit(1), F.expr("INTERVAL '0' HOUR"),
        F.expr("INTERVAL '1' HOUR"), "followers", open_start=True, by="event_id",
    )
    alone = events.filter("user_id IS NULL").select("event_id", F.lit(0).cast("long").alias("followers"))
    return after.select("event_id", F.coalesce("followers", F.lit(0)).alias("followers")).unionByName(alone)


@query(
    "q20_group_having",
    """SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_quantity), 6) AS mean_qty,
              min(l_extendedprice) AS low, max(l_extendedprice) AS high
       FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 15300""",
)
def q20(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.round(F.avg("l_quantity"), 6).alias("mean_qty"),
            F.min("l_extendedprice").alias("low"),
            F.max("l_extendedprice").alias("high"),
        )
        .filter(F.col("qty") > 15300)
    )


@query(
    "q21_distinct",
    """SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS buyers
       FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM orders) GROUP BY 1, 2""",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .select("o_orderstatus", "o_orderpriority", "o_custkey")
        .distinct()
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count("o_custkey").alias("buyers"))
    )


@query(
    "q22_filtered_agg",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'click') AS clicks,
              round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS bought,
              sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors
       FROM events GROUP BY 1""",
)
def q22(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return (
        table(spark, d, "events")
        .groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count_if(kind == "click").alias("clicks"),
            F.round(F.sum(F.when(kind == "purchase", F.col("value"))), 2).alias("bought"),
            F.sum(F.when(kind == "error", 1).otherwise(0)).alias("errors"),
        )
    )


@query(
    "q23_group_concat",
    """SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations
       FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    df, _ = run_readonly(
        spark,
        """SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations
           FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name""",
        nation=table(spark, d, "nation"),
        region=table(spark, d, "region"),
    )
    return df


@query(
    "q24_rank",
    """SELECT o_orderkey, row_number() OVER p AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS dense,
              ntile(4) OVER p AS quart, round(percent_rank() OVER v, 9) AS pct,
              round(cume_dist() OVER v, 9) AS cume
       FROM """ + _GAPPED_ORDERS_SQL + """
       WINDOW p AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey),
              v AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""",
)
def q24(spark: SparkSession, d: str) -> DataFrame:
    orders = _gapped_orders(spark, d).select("o_custkey", "o_totalprice", "o_orderkey")
    down = F.col("o_totalprice").desc()
    rows = running_sums(orders, "o_custkey", [down, "o_orderkey"], {"rn": F.lit(1)}, keep_segment=True)
    level = orders.groupBy("o_custkey", "o_totalprice").agg(F.count(F.lit(1)).alias("c"))
    level = running_sums(level, "o_custkey", [down], {"upto": F.col("c"), "dense": F.lit(1)}, keep_segment=True)
    size = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    level = spread_join(level, size, ["o_custkey"]).drop(SEG)
    rnk = F.col("upto") - F.col("c") + 1
    even, odd = F.expr("size div 4"), F.expr("size % 4")
    wide = odd * (even + 1)
    quart = F.when(F.col("rn") <= wide, F.floor((F.col("rn") - 1) / (even + 1)) + 1).otherwise(
        odd + F.floor((F.col("rn") - 1 - wide) / F.greatest(even, F.lit(1))) + 1
    )
    pct = F.when(F.col("size") > 1, (rnk - 1) / (F.col("size") - 1)).otherwise(F.lit(0.0))
    return (
        spread_join(rows, level, ["o_custkey", "o_totalprice"])
        .select(
            "o_orderkey", "rn", rnk.alias("rnk"), "dense", quart.alias("quart"),
            F.round(pct, 9).alias("pct"), F.round(F.col("upto") / F.col("size"), 9).alias("cume"),
        )
    )


@query(
    "q25_offset_fns",
    """SELECT event_id, lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value,
              first_value(value) OVER f AS first_v, last_value(value) OVER f AS last_v,
              nth_value(value, 3) OVER f AS third_v
       FROM """ + _GAPPED_EVENTS_SQL + """
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
              f AS (PARTITION BY user_id ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def q25(spark: SparkSession, d: str) -> DataFrame:
    events = _gapped_events(spark, d)
    near = neighbours(events, "user_id", ["ts", "event_id"], "value", "prev_value", "next_value", keep_segment=True)
    at = F.struct("ts", "event_id")
    ends = events.groupBy("user_id").agg(
        F.min_by("value", at).alias("first_v"), F.max_by("value", at).alias("last_v")
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    third = (
        events.withColumn("_n", place).filter("_n <= 3").filter("_n = 3")
        .select("user_id", F.col("value").alias("third_v"))
    )
    third = third.withColumnRenamed("user_id", "_u")
    per_user = ends.join(third, F.col("user_id").eqNullSafe(F.col("_u")), "left").drop("_u")
    return spread_join(near, per_user, ["user_id"]).select(
        "event_id", "prev_value", "next_value", "first_v", "last_v", "third_v"
    )


@query(
    "q26_frames",
    """SELECT o_orderkey,
              round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                    ROWS UNBOUNDED PRECEDING), 2) AS running_total,
              round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3_total,
              round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
                    RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), 2) AS days30_total
       FROM """ + _GAPPED_ORDERS_SQL,
)
def q26(spark: SparkSession, d: str) -> DataFrame:
    orders = _gapped_orders(spark, d)
    order = ["o_orderdate", "o_orderkey"]
    run = running_sums(orders, "o_custkey", order, {"run": F.col("o_totalprice")}, keep_segment=True)
    run = recent_sums(run, "o_custkey", order, "o_totalprice", 3, "last3", segmented=True)
    days = range_frame_sums(
        orders, "o_custkey", "o_orderdate", F.col("o_totalprice"),
        F.expr("INTERVAL '-30' DAY"), F.expr("INTERVAL '0' DAY"), "days30",
    )
    return spread_join(run, days, ["o_custkey", "o_orderdate"]).select(
        "o_orderkey", F.round("run", 2).alias("running_total"), F.round("last3", 2).alias("last3_total"),
        F.round("days30", 2).alias("days30_total"),
    )


def _buyers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))


def _debtors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))


_SETS = """SELECT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
{op} SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0)"""


@query("q27_union", _SETS.format(op="UNION"))
def q27(spark: SparkSession, d: str) -> DataFrame:
    return _buyers(spark, d).union(_debtors(spark, d)).distinct()


@query("q28_intersect", _SETS.format(op="INTERSECT"))
def q28(spark: SparkSession, d: str) -> DataFrame:
    return _buyers(spark, d).intersect(_debtors(spark, d))


@query("q29_except", _SETS.format(op="EXCEPT"))
def q29(spark: SparkSession, d: str) -> DataFrame:
    return _buyers(spark, d).subtract(_debtors(spark, d))


@query(
    "q30_scalar_subquery",
    """SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice >
         (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
)
def q30(spark: SparkSession, d: str) -> DataFrame:
    """The mean per customer is worked out once and met by the orders in shares of a customer."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    joined = spread_join(orders, mean, ["o_custkey"], by="o_orderkey", nulls=False)
    return joined.filter(F.col("o_totalprice") > F.col("mean")).select("o_orderkey", "o_custkey")


@query(
    "q32_case",
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'drop'
              ELSE 'review' END AS verdict,
              coalesce(nullif(quality, 0), -1) AS q, CASE WHEN toxic = 1 THEN 'y' ELSE 'n' END AS t
       FROM labels""",
)
def q32(spark: SparkSession, d: str) -> DataFrame:
    quality, toxic = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").select(
        "doc_id",
        F.when((quality == 1) & (toxic == 0), "keep").when(toxic == 1, "drop")
        .otherwise("review").alias("verdict"),
        F.coalesce(F.nullif(quality, F.lit(0)), F.lit(-1)).alias("q"),
        F.expr("if(toxic = 1, 'y', 'n')").alias("t"),
    )


@query(
    "q33_sort_nulls",
    """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)
       ORDER BY quality ASC NULLS FIRST, doc_id""",
)
def q33(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "documents").select("doc_id")
        .join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
        .orderBy(F.col("quality").asc_nulls_first(), "doc_id")
    )


@query(
    "q34_topk_per_group",
    """SELECT l_suppkey, l_partkey, revenue, rn FROM (
         SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) AS rn
         FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS revenue
               FROM lineitem GROUP BY 1, 2)) WHERE rn <= 3""",
)
def q34(spark: SparkSession, d: str) -> DataFrame:
    sold = (
        table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    )
    best = Window.partitionBy("l_suppkey").orderBy(F.col("revenue").desc(), "l_partkey")
    return sold.withColumn("rn", F.row_number().over(best)).filter("rn <= 3")


@query(
    "q35_approx_distinct",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact_n, true AS within_bound
       FROM lineitem GROUP BY 1""",
)
def q35(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    guess = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.01).alias("guess")
    )
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("exact_n"))
    return exact.join(guess, "l_returnflag").select(
        "l_returnflag", "exact_n",
        (F.abs(F.col("guess") - F.col("exact_n")) <= 0.05 * F.col("exact_n")).alias("within_bound"),
    )


@query(
    "f_string",
    """SELECT p_partkey, substr(p_name, 2, 4) AS sub, CAST(instr(p_name, 'l') AS INTEGER) AS pos,
              CAST(length(p_name) AS INTEGER) AS len, upper(p_name) AS up,
              trim('  ' || p_brand || ' ') AS trimmed, replace(p_name, ' ', '_') AS snake,
              p_brand || '/' || p_type AS tag FROM part""",
)
def f_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        F.substring("p_name", 2, 4).alias("sub"),
        F.instr("p_name", "l").alias("pos"),
        F.length("p_name").alias("len"),
        F.upper("p_name").alias("up"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("tag"),
    )


@query(
    "f_date",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
              CAST(day(o_orderdate) AS INTEGER) AS dd,
              CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
              strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
              strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders""",
)
def f_date(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.year(at).alias("y"),
        F.month(at).alias("m"),
        F.dayofmonth(at).alias("dd"),
        F.datediff(at.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_format(F.date_trunc("month", at), "yyyy-MM-dd").alias("month_start"),
        F.date_format(at, "dd/MM/yyyy").alias("shown"),
    )


@query(
    "f_math",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(l_discount - l_tax) AS gap,
              round(l_extendedprice * l_tax, 4) AS tax, CAST(l_quantity AS BIGINT) % 7 AS m,
              least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high FROM lineitem""",
)
def f_math(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("tax"),
        (F.col("l_quantity").cast("bigint") % 7).alias("m"),
        F.least("l_discount", "l_tax").alias("low"),
        F.greatest("l_discount", "l_tax").alias("high"),
    )


@query(
    "f_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              json_extract_string(props, '$.none') AS missing FROM events""",
)
def f_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.get_json_object("props", "$.none").alias("missing"),
    )


@query(
    "f_cond",
    """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'B') AS seg,
              CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state FROM customer""",
)
def f_cond(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey",
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("B")).alias("seg"),
        F.expr("if(c_acctbal < 0, 'debt', 'ok')").alias("state"),
    )


@query(
    "f_cast",
    """SELECT o_orderkey, TRY_CAST(o_orderstatus AS INTEGER) AS bad,
              CAST(o_totalprice AS VARCHAR) IS NOT NULL AS has_text,
              TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS prio FROM orders""",
)
def f_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").try_cast("int").alias("bad"),
        F.col("o_totalprice").cast("string").isNotNull().alias("has_text"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("int").alias("prio"),
    )
