"""Queries of the small operators that larger ones are composed of: rolling measures, scalar rules, selections."""

from __future__ import annotations

from tidemark.functions import checks as C
from tidemark.functions import scalar as X
from tidemark.operators import grid as GR
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import paths as PA
from tidemark.operators import ranking as K
from tidemark.operators import resample as R
from tidemark.operators import skyline
from tidemark.plans.base import BE, BO, DAY, Book, DataFrame, F, SparkSession, rounded
from tidemark.session import table
from tidemark.sources.bars import bars_events, bars_orders

BOOK = Book()
add = BOOK.add
KEY = ["event_type"]
OVER = "PARTITION BY event_type ORDER BY open_time_ms"


@add("w2_trailing_std", f"""WITH {BE} SELECT event_type, open_time_ms, round(coalesce(stddev_samp(close) OVER ({OVER} ROWS 20 PRECEDING), 0), 6) AS std FROM be""")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars_events(spark, d).select(*KEY, "open_time_ms", I.trailing_std("close", I.window(KEY), 21).alias("std")))


@add("w3_mean_abs_change", f"""WITH {BE}, s AS (SELECT event_type, open_time_ms, abs(close - lag(close) OVER ({OVER})) AS step FROM be)
    SELECT event_type, open_time_ms, round(coalesce(avg(step) OVER ({OVER} ROWS 14 PRECEDING), 0), 6) AS change FROM s""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.mean_abs_change(bars_events(spark, d), KEY, 16, "change").select(*KEY, "open_time_ms", "change"))


@add("w5_rolling_max", f"""WITH {BE} SELECT event_type, open_time_ms, max(close) OVER ({OVER} ROWS 111 PRECEDING) AS high_slow FROM be""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return I.indicators(bars_events(spark, d), KEY).select(*KEY, "open_time_ms", "high_slow")


@add("f8_evaluation_range", f"""WITH {BO} SELECT open_time_ms, close FROM bo WHERE open_time_ms >= {9000 * DAY} AND open_time_ms <= {9500 * DAY}""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return bars_orders(spark, d).where(C.in_evaluation(9000 * DAY, 9500 * DAY)).select("open_time_ms", "close")


@add("f12_completed_daily", f"""WITH {BO} SELECT open_time_ms FROM bo WHERE open_time_ms + {DAY} + 90 * 60000 <= {9500 * DAY}""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return R.completed_daily(bars_orders(spark, d), "UTC", 9500 * DAY).select("open_time_ms")


@add("f23_finite_values", """SELECT event_type, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE ELSE value END AS x FROM events) WHERE x IS NOT NULL AND isfinite(x) GROUP BY 1""")
def f23(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x = F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("-inf")).otherwise(F.col("value"))
    rows = table(spark, d, "events").select(*KEY, x.alias("x")).where(C.finite(F.col("x")))
    return rounded(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")))


@add("j4_matched_changes", f"""WITH {BE}, j AS (SELECT a.event_type, a.open_time_ms, a.close AS l, b.high AS r FROM be a JOIN be b ON a.event_type = b.event_type AND a.open_time_ms = b.open_time_ms AND b.close > b.open),
    p AS (SELECT *, lag(l) OVER ({OVER}) AS pl, lag(r) OVER ({OVER}) AS pr FROM j)
    SELECT event_type, open_time_ms, round(CASE WHEN pl > 0 THEN l / pl - 1 ELSE 0 END, 6) AS left_change, round(CASE WHEN pr > 0 THEN r / pr - 1 ELSE 0 END, 6) AS right_change FROM p""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d)
    rising = b.where("close > open").select(*KEY, "open_time_ms", F.col("high").alias("nav"))
    return rounded(J.matched_changes(b.select(*KEY, "open_time_ms", F.col("close").alias("nav")), rising, KEY).select(*KEY, "open_time_ms", "left_change", "right_change"))


@add("j18_two_objective_front", """WITH p AS (SELECT o_orderpriority AS k, o_orderkey AS id, o_totalprice AS a, -(o_custkey::DOUBLE) AS b FROM orders)
    SELECT k, id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.k = p.k AND q.a >= p.a AND q.b >= p.b AND (q.a > p.a OR q.b > p.b))""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), (-F.col("o_custkey").cast("double")).alias("b"))
    return skyline.pareto(p, ["k"], ["a", "b"], "id").select("k", "id")


@add("t3_first_by_priority", """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1""")
def t3(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return K.first_by_priority(table(spark, d, "orders"), ["o_custkey"], [mode, F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@add("t10_centre_cascade", """WITH a AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part), b AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS n FROM a WHERE p_size = m)
    SELECT p_brand, p_partkey FROM b WHERE p_retailprice = n""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return GR.centre_cascade(table(spark, d, "part"), "p_brand", [F.col("p_size"), F.col("p_retailprice")]).select("p_brand", "p_partkey")


@add("x7_month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.month_key(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("month"))


@add("x13_symbol", "SELECT p_partkey, upper(p_name) AS symbol FROM part")
def x13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.symbol(F.concat(F.lit("  "), F.lower("p_name"), F.lit(" "))).alias("symbol"))


@add("x18_normalised", """WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
    SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE 0 END, 6) AS x FROM part JOIN r USING (p_brand)""")
def x18(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    r = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return rounded(p.join(r, "p_brand").select("p_partkey", PA.normalized(F.col("p_retailprice"), F.col("lo"), F.col("hi")).alias("x")))


@add("x19_reflected", """WITH v AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer), m AS (SELECT c_custkey, x - 2 * floor(x / 2) AS r FROM v) SELECT c_custkey, round(CASE WHEN r > 1 THEN 2 - r ELSE r END, 6) AS x FROM m""")
def x19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "customer").select("c_custkey", X.reflected(F.col("c_acctbal") / 1000).alias("x")))


@add("x23_triangular", """SELECT o_orderkey, round((('0x' || sha256('3|' || o_orderkey || '|0')[1:13])::BIGINT - ('0x' || sha256('3|' || o_orderkey || '|1')[1:13])::BIGINT) / 16.0 ^ 13, 9) AS u FROM orders""")
def x23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "orders").select("o_orderkey", X.triangular(F.lit(3), F.col("o_orderkey")).alias("u")), 9)


@add("x30_bounded_sigmoid", "SELECT c_custkey, round(0.2 + 0.6 / (1 + exp(-c_acctbal / 500)), 6) AS weight FROM customer")
def x30(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "customer").select("c_custkey", X.bounded_sigmoid(F.col("c_acctbal") / 500, 0.2, 0.8).alias("weight")))


@add("x32_prefixed_sha256", "SELECT p_partkey, 'sha256:' || sha256(p_name) AS hash FROM part")
def x32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.prefixed_sha256(F.col("p_name").cast("binary")).alias("hash"))


@add("a50_progress", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') / count(*) AS progress FROM orders GROUP BY 1""")
def a50(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("valid"), F.count(F.lit(1)).alias("total"))
    return done.select("o_custkey", X.progress(F.col("valid"), F.col("total")).alias("progress"))


@add("a5_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", R.period_key(F.unix_millis(F.col("o_orderdate").cast("timestamp")), "week").alias("week"))


@add("a40_average_ranks", """SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS place FROM part""")
def a40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", K.average_rank("p_size", ["p_brand"]).alias("place"))
