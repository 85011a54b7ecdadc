"""Queries of joins, sets, ranking, grids, scalar functions and pure-window simulations."""

from __future__ import annotations

from tidemark.functions import scalar as X
from tidemark.operators import grid as G
from tidemark.operators import joins as J
from tidemark.operators import ranking as K
from tidemark.operators import simulate as S
from tidemark.operators import skyline
from tidemark.plans.base import BE, BEH, BO, DAY, HOUR, Book, DataFrame, F, SparkSession, rounded
from tidemark.session import table
from tidemark.sources.bars import bars_events, bars_orders, with_availability

BOOK = Book()
add = BOOK.add


def _navs(spark: SparkSession, d: str, t: str) -> DataFrame:
    return bars_events(spark, d).where(F.col("event_type") == t).select("open_time_ms", F.col("close").alias("nav"))


AV = f"s AS (SELECT open_time_ms AS time_ms, open_time_ms + (1 + (open_time_ms // {DAY}) % 4) * {DAY} AS avail_ms, close AS value FROM be WHERE event_type = 'view')"


@add("j5_as_of", f"""WITH {BE}, {AV}, t AS (SELECT DISTINCT open_time_ms AS time_ms FROM be),
    m AS (SELECT t.time_ms, max(s.time_ms) AS matched_ms FROM t LEFT JOIN s ON s.time_ms <= t.time_ms AND s.avail_ms <= t.time_ms GROUP BY 1)
    SELECT m.time_ms, round(s.value, 6) AS value, m.matched_ms, CASE WHEN m.matched_ms IS NULL THEN 'missing' WHEN m.matched_ms = m.time_ms THEN 'aligned' ELSE 'filled' END AS kind FROM m LEFT JOIN s ON s.time_ms = m.matched_ms""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d)
    series = with_availability(b.where("event_type = 'view'"), (1 + F.col("open_time_ms") / DAY % 4).cast("int"))
    series = series.select(F.col("open_time_ms").alias("time_ms"), "avail_ms", F.col("close").alias("value"))
    return rounded(J.as_of(b.select(F.col("open_time_ms").alias("time_ms")).distinct(), series, []))


@add("j5_alignment_summary", f"""WITH {BE}, {AV}, t AS (SELECT DISTINCT open_time_ms AS time_ms FROM be), m AS (SELECT t.time_ms, max(s.time_ms) AS matched_ms FROM t LEFT JOIN s ON s.time_ms <= t.time_ms AND s.avail_ms <= t.time_ms GROUP BY 1)
    SELECT count(matched_ms) AS aligned, count(*) FILTER (matched_ms IS NULL) AS missing, count(*) FILTER (matched_ms < time_ms) AS filled FROM m""")
def j5s(spark: SparkSession, d: str) -> DataFrame:
    return J.alignment_summary(j5(spark, d), [])


@add("j2_path_with_benchmark", f"""WITH {BE}, b AS (SELECT open_time_ms, close AS benchmark_nav, close / lag(close) OVER (ORDER BY open_time_ms) - 1 AS r FROM be WHERE event_type = 'view' AND (open_time_ms // {DAY}) % 5 <> 0)
    SELECT be.open_time_ms, round(be.close, 6) AS nav, round(benchmark_nav, 6) AS benchmark_nav, round(r, 6) AS benchmark_return FROM be LEFT JOIN b USING (open_time_ms) WHERE event_type = 'click'""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.with_benchmark(_navs(spark, d, "click"), _navs(spark, d, "view").where(F.col("open_time_ms") / DAY % 5 != 0), []))


@add("j3_matched_changes", f"""WITH {BE}, m AS (SELECT a.open_time_ms, a.close AS l, b.close AS r FROM be a JOIN be b USING (open_time_ms) WHERE a.event_type = 'click' AND b.event_type = 'view' AND (open_time_ms // {DAY}) % 5 <> 0)
    SELECT open_time_ms, round(l, 6) AS left_nav, round(r, 6) AS right_nav, round(coalesce(l / lag(l) OVER w - 1, 0), 6) AS left_change, round(coalesce(r / lag(r) OVER w - 1, 0), 6) AS right_change FROM m WINDOW w AS (ORDER BY open_time_ms)""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.matched_changes(_navs(spark, d, "click"), _navs(spark, d, "view").where(F.col("open_time_ms") / DAY % 5 != 0), []))


@add("j15_pareto_front", """WITH p AS (SELECT p_brand, p_partkey, p_retailprice AS a, p_size::DOUBLE AS b FROM part)
    SELECT p_brand, p_partkey, a, b FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.p_brand = x.p_brand AND y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return skyline.pareto(p, ["p_brand"], ["a", "b"], "p_partkey")


GRID = "g AS (SELECT l_linenumber AS x, l_quantity::INT AS y, l_suppkey % 5 AS z, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"
FINE = GRID.replace("% 5", "% 50")


def points(spark: SparkSession, d: str, z: int = 5) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_suppkey") % z).alias("z")).agg(F.avg("l_extendedprice").alias("v"))


@add("j13_box_neighbours", f"""WITH {GRID} SELECT a.x, a.y, a.z, count(*) AS n, round(avg(b.v), 6) AS mean, round(quantile_cont(b.v, 0.5), 6) AS median, round(stddev_pop(b.v), 3) AS std
    FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY a.x, a.y, a.z""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    near = J.box_neighbours(points(spark, d), [], ["x", "y", "z"], 1)
    return rounded(near.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"), F.avg("n_v").alias("mean"), F.percentile("n_v", F.lit(0.5)).alias("median"), F.round(F.stddev_pop("n_v"), 3).alias("std")))


@add("j14_axis_neighbours", f"""WITH {GRID} SELECT a.x, a.y, a.z, count(*) AS n FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY ALL""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return J.axis_neighbours(points(spark, d), [], ["x", "y", "z"]).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


@add("j21_full_grid", """WITH n AS (SELECT count(DISTINCT l_linenumber) AS f, count(DISTINCT l_returnflag) AS g, count(DISTINCT l_quantity) AS h FROM lineitem) SELECT a.r AS f, b.r AS g, c.r AS h FROM n, unnest(range(n.f)) a(r), unnest(range(n.g)) b(r), unnest(range(n.h)) c(r) WHERE NOT (a.r = 3 AND b.r = 2)""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    """Axes as long as lineitem has line numbers, flags and quantities."""
    sizes = table(spark, d, "lineitem").agg(*[F.count_distinct(c).alias(a) for a, c in (("f", "l_linenumber"), ("g", "l_returnflag"), ("h", "l_quantity"))])
    return J.full_grid(sizes, ["f", "g", "h"]).where("NOT (f = 3 AND g = 2)")


@add("j25_missing_coordinates", f"""WITH {FINE} SELECT x.r + 1 AS x, y.r + 1 AS y, z.r AS z FROM range(7) x(r), range(50) y(r), range(50) z(r) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.x = x.r + 1 AND g.y = y.r + 1 AND g.z = z.r)""")
def j25(spark: SparkSession, d: str) -> DataFrame:
    sizes = spark.range(1).select(F.lit(7).cast("long").alias("x"), F.lit(50).cast("long").alias("y"), F.lit(50).cast("long").alias("z"))
    grid = J.full_grid(sizes, ["x", "y", "z"]).select((F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), "z")
    return J.missing_coordinates(grid, points(spark, d, 50), ["x", "y", "z"])


@add("j26_eligible_items", """SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')""")
def j26(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").join(blocked, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@add("j30_integrity_count", """SELECT n_name, count(DISTINCT o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def j30(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("c_custkey").alias("customers"))


@add("j31_ownership", """SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region))""")
def j31(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "region").orderBy("r_name").limit(1)
    owned = table(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, d, "supplier").join(owned, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@add("j38_paired_differences", """WITH g AS (SELECT l_returnflag AS c, l_partkey AS k, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY ALL)
    SELECT a.k, round(a.d - b.d, 6) AS d, round(a.t - b.t, 6) AS t FROM g a JOIN g b ON a.k = b.k WHERE a.c = 'A' AND b.c = 'N'""")
def j38(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("c"), F.col("l_partkey").alias("k")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return rounded(J.paired_differences(g, "A", "N", "c", "k", ["d", "t"]))


@add("j39_ancestors", """WITH RECURSIVE a(node, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P' UNION SELECT node // 2, depth + 1 FROM a WHERE node // 2 > 0)
    SELECT node, min(depth) AS depth FROM a GROUP BY node HAVING min(depth) > 0""")
def j39(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_orderkey")).first()[0]
    edges = spark.range(1, top + 1).select(F.col("id").alias("child"), F.when(F.expr("id div 2") > 0, F.expr("id div 2")).alias("parent"))
    return J.ancestors(edges, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("child")), "child", "parent")


@add("u15_union_of_points", """SELECT DISTINCT l_partkey % 500 AS k FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def u15(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    key = (F.col("l_partkey") % 500).alias("k")
    return li.where("l_returnflag = 'A'").select(key).union(li.where("l_returnflag = 'N'").select(key)).distinct()


@add("u16_missing_by_configuration", """WITH p AS (SELECT DISTINCT l_linenumber AS c, l_partkey AS k FROM lineitem) SELECT c.c, k.k FROM (SELECT DISTINCT c FROM p) c, (SELECT DISTINCT k FROM p) k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.c = c.c AND p.k = k.k)""")
def u16(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("c"), F.col("l_partkey").alias("k")).distinct()
    return J.missing_by_configuration(p, "c", "k").select("c", "k")


@add("u7_unique_within", """WITH v AS (SELECT l_returnflag, l_extendedprice AS v, l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS d FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sum(v), 2) AS total FROM v WHERE d IS NULL OR d > 0.5 GROUP BY 1""")
def u7(spark: SparkSession, d: str) -> DataFrame:
    u = K.unique_within(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5)
    return rounded(u.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")), 2)


@add("u10_components_of_grid", f"""WITH RECURSIVE {GRID}, q AS (SELECT x, y FROM g GROUP BY x, y HAVING avg(v) > 38000), r(x, y, cx, cy) AS (SELECT x, y, x, y FROM q UNION SELECT q.x, q.y, r.cx, r.cy FROM r JOIN q ON abs(q.x - r.x) + abs(q.y - r.y) = 1)
    SELECT x, y, min(cx * 1000 + cy)::BIGINT AS component FROM r GROUP BY x, y""")
def u10(spark: SparkSession, d: str) -> DataFrame:
    q = points(spark, d).groupBy("x", "y").agg(F.avg("v").alias("v")).where("v > 38000")
    return G.grid_components(q.select("x", "y"), ["x", "y"], F.col("x").cast("long") * 1000 + F.col("y"))


@add("a17_midrank_percentile", """WITH s AS (SELECT event_type, value FROM events), v AS (SELECT event_id, event_type, value FROM events)
    SELECT v.event_type, round(v.value, 6) AS value, round(100.0 * (sum((s.value < v.value - 1e-12)::INT) + 0.5 * sum((abs(s.value - v.value) <= 1e-12)::INT)) / count(*), 6) AS percentile FROM v JOIN s USING (event_type) GROUP BY v.event_id, v.event_type, v.value""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rounded(K.midrank_percentile(e, e, ["event_type"]))


@add("a19_metric_groups", """WITH b AS (SELECT l_suppkey, avg(l_discount) AS d0, avg(l_tax) AS t0 FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), r AS (SELECT l_suppkey % 10 AS subject, l_linenumber AS alpha, l_discount - d0 AS discount, l_tax - t0 AS tax FROM lineitem JOIN b USING (l_suppkey)),
    u AS (SELECT subject, alpha, 'discount' AS metric, discount AS v FROM r UNION ALL SELECT subject, alpha, 'tax', tax FROM r)
    SELECT subject, alpha, metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median FROM u GROUP BY ALL""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    base = li.where("l_linenumber = 1").groupBy("l_suppkey").agg(F.avg("l_discount").alias("d0"), F.avg("l_tax").alias("t0"))
    r = li.join(base, "l_suppkey").select((F.col("l_suppkey") % 10).alias("subject"), F.col("l_linenumber").alias("alpha"), (F.col("l_discount") - F.col("d0")).alias("discount"), (F.col("l_tax") - F.col("t0")).alias("tax"))
    u = r.unpivot(["subject", "alpha"], ["discount", "tax"], "metric", "v")
    return rounded(u.groupBy("subject", "alpha", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.5)).alias("median")))


@add("a20_pivot_counts", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@add("a21_coverage", """SELECT count(DISTINCT l_partkey % 200) AS cells, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_partkey % 200 END) AS cells_a, count(DISTINCT CASE WHEN l_tax > 0.07 AND l_quantity > 49 THEN l_partkey % 200 END) AS cells_b,
    round(count(DISTINCT CASE WHEN l_tax > 0.07 AND l_quantity > 49 THEN l_partkey % 200 END) / count(DISTINCT l_partkey % 200), 6) AS ratio_b FROM lineitem""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    cell = F.col("l_partkey") % 200
    b = F.countDistinct(F.when((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 49), cell))
    return rounded(table(spark, d, "lineitem").agg(F.countDistinct(cell).alias("cells"), F.countDistinct(F.when(F.col("l_discount") > 0.05, cell)).alias("cells_a"), b.alias("cells_b"), (b / F.countDistinct(cell)).alias("ratio_b")))


@add("a23_pass_rate_curve", """WITH p AS (SELECT l_returnflag, l_discount, count(*) AS n, sum((l_tax > 0.04)::INT) AS p FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_discount, (sum(n) OVER w)::BIGINT AS n, round(sum(p) OVER w / sum(n) OVER w, 6) AS rate FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount)""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.pass_rate_curve(table(spark, d, "lineitem").withColumn("p", F.col("l_tax") > 0.04), ["l_returnflag"], "l_discount", "p"))


@add("a25_bounds", """SELECT event_type, user_id % 7 AS shard, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY ALL""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@add("a27_next_version", """SELECT n_nationkey, coalesce(max(c_custkey), 0) + 1 AS next FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next"))


@add("a29_safe_ratio", """SELECT c_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / nullif(count(o_orderkey), 0), 6) AS share FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rounded(j.groupBy("c_custkey").agg(F.try_divide(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)), F.count("o_orderkey")).alias("share")))


@add("a37_mutual_information", """WITH j AS (SELECT event_type AS a, user_id % 4 AS b, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT a, b, n / sum(n) OVER () AS p FROM j), m AS (SELECT *, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM p)
    SELECT round(sum(p * ln(p / (pa * pb))) / sqrt(sum(-p * ln(pa)) * sum(-p * ln(pb))), 9) AS nmi FROM m""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.mutual_information(table(spark, d, "events").withColumn("u", F.col("user_id") % 4), "event_type", "u"), 9)


@add("a38_reliability_bins", """SELECT l_returnflag, least(floor(l_discount * 10 * 10), 9)::INT AS bin, count(*) AS n, round(avg(l_discount * 10), 6) AS forecast, round(avg((l_tax > 0.04)::INT), 6) AS observed FROM lineitem GROUP BY 1, 2""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumns({"p": F.col("l_discount") * 10, "y": (F.col("l_tax") > 0.04).cast("int")})
    return rounded(K.reliability_bins(li, ["l_returnflag"], "p", "y"))


@add("a39_spearman", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part)
    SELECT p_brand, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.spearman(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"))


@add("a41_error_metrics", """SELECT l_returnflag, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ^ 2)), 4) AS rmse, round(quantile_cont(abs(l_extendedprice - l_quantity * 1500), 0.5), 4) AS median_error, round(quantile_cont(abs(l_extendedprice - l_quantity * 1500), 0.9), 4) AS p90_error FROM lineitem GROUP BY 1""")
def a41(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.error_metrics(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500), ["l_returnflag"], "l_extendedprice", "p"), 4)


@add("f2_ohlc_validity", f"""WITH {BE} SELECT event_type, count(*) AS n, count(*) FILTER (open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close, low) AND low <= least(open, close)) AS valid FROM (SELECT event_type, open, close, low, CASE WHEN volume > 70 THEN open - 1 ELSE high END AS high FROM be) GROUP BY 1""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d).withColumn("high", F.when(F.col("volume") > 70, F.col("open") - 1).otherwise(F.col("high")))
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.valid_ohlc(*map(F.col, ("open", "high", "low", "close")))).alias("valid"))


@add("f14_json_predicate", """SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT % 10 = 3""")
def f14(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k % 10 = 3")


@add("f18_in_subquery", """SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def f18(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").select("p_partkey")


@add("t2_nulls_last_top1", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 9900 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey) AS r FROM customer) WHERE r = 1""")
def t2(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("c_acctbal") <= 9900, F.col("c_acctbal"))
    return K.first_by_priority(table(spark, d, "customer"), ["c_nationkey"], [a.desc_nulls_last(), F.col("c_custkey").asc()]).select("c_nationkey", "c_custkey")


@add("t4_page", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, ceil((SELECT count(*) FROM orders) / 50)::BIGINT AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return K.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3, 50)


@add("w44_evenly_spaced", f"""WITH {BEH}, r AS (SELECT event_type, open_time_ms, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM be WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)) SELECT event_type, open_time_ms FROM r WHERE n <= 100 OR round(round(i / ((n - 1) / 99)) * ((n - 1) / 99)) = i""")
def w44(spark: SparkSession, d: str) -> DataFrame:
    return K.evenly_spaced(bars_events(spark, d, HOUR).select("event_type", "open_time_ms"), ["event_type"], ["open_time_ms"])


@add("w45_representatives", """WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, p_partkey, p_retailprice, 'low' AS role FROM r WHERE i = 0 UNION ALL SELECT p_brand, p_partkey, p_retailprice, 'median' FROM r WHERE i = n // 2 UNION ALL SELECT p_brand, p_partkey, p_retailprice, 'high' FROM r WHERE i = n - 1""")
def w45(spark: SparkSession, d: str) -> DataFrame:
    return K.representatives(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey")


@add("x_scalars", """SELECT l_orderkey, l_linenumber, sign(l_extendedprice) * floor(abs(l_extendedprice / 7) * 100 + 0.5) / 100 AS cents, round(10000 / (l_extendedprice * 1.001 * 1.002), 6) AS quantity, round(l_quantity * l_extendedprice * 0.999 * 0.998, 1) AS proceeds,
    round(least((l_quantity / 7) % 2, 2 - (l_quantity / 7) % 2), 6) AS reflected, round(round(greatest(0.1, least(0.9, round(l_quantity / 60 / 0.05) * 0.05)), 6), 6) AS lattice FROM lineitem""")
def xs(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.cents(p / 7).alias("cents"), X.buy_quantity(F.lit(10000.0), p, 0.002, 0.001).alias("quantity"), F.round(X.sell_proceeds(q, p, 0.002, 0.001), 1).alias("proceeds"), X.reflected(q / 7).alias("reflected"), X.lattice(q / 60, 0.1, 0.9).alias("lattice"))
    return rounded(out)


@add("x15_relative_metrics", f"""WITH {BE}, p AS (SELECT event_type, open_time_ms, close, max(close) OVER (PARTITION BY event_type ORDER BY open_time_ms) AS pk FROM be), s AS (SELECT event_type, arg_max(close, open_time_ms) AS f, max((pk - close) / pk) AS dd FROM p GROUP BY 1), b AS (SELECT f AS bf, dd AS bd FROM s WHERE event_type = 'view')
    SELECT event_type, round(ln(f / bf), 6) AS log_final_nav_ratio, round(ln((1 - dd) / (1 - bd)), 6) AS log_drawdown_residual_ratio, round(ln(f / bf) * (1 - dd) / (1 - bd), 6) AS performance_drawdown_composite, f > bf AND dd < bd AS qualified FROM s, b""")
def x15(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import performance as P

    n = bars_events(spark, d).select("event_type", "open_time_ms", F.col("close").alias("nav"))
    s = n.groupBy("event_type").agg(F.max_by("nav", "open_time_ms").alias("f")).join(P.max_drawdown(n, ["event_type"]), "event_type")
    both = s.crossJoin(F.broadcast(s.where("event_type = 'view'").select(F.col("f").alias("bf"), F.col("max_drawdown").alias("bd"))))  # one row
    m = X.metrics(F.col("f"), F.col("bf"), F.col("max_drawdown"), F.col("bd"))
    return rounded(both.select("event_type", *[c.alias(k) for k, c in m.items()]))


@add("x22_keyed_uniform", """SELECT o_orderkey, round(('0x' || sha256('7|' || o_orderkey::VARCHAR)[1:13])::BIGINT / 16.0 ^ 13, 9) AS u FROM orders""")
def x22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "orders").select("o_orderkey", X.keyed_uniform(F.lit(7), F.col("o_orderkey")).alias("u")), 9)


@add("x26_halton", """WITH RECURSIVE h(i, k, f, r) AS (SELECT o_orderkey, o_orderkey, 1.0::DOUBLE, 0.0::DOUBLE FROM orders UNION ALL SELECT i, k // 3, f / 3, r + f / 3 * (k % 3) FROM h WHERE k > 0) SELECT i AS o_orderkey, round(max(r), 9) AS h FROM h GROUP BY i""")
def x26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "orders").select("o_orderkey", X.radical_inverse(F.col("o_orderkey"), 3).alias("h")), 9)


@add("b13_ghost_dca", f"""WITH {BO}, m AS (SELECT *, date_trunc('month', make_timestamp(open_time_ms * 1000)) AS m FROM bo), f AS (SELECT *, row_number() OVER (ORDER BY open_time_ms) AS i, lag(m) OVER (ORDER BY open_time_ms) AS pm FROM m),
    q AS (SELECT *, CASE WHEN i = 1 THEN 10000 / (close * 1.0005 * 1.001) WHEN m <> pm THEN 500 / (close * 1.0005 * 1.001) ELSE 0 END AS buy, CASE WHEN i > 1 AND m <> pm THEN 500 ELSE 0 END AS flow FROM f)
    SELECT open_time_ms, round(sum(buy) OVER (ORDER BY open_time_ms) * close, 4) AS nav, (sum(flow) OVER (ORDER BY open_time_ms))::DOUBLE AS injected FROM q""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.ghost_dca(bars_orders(spark, d), [], 10_000.0, 500.0, 0.001, 0.0005).select("open_time_ms", "nav", "injected"), 4)


@add("b12_rule_targets", f"""WITH {BE}, r AS (SELECT event_type, open_time_ms, day(make_timestamp(open_time_ms * 1000)) AS dom, row_number() OVER (PARTITION BY event_type ORDER BY open_time_ms) - 1 AS i FROM be)
    SELECT event_type, open_time_ms, 1.0::DOUBLE AS always, (dom % 2 = 1)::INT::DOUBLE AS odd_day, (dom % 2 = 0)::INT::DOUBLE AS even_day, ((i // 5) % 2 = 0)::INT::DOUBLE AS toggle FROM r""")
def b12(spark: SparkSession, d: str) -> DataFrame:
    return S.rule_targets(bars_events(spark, d), ["event_type"], 5).select("event_type", "open_time_ms", "always", "odd_day", "even_day", "toggle")


@add("b18_window_scores", f"""WITH {BE}, p AS (SELECT event_type, open_time_ms // {7 * DAY} AS win, open_time_ms, close, max(close) OVER (PARTITION BY event_type, open_time_ms // {7 * DAY} ORDER BY open_time_ms) AS pk FROM be), s AS (SELECT event_type, win, arg_max(close, open_time_ms) / arg_min(close, open_time_ms) - 1 AS roi, max((pk - close) / pk) AS dd FROM p GROUP BY 1, 2)
    SELECT s.event_type, s.win, round(CASE WHEN s.dd >= 0.88 THEN -99999 ELSE s.roi - b.roi - 1.5 * greatest(0, s.dd - b.dd) END, 6) AS score FROM s JOIN s b ON b.win = s.win AND b.event_type = 'view'""")
def b18(spark: SparkSession, d: str) -> DataFrame:
    n = bars_events(spark, d).select("event_type", F.floor(F.col("open_time_ms") / (7 * DAY)).alias("win"), "open_time_ms", F.col("close").alias("nav"))
    return rounded(S.window_scores(n, "event_type", "view", "win"))


@add("a31_lattice_counts", """SELECT 'discount' AS param, round(l_discount / 0.05)::INT AS step, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'tax', round(l_tax / 0.05)::INT, count(*) FROM lineitem GROUP BY 2""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.explode(F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"))).alias("param", "v"))
    return m.groupBy("param", F.round(F.col("v") / 0.05).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"))


