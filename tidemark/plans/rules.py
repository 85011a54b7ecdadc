"""Queries of validity rules, lookups, ownership, paging, order statistics, geometry and distribution functions."""

from __future__ import annotations

from tidemark.functions import checks as C
from tidemark.functions import scalar as X
from tidemark.operators import grid as GR
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import learning as L
from tidemark.operators import paths as PA
from tidemark.operators import performance as PF
from tidemark.operators import ranking as K
from tidemark.operators import resample as R
from tidemark.operators import robust as RB
from tidemark.operators import sampling as G
from tidemark.operators import simulate as S
from tidemark.operators import states as W
from tidemark.plans.base import BE, BO, DAY, HOUR, Book, DataFrame, F, SparkSession, be, rounded
from tidemark.session import table
from tidemark.sources import store, upsert
from tidemark.sources.bars import bars_events, bars_orders, scan

BOOK = Book()
add = BOOK.add
KEY = ["event_type"]
OVER = "PARTITION BY event_type ORDER BY open_time_ms"

# bars with made-up faults: high below low, no number, a negative low, a negative count, a time of 0
FAULTY = f"""{BE}, x AS (SELECT event_type, open_time_ms AS id, CASE WHEN open_time_ms // {DAY} % 19 = 0 THEN 0 ELSE open_time_ms END AS open_time_ms, CASE WHEN open_time_ms // {DAY} % 11 = 0 THEN 'nan'::DOUBLE ELSE open END AS open,
    CASE WHEN open_time_ms // {DAY} % 7 = 0 THEN low / 2 ELSE high END AS high, CASE WHEN open_time_ms // {DAY} % 13 = 0 THEN -low ELSE low END AS low, close, CASE WHEN open_time_ms // {DAY} % 5 = 0 THEN -volume ELSE volume END AS volume FROM be)"""
PRICES = "isfinite(open) AND open > 0 AND isfinite(high) AND high > 0 AND isfinite(low) AND low > 0 AND isfinite(close) AND close > 0"
HELD = "high >= greatest(open, close) AND low <= least(open, close)"


def faulty(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr(f"open_time_ms div {DAY}")
    made = {
        "id": F.col("open_time_ms"),
        "open": F.when(day % 11 == 0, float("nan")).otherwise(F.col("open")),
        "high": F.when(day % 7 == 0, F.col("low") / 2).otherwise(F.col("high")),
        "low": F.when(day % 13 == 0, -F.col("low")).otherwise(F.col("low")),
        "volume": F.when(day % 5 == 0, -F.col("volume")).otherwise(F.col("volume")),
        "open_time_ms": F.when(day % 19 == 0, 0).otherwise(F.col("open_time_ms")),
    }
    return bars_events(spark, d).withColumns(made)


@add("f4_perturbation_bars", f"WITH {FAULTY} SELECT event_type, id, {PRICES} AND {HELD} AND isfinite(volume) AND volume >= 0 AS ok FROM x")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return faulty(spark, d).select(*KEY, "id", C.valid_bar(timed=False, counted=True).alias("ok"))


@add("f5_feature_bars", f"WITH {FAULTY} SELECT event_type, id, {PRICES} AND open_time_ms > 0 AS ok FROM x")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return faulty(spark, d).select(*KEY, "id", C.valid_bar(ordered=False).alias("ok"))


@add("f6_geometry_bars", f"WITH {FAULTY} SELECT event_type, id, {PRICES} AND {HELD} AND open_time_ms > 0 AS ok FROM x")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return faulty(spark, d).select(*KEY, "id", C.valid_bar().alias("ok"))


REGULAR = f"{be(HOUR)}, d AS (SELECT * FROM be WHERE open_time_ms % {DAY} = 0)"


@add("f10_regular_daily", f"WITH {REGULAR} SELECT event_type, open_time_ms, close FROM d")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return bars_events(spark, d, HOUR).where(R.is_canonical_open("open_time_ms", "UTC")).select(*KEY, "open_time_ms", "close")


# weeks start on Monday: day 4 of the epoch was one
WEEK = f"((open_time_ms // {DAY} - 4) // 7 * 7 + 4) * {DAY}"


@add("a2_regular_weekly", f"WITH {REGULAR} SELECT event_type, {WEEK} AS open_time_ms, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close, sum(volume) AS volume FROM d GROUP BY ALL")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return R.resample(bars_events(spark, d, HOUR).where(R.is_canonical_open("open_time_ms", "UTC")), KEY, "week")


@add("f13_complete_periods", f"WITH {BO}, w AS (SELECT {WEEK} AS open_time_ms, max(high) AS high FROM bo GROUP BY 1) SELECT * FROM w WHERE open_time_ms + {7 * DAY} <= {9500 * DAY}")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return R.resample(bars_orders(spark, d), [], "week", as_of_ms=9500 * DAY).select("open_time_ms", "high")


VERSIONS = """v AS (SELECT o_orderkey AS id, o_custkey AS series, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, o_orderkey % 3 > 0 AS published, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE END AS archived_at FROM orders)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("series"), status.alias("status"), (k % 3 > 0).alias("published"), F.when(k % 5 == 0, F.col("o_orderdate").cast("date")).alias("archived_at"))


@add("f17_usable_versions", f"WITH {VERSIONS} SELECT id, series FROM v WHERE status = 'completed' AND published AND archived_at IS NULL")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d).where(C.usable_version()).select("id", "series")


@add("u14_archived_versions", f"""WITH {VERSIONS} SELECT id, CASE WHEN series % 4 = 1 AND status = 'completed' AND published AND archived_at IS NULL THEN '2030-01-01' ELSE archived_at::VARCHAR END AS archived FROM v""")
def u14(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    series = v.select("series").distinct().withColumn("archived_at", F.lit(None).cast("date"))
    _, marked = upsert.archived(series, v, series.where("series % 4 = 1"), "series", F.lit("2030-01-01").cast("date"))
    return marked.select("id", F.col("archived_at").cast("string").alias("archived"))


GRID = "g AS (SELECT l_linenumber AS x, l_quantity::INT AS y, l_suppkey % 5 AS z, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), q AS (SELECT *, v > (SELECT avg(l_extendedprice) FROM lineitem) AS good FROM g)"
AXES = ["x", "y", "z"]
NEAR = " AND ".join(f"abs(a.{c} - b.{c}) <= r.r" for c in AXES)


def judged_points(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    mean = li.agg(F.avg("l_extendedprice")).first()[0]
    per = li.groupBy(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"), (F.col("l_suppkey") % 5).alias("z")).agg(F.avg("l_extendedprice").alias("v"))
    return per.withColumn("good", F.col("v") > mean)


@add("f19_excluded_coordinates", f"WITH {GRID} SELECT a.x, a.y, a.z FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.good AND b.x = a.x AND b.y = a.y AND b.z = a.z)")
def f19(spark: SparkSession, d: str) -> DataFrame:
    p = judged_points(spark, d)
    return J.missing_coordinates(p, p.where("good"), AXES).select(*AXES)


@add("l3_box_radius", f"""WITH {GRID}, o AS (SELECT a.x, a.y, a.z, r.r FROM q a, q b, range(1, 4) r(r) WHERE {NEAR} GROUP BY ALL HAVING bool_and(b.good))
    SELECT q.x, q.y, q.z, coalesce(max(o.r), 0)::INT AS radius FROM q LEFT JOIN o ON o.x = q.x AND o.y = q.y AND o.z = q.z WHERE q.good GROUP BY ALL""")
def l3(spark: SparkSession, d: str) -> DataFrame:
    return GR.box_radius(judged_points(spark, d), [], AXES, "good")


@add("l4_neighbourhood_objectives", f"""WITH {GRID}, p AS (SELECT a.x, a.y, a.z, r.r, count(*) AS n, avg(b.good::INT) AS s FROM q a, q b, range(1, 4) r(r) WHERE {NEAR} GROUP BY ALL)
    SELECT x, y, z, max(n) FILTER (r = 3) AS n_3, round(max(s) FILTER (r = 1), 6) AS good_1, round(max(s) FILTER (r = 3), 6) AS good_3, round(1 / (1 + stddev_pop(s)), 6) AS stability FROM p GROUP BY ALL""")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(GR.neighbourhood_objectives(judged_points(spark, d), [], AXES, ["good"]).select(*AXES, "n_3", "good_1", "good_3", "stability"))


@add("a13_neighbourhood_spread", f"""WITH {GRID} SELECT a.x, a.y, a.z, count(*) AS n, round(avg(b.v), 4) AS mean, round(quantile_cont(b.v, 0.5), 4) AS median, round(stddev_pop(b.v), 3) AS std FROM q a JOIN q b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2 GROUP BY ALL""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    near = J.box_neighbours(judged_points(spark, d), [], AXES, 2).groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"), F.avg("n_v").alias("mean"), F.percentile("n_v", F.lit(0.5)).alias("median"), F.round(F.stddev_pop("n_v"), 3).alias("std"))
    return rounded(near, 4)


@add("j1_beta_common_days", f"""WITH {BE}, b AS (SELECT open_time_ms, close AS b FROM be WHERE event_type = 'view' AND open_time_ms // {DAY} % 3 > 0),
    j AS (SELECT event_type, close / lag(close) OVER ({OVER}) - 1 AS ra, b / lag(b) OVER ({OVER}) - 1 AS rb FROM be JOIN b USING (open_time_ms))
    SELECT event_type, count(*) AS n, round(covar_pop(ra, rb) / var_pop(rb), 6) AS beta FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL AND isfinite(ra) AND isfinite(rb) GROUP BY 1""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d)
    benchmark = b.where((F.col("event_type") == "view") & (F.expr(f"open_time_ms div {DAY}") % 3 > 0)).select("open_time_ms", F.col("close").alias("value"))
    return rounded(PF.daily_beta(b.select(*KEY, "open_time_ms", F.col("close").alias("nav")), benchmark, KEY).select(*KEY, "n", "beta"))


def hull(first: str, last: str) -> str:
    """SQL: (event_type, base, area, slope) of the bars from `first` to `last` around each, by the best chord over each place."""
    return f"""r AS (SELECT *, row_number() OVER ({OVER}) AS i, count(*) OVER (PARTITION BY event_type) AS total FROM be),
    p AS (SELECT t.event_type, t.i AS base, t.open_time_ms, m.i, m.low, m.high, m.close FROM r t JOIN r m ON m.event_type = t.event_type AND m.i BETWEEN t.i + {first} AND t.i + {last} WHERE t.i + {first} >= 1 AND t.i + {last} <= t.total),
    c AS (SELECT a.event_type, a.base, k.i, max(CASE WHEN a.i = b.i THEN a.high ELSE a.high + (b.high - a.high) * (k.i - a.i) / (b.i - a.i) END) AS top, min(CASE WHEN a.i = b.i THEN a.low ELSE a.low + (b.low - a.low) * (k.i - a.i) / (b.i - a.i) END) AS bottom
        FROM p a JOIN p b ON b.event_type = a.event_type AND b.base = a.base AND b.i >= a.i JOIN p k ON k.event_type = a.event_type AND k.base = a.base AND k.i BETWEEN a.i AND b.i GROUP BY ALL),
    h AS (SELECT event_type, base, sum((top - bottom) * CASE WHEN i IN (base + {first}, base + {last}) THEN 0.5 ELSE 1 END) AS area FROM c GROUP BY ALL),
    s AS (SELECT event_type, base, open_time_ms, regr_slope(close, i) AS slope FROM p GROUP BY ALL)"""


@add("j8_geometry_samples", f"""WITH {BE}, f AS (WITH {hull('-4', '0')} SELECT * FROM s JOIN h USING (event_type, base)), t AS (WITH {hull('0', '2')} SELECT * FROM s JOIN h USING (event_type, base))
    SELECT f.event_type, f.open_time_ms, round(f.area, 6) AS area, round(f.slope, 6) AS slope, round(t.area, 6) AS t_area, round(t.slope, 6) AS t_slope FROM f JOIN t ON t.event_type = f.event_type AND t.base = f.base""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    rows = W.geometry(W.geometry(bars_events(spark, d), KEY, 4, 0), KEY, 0, 2, "t_area", "t_slope")
    return rounded(rows.where("area IS NOT NULL AND t_area IS NOT NULL").select(*KEY, "open_time_ms", "area", "slope", "t_area", "t_slope"))


@add("j9_out_of_fold_parts", f"""WITH {BE}, x AS (SELECT *, open_time_ms // {DAY} AS day FROM be), a AS (SELECT event_type, open_time_ms, close / 1000 AS p FROM x WHERE day % 3 > 0), b AS (SELECT event_type, open_time_ms, high - low AS width FROM x WHERE day % 5 > 0), c AS (SELECT event_type, open_time_ms, volume / 1000 AS v FROM x WHERE day % 7 > 0)
    SELECT event_type, open_time_ms, round(p, 6) AS p, round(width, 6) AS width, round(greatest(exp(v) - 1, 1e-12), 6) AS v FROM a JOIN b USING (event_type, open_time_ms) JOIN c USING (event_type, open_time_ms)""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d).withColumn("day", F.expr(f"open_time_ms div {DAY}"))
    key = [*KEY, "open_time_ms"]
    direction = b.where("day % 3 > 0").select(*key, (F.col("close") / 1000).alias("p"))
    joint = b.where("day % 5 > 0").select(*key, (F.col("high") - F.col("low")).alias("width"))
    activity = b.where("day % 7 > 0").select(*key, (F.col("volume") / 1000).alias("v"))
    return rounded(L.combined_predictions(direction, joint, activity, key, ["v"]))


@add("j12_training_examples", f"""WITH {be(HOUR)}, x AS (SELECT *, row_number() OVER ({OVER}) AS i, lead(close, 5) OVER ({OVER}) AS later FROM be)
    SELECT 'direction' AS kind, event_type, open_time_ms, (later > close)::INT::DOUBLE AS y FROM x WHERE i >= 10 AND later IS NOT NULL
    UNION ALL SELECT 'activity', event_type, open_time_ms, round(ln(1 + volume), 6) FROM x WHERE i >= 10""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d, HOUR)
    key = [*KEY, "open_time_ms"]
    features = b.withColumn("i", F.row_number().over(I.window(KEY))).select(*key, "i")
    ready = F.col("i") >= 10
    way = L.examples(features, I.forward_targets(b, KEY, 5).select(*key, "direction"), key, "direction", ["direction"], ready)
    amount = L.examples(features, b.select(*key, "volume"), key, "activity", ["volume"], ready)
    both = way.withColumn("kind", F.lit("direction")).unionByName(amount.withColumn("kind", F.lit("activity")))
    return rounded(both.select("kind", *key, F.col("target")[0].alias("y")))


@add("j27_stale_tasks", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O' AND l_shipdate > o_orderdate + INTERVAL 60 DAY)""")
def j27(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'O'").alias("o")
    held = table(spark, d, "lineitem").where("l_linestatus = 'O'").alias("l")
    return o.join(held, F.expr("l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY"), "left_anti").select("o_orderkey")


@add("j29_origins_stages_points", """SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND o_orderstatus = 'O' AND p_size < 20""")
def j29(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = table(spark, d, "lineitem").where("l_returnflag = 'N'"), table(spark, d, "orders").where("o_orderstatus = 'O'"), table(spark, d, "part").where("p_size < 20")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand")


@add("j32_evaluations_of_studies", """SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'""")
def j32(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name")


@add("j33_items_of_owner", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)""")
def j33(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").join(table(spark, d, "customer").where("c_nationkey = 3"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return table(spark, d, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@add("j34_reports_of_owner", """SELECT c_nationkey, count(*) AS reports FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' GROUP BY 1""")
def j34(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = table(spark, d, "lineitem").where("l_returnflag = 'R'"), table(spark, d, "orders"), table(spark, d, "customer")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("reports"))


@add("j37_listed_paths", """SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (1, 2, 3, 5, 8, 13, 21)""")
def j37(spark: SparkSession, d: str) -> DataFrame:
    named = [1, 2, 3, 5, 8, 13, 21]
    parts = table(spark, d, "part").where(F.col("p_partkey").isin(named)).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return C.lookup(table(spark, d, "lineitem").where(F.col("l_partkey").isin(named)), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@add("a9_quantile_set", f"""SELECT event_type, {', '.join(f'round(quantile_cont(value, {p}), 6) AS q{int(p * 100)}' for p in (0.0, 0.1, 0.5, 0.9, 1.0))} FROM events GROUP BY 1""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "events").groupBy(*KEY).agg(*PF.quantiles("value", {f"q{int(p * 100)}": p for p in (0.0, 0.1, 0.5, 0.9, 1.0)})))


@add("a10_five_numbers", """SELECT p_brand, count(*) AS n, min(p_retailprice) AS minimum, round(quantile_cont(p_retailprice, 0.05), 6) AS p05, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, max(p_retailprice) AS maximum FROM part GROUP BY 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PF.describe(table(spark, d, "part"), ["p_brand"], "p_retailprice").select("p_brand", "n", "minimum", "p05", "median", "p95", "maximum"))


@add("a24_study_spread", """SELECT l_suppkey, round(stddev_pop(l_extendedprice / l_quantity), 4) AS spread FROM lineitem GROUP BY 1""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    moments = PF.moments(F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(table(spark, d, "lineitem").groupBy("l_suppkey").agg(*moments).select("l_suppkey", F.col("std").alias("spread")), 4)


@add("a26_series_bounds", f"WITH {BO} SELECT count(*) AS n, min(open_time_ms) AS first_ms, max(open_time_ms) AS last_ms, max(volume) AS most FROM bo")
def a26(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("open_time_ms")
    return bars_orders(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"), F.max("volume").alias("most"))


@add("a30_role_audit", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@add("w4_trailing_slice", f"""WITH {BE}, l AS (SELECT event_type, list(close ORDER BY open_time_ms) AS c FROM be GROUP BY 1) SELECT event_type, p.p AS period, round(list_sum(CASE WHEN p.p <= 0 OR p.p >= len(c) THEN c ELSE c[len(c) - p.p + 1:] END), 6) AS total FROM l, (VALUES (0), (3), (20), (100000)) p(p)""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("open_time_ms", "close"))), lambda s: s["close"])
    per = bars_events(spark, d).groupBy(*KEY).agg(values.alias("c")).withColumn("period", F.explode(F.array(*map(F.lit, (0, 3, 20, 100_000)))))
    return rounded(per.select(*KEY, "period", F.aggregate(X.trailing(F.col("c"), F.col("period")), F.lit(0.0), lambda a, x: a + x).alias("total")))


@add("w9_shocks", f"""WITH {be(HOUR)}, p AS (SELECT *, abs(close - lag(close) OVER ({OVER})) AS dc, CASE WHEN close > 0 AND lag(close) OVER ({OVER}) > 0 THEN ln(close / lag(close) OVER ({OVER})) END AS r, row_number() OVER ({OVER}) AS n FROM be),
    a AS (SELECT *, avg(dc) OVER ({OVER} ROWS 14 PRECEDING) AS s, avg(dc) OVER ({OVER} ROWS 110 PRECEDING) AS l, coalesce(stddev_samp(r) OVER ({OVER} ROWS 20 PRECEDING), 0) AS sigma FROM p)
    SELECT event_type, open_time_ms, coalesce(s > 0 AND l > 0 AND least(greatest(s / l, 0.1), 3) > 1.8, false) OR coalesce(n >= 23 AND sigma > 0 AND abs(r) > 2.5 * sigma, false) AS shock FROM a""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return I.indicators(bars_events(spark, d, HOUR), KEY).select(*KEY, "open_time_ms", F.coalesce(I.is_shock(), F.lit(False)).alias("shock"))


@add("w38_hull_area", f"WITH {BE}, {hull('-5', '0')} SELECT event_type, open_time_ms, round(area, 6) AS area FROM s JOIN h USING (event_type, base)")
def w38(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.geometry(bars_events(spark, d), KEY, 5, 0).where("area IS NOT NULL").select(*KEY, "open_time_ms", "area"))


@add("t1_ordered_scan", f"WITH {BE} SELECT open_time_ms, close, row_number() OVER (ORDER BY open_time_ms) AS place FROM be WHERE event_type = 'click'")
def t1(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(bars_events(spark, d), 0, 1 << 60, event_type="click")
    return rows.select("open_time_ms", "close", F.row_number().over(I.window([])).cast("long").alias("place"))


@add("s12_chart_scan", f"WITH {be(HOUR)} SELECT open_time_ms, close FROM be WHERE event_type = 'view' AND open_time_ms BETWEEN (SELECT min(open_time_ms) FROM be) + {DAY} AND (SELECT min(open_time_ms) FROM be) + {9 * DAY} ORDER BY open_time_ms LIMIT 5000")
def s12(spark: SparkSession, d: str) -> DataFrame:
    b = bars_events(spark, d, HOUR)
    first = b.agg(F.min("open_time_ms")).first()[0]
    return scan(b, first + DAY, first + 9 * DAY, limit=5000, event_type="view").select("open_time_ms", "close")


@add("t5_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey", "o_orderdate")


@add("t6_paths_in_order", """SELECT p_partkey FROM part ORDER BY p_brand = 'Brand#13' DESC, p_size DESC, p_retailprice DESC, p_partkey LIMIT 30""")
def t6(spark: SparkSession, d: str) -> DataFrame:
    first = (F.col("p_brand") == "Brand#13").desc()
    return table(spark, d, "part").orderBy(first, F.col("p_size").desc(), F.col("p_retailprice").desc(), "p_partkey").limit(30).select("p_partkey")


@add("t12_tied_best", """WITH a AS (SELECT * FROM part QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)), b AS (SELECT * FROM a QUALIFY p_retailprice = max(p_retailprice) OVER (PARTITION BY p_brand)) SELECT p_brand, p_partkey FROM b QUALIFY p_partkey = max(p_partkey) OVER (PARTITION BY p_brand)""")
def t12(spark: SparkSession, d: str) -> DataFrame:
    return RB.tied_best(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@add("t15_status_page", """SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT (count(*) + 19) // 20 FROM orders WHERE o_orderstatus = 'F') AS pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def t15(spark: SparkSession, d: str) -> DataFrame:
    return K.page(table(spark, d, "orders").where("o_orderstatus = 'F'"), [F.col("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "total", "pages")


@add("u5_merged_days", f"""WITH {BO}, m AS (SELECT open_time_ms + CASE WHEN open_time_ms // {DAY} % 2 = 0 THEN 0 ELSE {4000 * DAY} END AS open_time_ms, close + 1 AS close FROM bo WHERE open_time_ms // {DAY} % 3 = 0)
    SELECT open_time_ms, round(coalesce(m.close, bo.close), 6) AS close FROM bo FULL JOIN m USING (open_time_ms)""")
def u5(spark: SparkSession, d: str) -> DataFrame:
    b = bars_orders(spark, d)
    day = F.expr(f"open_time_ms div {DAY}")
    manual = b.where(day % 3 == 0).select(F.date_from_unix_date((day + F.when(day % 2 == 0, 0).otherwise(4000)).cast("int")).cast("string").alias("date"), (F.col("close") + 1).alias("close"))
    return rounded(store.with_manual_prices(b, manual).select("open_time_ms", "close"))


@add("u12_marked_ancestors", """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority = '1-URGENT' AS seed FROM orders)
    SELECT o_orderkey, coalesce(min(CASE WHEN seed THEN i END) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) > 0 AS permanent FROM r""")
def u12(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"), (F.col("o_orderpriority") == "1-URGENT").alias("seed"))
    above = J.ancestors(o, o.where("seed").select("child"), "child", "parent").select(F.col("node").alias("child"), F.lit(True).alias("above"))
    return o.join(above, "child", "left").select(F.col("child").alias("o_orderkey"), F.coalesce(F.col("seed") | F.coalesce("above", F.lit(False)), F.lit(False)).alias("permanent"))


@add("x8_new_month", f"WITH {BO} SELECT open_time_ms, coalesce(strftime(epoch_ms(open_time_ms), '%Y-%m') <> lag(strftime(epoch_ms(open_time_ms), '%Y-%m')) OVER (ORDER BY open_time_ms), false) AS fresh FROM bo")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return bars_orders(spark, d).select("open_time_ms", S.month_change([]).alias("fresh"))


@add("x9_session_times", f"""WITH {be(HOUR)}, l AS (SELECT DISTINCT open_time_ms, (open_time_ms + 8 * {HOUR}) // {DAY} * {DAY} - 8 * {HOUR} AS midnight FROM be) SELECT open_time_ms, midnight + 9 * {HOUR} AS opens, midnight + 27 * {HOUR // 2} AS closes FROM l""")
def x9(spark: SparkSession, d: str) -> DataFrame:
    tz = "Asia/Taipei"
    return bars_events(spark, d, HOUR).select("open_time_ms").distinct().select("open_time_ms", R.session_open("open_time_ms", tz).alias("opens"), R.session_close("open_time_ms", tz).alias("closes"))


@add("x14_relative_performance", """WITH x AS (SELECT p_partkey, p_retailprice AS s, 1000.0 + p_size AS b, p_size / 100.0 AS sd, (p_partkey % 40) / 50.0 AS bd FROM part)
    SELECT p_partkey, round(ln(s / b), 6) AS ratio, round(ln((1 - sd) / (1 - bd)), 6) AS residual, round(ln(s / b) * (1 - sd) / (1 - bd), 6) AS composite, s / 1000 > b / 1000 AND sd < bd AS qualified FROM x""")
def x14(spark: SparkSession, d: str) -> DataFrame:
    s, b = F.col("p_retailprice"), 1000.0 + F.col("p_size")
    m = X.relative_performance(s, b, s / 1000, b / 1000, F.col("p_size") / 100.0, (F.col("p_partkey") % 40) / 50.0)
    return rounded(table(spark, d, "part").select("p_partkey", m["log_final_nav_ratio"].alias("ratio"), m["log_drawdown_residual_ratio"].alias("residual"), m["performance_drawdown_composite"].alias("composite"), m["qualified"].alias("qualified")))


def cdf(x: str) -> str:
    """SQL: the normal distribution function by its series x^(2k+1) / (1 * 3 * ... * (2k+1)), for moderate x."""
    term = f"CASE WHEN ({x}) = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({x})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {term})))"


@add("x28_inverse_normal", "SELECT o_orderkey, round((o_orderkey % 999 + 0.5) / 999.0, 6) AS p FROM orders")
def x28(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("o_orderkey") % 999 + 0.5) / 999.0
    return rounded(table(spark, d, "orders").select("o_orderkey", X.normal_cdf(X.inverse_normal(p)).alias("p")))


@add("x29_normal_cdf", f"SELECT c_custkey, round({cdf('c_acctbal / 3000')}, 9) AS p FROM customer")
def x29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.round(X.normal_cdf(F.col("c_acctbal") / 3000), 9).alias("p"))


@add("x40_lattice", "SELECT c_custkey, round(least(greatest(round(c_acctbal / 2000 / 0.05) * 0.05, -0.3), 3.2), 6) AS x FROM customer")
def x40(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "customer").select("c_custkey", X.lattice(F.col("c_acctbal") / 2000, -0.3, 3.2).alias("x")))


BUDGETS = "n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"


def budgets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@add("x45_auto_cells", f"WITH {BUDGETS}, k AS (SELECT o_custkey, n * 7 AS n, greatest(1, floor(sqrt(n * 7) + 0.5)) AS k FROM n) SELECT o_custkey, k::BIGINT AS k, greatest(4, floor(sqrt(n / k) + 0.5))::BIGINT AS p FROM k")
def x45(spark: SparkSession, d: str) -> DataFrame:
    """Budgets of seven evaluations an order."""
    return budgets(spark, d).select("o_custkey", G.auto_cell_counts(F.col("n") * 7).alias("c")).select("o_custkey", "c.*")


@add("x46_quotas", f"WITH {BUDGETS} SELECT o_custkey, o.name, (n // 5 + (o.i < n % 5)::INT)::BIGINT AS children FROM n, (VALUES (0, 'global'), (1, 'local'), (2, 'block'), (3, 'crossover'), (4, 'directional')) o(i, name)")
def x46(spark: SparkSession, d: str) -> DataFrame:
    return PA.quota_rows(budgets(spark, d), "n").select("o_custkey", "name", "children")


@add("g6_initial_count", "WITH n AS (SELECT l_orderkey, count(*) AS d FROM lineitem GROUP BY 1) SELECT l_orderkey, (2 ** ceil(log2(greatest(64, 16 * d))))::BIGINT AS n FROM n")
def g6(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("d"))
    return lines.select("l_orderkey", G.sobol_counts(F.col("d")).alias("n"))


@add(
    "x28_inverse_values",
    f"""WITH RECURSIVE p AS (SELECT DISTINCT (o_orderkey % 999 + 0.5) / 999.0 AS p FROM orders), b AS (SELECT p, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS s FROM p
      UNION ALL SELECT p, CASE WHEN c < p THEN m ELSE lo END, CASE WHEN c < p THEN hi ELSE m END, s + 1 FROM (SELECT *, {cdf('m')} AS c FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE s < 36)))
    SELECT o_orderkey, round(lo, 5) + 0.0 AS z FROM orders JOIN b ON b.p = (o_orderkey % 999 + 0.5) / 999.0 WHERE s = 36""",
)
def x28_values(spark: SparkSession, d: str) -> DataFrame:
    """The inverse itself, against halving of the distribution function's argument."""
    p = (F.col("o_orderkey") % 999 + 0.5) / 999.0
    return rounded(table(spark, d, "orders").select("o_orderkey", X.inverse_normal(p).alias("z")), 5)


@add("b7_released_lots", """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS amount, CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END AS size FROM lineitem), b AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - size AS before FROM w)
    SELECT l_orderkey, l_linenumber, round(greatest(least(60 - before, size), 0), 6)::DOUBLE AS released, round(amount - greatest(least(60 - before, size), 0), 6)::DOUBLE AS kept FROM b""")
def b7(spark: SparkSession, d: str) -> DataFrame:
    lots = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("double").alias("amount"), "l_returnflag")
    return rounded(S.released_lots(lots, ["l_orderkey"], F.lit(60.0), ["l_linenumber", "l_partkey", "l_extendedprice"], eligible=F.col("l_returnflag") != "A").select("l_orderkey", "l_linenumber", "released", "kept"))


@add("g20_region_parameters", """WITH p AS (SELECT r_regionkey AS region, r_regionkey * 0.5 + 1 AS gamma FROM region WHERE r_regionkey <> 2) SELECT n_nationkey, round(coalesce(p.gamma, (SELECT gamma FROM p WHERE region = 0)), 6)::DOUBLE AS gamma FROM nation LEFT JOIN p ON p.region = n_regionkey""")
def g20(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("region"), (F.col("r_regionkey") * 0.5 + 1).cast("double").alias("gamma"))
    return rounded(S.with_region_parameters(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("region")), packs, first="0").select("n_nationkey", "gamma"))


@add("l10_additive_basis", """WITH v AS (SELECT p_partkey, tanh(ln(p_size / 25.0)) AS a, tanh(ln(p_retailprice / 1200)) AS b FROM part) SELECT p_partkey, round(a, 6) AS size_v, round(a * a, 6) AS size_v2, round(b, 6) AS price_v, round(b * b, 6) AS price_v2, round(a * b, 6) AS size_x_price FROM v""")
def l10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 25.0).alias("size"), (F.col("p_retailprice") / 1200).alias("price"))
    return rounded(rows.select("p_partkey", *[c.alias(n) for n, c in L.basis(["size", "price"], True).items()]))


@add("l25_policy_signals", """SELECT p_partkey, round(2 * (p_size / 51.0) - 1, 6) AS up, round(CASE WHEN p_size > 5 THEN tanh(ln(p_retailprice / (1000 / (p_size / 20.0)))) END, 6) AS activity, round(tanh((p_partkey % 100 - 50) / 20.0), 6) AS occurrence_trend_deviation FROM part""")
def l25(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    ratio = F.when(size > 5, size / 20.0).otherwise(0.0)
    found = L.policy_signals({"up": size / 51.0}, {"activity": (F.col("p_retailprice"), F.lit(1000.0), ratio)}, (F.col("p_partkey") % 100 - 50) / 20.0)
    return rounded(table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in found.items()]))


SCORED = "x AS (SELECT event_type, event_id, event_id % 7 / 7.0 AS f, event_id % 5 / 5.0 AS g, value / 100 AS area, (event_id % 23 - 11) / 10.0 AS slope FROM events), m AS (SELECT *, 0.5 + 0.2 * f + 0.1 * g AS ma, 0.1 - 0.3 * f + 0.2 * g AS ms FROM x)"
WHOLE = f"greatest({cdf('ma / 0.8')}, 1e-12)"
DET = 0.8 * 0.8 * 0.7 * 0.7 - 0.1 * 0.1


def scored(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, d, "events").select(*KEY, i, (i % 7 / 7.0).alias("f"), (i % 5 / 5.0).alias("g"), (F.col("value") / 100).alias("area"), ((i % 23 - 11) / 10.0).alias("slope"))
    line = spark.createDataFrame([(0, 1.0, [0.5, 0.2, 0.1], [0.1, -0.3, 0.2], 0.8, 0.7, 0.1)], "region int, weight double, ca array<double>, cs array<double>, sa double, ss double, cov double")
    model = rows.select(*KEY).distinct().join(F.broadcast(line), F.lit(True))  # one row
    return rounded(L.geometry_scores(rows, model, KEY, ("f", "g"), ("area", "slope"), "event_id"))


@add("l28_joint_likelihood", f"""WITH {SCORED}, d AS (SELECT event_type, exp(-(0.49 * (area - ma) * (area - ma) - 0.2 * (area - ma) * (slope - ms) + 0.64 * (slope - ms) * (slope - ms)) / {DET!r} / 2) / (2 * pi() * sqrt({DET!r})) / {WHOLE} AS f FROM m)
    SELECT event_type, count(*) AS n, round(avg(-ln(greatest(f, 1e-300))), 6) AS joint_nll FROM d GROUP BY 1""")
def l28(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(*KEY, "n", "joint_nll")


@add("l29_calibration_error", f"""WITH {SCORED}, d AS (SELECT event_type, least(9, floor(10 * greatest(0, least(1, ({cdf('least((area - ma) / 0.8, 9)')} - {cdf('-ma / 0.8')}) / {WHOLE}))))::INT AS a, least(9, floor(10 * {cdf('(slope - ms) / 0.7')}))::INT AS s FROM m),
    b AS (SELECT event_type, k.r AS k, abs(avg((a = k.r)::INT) - 0.1) + abs(avg((s = k.r)::INT) - 0.1) AS off FROM d, range(10) k(r) GROUP BY ALL) SELECT event_type, round(sum(off) / 20, 6) AS calibration_error FROM b GROUP BY 1""")
def l29(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(*KEY, "calibration_error")


def uniform(seed: int, axis: str, low: int, high: int) -> str:
    return f"(least(floor(('0x' || sha256('{seed}|' || i || '|{axis}')[1:13])::BIGINT / 16.0 ^ 13 * {high - low + 1}), {high - low}) + {low})::INT AS {axis}"


@add("g1_discrete_sample", f"""WITH r AS (SELECT i, {uniform(5, 'a', 0, 9)}, {uniform(5, 'b', 1, 12)}, {uniform(5, 'c', 0, 4)} FROM (SELECT unnest(range(0, 3200)) AS i)), f AS (SELECT a, b, c, min(i) AS i FROM r WHERE a <= b GROUP BY a, b, c) SELECT a, b, c FROM f ORDER BY i LIMIT 100""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return G.discrete_sample(spark, {"a": (0, 9), "b": (1, 12), "c": (0, 4)}, 100, 5, legal=F.col("a") <= F.col("b")).select("a", "b", "c")


def mirrored(base: int) -> str:
    return f"list_sum(list_transform(range(0, 20), lambda k: floor(i / {base}::DOUBLE ** k) % {base} / {base}::DOUBLE ** (k + 1)))"


@add("g3_halton_sample", f"""WITH r AS (SELECT i, least(floor({mirrored(2)} * 10), 9)::INT AS a, (least(floor({mirrored(3)} * 12), 11) + 1)::INT AS b, least(floor({mirrored(5)} * 5), 4)::INT AS c FROM (SELECT unnest(range(11, 3000)) AS i)), f AS (SELECT a, b, c, min(i) AS seq FROM r GROUP BY a, b, c) SELECT seq, a, b, c FROM f ORDER BY seq LIMIT 120""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return G.halton_sample(spark, {"a": (0, 9), "b": (1, 12), "c": (0, 4)}, 120, 10)


@add("w40_geometry_features", f"WITH {BE}, {hull('-7', '0')} SELECT be.event_type, be.open_time_ms, round(area, 6) AS area, round(slope, 6) AS slope FROM be LEFT JOIN (SELECT * FROM s JOIN h USING (event_type, base)) x ON x.event_type = be.event_type AND x.open_time_ms = be.open_time_ms")
def w40(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.geometry(bars_events(spark, d), KEY, 7, 0).select(*KEY, "open_time_ms", "area", "slope"))


@add("w41_geometry_targets", f"WITH {BE}, {hull('0', '4')} SELECT be.event_type, be.open_time_ms, round(area, 6) AS area, round(slope, 6) AS slope FROM be LEFT JOIN (SELECT * FROM s JOIN h USING (event_type, base)) x ON x.event_type = be.event_type AND x.open_time_ms = be.open_time_ms")
def w41(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.geometry(bars_events(spark, d), KEY, 0, 4).select(*KEY, "open_time_ms", "area", "slope"))
