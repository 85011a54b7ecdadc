"""Queries of sources, sinks, calendars and resampling."""

from __future__ import annotations

from tidemark.operators import resample as R
from tidemark.plans.base import BE, BEH, BO, DAY, HOUR, Book, DataFrame, F, SparkSession, rounded
from tidemark.sources import bars as B
from tidemark.sources import upsert as U
from tidemark.session import table

BOOK = Book()
add = BOOK.add


@add("s3_positional_json", f"""WITH {BO} SELECT open_time_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bo""")
def s3(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_orders(spark, d)
    cells = F.array(F.col("open_time_ms").cast("string"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    landed = b.groupBy(F.floor(F.col("open_time_ms") / (100 * DAY)).alias("page")).agg(F.to_json(F.collect_list(cells)).alias("payload"))
    return rounded(B.from_positional_json(landed.select("payload")))


@add(
    "s4_chart_json",
    f"""WITH {BE}, f AS (SELECT *, CASE WHEN day % 7 = 3 THEN NULL ELSE low END AS l2, CASE WHEN close > 0 THEN (close * 0.5) / close ELSE 1 END AS k
        FROM (SELECT *, open_time_ms // {DAY} AS day FROM be))
        SELECT event_type, open_time_ms, round(open * k, 6) AS open, round(high * k, 6) AS high, round(l2 * k, 6) AS low, round(close * k, 6) AS close, volume FROM f WHERE l2 IS NOT NULL""",
)
def s4(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_events(spark, d).withColumn("low", F.when(F.col("open_time_ms") / DAY % 7 != 3, F.col("low"))).withColumns({"timestamp": (F.col("open_time_ms") / 1000).cast("long"), "adjclose": F.col("close") * 0.5})
    names = ["timestamp", "open", "high", "low", "close", "volume", "adjclose"]
    rows = F.sort_array(F.collect_list(F.struct("timestamp", *[F.struct(F.col(n).alias("v")).alias(n + "_") for n in names[1:]])))
    grouped = b.groupBy("event_type").agg(rows.alias("r"))
    column = lambda n: F.transform("r", lambda x: x[n] if n == "timestamp" else x[n + "_"]["v"]).alias(n)
    payload = F.to_json(F.struct(*[column(n) for n in names]), {"ignoreNullFields": "false"})
    return rounded(B.from_chart_json(grouped.select("event_type", payload.alias("payload"))))


@add(
    "s8_first_vintage",
    """WITH v AS (SELECT o_custkey % 50 AS k, strftime(o_orderdate, '%Y%m%d') AS day, o_totalprice AS p FROM orders),
        g AS (SELECT k, day, max(p) AS p FROM v GROUP BY ALL)
        SELECT k::VARCHAR AS date, min(day) AS vintage, round(arg_min(p, day), 6) AS value FROM g GROUP BY k""",
)
def s8(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.max("o_totalprice").alias("p"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("SER_"), F.col("day")), F.col("p").cast("string"))))
    landed = o.groupBy("k").agg(pairs.alias("m")).select(F.to_json(F.map_concat("m", F.create_map(F.lit("date"), F.col("k").cast("string"), F.lit("SER_x"), F.lit(".")))).alias("payload"))
    return rounded(B.from_vintages(landed, "SER"))


@add("s10_range_scan", f"""WITH {BE} SELECT * FROM be WHERE event_type = 'click' AND open_time_ms BETWEEN (SELECT min(open_time_ms) FROM be) + {5 * DAY} AND (SELECT min(open_time_ms) FROM be) + {15 * DAY}""")
def s10(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_events(spark, d)
    first = b.agg(F.min("open_time_ms")).first()[0]
    return B.scan(b, first + 5 * DAY, first + 15 * DAY, event_type="click")


@add("s13_latest_bars", f"""WITH {BO} SELECT * FROM bo ORDER BY open_time_ms DESC LIMIT 250""")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return B.scan(B.bars_orders(spark, d), 0, 1 << 60, limit=250, latest=True)


@add("s15_availability", f"""WITH {BE} SELECT event_type, open_time_ms, CASE WHEN event_type = 'view' THEN open_time_ms + {3 * DAY} ELSE open_time_ms END AS avail_ms FROM be""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return B.with_availability(B.bars_events(spark, d), 3, F.col("event_type") == "view").select("event_type", "open_time_ms", "avail_ms")


@add("s18_result_blocks", f"""WITH {BEH}, r AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY open_time_ms) - 1) // 256 AS block FROM be)
    SELECT event_type, block, count(*) AS n, true AS intact FROM r GROUP BY ALL""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    blocks = B.result_blocks(B.bars_events(spark, d, HOUR), ["event_type"], "open_time_ms", ["open_time_ms", "close"])
    return B.checked_blocks(blocks).select("event_type", "block", "n", "intact")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = B.bars_events(spark, d)
    day = F.col("open_time_ms") / DAY
    return b.where(day % 3 != 0), b.where(day % 2 == 0).withColumn("close", F.col("close") + 1000)


@add("u1_upsert", f"""WITH {BE}, x AS (SELECT *, open_time_ms // {DAY} AS day FROM be) SELECT event_type, open_time_ms, round(CASE WHEN day % 2 = 0 THEN close + 1000 ELSE close END, 6) AS close FROM x WHERE day % 3 <> 0 OR day % 2 = 0""")
def u1(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _halves(spark, d)
    return rounded(U.upsert(stored, new, ["event_type", "open_time_ms"], [F.col("close")]).select("event_type", "open_time_ms", "close"))


@add("u2_insert_absent", f"""WITH {BE}, x AS (SELECT *, open_time_ms // {DAY} AS day FROM be) SELECT event_type, open_time_ms, round(CASE WHEN day % 3 = 0 THEN close + 1000 ELSE close END, 6) AS close FROM x WHERE day % 3 <> 0 OR day % 2 = 0""")
def u2(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _halves(spark, d)
    return rounded(U.insert_absent(stored, new, ["event_type", "open_time_ms"]).select("event_type", "open_time_ms", "close"))


@add("u3_additive_upsert", """SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def u3(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    counts = lambda c: li.where(c).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return U.add_counts(counts("l_linenumber <= 4"), counts("l_linenumber > 2"), ["l_returnflag", "l_linestatus"])


@add("u9_point_set_hash", """SELECT event_type, sha256(string_agg(k, ',' ORDER BY k)) AS hash FROM (SELECT DISTINCT event_type, (user_id % 97)::VARCHAR AS k FROM events) GROUP BY event_type""")
def u9(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.sha2(F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 97).cast("string"))), ",").cast("binary"), 256).alias("hash"))


@add("u13_foreign_key_closure", """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def u13(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("2001-01-01").cast("timestamp_ntz")
    o = U.changed_since(table(spark, d, "orders"), since, "o_orderdate", "o_orderdate")
    return U.with_parents(o, table(spark, d, "customer"), "o_custkey", "c_custkey").select("c_custkey", "c_name")


RESAMPLE = "SELECT {keys} epoch_ms(p) AS open_time_ms, round(arg_min(open, open_time_ms), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, open_time_ms), 6) AS close, sum(volume) AS volume FROM x GROUP BY {keys} p"


@add("a1_resample_weekly", f"""WITH {BO}, x AS (SELECT *, date_trunc('week', make_timestamp(open_time_ms * 1000)) AS p FROM bo) {RESAMPLE.format(keys="")}
    HAVING epoch_ms(p + INTERVAL 7 DAY) <= (SELECT max(open_time_ms) FROM bo)""")
def a1w(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_orders(spark, d)
    return rounded(R.resample(b, [], "week", "UTC", b.agg(F.max("open_time_ms")).first()[0]))


@add("a1_resample_monthly", f"""WITH {BE}, x AS (SELECT *, date_trunc('month', make_timestamp(open_time_ms * 1000)) AS p FROM be) {RESAMPLE.format(keys="event_type,")}""")
def a1m(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample(B.bars_events(spark, d), ["event_type"], "month"))


TAIPEI = "((make_timestamp(open_time_ms * 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Taipei')"


@add("a3_market_week", f"""WITH {BEH}, x AS (SELECT *, ((date_trunc('week', {TAIPEI}) AT TIME ZONE 'Asia/Taipei') AT TIME ZONE 'UTC') AS p FROM be) {RESAMPLE.format(keys="event_type,")}""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample(B.bars_events(spark, d, HOUR), ["event_type"], "week", "Asia/Taipei"))


@add("a4_last_of_week", f"""WITH {BO}, x AS (SELECT *, strftime(make_timestamp(open_time_ms * 1000), '%G-W%V') AS period FROM bo)
    SELECT period, max(open_time_ms) AS open_time_ms, round(arg_max(close, open_time_ms), 6) AS close FROM x GROUP BY period""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.last_of_period(B.bars_orders(spark, d).select("open_time_ms", "close"), [], "week"))


@add("f9_canonical_open", f"""WITH {BEH}, x AS (SELECT *, {TAIPEI} AS l FROM be) SELECT event_type, count(*) AS n, count(*) FILTER (hour(l) = 9 AND minute(l) = 0) AS canonical FROM x GROUP BY event_type""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_events(spark, d, HOUR)
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(R.is_canonical_open("open_time_ms", "Asia/Taipei")).alias("canonical"))


@add("f11_completed_daily", f"""WITH {BEH}, x AS (SELECT *, {TAIPEI} AS l FROM be) SELECT event_type, open_time_ms FROM x WHERE hour(l) = 9 AND epoch_ms(date_trunc('day', l)) + 810 * 60000 - 8 * {HOUR} + 90 * 60000 <= (SELECT min(open_time_ms) FROM be) + {10 * DAY}""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_events(spark, d, HOUR)
    now = b.agg(F.min("open_time_ms")).first()[0] + 10 * DAY
    return R.completed_daily(b, "Asia/Taipei", now).select("event_type", "open_time_ms")


@add(
    "w15_preclose_snapshot",
    f"""WITH t AS (SELECT event_type, event_id, value, epoch_us(ts) // 1000 AS ms, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Taipei' AS l FROM events),
        a AS (SELECT *, (epoch_us(l) - epoch_us(date_trunc('day', l))) // 1000 - (13 * {HOUR} + 20 * 60000) AS away_ms FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('day', l) ORDER BY abs(away_ms), ms) AS k FROM a WHERE away_ms BETWEEN -1200000 AND 900000)
        SELECT event_type, strftime(l, '%Y-%m-%d') AS trade_date, ms AS open_time_ms, away_ms, round(value, 6) AS value FROM r WHERE k = 1""",
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value", B.millis("ts").alias("open_time_ms"))
    return rounded(R.preclose_snapshots(e, ["event_type"], "Asia/Taipei").select("event_type", F.col("trade_date").cast("string").alias("trade_date"), "open_time_ms", "away_ms", "value"))


@add("w16_first_release", """SELECT user_id, round(arg_min(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id""")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(U.earliest(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "value"))


@add(
    "w18_back_adjust",
    f"""WITH {BO}, j AS (SELECT *, close / lag(close) OVER (ORDER BY open_time_ms) AS q FROM bo),
        f AS (SELECT *, CASE WHEN q < 0.35 OR q > 2.85 THEN ln(q) ELSE 0 END AS lq FROM j)
        SELECT open_time_ms, round(ln(close) + coalesce(sum(lq) OVER (ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS log_close FROM f""",
)
def w18(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.back_adjusted(B.bars_orders(spark, d), []).select("open_time_ms", F.log("close").alias("log_close")))


@add(
    "w19_leveraged_child",
    f"""WITH {BE}, g AS (SELECT event_type, open_time_ms, coalesce(lag(close) OVER w, open) AS b, open, close FROM be WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)),
        c AS (SELECT *, 10000 * product(1 + 0.1 * (close / b - 1)) OVER (PARTITION BY event_type ORDER BY open_time_ms) AS child FROM g)
        SELECT event_type, open_time_ms, round(coalesce(lag(child) OVER w, 10000) * (1 + 0.1 * (open / b - 1)), 4) AS open, round(child, 4) AS close FROM c WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)""",
)
def w19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.leveraged(B.bars_events(spark, d), ["event_type"], 0.1), 4)


@add("o8_maintenance_audit", f"""WITH {BO}, x AS (SELECT date_trunc('month', make_timestamp(open_time_ms * 1000)) AS p, open_time_ms FROM bo)
    SELECT strftime(p, '%Y-%m') AS month, count(*) AS bars, day(last_day(p::DATE)) - count(*) AS missing_days FROM x GROUP BY p""")
def o8(spark: SparkSession, d: str) -> DataFrame:
    b = B.bars_orders(spark, d)
    days = F.dayofmonth(F.last_day(F.max(B.utc_date("open_time_ms")))) - F.count(F.lit(1))
    return b.groupBy(R.period_key("open_time_ms", "month").alias("month")).agg(F.count(F.lit(1)).alias("bars"), days.alias("missing_days"))


@add("x11_previous_business_day", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate - to_days(CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END::INTEGER), '%Y-%m-%d') AS before FROM orders""")
def x11(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), R.previous_business_day(F.col("day")).cast("string").alias("before"))


