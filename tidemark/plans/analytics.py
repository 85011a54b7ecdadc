"""Queries of performance, indicators, features and targets."""

from __future__ import annotations

from tidemark.operators import indicators as I
from tidemark.operators import performance as P
from tidemark.plans.base import BE, BEH, BO, DAY, HOUR, PRICED, Book, DataFrame, F, SparkSession, lr, rounded
from tidemark.sources.bars import bars_events, bars_orders

BOOK = Book()
add = BOOK.add

RET = f"{BO}, r AS (SELECT open_time_ms, close, close / lag(close) OVER (ORDER BY open_time_ms) - 1 AS ret FROM bo)"
MOM = """avg(ret) AS mean, stddev_pop(ret) AS std, avg(ret ^ 3) - 3 * avg(ret) * avg(ret ^ 2) + 2 * avg(ret) ^ 3 AS m3, kurtosis_pop(ret) AS kurtosis"""


def nav(spark: SparkSession, d: str) -> DataFrame:
    return bars_orders(spark, d).select("open_time_ms", F.col("close").alias("nav"))


def navs(spark: SparkSession, d: str) -> DataFrame:
    return bars_events(spark, d).select("event_type", "open_time_ms", F.col("close").alias("nav"))


@add(
    "o1_performance_report",
    f"""WITH {RET}, dist AS (SELECT count(*) AS n_returns, avg(ret) AS mean, stddev_pop(ret) AS std, quantile_cont(ret, 0.05) AS p05, quantile_cont(ret, 0.5) AS median, quantile_cont(ret, 0.95) AS p95, kurtosis_pop(ret) AS kurtosis FROM r WHERE ret IS NOT NULL),
        c AS (SELECT avg((ret - mean) ^ 3) / any_value(std) ^ 3 AS skew FROM r, dist WHERE ret IS NOT NULL),
        pk AS (SELECT open_time_ms, close, max(close) OVER (ORDER BY open_time_ms) AS peak FROM bo),
        dd AS (SELECT max((peak - close) / peak) AS max_drawdown FROM pk),
        sp AS (SELECT *, sum((close >= peak)::INT) OVER (ORDER BY open_time_ms) AS spell, lead(open_time_ms) OVER (ORDER BY open_time_ms) AS nx FROM pk),
        uw AS (SELECT spell, count(*) AS points, min(open_time_ms) AS s, coalesce(arg_max(nx, open_time_ms), max(nx), max(open_time_ms)) AS e, max(open_time_ms) AS l FROM sp WHERE close < peak GROUP BY spell),
        u AS (SELECT max((greatest(e, l) - s) // {DAY}) AS max_days, max(points) AS max_points FROM uw),
        ends AS (SELECT arg_min(close, open_time_ms) AS a, arg_max(close, open_time_ms) AS b, (max(open_time_ms) - min(open_time_ms)) / {DAY} AS dd FROM bo),
        so AS (SELECT avg(ret) / sqrt(avg(least(ret, 0) ^ 2)) * sqrt((count(*) - 1) * 365.2425 / ((max(open_time_ms) - min(open_time_ms)) / {DAY})) AS sortino FROM r WHERE ret IS NOT NULL)
        SELECT n_returns, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew, round(kurtosis, 4) AS kurtosis, round(p05, 6) AS p05, round(median, 6) AS median, round(p95, 6) AS p95,
            round(max_drawdown, 6) AS max_drawdown, max_days, max_points, round((b / a) ^ (365.2425 / ends.dd) - 1, 6) AS cagr, round(sortino, 6) AS sortino FROM dist, c, dd, u, ends, so""",
)
def o1(spark: SparkSession, d: str) -> DataFrame:
    out = P.report(nav(spark, d), [])
    return rounded(out.withColumn("kurtosis", F.round("kurtosis", 4)))


@add("a6_moments", f"""WITH {BE}, r AS (SELECT event_type, close / lag(close) OVER (PARTITION BY event_type ORDER BY open_time_ms) - 1 AS ret FROM be)
    SELECT event_type, round(avg(ret), 6) AS mean, round(stddev_pop(ret), 6) AS std, round((avg(ret ^ 3) - 3 * avg(ret) * avg(ret ^ 2) + 2 * avg(ret) ^ 3) / stddev_pop(ret) ^ 3, 6) AS skew, round(kurtosis_pop(ret), 6) AS kurtosis FROM r WHERE ret IS NOT NULL GROUP BY event_type""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.period_returns(navs(spark, d), ["event_type"], "day").groupBy("event_type").agg(*P.moments("ret")))


QS = {"minimum": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "maximum": 1.0}


@add("a7_quantiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in QS.items()) + " FROM events GROUP BY event_type")
def a7(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return rounded(e.groupBy("event_type").agg(*P.quantiles("value", QS)))


@add("a11_describe", """SELECT l_returnflag, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round((avg(l_discount ^ 3) - 3 * avg(l_discount) * avg(l_discount ^ 2) + 2 * avg(l_discount) ^ 3) / stddev_pop(l_discount) ^ 3, 4) AS skew,
    round(kurtosis_pop(l_discount), 4) AS kurtosis, min(l_discount) AS minimum, round(quantile_cont(l_discount, 0.05), 6) AS p05, round(quantile_cont(l_discount, 0.5), 6) AS median, round(quantile_cont(l_discount, 0.95), 6) AS p95, max(l_discount) AS maximum FROM lineitem GROUP BY l_returnflag""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    out = P.describe(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], "l_discount")
    return rounded(out.withColumns({"skew": F.round("skew", 4), "kurtosis": F.round("kurtosis", 4)}))


@add("a16_histogram", """WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS w FROM events GROUP BY event_type),
    b AS (SELECT event_type, lo, w, unnest(range(20)) AS bin FROM s),
    c AS (SELECT e.event_type, least(floor((value - lo) / w), 19)::INT AS bin, count(*) AS n FROM events e JOIN s USING (event_type) GROUP BY ALL)
    SELECT b.event_type, b.bin::INT AS bin, round(lo + b.bin * w, 6) AS lower, round(lo + b.bin * w + w, 6) AS upper, coalesce(n, 0) AS count FROM b LEFT JOIN c ON c.event_type = b.event_type AND c.bin = b.bin""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.histogram(spark.read.parquet(f"{d}/events.parquet").select("event_type", "value"), ["event_type"], "value"))


@add("a36_beta", f"""WITH {BE}, a AS (SELECT open_time_ms, close AS a FROM be WHERE event_type = 'click'), v AS (SELECT open_time_ms, close AS b FROM be WHERE event_type = 'view'),
    j AS (SELECT a / lag(a) OVER (ORDER BY open_time_ms) - 1 AS ra, b / lag(b) OVER (ORDER BY open_time_ms) - 1 AS rb FROM a JOIN v USING (open_time_ms))
    SELECT count(*) AS n, round(covar_pop(ra, rb) / var_pop(rb), 6) AS beta, round(corr(ra, rb), 6) AS correlation FROM j WHERE ra IS NOT NULL""")
def a36(spark: SparkSession, d: str) -> DataFrame:
    n = navs(spark, d)
    one = lambda t: n.where(F.col("event_type") == t).drop("event_type")
    return rounded(P.daily_beta(one("click"), one("view").withColumnRenamed("nav", "value"), []))


@add("a43_exposure", f"""WITH {BE}, x AS (SELECT *, CASE WHEN (open_time_ms // {DAY}) % 4 = 0 THEN 0 ELSE least(1, volume / 100) END AS e FROM be)
    SELECT event_type, round(avg((e > 0)::INT), 6) AS exposed_ratio, round(avg(e), 6) AS average_exposure, round((arg_max(close, open_time_ms) / arg_min(close, open_time_ms) - 1) / avg(e), 6) AS adjusted_return FROM x GROUP BY event_type""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("open_time_ms") / DAY % 4 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("volume") / 100))
    return rounded(P.exposure(bars_events(spark, d).withColumns({"nav": F.col("close"), "actual_exposure": e}).select("event_type", "open_time_ms", "nav", "actual_exposure"), ["event_type"]))


@add("a46_modified_dietz", f"""WITH {BO}, m AS (SELECT date_trunc('year', make_timestamp(open_time_ms * 1000)) AS y, * FROM bo), e AS (SELECT y, min(open_time_ms) AS s, max(open_time_ms) AS e, arg_min(close, open_time_ms) AS i, arg_max(close, open_time_ms) AS f FROM m GROUP BY y),
    fl AS (SELECT m.y, sum(volume * 100) AS total, sum(volume * 100 * (greatest(1, (e - s) / {DAY}) - (open_time_ms - s) / {DAY}) / greatest(1, (e - s) / {DAY})) AS w FROM m JOIN e ON e.y = m.y WHERE day(make_timestamp(open_time_ms * 1000)) = 15 GROUP BY m.y)
    SELECT year(e.y) AS year, round(CASE WHEN e > s THEN (f - i - coalesce(total, 0)) / (i + coalesce(w, 0)) ELSE 0 END, 6) AS ret FROM e LEFT JOIN fl ON fl.y = e.y""")
def a46(spark: SparkSession, d: str) -> DataFrame:
    b = bars_orders(spark, d).withColumn("_d", F.date_from_unix_date((F.col("open_time_ms") / DAY).cast("int")))
    flow = F.when(F.dayofmonth("_d") == 15, F.struct(F.col("open_time_ms").alias("time_ms"), (F.col("volume") * 100).alias("amount")))
    y = b.groupBy(F.year("_d").alias("year")).agg(F.min("open_time_ms").alias("s"), F.max("open_time_ms").alias("e"), F.min_by("close", "open_time_ms").alias("i"), F.max_by("close", "open_time_ms").alias("f"), F.sort_array(F.collect_list(flow)).alias("flows"))
    return rounded(y.select("year", P.modified_dietz(F.col("i"), F.col("f"), F.col("flows"), F.col("s"), F.col("e")).alias("ret")))


@add("a47_cagr", f"""WITH {BE} SELECT event_type, round((arg_max(close, open_time_ms) / arg_min(close, open_time_ms)) ^ (365.2425 / ((max(open_time_ms) - min(open_time_ms)) / {DAY})) - 1, 4) AS cagr FROM be GROUP BY event_type""")
def a47(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.cagr(navs(spark, d), ["event_type"]), 4)


@add("a48_sortino", f"""WITH {BE}, r AS (SELECT event_type, open_time_ms, close / lag(close) OVER (PARTITION BY event_type ORDER BY open_time_ms) - 1 AS ret FROM be),
    n AS (SELECT event_type, count(*) AS n, (count(*) - 1) * 365.2425 / ((max(open_time_ms) - min(open_time_ms)) / {DAY}) AS ppy FROM r WHERE ret IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, round(avg(ret - (1.03 ^ (1 / ppy) - 1)) / sqrt(avg(least(ret - (1.03 ^ (1 / ppy) - 1), 0) ^ 2)) * sqrt(any_value(ppy)), 6) AS sortino, NULL::VARCHAR AS reason FROM r JOIN n USING (event_type) WHERE ret IS NOT NULL GROUP BY event_type, n""")
def a48(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.sortino(navs(spark, d), ["event_type"], 0.03))


@add("w10_max_drawdown", f"""WITH {BE}, p AS (SELECT event_type, close, max(close) OVER (PARTITION BY event_type ORDER BY open_time_ms) AS peak FROM be) SELECT event_type, round(max((peak - close) / peak), 6) AS max_drawdown FROM p GROUP BY event_type""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.max_drawdown(navs(spark, d), ["event_type"]))


@add("w11_weekly_returns", f"""WITH {BE}, k AS (SELECT event_type, strftime(make_timestamp(open_time_ms * 1000), '%G-W%V') AS period, max(open_time_ms) AS open_time_ms, arg_max(close, open_time_ms) AS nav FROM be GROUP BY 1, 2),
    r AS (SELECT *, nav / lag(nav) OVER (PARTITION BY event_type ORDER BY open_time_ms) - 1 AS ret FROM k) SELECT event_type, period, open_time_ms, round(nav, 6) AS nav, round(ret, 6) AS ret FROM r WHERE ret IS NOT NULL""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.period_returns(navs(spark, d), ["event_type"], "week"))


@add("w12_accumulation", f"""WITH {BE}, r AS (SELECT event_type, open_time_ms, close AS nav, coalesce(close / lag(close) OVER w - 1, 0) AS ret, close / first_value(close) OVER w - 1 AS compounded FROM be WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms))
    SELECT event_type, open_time_ms, round(nav, 6) AS nav, round(ret, 6) AS ret, round(sum(ret) OVER (PARTITION BY event_type ORDER BY open_time_ms), 6) AS arithmetic, round(compounded, 6) AS compounded FROM r""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.accumulation(navs(spark, d), ["event_type"]))


@add("w13_underwater_spells", f"""WITH {BE}, p AS (SELECT event_type, open_time_ms, close, max(close) OVER w AS peak FROM be WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)),
    s AS (SELECT *, sum((close >= peak)::INT) OVER w AS spell, lead(open_time_ms) OVER w AS nx FROM p WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)),
    g AS (SELECT event_type, spell, min(open_time_ms) AS start_ms, count(*) AS points, min(close / peak - 1) AS depth, max(open_time_ms) AS l, max(CASE WHEN nx IS NULL THEN 1 ELSE 0 END) AS open_end, max(nx) AS nx FROM s WHERE close < peak GROUP BY 1, 2),
    e AS (SELECT event_type, start_ms, points, round(depth, 6) AS depth, CASE WHEN open_end = 1 THEN l ELSE nx END AS end_ms, open_end = 0 AS recovered FROM g),
    d AS (SELECT *, (end_ms - start_ms) // {DAY} AS days FROM e) SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY days DESC, points DESC, start_ms)::INT AS rank FROM d""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.underwater_spells(navs(spark, d), ["event_type"]))


EMA = "list_reduce(list(close) OVER (PARTITION BY event_type ORDER BY open_time_ms), lambda a, x: a + (x - a) * {a})"


@add("w1_ema", f"""WITH {BEH} SELECT event_type, open_time_ms, round({EMA.format(a=2 / 22)}, 6) AS ema FROM be""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.ema(bars_events(spark, d, HOUR), ["event_type"], 21).select("event_type", "open_time_ms", "ema"))


W = "WINDOW w AS (PARTITION BY event_type ORDER BY open_time_ms)"
IND = f"""{BEH}, e0 AS (SELECT *, {EMA.format(a=2 / 22)} AS ema_fast, {EMA.format(a=2 / 113)} AS ema_slow, row_number() OVER w AS n, lag(close) OVER w AS pc, lag(close, 21) OVER w AS pc21, max(close) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS 111 PRECEDING) AS high_slow FROM be {W}),
    e1 AS (SELECT *, {lr('close', 'pc')} AS log_return, {lr('close', 'pc21')} AS momentum, abs(close - pc) AS dc FROM e0),
    e2 AS (SELECT *, coalesce(stddev_samp(log_return) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS 20 PRECEDING), 0) AS sigma, coalesce(avg(dc) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS 14 PRECEDING), 0) AS vs, coalesce(avg(dc) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS 110 PRECEDING), 0) AS vl FROM e1),
    e3 AS (SELECT *, CASE WHEN vs > 0 AND vl > 0 THEN least(greatest(vs / vl, 0.1), 3) ELSE 1 END AS volatility_ratio FROM e2)"""


@add("w7_micro_signal", f"""WITH {IND} SELECT event_type, open_time_ms, round(volatility_ratio, 6) AS volatility_ratio, round(sigma, 6) AS sigma,
    round(CASE WHEN n >= 22 THEN (close / ema_fast - 1) / greatest(sigma, 0.001) + coalesce(momentum, 0) + (close / high_slow - 1) END, 6) AS signal FROM e3""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    rows = I.micro_signal(I.indicators(bars_events(spark, d, HOUR), ["event_type"]))
    return rounded(rows.select("event_type", "open_time_ms", "volatility_ratio", "sigma", "signal"))


@add("w8_market_regime", f"""WITH {IND}, c AS (SELECT *, CASE WHEN n < 22 THEN 'early' WHEN volatility_ratio > 1.8 OR (n >= 23 AND sigma > 0 AND abs(log_return) > 2.5 * sigma) THEN 'shock'
        WHEN ema_fast / ema_slow - 1 < -0.03 OR close / high_slow - 1 < -0.2 THEN 'bear' WHEN ema_fast / ema_slow - 1 > 0.03 AND coalesce(momentum, 0) > 0 THEN 'bull'
        WHEN volatility_ratio < 0.75 AND abs(close / ema_fast - 1) < 0.015 THEN 'calm' ELSE 'plain' END AS k FROM e3)
    SELECT event_type, open_time_ms, CASE WHEN k IN ('early', 'calm', 'plain') THEN 'quiet' ELSE k END AS regime, CASE k WHEN 'shock' THEN 1.5 WHEN 'bear' THEN 1.25 WHEN 'bull' THEN 0.85 ELSE 1.0 END::DOUBLE AS time_multiplier,
        CASE k WHEN 'shock' THEN 1.4 WHEN 'bear' THEN 1.15 WHEN 'bull' THEN 1.0 WHEN 'plain' THEN 1.0 ELSE 0.65 END::DOUBLE AS beta_multiplier, k IN ('early', 'calm') AS is_quiet FROM c""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    rows = I.market_regime(I.indicators(bars_events(spark, d, HOUR), ["event_type"]))
    return rows.select("event_type", "open_time_ms", "regime", "time_multiplier", "beta_multiplier", "is_quiet")


@add("w21_true_range", f"""WITH {BEH}, p AS (SELECT *, lag(close) OVER w AS pc FROM be {W}) SELECT event_type, open_time_ms, round(greatest({lr('high', 'low')}, abs({lr('high', 'pc')}), abs({lr('low', 'pc')})), 6) AS scale FROM p""")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.true_range_log(bars_events(spark, d, HOUR), ["event_type"]).select("event_type", "open_time_ms", "scale"))


@add("w22_coordinates", f"""WITH {BEH}, p AS (SELECT *, lag(close) OVER w AS pc FROM be WHERE {PRICED} {W}) SELECT event_type, open_time_ms, round(ln(open / pc), 6) AS g, round(ln(close / open), 6) AS b, round(ln(high / greatest(open, close)), 6) AS u, round(ln(least(open, close) / low), 6) AS d FROM p WHERE pc IS NOT NULL""")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.coordinates(bars_events(spark, d, HOUR), ["event_type"]).select("event_type", "open_time_ms", "g", "b", "u", "d"))


@add("w23_reconstruction", f"""WITH {BE}, r AS (SELECT *, row_number() OVER w AS k, first_value(close) OVER w AS c0 FROM be WHERE {PRICED} {W}) SELECT event_type, open_time_ms, round(ln(open / c0), 6) AS open, round(ln(high / c0), 6) AS high, round(ln(low / c0), 6) AS low, round(ln(close / c0), 6) AS close FROM r WHERE k > 1""")
def w23(spark: SparkSession, d: str) -> DataFrame:
    path = I.from_coordinates(I.coordinates(bars_events(spark, d), ["event_type"]).select("event_type", "open_time_ms", "g", "b", "u", "d"), ["event_type"], 1.0)
    return rounded(path.select("event_type", "open_time_ms", *[F.log(c).alias(c) for c in ("open", "high", "low", "close")]))


@add("w25_long_term_filter", f"""WITH {BO}, m AS (SELECT *, date_trunc('month', make_timestamp(open_time_ms * 1000)) AS m FROM bo), x AS (SELECT *, lead(m) OVER (ORDER BY open_time_ms) AS nm FROM m),
    e AS (SELECT open_time_ms, CASE WHEN count(*) OVER w = 3 THEN avg(close) OVER w END AS sma FROM x WHERE nm > m WINDOW w AS (ORDER BY open_time_ms ROWS 2 PRECEDING)),
    s AS (SELECT open_time_ms, nullif(sign(sma - lag(sma) OVER (ORDER BY open_time_ms)), 0) AS sg FROM e),
    st AS (SELECT open_time_ms, last_value(sg IGNORE NULLS) OVER (ORDER BY open_time_ms) AS state FROM s)
    SELECT b.open_time_ms, (last_value(state IGNORE NULLS) OVER (ORDER BY b.open_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS filter_state FROM bo b LEFT JOIN st ON st.open_time_ms = b.open_time_ms""")
def w25(spark: SparkSession, d: str) -> DataFrame:
    return I.long_term_filter(bars_orders(spark, d), [], 3).select("open_time_ms", "filter_state")


L = 16
ACT = f"""{BEH}, p AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS n FROM be {W}),
    t AS (SELECT *, CASE WHEN pc > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) / pc END AS tr0, {lr('high', 'low')} AS hl, {lr('open', 'pc')} AS ov, {lr('close', 'open')} AS oc, ({lr('high', 'close')}) * ({lr('high', 'open')}) + ({lr('low', 'close')}) * ({lr('low', 'open')}) AS rs FROM p),
    t2 AS (SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE tr0 END AS tr FROM t),
    act AS (SELECT *, CASE WHEN n >= {L} THEN avg(tr) OVER ws END AS tr_mean, CASE WHEN n >= {L} THEN stddev_samp(tr) OVER ws END AS tr_std, CASE WHEN n >= {L} THEN avg(hl) OVER wl END AS hl_mean, CASE WHEN n >= {L} THEN stddev_samp(hl) OVER wl END AS hl_std,
        CASE WHEN n >= {L} THEN sqrt(avg(hl * hl) OVER wl / (4 * ln(2))) END AS parkinson,
        CASE WHEN n >= {L} THEN sqrt(greatest(0, var_samp(ov) OVER ws + (0.34 / (1.34 + {L + 1} / {L - 1}.0)) * var_samp(oc) OVER wl + (1 - 0.34 / (1.34 + {L + 1} / {L - 1}.0)) * avg(rs) OVER wl)) END AS yang_zhang
        FROM t2 WINDOW ws AS (PARTITION BY event_type ORDER BY open_time_ms ROWS {L - 2} PRECEDING), wl AS (PARTITION BY event_type ORDER BY open_time_ms ROWS {L - 1} PRECEDING))"""
FEATURES = ("tr_mean", "tr_std", "hl_mean", "hl_std", "parkinson", "yang_zhang")


@add("w33_activity", f"WITH {ACT} SELECT event_type, open_time_ms, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM act")
def w33(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.activity(bars_events(spark, d, HOUR), ["event_type"], L).select("event_type", "open_time_ms", *FEATURES))


@add("w34_history_ratio", f"WITH {ACT} SELECT event_type, open_time_ms, round(parkinson / quantile_cont(CASE WHEN parkinson > 0 THEN parkinson END, 0.5) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS ratio FROM act")
def w34(spark: SparkSession, d: str) -> DataFrame:
    rows = I.activity(bars_events(spark, d, HOUR), ["event_type"], L)
    return rounded(I.history_ratio(rows, ["event_type"], "parkinson", "ratio").select("event_type", "open_time_ms", "ratio"))


@add("w36_forward_targets", f"""WITH {BEH}, p AS (SELECT *, lead(close, 20) OVER w AS c2, max(high) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS hi, min(low) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS lo FROM be {W}),
    t AS (SELECT *, CASE WHEN close > 0 THEN greatest(0, {lr('hi', 'close')}) END AS up, CASE WHEN lo > 0 THEN greatest(0, {lr('close', 'lo')}) END AS down FROM p WHERE c2 IS NOT NULL)
    SELECT event_type, open_time_ms, (c2 > close)::INT AS direction, round(up, 6) AS up, round(down, 6) AS down, round(quantile_cont(CASE WHEN up + down > 0 THEN up + down END, 0.5) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING), 6) AS normaliser FROM t""")
def w36(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.forward_targets(bars_events(spark, d, HOUR), ["event_type"], 20).select("event_type", "open_time_ms", "direction", "up", "down", "normaliser"))


@add("w39_rolling_slope", f"""WITH {BEH}, r AS (SELECT *, row_number() OVER w AS i FROM be {W}) SELECT event_type, open_time_ms, round(CASE WHEN i >= 30 THEN regr_slope(close, i) OVER (PARTITION BY event_type ORDER BY open_time_ms ROWS 29 PRECEDING) END, 6) AS slope FROM r""")
def w39(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.rolling_slope(bars_events(spark, d, HOUR), ["event_type"], 30).select("event_type", "open_time_ms", "slope"))


@add("w42_region_key", f"""WITH {IND} SELECT event_type, open_time_ms, 'vol=' || ((volatility_ratio > 0.8)::INT + (volatility_ratio > 1.0)::INT + (volatility_ratio > 1.2)::INT) || ';trend=' || ((ema_fast / ema_slow > 0.98)::INT + (ema_fast / ema_slow > 1.02)::INT) AS region FROM e3""")
def w42(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.scalar import region_key

    rows = I.indicators(bars_events(spark, d, HOUR), ["event_type"])
    key = region_key([F.col("volatility_ratio"), F.col("ema_fast") / F.col("ema_slow")], [[0.8, 1.0, 1.2], [0.98, 1.02]], ["vol", "trend"])
    return rows.select("event_type", "open_time_ms", key.alias("region"))


@add("w43_walk_forward", f"""WITH {BEH}, t AS (SELECT event_type, count(*) AS n FROM be GROUP BY 1), f AS (SELECT *, unnest(range(5)) AS fold, (n - 100 - 20) // 5 AS blk FROM t)
    SELECT event_type, fold::INT AS fold, 120 + fold * blk - 21 AS train_end, 120 + fold * blk AS validation_start, CASE WHEN fold = 4 THEN n - 1 ELSE 120 + fold * blk + blk - 1 END AS validation_end FROM f""")
def w43(spark: SparkSession, d: str) -> DataFrame:
    return I.walk_forward_folds(bars_events(spark, d, HOUR), ["event_type"], 100, 20, 5)
