"""Queries of the bit-exact generators and fingerprints, with their SQL in wide whole numbers, and of the streamed import and states."""

from __future__ import annotations

from tidemark.functions import wrapping as U
from tidemark.plans.base import BE, HOUR, Book, DataFrame, F, SparkSession
from tidemark.plans.research import ENTER_KEEP, RATIO_A, RATIO_B, STATE, swings
from tidemark.session import table
from tidemark.sources.bars import bars_events

BOOK = Book()
add = BOOK.add
WORD = "18446744073709551616::UHUGEINT"


def mod(x: str) -> str:
    return f"(({x}) % {WORD})::UBIGINT"


def mul(x: str, factor: int) -> str:
    return mod(f"({x})::UHUGEINT * {factor}::UHUGEINT")


def inc(x: str, y: str) -> str:
    return mod(f"({x})::UHUGEINT + ({y})::UHUGEINT")


def final(source: str, x: str, to: str, kept: str) -> str:
    """CTEs that finalise column x of a source to column `to`."""
    return f"""{to}_1 AS (SELECT {kept}, {mul(f"xor({x}, {x} >> 30)", U.FIRST)} AS z FROM {source}),
    {to}_2 AS (SELECT {kept}, {mul("xor(z, z >> 27)", U.SECOND)} AS z FROM {to}_1), {to} AS (SELECT {kept}, xor(z, z >> 31) AS {to} FROM {to}_2)"""


UNIT = "(({}) >> 11)::DOUBLE / 9007199254740992.0"
HEX = "lower(lpad(hex({}), 16, '0'))"


@add(
    "x24_counter_unit",
    f"""WITH s AS (SELECT o_orderkey, o_custkey, {inc(f"xor(xor(o_orderkey::UBIGINT, {mul('o_custkey + 1', U.STEP)}), {mul('day(o_orderdate) + 1', U.FIRST)})", str(U.STEP))} AS v FROM orders),
    {final("s", "v", "u", "o_orderkey, o_custkey")} SELECT o_orderkey, o_custkey, {UNIT.format("u")} AS u FROM u""",
)
def x24(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", U.counter_unit(F.col("o_orderkey"), F.col("o_custkey"), F.dayofmonth("o_orderdate")).alias("u"))


@add(
    "x25_stream",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, {inc(f"CASE WHEN l_orderkey = 0 THEN {U.STEP}::UBIGINT ELSE l_orderkey::UBIGINT END", mul("l_linenumber + 1", U.STEP))} AS v FROM lineitem),
    {final("s", "v", "z", "l_orderkey, l_linenumber")} SELECT l_orderkey, l_linenumber, {HEX.format("z")} AS bits, (z % 1000)::BIGINT AS draw FROM z""",
)
def x25(spark: SparkSession, d: str) -> DataFrame:
    z = U.stream(F.col("l_orderkey"), F.col("l_linenumber"))
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z"))
    return found.select("l_orderkey", "l_linenumber", F.lower(F.lpad(F.hex("z"), 16, "0")).alias("bits"), U.modulo(F.col("z"), F.lit(1000)).cast("long").alias("draw"))


_GENE = ("c_acctbal", "c_acctbal / 7", "c_nationkey", "c_custkey / 1e6")


@add(
    "x34_gene_fingerprint",
    f"""WITH q AS (SELECT c_custkey, unnest([{", ".join(f"CASE WHEN {v} < 0 THEN -floor(-({v}) * 1e6 + 0.5) ELSE floor(({v}) * 1e6 + 0.5) END::HUGEINT" for v in _GENE)}]) AS v, unnest(range({len(_GENE)})) AS k FROM customer),
    w AS (SELECT c_custkey, k, (CASE WHEN v < 0 THEN v + 18446744073709551616::HUGEINT ELSE v END)::UBIGINT AS v FROM q),
    b AS (SELECT c_custkey, list((v >> s) & 255 ORDER BY k, s) AS o FROM (SELECT *, unnest(range(0, 64, 8)) AS s FROM w) GROUP BY c_custkey),
    h AS (SELECT c_custkey, list_reduce(list_prepend({U.BASIS}::UBIGINT, o), lambda h, x: {mul("xor(h, x)", U.PRIME)}) AS h FROM b)
    SELECT c_custkey, {HEX.format("h")} AS fingerprint FROM h""",
)
def x34(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "customer").select("c_custkey", U.gene_fingerprint(*[F.expr(v).cast("double") for v in _GENE]).alias("h"))
    return found.select("c_custkey", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("fingerprint"))


#: The domain keeps these draws apart from others; a caller gives the one of the results to be repeated.
DOMAIN = "bars:triangular:v1"


def _long_hex(x: str) -> str:
    return f"lpad(hex({x}), 16, '0')"


def _framed(x: str) -> str:
    return f"lpad(hex(strlen({x})), 8, '0') || hex(encode({x}))"


def _draw(k: int) -> str:
    body = f"{_framed(repr(DOMAIN))} || {_long_hex('42')} || {_framed(repr('bars'))} || {_framed(repr('events'))} || {_framed('event_type')} || {_framed(repr('1d'))} || {_long_hex('open_time_ms')} || '02' || '0{k}'"
    return f"(('0x' || sha256(unhex({body}))[1:14])::BIGINT >> 3)::DOUBLE / 9007199254740992.0"


@add("x22_source_draws", f"""WITH {BE} SELECT event_type, open_time_ms, {_draw(0)} AS u, {_draw(0)} - {_draw(1)} AS triangular FROM be""")
def x22_source(spark: SparkSession, d: str) -> DataFrame:
    source = [F.lit("bars"), F.lit("events"), F.col("event_type"), F.lit("1d")]
    u = lambda k: U.source_unit(DOMAIN, F.lit(42), source, F.col("open_time_ms"), F.lit(2), F.lit(k))
    return bars_events(spark, d).select("event_type", "open_time_ms", u(0).alias("u"), (u(0) - u(1)).alias("triangular"))


@add(
    "g2_shuffles",
    f"""WITH RECURSIVE {BE}, o AS (SELECT event_type, list(close ORDER BY open_time_ms) AS l, list(open_time_ms ORDER BY open_time_ms) AS t FROM be GROUP BY 1),
    y AS (SELECT event_type, r.r AS sequence, l, t, xor(3::UBIGINT, {inc("r.r", str(U.STEP))}) AS y FROM o, range(3) r(r)),
    e AS (SELECT event_type, sequence, l, t, {inc("y", str(U.STEP))} AS y FROM y),
    {final("e", "y", "seed", "event_type, sequence, l, t")},
    i AS (SELECT event_type, sequence, seed, unnest(range(2, len(l) + 1)) AS i, len(l) AS n FROM seed),
    j AS (SELECT event_type, sequence, i, {inc("seed", mul("n - i + 1", U.STEP))} AS v FROM i),
    {final("j", "v", "z", "event_type, sequence, i")},
    s AS (SELECT event_type, sequence, t, l, len(l) AS i FROM seed UNION ALL
      SELECT s.event_type, s.sequence, t, [CASE WHEN k = s.i THEN l[(z.z % s.i)::BIGINT + 1] WHEN k = (z.z % s.i)::BIGINT + 1 THEN l[s.i] ELSE l[k] END for k in range(1, len(l) + 1)], s.i - 1
      FROM s JOIN z ON z.event_type = s.event_type AND z.sequence = s.sequence AND z.i = s.i)
    SELECT event_type, sequence::INT AS sequence, unnest(t) AS open_time_ms, unnest(l) AS close FROM s WHERE i <= 1""",
)
def g2(spark: SparkSession, d: str) -> DataFrame:
    return U.fisher_yates(bars_events(spark, d), ["event_type"], "open_time_ms", "close", 3, 3)


@add("s9_streamed_import", f"""WITH {BE} SELECT upper(event_type) AS symbol, open_time_ms, open, high, low, close, volume FROM be WHERE least(open, high, low, close) > 0""")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars imported through the paged stream in two runs, the second from the first one's checkpoint."""
    from tidemark.shared import shared_folder, written
    from tidemark.sources.store import stored
    from tidemark.streaming.importing import imported

    bars = bars_events(spark, d).select(F.upper("event_type").alias("symbol"), "open_time_ms", "open", "high", "low", "close", "volume")
    here, path, checkpoint = (shared_folder(spark) for _ in range(3))
    symbols = ",".join(sorted(r[0] for r in bars.select("symbol").distinct().collect()))  # one a series
    first, middle = bars.agg(F.min("open_time_ms"), F.percentile_approx("open_time_ms", 0.5)).first()
    options = {"symbol": symbols, "start_ms": str(first), "fetch": "tidemark.sources.paged:stored_pages", "latest": "tidemark.sources.paged:stored_latest", "limit": "7", "slices": "2", "table": here}
    for part in (bars.where(F.col("open_time_ms") <= middle), bars):
        written(part, here)
        imported(spark, path, checkpoint, "events", options).awaitTermination()
    return stored(spark, f"{path}/bars", bars).select(*bars.columns)


_WAITS = 6  # hours


@add(
    "w27_streamed_states",
    f"""WITH {STATE.replace("AS p FROM be)", f"AS p, {RATIO_A} AS ra, {RATIO_B} AS rb FROM be)").replace("'uncertain' END AS st", "'uncertain' END || CASE WHEN hi = 1 THEN '_high' ELSE '_low' END AS st").replace(" AS dn FROM x)", f" AS dn, {ENTER_KEEP.format(enter='ra > 1.5 OR rb > 1.3', keep='ra >= 1.25 OR rb >= 1.15')} AS hi FROM x)")},
    f AS (SELECT *, min(open_time_ms) OVER (PARTITION BY event_type, occurrence) AS start_ms FROM o)
    SELECT event_type, open_time_ms, st AS state, occurrence::BIGINT AS occurrence, start_ms, 0::BIGINT AS late FROM f WHERE open_time_ms < (SELECT max(open_time_ms) FROM be) - {_WAITS * HOUR}""",
)
def w27_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars sent through a stream in four parts, with a restart in the middle; what the watermark has passed."""
    from tidemark.shared import removed, shared_folder, written
    from tidemark.streaming.states import kept_states, streamed_states

    bars = written(swings(spark, d))
    here, path, checkpoint = (shared_folder(spark) for _ in range(3))
    inner, last = bars.agg(F.percentile_approx("open_time_ms", [0.25, 0.5, 0.75]), F.max("open_time_ms")).first()
    cuts = [-1, *inner, last]
    for i in range(4):
        bars.where((F.col("open_time_ms") > cuts[i]) & (F.col("open_time_ms") <= cuts[i + 1])).write.mode("append").parquet(here)
        if i % 2:
            stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 8).parquet(here)
            kept_states(streamed_states(stream, "event_type", "p", {"ra": 1.5, "rb": 1.3}, f"{_WAITS} hours"), path, checkpoint).awaitTermination()
    for folder in (here, checkpoint):
        removed(spark, folder)
    return spark.read.parquet(path).select("event_type", "open_time_ms", "state", "occurrence", "start_ms", "late")
