"""Validity of rows and series, as columns and as relations of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import valid_ohlc


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def positive(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(finite(c) & (c > 0), F.lit(False)) for c in cs])


def valid_bar(timed: bool = True, ordered: bool = True, counted: bool = False) -> Column:
    """Whether a bar's prices are finite and above 0, by the rule that its reader needs: timed asks for a time above 0, ordered
    for a high and a low that hold open and close, counted for a finite volume of 0 or more.

    Features take timed bars as they are, geometry takes timed and ordered ones, perturbation ordered and counted ones."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = positive(o, h, lo, c)
    if timed:
        ok = ok & F.coalesce(F.col("open_time_ms") > 0, F.lit(False))
    if ordered:
        ok = ok & (h >= F.greatest(o, c)) & (lo <= F.least(o, c))
    if counted:
        ok = ok & F.coalesce(finite(F.col("volume")) & (F.col("volume") >= 0), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def usable_version(status: str = "status", published: str = "published", archived: str = "archived_at") -> Column:
    """Whether a version is completed, published and not archived."""
    return F.coalesce((F.col(status) == "completed") & F.col(published) & F.col(archived).isNull(), F.lit(False))


def series_faults(bars: DataFrame, keys: list[str], ordered: bool = False) -> DataFrame:
    """(keys, n, bad_bars, not_increasing, gaps): rows that are no valid bar, times not above the one before, and with
    `ordered` ordinals that do not follow on the one before. A series with n = 0 is not listed."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("ordinal" if ordered else "open_time_ms")
    late = F.coalesce(F.col("open_time_ms") <= F.lag("open_time_ms").over(w), F.lit(False))
    gap = F.coalesce(F.col("ordinal") != F.lag("ordinal").over(w) + 1, F.col("ordinal") != 0) if ordered else F.lit(False)
    ok = F.coalesce(valid_ohlc(*[F.col(c) for c in ("open", "high", "low", "close")]) & (F.col("open_time_ms") > 0), F.lit(False))
    rows = bars.withColumns({"_late": late, "_gap": gap, "_ok": ok})
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ok")).alias("bad_bars"), F.count_if("_late").alias("not_increasing"), F.count_if("_gap").alias("gaps"))


def path_faults(path: DataFrame, keys: list[str], exposure: str = "actual_exposure") -> DataFrame:
    """(keys, n, bad_nav, bad_exposure, valid): a path needs two rows, values above 0 and exposures in [0, 1]."""
    bad_nav = F.count_if(~positive(F.col("nav")))
    bad_exposure = F.count_if(~F.coalesce(F.col(exposure).between(0, 1), F.lit(False)))
    n = F.count(F.lit(1))
    return path.groupBy(*keys).agg(n.alias("n"), bad_nav.alias("bad_nav"), bad_exposure.alias("bad_exposure"), ((n >= 2) & (bad_nav == 0) & (bad_exposure == 0)).alias("valid"))


def in_evaluation(start_ms: int, end_ms: int, time: str = "open_time_ms") -> Column:
    """Whether a row lies in the evaluation's range, both ends included."""
    return F.col(time).between(start_ms, end_ms)


def on_grid(bounds: dict[str, tuple[int, int]]) -> Column:
    """Whether a point lies within the ranges of its axes."""
    return reduce(lambda a, b: a & b, [F.col(a).between(lo, hi) for a, (lo, hi) in bounds.items()])


def lookup(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their one target; a missing or repeated target fails the job."""
    counted = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in targets.columns if c not in keys])
    joined = rows.join(counted, keys, "left")
    checked = F.assert_true(F.coalesce(F.col("_n") == 1, F.lit(False)), F.lit("each row needs exactly one target"))
    # kept as a filter so that the check is not pruned away
    return joined.where(checked.isNull()).drop("_n")


def filtered(rows: DataFrame, cell: int | None = None, state: str | None = None, permanent: bool | None = None, passed: str | None = None) -> DataFrame:
    """Rows by those of the optional predicates that are given."""
    for column, value in (("cell", cell), ("state", state), ("permanent", permanent)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.col(passed)) if passed else rows


def eligibility(members: DataFrame, versions: list[str], context: list[str], schema: str, points: str) -> DataFrame:
    """How far a set of configurations can be compared: incompatible, descriptive_only, context_matched_unpaired or paired_direct."""
    one = lambda cs: F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])) == 1
    missing = F.count_if(F.coalesce(F.col(points), F.lit("")) == "") > 0
    return members.agg(
        F.when((F.count(F.lit(1)) < 2) | ~one(versions), "incompatible")
        .when(~one(context), "descriptive_only")
        .when(~one([schema]) | ~one([points]) | missing, "context_matched_unpaired")
        .otherwise("paired_direct")
        .alias("level")
    )
