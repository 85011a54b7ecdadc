"""Places of rows in the order of large keys: rows are dealt to ranges of (key, order), a range is one task's, and a row a range and key tells
how many rows, and which value, stand before it. So few large keys spread over all tasks; a window over the whole key would be one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import removed, shared_folder, written


def _ranged(rows: DataFrame, keys: list[str], order: list[str], folder: str) -> DataFrame:
    """The rows as a table, with _range, the number of their range; ranges follow the order within a key, equal rows share one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), folder)


def _dealt(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges dealt to as many tasks as there are ranges; by bytes, adaptive execution would put many ranges of well compressed rows into one."""
    return ranged.repartition(int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_range", *keys)


def _beside(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the row of their range and key; null keys are keys."""
    named = per.withColumnsRenamed({k: f"_key_{k}" for k in ["_range", *keys]})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(named[f"_key_{k}"]) for k in ["_range", *keys]])
    return rows.join(named, on).drop(*[f"_key_{k}" for k in ["_range", *keys]])


def _key(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows as a table, with _i, their place in their key's order from 0, and _n, the key's rows."""
    spark = rows.sparkSession
    ranged = _ranged(rows, keys, order, folder := shared_folder(spark))
    per = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_m"))
    per = per.select("_range", *keys, (F.sum("_m").over(_key(keys).orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(_key(keys)).alias("_n"))
    here = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    out = written(_beside(_dealt(ranged, keys).withColumn("_here", here), per, keys).withColumn("_i", F.col("_before") + F.col("_here") - 1).drop("_range", "_before", "_here"))
    removed(spark, folder)
    return out


def with_previous(rows: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """Adds the key's value before each in the order of values; null for the first."""
    ranged = _ranged(rows, keys, [value], shared_folder(rows.sparkSession))
    per = ranged.groupBy("_range", *keys).agg(F.max(value).alias("_last"))
    per = per.select("_range", *keys, F.lag("_last").over(_key(keys).orderBy("_range")).alias("_prior"))
    w = Window.partitionBy("_range", *keys).orderBy(value)
    near = _dealt(ranged, keys).withColumns({"_here": F.row_number().over(w), to: F.lag(value).over(w)})
    return _beside(near, per, keys).withColumn(to, F.when(F.col("_here") == 1, F.col("_prior")).otherwise(F.col(to))).drop("_range", "_here", "_prior")


def percentiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each of at): exact percentiles of each key's values, between two by their distance, as Spark's `percentile`.

    Null values are not counted; a key without others has no row."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = _ranged(counted, keys, ["_v"], shared_folder(rows.sparkSession))
    per = ranged.groupBy("_range", *keys).agg(F.sum("_c").alias("_m"))
    per = per.select("_range", *keys, "_m", (F.sum("_m").over(_key(keys).orderBy("_range")) - F.col("_m")).alias("_before"), F.sum("_m").over(_key(keys)).alias("_n"))
    place = {n: F.lit(p) * (F.col("_n") - 1) for n, p in at.items()}
    asked = lambda first, last: reduce(lambda a, b: a | b, [((g := f(place[n])) >= first) & (g <= last) for n in at for f in (F.floor, F.ceil)])
    # only the ranges that hold a place that is asked for are looked into
    per = per.where(asked(F.col("_before"), F.col("_before") + F.col("_m") - 1))
    near = _beside(_dealt(ranged, keys), per, keys)
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_range", *keys).orderBy("_v"))
    near = near.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1).where(asked(F.col("_first"), F.col("_last")))
    pick = lambda n, f: F.max(F.when((f(place[n]) >= F.col("_first")) & (f(place[n]) <= F.col("_last")), F.col("_v")))
    found = near.groupBy(*keys).agg(F.any_value("_n").alias("_n"), *[pick(n, F.floor).alias(f"_lo_{n}") for n in at], *[pick(n, F.ceil).alias(f"_hi_{n}") for n in at])
    part = {n: place[n] - F.floor(place[n]) for n in at}
    made = {n: F.when(part[n] == 0, F.col(f"_lo_{n}")).otherwise((1 - part[n]) * F.col(f"_lo_{n}") + part[n] * F.col(f"_hi_{n}")) for n in at}
    return found.select(*keys, *[c.alias(n) for n, c in made.items()])
