"""Stored series: partitioned tables with upserts, immutable versions, blocks, exports and manual prices."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import checked_blocks
from tidemark.sources.upsert import upsert, with_parents

MONTH = "month"


def _months(rows: DataFrame) -> DataFrame:
    return rows.withColumn(MONTH, F.date_format(F.timestamp_millis("open_time_ms").cast("timestamp_ntz"), "yyyy-MM"))


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or no rows where there is none yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _months(like.limit(0))
    return found.select(*like.columns, MONTH)


def recovered(spark: SparkSession, path: str) -> list[str]:
    """Months that a writer had set aside and not replaced when it ended, put back; their names."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    back = []
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith(".old-"):
            month = name.rpartition("@")[2]
            there = spark._jvm.org.apache.hadoop.fs.Path(folder, month)
            if not fs.exists(there):
                fs.rename(entry.getPath(), there)
                back.append(month)
            else:
                fs.delete(entry.getPath(), True)
    return back


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def put_bars(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Upserts bars by key and open time into a table partitioned by month; only months that get rows are read and written anew.

    The new months are written whole into a folder of this call's own, which readers do not see, and then take the places of the old ones one by
    one. A writer that ends between leaves each month as it was or as it should be (`recovered` puts back one that was set aside), and the same
    rows put again make the table whole. Two writers at once must not touch the same month."""
    spark = rows.sparkSession
    recovered(spark, path)
    new = _months(rows)
    touched = [r[0] for r in new.select(MONTH).distinct().collect()]  # as many as there are months
    if not touched:
        return
    old = stored(spark, path, rows).where(F.col(MONTH).isin(touched))
    merged = upsert(old, new, [*keys, "open_time_ms"])
    folder, fs = _folder(spark, path)
    own = uuid.uuid4().hex
    side = f"{path.rstrip('/')}/.next-{own}"
    merged.repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(side)
    at = spark._jvm.org.apache.hadoop.fs.Path
    for month in touched:
        name = f"{MONTH}={month}"
        place, aside = at(folder, name), at(folder, f".old-{own}@{name}")
        if fs.exists(place):
            fs.rename(place, aside)
        if not fs.rename(at(at(side), name), place):
            raise OSError(f"{name} could not be put in place")
        fs.delete(aside, True)
    fs.delete(at(side), True)


def put_version(rows: DataFrame, path: str, version: int, keys: list[str]) -> None:
    """Writes a series as an immutable version with ordinals from 0; a version that exists is refused."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("open_time_ms")
    numbered = rows.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    numbered.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def bars_of(spark: SparkSession, live: str, versions: str, version: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Live bars by time, or those of a version by ordinal; the same columns either way."""
    if version is not None:
        rows = spark.read.parquet(f"{versions.rstrip('/')}/version={version}")
        columns, order = [c for c in rows.columns if c != "ordinal"], "ordinal"
    else:
        rows = spark.read.parquet(live)
        columns, order = [c for c in rows.columns if c != MONTH], "open_time_ms"
    if start_ms is not None:
        rows = rows.where(F.col("open_time_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.where(F.col("open_time_ms") <= end_ms)
    return rows.orderBy(order).select(*columns)


def block_of(blocks: DataFrame, run: dict[str, object], number: int) -> DataFrame:
    """One block of a run; a body that no longer has its hash fails the job."""
    rows = blocks.where(F.col("block") == number)
    for name, value in run.items():
        rows = rows.where(F.col(name) == value)
    whole = checked_blocks(rows)
    return whole.where(F.assert_true(F.col("intact"), F.lit("a stored block is damaged")).isNull())


def export_changes(children: DataFrame, parents: DataFrame, since: Column, updated: str, created: str, child_key: str, parent_key: str, folder: str) -> None:
    """Writes rows touched since a time and the parents that they refer to, as JSON."""
    changed = children.where((F.col(updated) >= since) | (F.col(created) >= since))
    changed.write.mode("overwrite").json(f"{folder.rstrip('/')}/children")
    with_parents(changed, parents, child_key, parent_key).write.mode("overwrite").json(f"{folder.rstrip('/')}/parents")


def restore(base: DataFrame, folder: str, name: str, keys: list[str]) -> DataFrame:
    """A relation with an export's rows put over it."""
    new = base.sparkSession.read.schema(base.schema).json(f"{folder.rstrip('/')}/{name}")
    return upsert(base, new, keys)


def with_manual_prices(bars: DataFrame, manual: DataFrame) -> DataFrame:
    """Bars with manual closes (date, close) put over them by UTC date; a price for a new date is a flat bar at midnight."""
    day = 86_400_000
    flat = manual.select((F.unix_date(F.col("date").cast("date")).cast("long") * day).alias("open_time_ms"), *[F.col("close").cast("double").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))
    both = bars.select("open_time_ms", "open", "high", "low", "close", "volume").withColumn("_side", F.lit(0)).unionByName(flat.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(F.floor(F.col("open_time_ms") / day)).orderBy(F.col("_side").desc(), F.col("open_time_ms").desc())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_side")


def read_manual_prices(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) from JSON lines; lines that do not parse are left out."""
    return spark.read.schema("date string, close double").json(path).where("date IS NOT NULL AND close > 0")
