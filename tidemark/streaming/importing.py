"""Imports as a stream: from the last stored open on, into a table of bars and a table of what is known about each series.

A batch may be run again, after a lost driver or by hand: bars are upserted by symbol and open, and a series' first and last open only
ever widen, so the tables are those of one run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.checks import valid_bar
from tidemark.shared import shared_folder, written
from tidemark.sources.paged import PagedBars
from tidemark.sources.store import put_bars

SERIES = "symbol string, source string, interval string, first_open_ms long, last_open_ms long, refused long, last_batch long"


def series(spark: SparkSession, path: str) -> DataFrame:
    """What is known about each imported series; no rows where nothing was imported yet."""
    try:
        return spark.read.schema(SERIES).parquet(f"{path.rstrip('/')}/series")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SERIES)


def put_batch(path: str, source: str, interval: str) -> Callable[[DataFrame, int], None]:
    """A function of (rows, batch number) that stores a batch of bars below path: `bars` by month, `series` whole.

    Rows whose prices are no bar are refused and counted, once for each batch."""

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = written(rows)  # the source is asked once a batch
        if rows.isEmpty():
            return
        good = F.coalesce(valid_bar(), F.lit(False))
        put_bars(rows.where(good), f"{path.rstrip('/')}/bars", ["symbol"])
        new = rows.groupBy("symbol").agg(
            F.min(F.when(good, F.col("open_time_ms"))).alias("first_open_ms"), F.max(F.when(good, F.col("open_time_ms"))).alias("last_open_ms"), F.count_if(~good).alias("refused")
        )
        new = new.select("symbol", F.lit(source).alias("source"), F.lit(interval).alias("interval"), "first_open_ms", "last_open_ms", "refused", F.lit(batch).cast("long").alias("last_batch"))
        known = series(spark, path)
        again = known.where(F.col("last_batch") >= batch).select("symbol", "source", "interval", F.lit(True).alias("_again"))
        fresh = new.join(again, ["symbol", "source", "interval"], "left").withColumn("refused", F.when(F.col("_again"), 0).otherwise(F.col("refused"))).drop("_again")
        both = known.unionByName(fresh)
        merged = both.groupBy("symbol", "source", "interval").agg(F.min("first_open_ms").alias("first_open_ms"), F.max("last_open_ms").alias("last_open_ms"), F.sum("refused").alias("refused"), F.max("last_batch").alias("last_batch"))
        kept = written(merged, shared_folder(spark))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/series")

    return put


def imported(spark: SparkSession, path: str, checkpoint: str, source: str, options: dict[str, str], available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Starts the import of a paged source (see PagedBars for its options) below path: all that is there now, or again and again."""
    spark.dataSource.register(PagedBars)
    stream = spark.readStream.format("paged_bars").options(**options).load()
    writer = stream.writeStream.foreachBatch(put_batch(path, source, options.get("interval", "1d"))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
