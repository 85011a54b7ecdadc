"""An archive search in rounds: the best path of each cell of a behaviour space, improved by varied children of the paths that hold cells.

A round is one batch: all its children come from the archive as the round found it, are made and judged by one job, and meet the archive in one
aggregation by cell. With one child a round this is the sequential search, in which each child sees the last one's outcome. The archive
has a row a cell, whatever the number of children, and is a table of its own after each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import keyed_uniform
from tidemark.operators.paths import CHANNELS, quotas, varied
from tidemark.shared import removed, shared_folder, written

#: Paths (path_id, idx, g, b, u, d) to (path_id, vector, score).
Judge = Callable[[DataFrame], DataFrame]
OPERATIONS = tuple(quotas(0))
MOST_CELLS = 65_536


def placed(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds cell: the nearest centre (cell, v) of a point's vector, ties to the smaller cell. The centres are one row beside every point; more than MOST_CELLS are refused."""
    n = centres.count()
    if not 0 < n <= MOST_CELLS:
        raise ValueError(f"{n} centres, 1 to {MOST_CELLS} are allowed")
    one = centres.agg(F.collect_list(F.struct("cell", "v")).alias("_l"))
    away = lambda c: F.aggregate(F.zip_with("vector", c["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_l", lambda c: F.struct(away(c).alias("d"), c["cell"].alias("cell"))))
    return points.crossJoin(F.broadcast(one)).withColumn("cell", best["cell"]).drop("_l")  # one row


def _held(paths: DataFrame, judge: Judge, centres: DataFrame, about: DataFrame) -> DataFrame:
    """The best of each cell among paths: score first, then the smaller path_id. about: (path_id, round, operation, parent, other)."""
    listed = paths.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("idx", *CHANNELS))).alias("path"))
    scored = judge(paths).where("score IS NOT NULL AND NOT isnan(score)").select("path_id", "vector", "score")
    return _best(placed(scored, centres).drop("vector").join(listed, "path_id").join(about, "path_id"))


def _best(rows: DataFrame) -> DataFrame:
    columns = ["path_id", "score", "round", "operation", "parent", "other", "path"]
    first = F.min_by(F.struct(*columns), F.struct(-F.col("score"), F.col("round"), F.col("path_id"))).alias("_b")
    return rows.groupBy("cell").agg(first).select("cell", "_b.*")


def plan_of(archive: DataFrame, number: int, children: int, seed: int) -> DataFrame:
    """(child_id, operation, parent, other) of a round: operations in turn, parents drawn from the archive's cells by keys of seed, round and place; the other
    parent is another cell's, null where there is one cell only."""
    at = archive.select("path_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cell")).alias("_at"))  # a row a cell
    n = archive.count()
    u = lambda k: keyed_uniform(F.lit(seed), F.lit(number), F.col("id"), F.lit(k))
    rows = archive.sparkSession.range(children).withColumn("_p", F.floor(u("parent") * n))
    rows = rows.withColumn("_o", F.when(F.lit(n > 1), (F.col("_p") + 1 + F.floor(u("other") * (n - 1))) % n))
    rows = rows.join(at.select((F.col("_at") - 1).alias("_p"), F.col("path_id").alias("parent")), "_p").join(at.select((F.col("_at") - 1).alias("_o"), F.col("path_id").alias("other")), "_o", "left")
    name = F.element_at(F.array(*map(F.lit, OPERATIONS)), (F.col("id") % len(OPERATIONS) + 1).cast("int"))
    return rows.select(F.concat(F.lit(f"{number}:"), "id").alias("child_id"), name.alias("operation"), "parent", "other")


def _whole(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return bool(done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done))


def evolved(starts: DataFrame, judge: Judge, centres: DataFrame, rounds: int, children: int, seed: int, amplitude: float = 0.1, folder: str | None = None) -> DataFrame:
    """(cell, path_id, score, round, operation, parent, other, path) after `rounds` rounds of `children` children each.

    starts: (path_id, idx, g, b, u, d) in [0, 1], with ids that have no colon; `judge` gives each path its vector and score, and those without a score are left
    out; centres: (cell, v). Children are named round:place. A cell's holder gives way only to a larger score, so no cell ever gets worse, and equal
    arguments give equal archives. Rounds are kept below `folder`, where one is given: a search that was cut off, or is to go on for more rounds, goes on from
    the last whole one. No starts give no archive."""
    spark = starts.sparkSession
    base = folder or shared_folder(spark)
    nothing = F.lit(None).cast("string")
    for number in range(rounds + 1):
        here, before = f"{base.rstrip('/')}/round-{number}", f"{base.rstrip('/')}/round-{number - 1}"
        if _whole(spark, here):
            continue
        if number == 0:
            paths = starts.select(F.col("path_id").cast("string").alias("path_id"), "idx", *CHANNELS)
            about = paths.select("path_id").distinct().select("path_id", F.lit(0).alias("round"), F.lit("start").alias("operation"), nothing.alias("parent"), nothing.alias("other"))
            written(_held(paths, judge, centres, about), here)
            continue
        archive = spark.read.parquet(before)
        plan = written(plan_of(archive, number, children, seed), planned := shared_folder(spark))
        long = archive.select("path_id", F.inline("path"))
        made = written(varied(long, plan, seed, amplitude).withColumnRenamed("child_id", "path_id"), born := shared_folder(spark))
        about = plan.withColumnRenamed("child_id", "path_id").withColumn("round", F.lit(number))
        written(_best(archive.unionByName(_held(made, judge, centres, about))), here)
        for f in (planned, born):
            removed(spark, f)
    return spark.read.parquet(f"{base.rstrip('/')}/round-{rounds}")
