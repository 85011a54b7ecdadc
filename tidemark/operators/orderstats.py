"""Medians of all earlier rows, by ranks and blocks.

One sort gives each value its rank, another each row its place. Places and ranks are cut into blocks of about the square root of
the series, and counts of rows by block of places and block of ranks, added up over places, tell how many values of each block of ranks
stand before a block of places. A row finds the block of ranks of its median in those counts, and the median itself among that block's
values. So a row costs about the square root of its series, whatever its place, and blocks are what a task holds, not series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written

#: Rows that look for their medians in one block of ranks, at most about so many a task.
ASKED = 1 << 16
#: Rows of a block at least: short series are one block.
LEAST = 256


def _places(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each row of a block of places (left) the block of ranks, and the place within it, of both middle values of all rows up to it."""
    if not left.num_rows:
        return pa.table({"_k": pa.array([], pa.string()), "_i": pa.array([], pa.int64()), "_rb": pa.array([], pa.int64()), "_nth": pa.array([], pa.int64())})
    left = left.sort_by("_i")
    before = dict(zip(right.column("_rank_block").to_pylist(), right.column("_before").to_pylist()))
    mine = left.column("_rb").to_pylist()
    counts = np.zeros(max([*before, *(x for x in mine if x is not None), 0]) + 1, np.int64)
    for rb, n in before.items():
        counts[rb] = n
    total, at, rbs, nths = int(counts.sum()), [], [], []
    for i, rb in zip(left.column("_i").to_pylist(), mine):
        if rb is not None:
            counts[rb] += 1
            total += 1
        if total:
            upto = np.cumsum(counts)
            for middle in {(total - 1) // 2, total // 2}:
                b = int(np.searchsorted(upto, middle, "right"))
                at.append(i)
                rbs.append(b)
                nths.append(middle - int(upto[b - 1]) if b else middle)
    return pa.table({"_k": pa.array([left.column("_k")[0].as_py()] * len(at), pa.string()), "_i": pa.array(at, pa.int64()), "_rb": pa.array(rbs, pa.int64()), "_nth": pa.array(nths, pa.int64())})


def _picked(asked: pa.Table, members: pa.Table) -> pa.Table:
    """The value of each question (_i, _nth): of a block of ranks, the one in place _nth of those that stand no later than _i."""
    i, nth = asked.column("_i").to_numpy(), asked.column("_nth").to_numpy()
    members = members.sort_by("_r")
    place, value = members.column("_at").to_numpy(), members.column("_v").to_numpy()
    out = np.empty(len(i))
    step = max(1, (1 << 22) // max(1, len(place)))
    for lo in range(0, len(i), step):
        there = np.cumsum(place[None, :] <= i[lo : lo + step, None], 1, dtype=np.int32)
        out[lo : lo + step] = value[(there == nth[lo : lo + step, None] + 1).argmax(1)]
    return pa.table({"_k": asked.column("_k"), "_i": asked.column("_i"), "_median": pa.array(out)})


def prefix_median(rows: DataFrame, keys: list[str], order: str, value: str, to: str, lag: int = 0) -> DataFrame:
    """Adds the median of the key's values from its first row up to `lag` rows before each row; null where there is none yet.

    Null values are not counted; the median of an even number is the mean of the middle two. `order` is unique within a key. Null keys are a
    key."""
    whole = Window.partitionBy("_k")
    named = rows.withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit("-"))
    placed = named.withColumn("_i", F.row_number().over(whole.orderBy(order)).cast("long") - 1)
    narrow = placed.select("_k", "_i", F.col(value).cast("double").alias("_v"))
    rank = F.when(F.col("_v").isNotNull(), F.row_number().over(whole.orderBy(F.col("_v").asc_nulls_last(), "_i")).cast("long") - 1)
    block = F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)).over(whole))), F.lit(LEAST)).cast("long")
    narrow = narrow.withColumns({"_r": rank, "_b": block})
    narrow = written(narrow.select("_k", "_i", "_v", "_r", "_b", F.floor(F.col("_i") / F.col("_b")).alias("_pb"), F.floor(F.col("_r") / F.col("_b")).alias("_rb")))
    counted = narrow.where("_r IS NOT NULL")
    # counts before each block of places, in all blocks of ranks that have begun by then
    cells = counted.groupBy("_k", "_rb", "_pb").agg(F.count(F.lit(1)).alias("_n"))
    last = narrow.groupBy("_k").agg(F.max("_pb").alias("_last"))
    added = cells.withColumn("_until", F.coalesce(F.lead("_pb").over(Window.partitionBy("_k", "_rb").orderBy("_pb")), F.lit(-1).cast("long")))
    added = added.withColumn("_before", F.sum("_n").over(Window.partitionBy("_k", "_rb").orderBy("_pb"))).join(last, "_k")
    to_block = F.when(F.col("_until") >= 0, F.col("_until")).otherwise(F.col("_last"))
    before = added.where(to_block > F.col("_pb")).select("_k", "_rb", "_before", F.explode(F.sequence(F.col("_pb") + 1, to_block)))
    before = before.toDF("_key", "_rank_block", "_before", "_block")  # other names: both sides come from one table
    asked = narrow.groupBy("_k", "_pb").cogroup(before.groupBy("_key", "_block")).applyInArrow(_places, "_k string, _i long, _rb long, _nth long")
    # a block of ranks that many rows ask is copied to slices of places, each of about ASKED rows
    size = narrow.groupBy("_k").agg(F.any_value("_b").alias("_b"))
    asked = written(asked.join(size, "_k").withColumn("_slice", F.floor(F.col("_i") / F.greatest(F.floor(F.lit(ASKED) / F.col("_b")) * F.col("_b"), F.col("_b")))).drop("_b"))
    wanted = asked.select("_k", "_rb", "_slice").distinct()
    members = counted.select("_k", "_rb", "_r", F.col("_i").alias("_at"), "_v").join(wanted, ["_k", "_rb"])
    members = members.select("_k", "_rb", "_slice", "_r", "_at", "_v").toDF("_key", "_block", "_part", "_r", "_at", "_v")
    found = asked.groupBy("_k", "_rb", "_slice").cogroup(members.groupBy("_key", "_block", "_part")).applyInArrow(_picked, "_k string, _i long, _median double")
    medians = found.groupBy("_k", (F.col("_i") + lag).alias("_i")).agg(F.avg("_median").alias(to))
    return placed.join(medians, ["_k", "_i"], "left").drop("_k", "_i")
