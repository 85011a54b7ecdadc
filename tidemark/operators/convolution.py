"""Dilated causal convolutions over series, forward: layers of two taps with tanh, and a linear head on every row.

The weights are a table, gathered into one row that lies beside every row. All layers look back through windows of the same partitions and order,
so a net of any depth costs one shuffle and one sort, and no Python touches a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A row a weight: layer from 0, the head is the last; tap 0 is the row itself, 1 the row `dilation` before; input -1 is the bias. The head has tap 0 only.
WEIGHTS = "layer int, dilation int, output int, input int, tap int, weight double"
MOST_WEIGHTS = 1_000_000
#: Starting weight k, from 1, is SPAN * sin(k * GOLDEN).
SPAN, GOLDEN = 0.08, (1 + math.sqrt(5)) / 2


def starting_weights(spark: SparkSession, inputs: int, hidden: int, dilations: list[int], outputs: int) -> DataFrame:
    """The weights a net starts with, numbered by layer, output, input and tap; biases are 0."""
    return spark.createDataFrame(starting_rows(inputs, hidden, dilations, outputs), WEIGHTS)


def starting_rows(inputs: int, hidden: int, dilations: list[int], outputs: int) -> list[tuple[int, int, int, int, int, float]]:
    wide = [inputs, *[hidden] * len(dilations)]
    places = [(k, d, o, i, t) for k, d in enumerate(dilations) for o in range(hidden) for i in range(wide[k]) for t in (0, 1)]
    places += [(len(dilations), 0, o, i, 0) for o in range(outputs) for i in range(hidden)]
    rows = [(*p, SPAN * math.sin((k + 1) * GOLDEN)) for k, p in enumerate(places)]
    return rows + [(k, d, o, -1, 0, 0.0) for k, d, n in [*[(k, d, hidden) for k, d in enumerate(dilations)], (len(dilations), 0, outputs)] for o in range(n)]


def _shape(weights: DataFrame, inputs: int) -> list[tuple[int, int]]:
    """(dilation, outputs) of each layer, the head last; a table that lacks a weight, or has one twice, is refused."""
    per = weights.groupBy("layer").agg(F.min("dilation"), F.max("dilation"), F.max("output") + 1, F.count(F.lit(1)), F.count_distinct("output", "input", "tap"), F.max("input") + 1, F.max("tap"), F.count("weight"))
    found = per.orderBy("layer").collect()  # a row a layer
    if not found or sum(r[4] for r in found) > MOST_WEIGHTS:
        raise ValueError(f"a net has 1 to {MOST_WEIGHTS} weights")
    shape, wide = [], inputs
    for k, (layer, low, high, n, rows, unlike, ins, tap, there) in enumerate(found):
        head = k == len(found) - 1
        if layer != k or low != high or ins != wide or tap != (0 if head else 1) or not rows == unlike == there == n * (wide * (1 if head else 2) + 1) or (low < 1 and not head):
            raise ValueError(f"layer {k} is not whole")
        shape.append((low, n))
        wide = n
    return shape


def _matrix(layer: int, tap: int) -> Column:
    """Weights of a layer's tap, by output and input: a flat array, cut into rows by `_rows`."""
    own = F.when((F.col("layer") == layer) & (F.col("tap") == tap) & (F.col("input") >= 0), F.struct("output", "input", "weight"))
    return F.transform(F.sort_array(F.collect_list(own)), lambda s: s["weight"])


def _rows(flat: Column, wide: int, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.slice(flat, o * wide + 1, wide))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _layer(now: Column, bias: Column, past: Column | None = None) -> Column:
    """Bias and weighted sums of the row (_x) and, within tanh, of the row before it (_past); without `past` the sums alone."""

    def output(weights: Column, o: Column) -> Column:
        own = bias[o] + _dot(weights, F.col("_x"))
        return own if past is None else F.tanh(own + _dot(past[o], F.col("_past")))

    return F.transform(now, output)


def forward(rows: DataFrame, keys: list[str], channels: list[str], weights: DataFrame, order: str = "open_time_ms", to: str = "output") -> DataFrame:
    """Adds an array of the head's outputs for each row of a series, from the row and those before it only.

    What lies before a series' first row counts as 0, at every layer. A null channel makes the outputs of all rows that see it null: the row itself and those
    as far after it as the dilations reach. `order` tells a key's rows apart. The weights are at most MOST_WEIGHTS."""
    shape = _shape(weights, len(channels))
    biases = [F.transform(F.sort_array(F.collect_list(F.when((F.col("layer") == k) & (F.col("input") == -1), F.struct("output", "weight")))), lambda s: s["weight"]).alias(f"_b{k}") for k in range(len(shape))]
    wide = [len(channels), *[n for _, n in shape]]
    flat = weights.agg(*[_matrix(k, t).alias(f"_f{k}_{t}") for k in range(len(shape)) for t in (0, 1)], *biases)
    net = flat.select(*[_rows(F.col(f"_f{k}_{t}"), wide[k], n).alias(f"_w{k}_{t}") for k, (_, n) in enumerate(shape) for t in (0, 1) if t == 0 or k < len(shape) - 1], *[f"_b{k}" for k in range(len(shape))])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    x = F.array(*[F.col(c).cast("double") for c in channels])
    there = F.forall(x, lambda v: v.isNotNull())
    at = rows.crossJoin(F.broadcast(net)).withColumns({"_x": F.when(there, x), "_i": F.row_number().over(w)})  # one row
    for k, (dilation, _) in enumerate(shape[:-1]):
        nought = F.array_repeat(F.lit(0.0), wide[k])
        at = at.withColumn("_past", F.when(F.col("_i") <= dilation, nought).otherwise(F.lag("_x", dilation).over(w)))
        whole = F.col("_x").isNotNull() & F.col("_past").isNotNull()
        at = at.withColumn("_x", F.when(whole, _layer(F.col(f"_w{k}_0"), F.col(f"_b{k}"), F.col(f"_w{k}_1"))))
    k = len(shape) - 1
    return at.withColumn(to, F.when(F.col("_x").isNotNull(), _layer(F.col(f"_w{k}_0"), F.col(f"_b{k}")))).select(*rows.columns, to)
