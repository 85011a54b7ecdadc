"""Parameter grids: components of qualified points, boxes around points, plans of evaluations."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import axis_neighbours, box_neighbours
from tidemark.shared import written


def grid_components(points: DataFrame, axes: list[str], node: Column, most_rounds: int | None = None) -> DataFrame:
    """Adds component: the smallest node number that steps along single axes reach.

    Labels spread to neighbours and jump to their label's label in each round, until none changes; labels that
    still change after most_rounds, where that is given, are refused.
    node numbers the points; equal coordinates must have equal numbers.
    """
    base = points.select(*axes, node.alias("node")).distinct()
    pairs = axis_neighbours(base.select(*axes), [], axes)
    other = base.select(*[F.col(a).alias(f"n_{a}") for a in axes], F.col("node").alias("to"))
    edges = pairs.join(other, [f"n_{a}" for a in axes]).join(base, axes).select(F.col("node").alias("a"), F.col("to").alias("b"))
    edges, labels = written(edges), written(base.select("node", F.col("node").alias("label")))
    for done in count(1):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = spread.join(labels.select(F.col("node").alias("low"), F.col("label").alias("far")), "low").select("node", "label", F.least("low", "far").alias("new"))
        jump = written(jump)
        changed = jump.where("new < label").limit(1).count()
        labels = jump.select("node", F.col("new").alias("label"))
        if not changed:
            break
        if most_rounds is not None and done >= most_rounds:
            raise ValueError(f"components unfinished after {most_rounds} rounds")
    return base.join(labels, "node").select(*axes, F.col("label").alias("component"))


def neighbourhood_objectives(points: DataFrame, keys: list[str], axes: list[str], qualified: list[str], radii: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each point and radius how many points its box holds and the share that qualifies, and the stability over
    the radii: 1 / (1 + population deviation of the first share)."""
    out = None
    for r in radii:
        near = box_neighbours(points.select(*keys, *axes, *qualified), keys, axes, r)
        per = near.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias(f"n_{r}"), *[F.avg(F.col(f"n_{q}").cast("double")).alias(f"{q}_{r}") for q in qualified])
        out = per if out is None else out.join(per, [*keys, *axes])
    shares = [F.col(f"{qualified[0]}_{r}") for r in radii]
    mean = reduce(lambda a, b: a + b, shares) / len(shares)
    var = reduce(lambda a, b: a + b, [(s - mean) * (s - mean) for s in shares]) / len(shares)
    return out.withColumn("stability", 1 / (1 + F.sqrt(var)))


def box_radius(points: DataFrame, keys: list[str], axes: list[str], qualified: str, most: int = 3) -> DataFrame:
    """The largest radius, up to `most`, at which all observed points of a qualified point's box qualify."""
    good = points.where(F.col(qualified))
    ok = good.select(*keys, *axes, F.lit(0).alias("radius"))
    for r in range(1, most + 1):
        near = box_neighbours(points.select(*keys, *axes, qualified), keys, axes, r)
        whole = near.groupBy(*keys, *axes).agg(F.min(F.col(f"n_{qualified}").cast("int")).alias("_all")).where("_all = 1").select(*keys, *axes, F.lit(r).alias("radius"))
        ok = ok.unionByName(whole)
    return ok.groupBy(*keys, *axes).agg(F.max("radius").alias("radius"))


def centre_cascade(candidates: DataFrame, region: str, order: list[Column]) -> DataFrame:
    """Candidates of a region that stay when the best by each criterion in turn is kept."""
    from pyspark.sql import Window

    out = candidates
    for i, c in enumerate(order):
        out = out.withColumn(f"_c{i}", c)
        out = out.withColumn("_m", F.max(f"_c{i}").over(Window.partitionBy(region))).where(F.col(f"_c{i}") == F.col("_m")).drop(f"_c{i}", "_m")
    return out
