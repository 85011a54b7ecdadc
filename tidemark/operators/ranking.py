"""Ranks, order statistics, samples and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import places
from tidemark.operators.fits import met


def _group(keys: list[str]):
    return Window.partitionBy(*(keys or [F.lit(0)]))


def average_rank(value: str, keys: list[str]) -> Column:
    """1-based rank, the mean place for ties."""
    return F.rank().over(_group(keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation, 0 where a side does not vary."""
    ranked = rows.select(*keys, average_rank(a, keys).alias("ra"), average_rank(b, keys).alias("rb"))
    varies = (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0)
    return ranked.groupBy(*keys).agg(F.when(varies, F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))).otherwise(0.0).alias("spearman"))


def midrank_percentile(values: DataFrame, sample: DataFrame, keys: list[str], value: str = "value", higher_is_better: bool = True, eps: float = 1e-12) -> DataFrame:
    """Where each value stands in its key's sample, in percent; ties within eps count half. One window over
    both sides, no pairs: equal values within eps form runs."""
    both = sample.select(*keys, F.col(value).alias("x"), F.lit(0).alias("_q")).unionByName(values.select(*keys, F.col(value).alias("x"), F.lit(1).alias("_q")))
    w = _group(keys).orderBy("x")
    runs = both.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(w) > eps).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = runs.groupBy(*keys, "_run").agg(F.sum(1 - F.col("_q")).alias("_n"))
    up = _group(keys).orderBy("_run")
    per = per.withColumns({"_below": F.sum("_n").over(up) - F.col("_n"), "_all": F.sum("_n").over(_group(keys))})
    out = runs.where("_q = 1").join(per, [*keys, "_run"])
    share = 100 * (F.col("_below") + 0.5 * F.col("_n")) / F.nullif(F.col("_all"), F.lit(0))
    return out.select(*keys, F.col("x").alias(value), (share if higher_is_better else 100 - share).alias("percentile"))


def representatives(rows: DataFrame, kind: str, metric: str, id_: str) -> DataFrame:
    """The lowest, median (place n / 2) and highest row of each kind."""
    w = Window.partitionBy(kind).orderBy(metric, id_)
    at = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(kind))})
    role = F.array_compact(F.array(F.when(F.col("_i") == 0, F.lit("low")), F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.lit("median")), F.when(F.col("_i") == F.col("_n") - 1, F.lit("high"))))
    return at.select(kind, id_, metric, F.explode(role).alias("role"))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], most: int = 100) -> DataFrame:
    """At most `most` rows of each key at even places of the order, first and last among them."""
    at = rows.withColumns({"_i": F.row_number().over(_group(keys).orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(_group(keys))})
    step = (F.col("_n") - 1) / (most - 1)
    k = F.round(F.col("_i") / F.nullif(step, F.lit(0.0)))
    return at.where((F.col("_n") <= most) | (F.round(k * step) == F.col("_i"))).drop("_i", "_n")


def unique_within(rows: DataFrame, keys: list[str], value: str, eps: float = 1e-9) -> DataFrame:
    """Values that lie more than eps above the one before."""
    near = places.with_previous(rows.select(*keys, value), keys, value, "_before")
    d = F.col(value) - F.col("_before")
    return near.select(*keys, value, d.alias("_d")).where("_d IS NULL OR _d > " + repr(eps)).drop("_d")


def pass_rate_curve(rows: DataFrame, keys: list[str], distance: str, passed: str) -> DataFrame:
    """Share of points within each distance that pass; equal distances are one row."""
    per = rows.groupBy(*keys, distance).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(passed).cast("int")).alias("_p"))
    w = _group(keys).orderBy(distance)
    return per.select(*keys, distance, F.sum("_n").over(w).alias("n"), (F.sum("_p").over(w) / F.sum("_n").over(w)).alias("rate"))


def reliability_bins(rows: DataFrame, keys: list[str], probability: str, label: str, bins: int = 10) -> DataFrame:
    """Count, mean forecast and observed rate of each bin of the forecast that has any."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("forecast"), F.avg(F.col(label).cast("double")).alias("observed"))


def error_metrics(rows: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """Mean, root mean square, median and 90th percentile of each key's absolute errors; the percentiles are exact."""
    e = rows.select(*keys, F.abs(F.col(actual) - F.col(predicted)).alias("_e"))
    means = e.groupBy(*keys).agg(F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    return met(means, places.percentiles(e, keys, "_e", {"median_error": 0.5, "p90_error": 0.9}), keys)


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labels over the geometric mean of their entropies."""
    joint = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    p = joint.withColumn("_p", F.col("n") / F.sum("n").over(everything))
    p = p.withColumns({"_a": F.sum("_p").over(Window.partitionBy(a)), "_b": F.sum("_p").over(Window.partitionBy(b))})
    mi = F.sum(F.col("_p") * F.log(F.col("_p") / (F.col("_a") * F.col("_b"))))
    # a marginal's entropy, from the joint cells: sum of p * -ln(marginal)
    ha, hb = F.sum(-F.col("_p") * F.log("_a")), F.sum(-F.col("_p") * F.log("_b"))
    return p.agg(F.when((ha > 0) & (hb > 0), mi / F.nullif(F.sqrt(ha * hb), F.lit(0.0))).otherwise(0.0).alias("nmi"))


def first_by_priority(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(_group(keys).orderBy(*order))).where("_r = 1").drop("_r")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in order, with the total number of rows and pages."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
