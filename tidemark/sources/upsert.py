"""Sinks and merges by key, as unions with a rule for which row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], newest: list[Column] | None = None) -> DataFrame:
    """Rows of both by key; a new row replaces a stored one, and of several new ones the last by `newest`."""
    both = stored.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.col("_side").desc(), *[c.desc() for c in newest or []])
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_side")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those new ones whose keys are not stored."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def add_counts(stored: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counts by key, those of both added up."""
    return stored.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def earliest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def archived(series: DataFrame, versions: DataFrame, chosen: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Series and their versions with archived_at set for the chosen keys: of versions those that are completed, published and
    not archived yet. A null `now` takes the marks away from chosen series and from all of their versions."""
    mark = chosen.select(key).distinct().withColumn("_chosen", F.lit(True))
    open_ = (F.col("status") == "completed") & F.col("published") & F.col("archived_at").isNull()

    def put(rows: DataFrame, which: Column) -> DataFrame:
        at = F.when(F.col("_chosen") & (which | now.isNull()), now).otherwise(F.col("archived_at"))
        return rows.join(mark, key, "left").withColumn("archived_at", at).drop("_chosen").select(*rows.columns)

    return put(series, F.lit(True)), put(versions, open_)


def changed_since(rows: DataFrame, since: Column, updated: str, created: str) -> DataFrame:
    """Rows touched since a time, for an incremental export."""
    return rows.where((F.col(updated) >= since) | (F.col(created) >= since))


def with_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The parents that children refer to: one step of a foreign-key closure."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_semi")
