"""Content identities: equal inputs give equal keys, and a change that matters gives another."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(raw: Column) -> Column:
    """JSON text with sorted keys and no white space; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    def all_of(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(all_of, "string")(raw)


def dataset_hash(rows: DataFrame, keys: list[str], order: str, values: list[str], block: int = 256) -> DataFrame:
    """(keys, rows, hash): the hash of each key's rows in order, by way of the hashes of blocks of so many rows, so that no
    more than a block or the list of block hashes is ever together."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    at = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_i") / block))
    cell = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
    blocks = at.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", cell.alias("c")))), lambda x: x["c"]), "\n"), 256).alias("_h"))
    return blocks.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), ","), 256)).alias("hash"))


def layered_key(layer: str, identity: object, *upstream: str) -> str:
    """The cache key of a layer from what identifies it and the keys of the layers before it, whatever their order."""
    text = json.dumps({"layer": layer, "identity": identity, "upstream": sorted(upstream)}, sort_keys=True, separators=(",", ":"))
    return f"{layer}:sha256:{hashlib.sha256(text.encode()).hexdigest()}"


def reused(spark, folder: str, key: str, make) -> DataFrame:
    """The table that `make()` gives, written below folder under its key once and read from there afterwards."""
    path = f"{folder.rstrip('/')}/{key.replace(':', '-')}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def set_hash(value: Column) -> Column:
    """The hash of a group's distinct values, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(value.cast("string"))), ",").cast("binary"), 256)
