"""Counts, quotas and region keys as columns against the functions of one number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import paths as P
from tidemark.operators import sampling as G


def test_columns_equal_functions(spark):
    n = spark.range(1, 3000).withColumnRenamed("id", "n")
    for r in n.select("n", G.auto_cell_counts(F.col("n")).alias("c"), G.sobol_counts(F.col("n")).alias("s")).collect():
        assert (r["c"]["k"], r["c"]["p"]) == G.auto_cells(r["n"]) and r["s"] == G.initial_sobol_count(r["n"])
    assert spark.range(1).select(G.sobol_counts(F.col("id"))).first()[0] == G.initial_sobol_count(0) == 0
    found = {}
    for r in P.quota_rows(spark.range(0, 40).withColumnRenamed("id", "n"), "n").collect():
        found.setdefault(r["n"], {})[r["name"]] = r["children"]
    assert found == {k: P.quotas(k) for k in range(40)}


def test_region_keys(spark):
    sizes = spark.createDataFrame([(3, 0, 2)], "a long, b long, c long")
    assert [r[0] for r in G.region_key_rows(sizes).collect()] == G.region_keys({"a": [1.0, 2.0, 3.0], "b": [], "c": [0.0, 1.0]})
