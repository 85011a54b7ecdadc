"""Queries on inputs that the smallest tables do not have, and what a task holds of large keys."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.session import table

DATA = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, places=2):
    """Rows of a query and of its SQL over a folder, sorted, doubles compared to so many places fewer than they are rounded to."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=str)
    got = sorted(([r[c] for c in columns] for r in catalog.QUERIES[name](spark, str(folder)).collect()), key=lambda r: str(tuple(r)))
    return got, [list(w) for w in want]


def test_round_trip_keeps_prices_without_a_logarithm(spark, tmp_path):
    e = table(spark, DATA, "events")
    odd = e.withColumn("value", F.when(F.col("event_id") % 40 == 0, 0.0).when(F.col("event_id") % 41 == 0, -3.5).otherwise(F.col("value")))
    odd.write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, tmp_path, "x17_coordinates_round_trip")
    assert any(r[4] <= 0 for r in want)
    assert got == want


def whole_key_windows(df, keys):
    """Windows over rows of a key as a whole: those of the plan that are partitioned by the keys and not by ranges of them."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line and "_range#" not in line and "_m#" not in line and "_last#" not in line]


def test_values_before_cross_ranges(spark):
    from tidemark.operators import ranking as K

    values = [("a", x) for x in (0.0, 0.5, 0.5, 1.1, 9.0, 9.0, 9.2, None, None)] + [(None, x) for x in (3.0, 3.7, 3.7)] + [("b", float(i) * 0.4) for i in range(50)]
    out = K.unique_within(spark.createDataFrame(values, "k string, v double"), ["k"], "v", 0.5)
    assert not whole_key_windows(out, ["k"])
    want = [("a", 0.0), ("a", 1.1), ("a", 9.0), ("a", None), ("a", None), (None, 3.0), (None, 3.7), ("b", 0.0)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_percentiles_are_exact_and_by_ranges(spark):
    from tidemark.operators import places
    from tidemark.operators import ranking as K

    rows = spark.range(500).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("k"), (F.pmod(F.col("id") * 37, F.lit(101)) / 3).alias("a"), F.lit(5.0).alias("p"))
    rows = rows.unionByName(spark.createDataFrame([("one", 2.0, 1.0), ("none", None, 1.0)], "k string, a double, p double"))
    out = K.error_metrics(rows, ["k"], "a", "p")
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    e = F.abs(F.col("a") - F.col("p"))
    want = {r.k: r for r in rows.groupBy("k").agg(F.avg(e).alias("mae"), F.percentile(e, F.lit(0.5)).alias("median_error"), F.percentile(e, F.lit(0.9)).alias("p90_error")).collect()}
    got = {r.k: r for r in out.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        for c in ("mae", "median_error", "p90_error"):
            assert r[c] == want[k][c] or abs(r[c] - want[k][c]) < 1e-9, (k, c)
    assert places.percentiles(rows, [], "a", {"m": 0.5}).collect()[0].m == rows.agg(F.percentile("a", F.lit(0.5))).first()[0]


def test_additive_model_keeps_no_rows(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *a: (_ for _ in ()).throw(AssertionError("rows are kept")))
    assert isinstance(catalog.QUERIES["l9_additive_model"](spark, DATA), DataFrame)


def test_folds_are_places_by_ranges(spark):
    from tidemark.operators import learning as L

    rows = spark.range(97).select((F.col("id") % 2).alias("k"), F.pmod(F.col("id") * 31, F.lit(97)).alias("at"))
    out = L.folds_of(rows, ["k"], "at", 10, 2, 3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # places are in a table
    got = sorted((r.k, r["at"], r.fold, r.part) for r in out.collect())
    want = []
    for k in (0, 1):
        ats = sorted(i * 31 % 97 for i in range(97) if i % 2 == k)
        block = (len(ats) - 12) // 3
        for f in range(3):
            start = 12 + f * block
            end = len(ats) if f == 2 else start + block
            want += [(k, x, f, "train" if i < start - 2 else "validation") for i, x in enumerate(ats) if i < start - 2 or start <= i < end]
    assert got == sorted(want)


def test_rounds_hold_rows_alike_once(spark, monkeypatch):
    from tidemark.operators import fits

    held = []
    true_nearest = fits.nearest
    monkeypatch.setattr(fits, "nearest", lambda rows, *a: held.append(rows.count()) or true_nearest(rows, *a))
    rows = spark.range(400).select(F.lit("a").alias("key"), (F.col("id") % 4).cast("double").alias("x"))
    got = {r.component: (r.n, r["mean"][0]) for r in fits.mixtures(rows, ["key"], ["x"], ["x"], F.array(F.lit(2)), 2).collect()}
    assert got == {0: (300, 1.0), 1: (100, 3.0)}  # starts are 1 and 3; 2 lies between and goes to the smaller number
    assert set(held) == {4}
