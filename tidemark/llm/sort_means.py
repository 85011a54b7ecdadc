"""Centroid clustering by sort-means, in whole numbers.

Vectors become integer grids (floor(scale * x)), so distances, sums and means are exact and every rerun agrees. In
each round the other centroids are ordered by their distance from each centroid. A vector first measures the centroid
that it had, then the others in that one's order, and stops strictly beyond twice the distance to its own: by the
triangle inequality nothing farther out can be nearer, or as near. New centroids are the floors of the means.

A round is one pass that writes (vec_id, v, cluster) to the shared folder, which is where the next one finds each vector's
last centroid, and one aggregation of a row for each centroid; nothing is shuffled but partial sums. The driver holds the
centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, written
from tidemark.shared import removed

#: Integers at or above this give distances beyond a long; such vectors are refused.
MOST = 1 << 27
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def usable(embedding: Column, dims: int) -> Column:
    """Whether a vector has exactly dims components, none of them null or non-finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dims) & ~bad, F.lit(False))


def on_grid(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as array<int>; a component of MOST or more is an error, not a wrong distance."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) < MOST, y.cast("int")).otherwise(F.raise_error(F.concat(F.lit("component too large for exact distances: "), x.cast("string"))))

    return F.transform(embedding, whole)


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors (vec_id, v) of the k smallest lowercase-hex SHA-256 of `<seed>:<vec_id>`, in that order; all, if fewer."""
    spot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["v"]) for r in rows.where("vec_id IS NOT NULL").select("v", spot.alias("spot")).orderBy("spot", "v").limit(k).collect()]


def nearest(x: np.ndarray, was: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row of x, whose last clusters are `was`, and how many distances were measured.

    Ties go to the smaller number. All in 64-bit integers."""

    def apart(rows: np.ndarray, c: int) -> np.ndarray:
        d = x[rows] - centroids[c]
        return np.einsum("ij,ij->i", d, d)

    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    best, dist, measured = was.astype(np.int64), np.zeros(len(x), np.int64), len(x)
    for own in np.unique(best).tolist():
        at = np.flatnonzero(was == own)
        first = apart(at, own)
        dist[at] = first
        for other in np.argsort(between[own], kind="stable").tolist():
            if other == own:
                continue
            left = 4 * first >= between[own, other]  # twice the distance, squared
            at, first = at[left], first[left]
            if not len(at):
                break
            measured += len(at)
            d = apart(at, other)
            better = (d < dist[at]) | (d == dist[at]) & (other < best[at])
            best[at[better]], dist[at[better]] = other, d[better]
    return best, dist, measured


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The columns of rows with `cluster`, the last centroid's number, renewed and `distance` set; rows has v and cluster."""
    names = [c for c in rows.columns if c != "distance"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "distance") + ", distance long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            cluster, distance, _ = nearest(x, batch.column("cluster").to_numpy(), c)
            own = {n: batch.column(n) for n in names} | {"cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)}
            yield pa.RecordBatch.from_pydict(own)

    return rows.select(*names).mapInArrow(assign, schema)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of each cluster's mean; an empty cluster keeps its centroid. Sums are added up before the shuffle."""
    out = [list(c) for c in centroids]
    total = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(len(out[0]))])
    for r in total.collect():  # a row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(out[0]))]
    return out


def cluster(
    docs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(vec_id, the columns of `keep`, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row with a usable vector; distances are squared.

    Rows whose vector is null, has another number of components, or a null or non-finite one are left out. The first
    centroids are the vectors with the smallest hashes of their ids (`seeds`; a null id is clustered, but no seed; of rows alike in id
    the smaller vector comes first); fewer than k usable rows give as many centroids. `rounds` times vectors go to the nearest
    centroid and centroids to the floor of their means, then vectors are assigned once more. Rounds after one that moves no
    centroid change nothing and are not run. Repeated rows count as often as they stand. An empty table, or one without a
    usable vector that has an id, gives no row. Columns that are not in `keep` stay behind, whatever their names; one in `keep`
    must not be named like those added.
    """
    spark = docs.sparkSession
    if clash := {*keep} & {vec_id, *ADDED}:
        raise ValueError(f"keep holds names that the result has: {sorted(clash)}")
    names = [f"keep_{i}" for i in range(len(keep))]
    plain = docs.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("x"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    rows = plain.where(usable(F.col("x"), dims)).select("vec_id", on_grid(F.col("x"), scale).alias("v"), F.lit(0).alias("cluster"), *names)
    state = written(rows, last := shared_folder(spark))
    centroids = seeds(state, k, seed)
    if not centroids:
        state, centroids, rounds = state.limit(0), [[0] * dims], 0
    for _ in range(rounds):
        state = written(assigned(state, centroids).drop("distance"), folder := shared_folder(spark))
        removed(spark, last)
        last, before = folder, centroids
        centroids = moved(state, centroids)
        if centroids == before:
            break
    found = written(assigned(state, centroids).drop("v"))
    removed(spark, last)
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row a centroid
    of_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return found.select(
        F.col("vec_id").alias(vec_id),
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        "cluster",
        "distance",
        F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
