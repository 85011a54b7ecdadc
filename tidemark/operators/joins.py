"""Joins of ordered relations: as-of with availability, matched series, dominance, boxes, neighbours, lineage."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import written


def as_of(timeline: DataFrame, series: DataFrame, keys: list[str], time: str = "time_ms", available: str = "avail_ms", value: str = "value") -> DataFrame:
    """Each time of the timeline with the series' latest row that is not later and was available by then.

    Adds value, matched_ms and kind: aligned (a row of that very time, available), filled or missing.
    A union and one ordered window do it, without pairs. A row enters the window when both its time
    and its availability have passed; the latest by time among those entered is kept as a running
    maximum, so releases out of order are handled.
    """
    entry = F.greatest(F.col(time), F.col(available))
    right = series.select(*keys, entry.alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_row"), F.lit(None).cast("long").alias(time))
    left = timeline.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), F.col(time).cast("long").alias(time))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_at", "_side")
    best = F.max("_row").over(w)
    out = right.unionByName(left).withColumn("_best", best).where("_side = 1")
    kind = F.when(F.col("_best").isNull(), "missing").when(F.col("_best.t") == F.col(time), "aligned").otherwise("filled")
    return out.select(*keys, time, F.col("_best.v").alias(value), F.col("_best.t").alias("matched_ms"), kind.alias("kind"))


def alignment_summary(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """How many times are aligned (a value at hand), filled with an earlier one, or missing."""
    n = lambda c: F.count_if(c)
    return aligned.groupBy(*keys).agg(n(F.col("kind") != "missing").alias("aligned"), n(F.col("kind") == "missing").alias("missing"), n(F.col("kind") == "filled").alias("filled"))


def matched_changes(left: DataFrame, right: DataFrame, keys: list[str], time: str = "open_time_ms") -> DataFrame:
    """Inner join of two series on time, then each one's change between matched rows (0 in the first)."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    rows = left.select(*keys, time, F.col("nav").alias("left_nav")).join(right.select(*keys, time, F.col("nav").alias("right_nav")), [*keys, time])
    change = lambda c: F.coalesce(F.when(F.lag(c).over(w) > 0, F.try_divide(F.col(c), F.lag(c).over(w)) - 1), F.lit(0.0))
    return rows.withColumns({"left_change": change("left_nav"), "right_change": change("right_nav")})


def with_benchmark(path: DataFrame, benchmark: DataFrame, keys: list[str], time: str = "open_time_ms") -> DataFrame:
    """Left join of a path with a benchmark whose own returns are taken before the join."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    own = benchmark.select(*keys, time, F.col("nav").alias("benchmark_nav"), (F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1).alias("benchmark_return"))
    return path.join(own, [*keys, time], "left")


def box_neighbours(points: DataFrame, keys: list[str], axes: list[str], radius: int) -> DataFrame:
    """Pairs (point, neighbour) of a key at most `radius` apart on every axis, the point itself included.

    An equi-join on cells of side radius + 1: a point looks into its own cell and those around it."""
    side = radius + 1
    cell = [F.floor(F.col(a) / side).alias(f"_c{i}") for i, a in enumerate(axes)]
    right = points.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes], *[F.col(c).alias(f"n_{c}") for c in points.columns if c not in keys and c not in axes], *cell)
    left = points.select("*", *cell)
    for i in range(len(axes)):
        left = left.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + d for d in (-1, 0, 1)])))
    both = left.join(right, [*keys, *[f"_c{i}" for i in range(len(axes))]])
    close = reduce(lambda x, y: x & y, [F.abs(F.col(a) - F.col(f"n_{a}")) <= radius for a in axes])
    return both.where(close).drop(*[f"_c{i}" for i in range(len(axes))])


def axis_neighbours(points: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Pairs of points one step apart on exactly one axis, by exploded neighbour keys."""
    steps = [F.struct(*[(F.col(a) + (d if a == moved else 0)).alias(a) for a in axes]) for moved in axes for d in (-1, 1)]
    moved = points.select(*keys, *axes, F.explode(F.array(*steps)).alias("_to"))
    other = points.select(*keys, *[F.col(a).alias(f"n_{a}") for a in axes])
    left = moved.select(*keys, *axes, *[F.col(f"_to.{a}").alias(f"n_{a}") for a in axes])
    return left.join(other, [*keys, *[f"n_{a}" for a in axes]])


def full_grid(sizes: DataFrame, axes: list[str]) -> DataFrame:
    """Every coordinate of a grid whose one row holds the number of values per axis; the last axis varies fastest."""
    out = sizes
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(a) - 1)))
    return out


def missing_coordinates(grid: DataFrame, observed: DataFrame, axes: list[str]) -> DataFrame:
    return grid.join(observed.select(*axes).distinct(), axes, "left_anti")


def nearest_centre(points: DataFrame, centres: DataFrame, vector: str, cell: str, most_centres: int = 4096) -> DataFrame:
    """Adds cell and distance (Euclidean): the nearest centre, the smallest cell on a tie.

    Centres travel with the tasks only if there are at most `most_centres`; beyond, this is refused.
    """
    found = centres.select(F.col(cell).alias("cell"), F.col(vector).alias("c")).limit(most_centres + 1).collect()
    if len(found) > most_centres:
        raise ValueError("too many centres to assign at once")
    listed = F.array(*[F.struct(F.lit(r.cell).alias("cell"), F.array(*map(F.lit, r.c)).alias("c")) for r in found])
    distance = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector), c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform(listed, lambda c: F.struct(distance(c).alias("d"), c["cell"].alias("cell"))))
    return points.withColumn("_b", best).withColumns({"cell": F.col("_b.cell"), "distance": F.col("_b.d")}).drop("_b")


def paired_differences(points: DataFrame, left: str, right: str, config: str, key: str, values: list[str]) -> DataFrame:
    """left minus right of two configurations on the points that both have."""
    a = points.where(F.col(config) == left).select(key, *[F.col(v).alias(f"l_{v}") for v in values])
    b = points.where(F.col(config) == right).select(key, *[F.col(v).alias(f"r_{v}") for v in values])
    return a.join(b, key).select(key, *[(F.col(f"l_{v}") - F.col(f"r_{v}")).alias(v) for v in values])


def missing_by_configuration(points: DataFrame, config: str, key: str, most: int = 100_000) -> DataFrame:
    """For each configuration the keys that others have and it lacks.

    A key's configurations are gathered and taken from the list of all, so the only rows made are those of the result. That list goes to
    every task: more than `most` configurations are refused. Null configurations are left out; a null key is a key.
    """
    own = points.where(F.col(config).isNotNull()).groupBy(key).agg(F.collect_set(config).alias("_own"))
    every = points.agg(F.array_sort(F.collect_set(config)).alias("_all"))
    n = every.select(F.size("_all")).first()[0]
    if n > most:
        raise ValueError(f"{n} configurations, {most} are allowed")
    return own.crossJoin(F.broadcast(every)).select(F.explode(F.array_except("_all", "_own")).alias(config), key)  # one row


def ancestors(edges: DataFrame, roots: DataFrame, child: str, parent: str, most_steps: int | None = None) -> DataFrame:
    """(node, depth): all transitive parents of the roots, with the smallest depth.

    Steps double: in round i the nodes known so far take hops of 2^i parents, and two such hops make one of the next
    round, so a chain of n parents takes about log2(n) rounds. A round that finds no new node is the last, cycles or not.
    Parents more than most_steps away, where that is given, are refused, not left out."""
    hops = written(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    seen = written(roots.select(F.col(child).alias("node")).distinct().withColumn("depth", F.lit(0)))
    known = seen.count()
    for i in count():
        far = seen.join(hops, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("depth") + (1 << i)).alias("depth"))
        seen = written(seen.unionByName(far).groupBy("node").agg(F.min("depth").alias("depth")))
        now = seen.count()
        if now == known:
            break
        known = now
        second = hops.select(F.col("a").alias("b"), F.col("b").alias("c"))
        hops = written(hops.join(second, "b").select("a", F.col("c").alias("b")).distinct())
    if most_steps is not None and seen.where(F.col("depth") > most_steps).take(1):
        raise ValueError(f"ancestors farther than {most_steps} steps")
    return seen.where("depth > 0")


#: Vectors of a block of `nearest_in_cell`, about; a task holds two blocks and STRIP rows of their distances.
BLOCK, STRIP = 4096, 512


def _matrix(part: pa.Table) -> np.ndarray:
    return part.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distance of rows i of a from rows j of b, one by one."""
    out, step = np.empty(len(i)), max(1, (1 << 21) // max(1, a.shape[1]))
    for lo in range(0, len(i), step):
        gap = a[i[lo : lo + step]] - b[j[lo : lo + step]]
        out[lo : lo + step] = np.sqrt((gap * gap).sum(1))
    return out


def _nearest_of(a: np.ndarray, b: np.ndarray, ids_a: np.ma.MaskedArray, ids_b: np.ma.MaskedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distance of each row of a from the nearest of b and the reverse, rows of one id aside, and whether there was any. A masked id is equal to none.

    Products only tell which pairs may be nearest, within the error that they can have; those pairs are measured by their differences. Rows
    that are not finite, or too large for products, are measured against all. NaN is the farthest."""
    with np.errstate(all="ignore"):
        na, nb = (a * a).sum(1), (b * b).sum(1)
        calm_a, calm_b = na < 1e300, nb < 1e300
        near_a, near_b = np.full(len(a), np.nan), np.full(len(b), np.nan)
        any_a, any_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        slack = 8 * (a.shape[1] + 4) * np.finfo(np.float64).eps
        least_b, largest = np.full(len(b), np.inf), nb[calm_b].max(initial=0.0)
        for lo in range(0, len(a), STRIP):
            at = slice(lo, lo + STRIP)
            other = (ids_a.data[at, None] != ids_b.data[None, :]) | ids_a.mask[at, None] | ids_b.mask[None, :]
            any_a[at], any_b = other.any(1), any_b | other.any(0)
            calm = other & calm_a[at, None] & calm_b[None, :]
            far = np.where(calm, na[at, None] + nb[None, :] - 2 * (a[at] @ b.T), np.inf)
            least_b = np.minimum(least_b, far.min(0, initial=np.inf))
            error_a, error_b = slack * (na[at] + largest), slack * (nb + na[at][calm_a[at]].max(initial=0.0))
            asked = (far <= (far.min(1, initial=np.inf) + 2 * error_a)[:, None]) | (far <= (least_b + 2 * error_b)[None, :])
            i, j = np.nonzero((asked & calm) | (other & ~calm))
            d = _exact(a, b, i + lo, j)
            np.fmin.at(near_a, i + lo, d)
            np.fmin.at(near_b, j, d)
    return near_a, near_b, any_a, any_b


def _block_pair(left: pa.Table, right: pa.Table) -> pa.Table:
    """(_i, _far) of the vectors of two blocks against each other; without a right block, of one against itself."""
    out = []
    if left.num_rows:
        one = not right.num_rows
        right = left if one else right
        ids = [np.ma.array(t.column("_n").fill_null(0).to_numpy(), mask=t.column("_n").is_null().to_numpy()) for t in (left, right)]
        near = _nearest_of(_matrix(left), _matrix(right), *ids)
        for part, d, there in zip((left, right)[: 1 if one else 2], near[:2], near[2:]):
            out.append(pa.table({"_n": part.column("_n"), "_far": pa.array(d, pa.float64())}).filter(pa.array(there)))
    return pa.concat_tables(out) if out else pa.table({"_n": pa.array([], pa.int64()), "_far": pa.array([], pa.float64())})


def nearest_in_cell(rows: DataFrame, cell: str, id_: str, vector: str) -> DataFrame:
    """(id_, nearest): the Euclidean distance of each row's vector from the nearest of its cell with another id (a whole number).

    Rows alone in their cell have none. Vectors with a null, or of another length, have no distance; NaN is the farthest. Copies are one
    vector: a vector that several ids have is at 0. The others are dealt to blocks, and each pair of a cell's blocks is a group, so a
    task holds two blocks whatever the cell; all pairs of different vectors are looked at, so the work is their square."""
    e = rows.select(F.col(cell).alias("_c"), F.col(id_).cast("long").alias("_n"), F.col(vector).alias("_v")).where("_c IS NOT NULL AND _n IS NOT NULL")
    cells = e.groupBy("_c").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).where("_lo != _hi")
    nothing = e.join(cells, "_c", "left_semi").select("_n", F.lit(None).cast("double").alias("_far"))
    whole = e.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
    finite = F.forall("_v", lambda x: F.abs(x) < float("inf"))
    kinds = whole.groupBy("_c", "_v", F.when(~finite, F.col("_n")).alias("_own")).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    kinds = written(kinds)
    copied = kinds.where("_lo != _hi").select(F.col("_c").alias("_cell"), F.col("_v").alias("_w"))
    zero = whole.join(copied, (F.col("_c") == F.col("_cell")) & (F.col("_v") == F.col("_w")), "left_semi").select("_n", F.lit(0.0).alias("_far"))
    # a vector that has several ids stands for one that no id is equal to
    kinds = kinds.select("_c", F.size("_v").alias("_d"), "_v", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_n"))
    count = kinds.groupBy("_c", "_d").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    count = count.select(F.col("_c").alias("_cell"), F.col("_d").alias("_size"), "_blocks")
    dealt = kinds.join(count, (F.col("_c") == F.col("_cell")) & (F.col("_d") == F.col("_size"))).withColumn("_b", F.pmod(F.xxhash64("_v", "_n"), F.col("_blocks")).cast("int"))
    left = dealt.select("_c", "_d", "_b", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_o"), "_n", "_v")
    right = dealt.where("_b > 0").select("_c", "_d", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_b"), F.col("_b").alias("_o"), "_n", "_v")
    right = right.toDF("_cell", "_size", "_first", "_second", "_n", "_v")
    met = left.groupBy("_c", "_d", "_b", "_o").cogroup(right.groupBy("_cell", "_size", "_first", "_second")).applyInArrow(_block_pair, "_n long, _far double")
    found = nothing.unionByName(zero).unionByName(met.where("_n IS NOT NULL"))
    return found.groupBy(F.col("_n").alias(id_)).agg(F.min("_far").alias("nearest"))
