"""Samples of parameter grids: low-discrepancy sequences, plans of evaluations, seeded draws and shuffles.

A grid is a dict of axis name to (first, last) index. All sequences are functions of a row number, so any part
of one is made anywhere, in any order, and a longer one begins with a shorter one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import keyed_uniform, radical_inverse
from tidemark.operators.joins import full_grid

Grid = dict[str, tuple[int, int]]
BITS = 32
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71)

#: Degree, coefficients and first direction numbers of the sequence's dimensions after the first.
SOBOL = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 3, 5, 13)),
    (4, 4, (1, 1, 5, 5)),
    (5, 2, (1, 3, 3, 9, 7)),
    (5, 4, (1, 3, 7, 13, 3)),
    (5, 7, (1, 1, 5, 11, 27)),
    (5, 11, (1, 1, 7, 3, 29)),
    (5, 13, (1, 3, 7, 7, 21)),
    (5, 14, (1, 3, 1, 9, 23)),
    (6, 1, (1, 3, 3, 5, 19, 33)),
    (6, 13, (1, 1, 3, 13, 11, 7)),
    (6, 16, (1, 1, 7, 13, 25, 5)),
    (6, 19, (1, 3, 5, 11, 7, 11)),
    (6, 22, (1, 1, 1, 3, 13, 39)),
    (6, 25, (1, 3, 1, 15, 17, 63)),
    (6, 28, (1, 1, 5, 5, 1, 27)),
)


def directions(dimension: int) -> list[int]:
    """The direction numbers of a dimension (from 0), one for each bit of the index."""
    if dimension == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    degree, poly, first = SOBOL[dimension - 1]
    v = [m << (BITS - 1 - k) for k, m in enumerate(first)]
    for k in range(degree, BITS):
        x = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if poly >> (degree - 1 - j) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


def sobol(index: Column, dimension: int) -> Column:
    """The coordinate in [0, 1) of a point of the Sobol sequence, in Gray code order."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    x = F.lit(0).cast("long")
    for k, v in enumerate(directions(dimension)):
        x = x.bitwiseXOR(F.when(F.shiftright(gray, k).bitwiseAND(1) == 1, F.lit(v)).otherwise(F.lit(0)).cast("long"))
    return x / float(1 << BITS)


def initial_sobol_count(dimensions: int) -> int:
    """The least power of two that is 64 and 16 per dimension or more."""
    return 0 if dimensions < 1 else 1 << math.ceil(math.log2(max(64, 16 * dimensions)))


def sobol_counts(dimensions: Column) -> Column:
    """`initial_sobol_count` of a column."""
    least = F.greatest(F.lit(64).cast("long"), 16 * dimensions.cast("long"))
    return F.when(dimensions < 1, 0).otherwise(F.pow(F.lit(2.0), F.length(F.bin(least - 1))).cast("long"))


def combinations(grid: Grid, excluded: int = 0) -> int:
    """Number of points of a grid without the excluded ones, no more than an unsigned 64-bit number holds."""
    total = math.prod(b - a + 1 for a, b in grid.values())
    return min(total, (1 << 64) - 1) - (excluded if excluded < total else 0)


def axis_values(centre: float, low: float, high: float, step: float, radius: int, whole: bool = False) -> list[float]:
    """Values around a centre, within bounds, to eight digits; whole numbers if asked."""
    if whole:
        centre, low, high, step = round(centre), math.ceil(low), math.floor(high), max(1, round(step))
    found = [centre + k * step for k in range(-radius, radius + 1)]
    return sorted({round(x, 8) for x in found if low - 1e-9 <= x <= high + 1e-9})


def _on_grid(u: Column, span: tuple[int, int]) -> Column:
    width = span[1] - span[0] + 1
    return (F.least(F.floor(u * width), F.lit(width - 1)) + span[0]).cast("int")


def _first_of_each(rows: DataFrame, axes: list[str], order: str) -> DataFrame:
    return rows.groupBy(*axes).agg(F.min(order).alias(order))


def _fresh(rows: DataFrame, axes: list[str], *others: DataFrame | None) -> DataFrame:
    for o in others:
        if o is not None:
            rows = rows.join(o.select(*axes), axes, "left_anti")
    return rows


#: Grids up to this size are counted before points are drawn from them; beyond it, so many attempts are made at most.
COUNTED, MOST_TRIES = 1 << 24, 1 << 33


def _every_point(spark: SparkSession, grid: Grid) -> DataFrame:
    rows = spark.range(1)
    for a, (lo, hi) in grid.items():
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return rows.select(*grid)


def _refuse_too_few(spark: SparkSession, grid: Grid, count: int, legal: Column | None, *taken: DataFrame | None) -> None:
    """Raises where a grid that can be counted has fewer than `count` legal points besides those taken."""
    if combinations(grid) > COUNTED:
        return
    points = _every_point(spark, grid)
    there = _fresh(points if legal is None else points.where(legal), list(grid), *taken).count()
    if there < count:
        raise ValueError(f"{count} points are asked for, and there are {there}")


def _found(tries: Callable[[int], DataFrame], count: int, most: int = MOST_TRIES) -> DataFrame:
    """tries(n) for n large enough to find `count` rows; n doubles from twice the count, and more than `most` is an error."""
    n = 2 * max(count, 1)
    while True:
        rows = tries(n)
        there = rows.count()
        if there >= count:
            return rows
        if n >= most:
            raise ValueError(f"{there} of {count} points found in {n} attempts")
        n = min(2 * n, most)


def halton_sample(spark: SparkSession, grid: Grid, count: int, offset: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """(seq, axes): the first `count` different grid points of the Halton sequence after `offset`, without excluded ones.

    Twice as many indices are tried as are needed, then twice as many again, until there are enough; the range grows, not the job's
    state. A grid with too few points is refused."""
    axes = list(grid)
    if combinations(grid) < count:
        raise ValueError("the grid has fewer points than asked for")
    _refuse_too_few(spark, grid, count, None, excluded)

    def tries(n: int) -> DataFrame:
        seq = spark.range(offset + 1, offset + 1 + n).select(F.col("id").alias("seq"))
        points = seq.select("seq", *[_on_grid(radical_inverse(F.col("seq"), p), grid[a]).alias(a) for a, p in zip(axes, PRIMES)])
        return _fresh(_first_of_each(points, axes, "seq"), axes, excluded)

    return _found(tries, count).orderBy("seq").limit(count).select("seq", *axes)


def global_plan(spark: SparkSession, grid: Grid, base: dict[str, int], count: int, start: int = 0, existing: DataFrame | None = None, anchors: bool = True, legal: Column | None = None) -> DataFrame:
    """(axes, origin, origin_key, sobol_index): the base and the ends of each axis through it, then `count` new points of
    the Sobol sequence from `start` on, or the whole grid if that is no larger and start is 0. Points that exist, or are
    not legal, are left out; a point belongs to its first origin. A grid with fewer than `count` new legal points is refused."""
    axes = list(grid)
    kind = [f"{a} int" for a in axes]
    rows = []
    if anchors:
        rows.append((0, "baseline", "baseline", *[base[a] for a in axes]))
        for a in axes:
            for name, v in (("minimum", grid[a][0]), ("maximum", grid[a][1])):
                rows.append((len(rows), "axis_anchor", f"{a}:{name}", *[v if x == a else base[x] for x in axes]))
    fixed = spark.createDataFrame(rows, ", ".join(["rank long", "origin string", "origin_key string", *kind]))
    if legal is not None:
        fixed = fixed.where(legal)
    fixed = _fresh(fixed, axes, existing)
    fixed = fixed.groupBy(*axes).agg(F.min_by(F.struct("rank", "origin", "origin_key"), "rank").alias("o")).select(*axes, "o.rank", "o.origin", "o.origin_key", F.lit(None).cast("long").alias("sobol_index"))
    total = combinations(grid)
    if total <= count and start == 0:
        every = _every_point(spark, grid)
        more = every.select(*axes, F.lit(1 << 40).alias("rank"), F.lit("full_enumeration").alias("origin"), F.concat_ws(":", *axes).alias("origin_key"), F.lit(None).cast("long").alias("sobol_index"))
        more = _fresh(more.where(legal) if legal is not None else more, axes, existing, fixed)
        return fixed.unionByName(more).drop("rank")
    _refuse_too_few(spark, grid, count, legal, existing, fixed)

    def tries(n: int) -> DataFrame:
        index = spark.range(start, start + n).select(F.col("id").alias("sobol_index"))
        points = index.select("sobol_index", *[_on_grid(sobol(F.col("sobol_index"), k), grid[a]).alias(a) for k, a in enumerate(axes)])
        points = points.where(legal) if legal is not None else points
        return _fresh(_first_of_each(points, axes, "sobol_index"), axes, existing, fixed)

    found = _found(tries, count, (1 << BITS) - start)
    chosen = found.orderBy("sobol_index").limit(count)
    more = chosen.select(*axes, F.lit(1 << 40).alias("rank"), F.lit("sobol").alias("origin"), F.concat(F.lit("sobol:"), F.col("sobol_index")).alias("origin_key"), "sobol_index")
    return fixed.unionByName(more).drop("rank")


def local_plan(spark: SparkSession, grid: Grid, centre: dict[str, int], radius: int, existing: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(axes): the box around a centre within the grid, without what exists; refused if larger than `most`."""
    spans = {a: (max(lo, centre[a] - radius), min(hi, centre[a] + radius)) for a, (lo, hi) in grid.items()}
    if most is not None and combinations(spans) > most:
        raise ValueError("the box has more points than allowed")
    return _fresh(_every_point(spark, spans), list(grid), existing)


def discrete_sample(spark: SparkSession, grid: Grid, count: int, seed: int, excluded: DataFrame | None = None, legal: Column | None = None) -> DataFrame:
    """(attempt, axes): `count` different legal points drawn evenly; attempts are numbered, so more attempts only add points. A
    grid with too few legal points besides the excluded ones is refused."""
    axes = list(grid)
    _refuse_too_few(spark, grid, count, legal, excluded)

    def tries(n: int) -> DataFrame:
        rows = spark.range(n).select(F.col("id").alias("attempt"), *[_on_grid(keyed_uniform(F.lit(seed), F.col("id"), F.lit(a)), grid[a]).alias(a) for a in axes])
        rows = rows.where(legal) if legal is not None else rows
        return _fresh(_first_of_each(rows, axes, "attempt"), axes, excluded)

    return _found(tries, count).orderBy("attempt").limit(count).select("attempt", *axes)


def rejections(spark: SparkSession, grid: Grid, attempts: int, seed: int, legal: Column) -> DataFrame:
    """(reason, n): what becomes of the first so many attempts of discrete_sample: accepted, duplicate or structural_constraint."""
    axes = list(grid)
    rows = spark.range(attempts).select(F.col("id").alias("attempt"), *[_on_grid(keyed_uniform(F.lit(seed), F.col("id"), F.lit(a)), grid[a]).alias(a) for a in axes])
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*axes).orderBy("attempt")))
    reason = F.when(~legal, "structural_constraint").when(F.col("_k") > 1, "duplicate").otherwise("accepted")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shuffled(rows: DataFrame, keys: list[str], order: str, value: str, seed: int, sequences: int) -> DataFrame:
    """(keys, sequence, order, value): for each sequence the key's values in a seeded random order, the multiset unchanged."""
    each = rows.select(*keys, order, value).withColumn("sequence", F.explode(F.sequence(F.lit(0), F.lit(sequences - 1))))
    group = Window.partitionBy(*keys, "sequence")
    each = each.withColumns({"_at": F.row_number().over(group.orderBy(order)), "_to": F.row_number().over(group.orderBy(keyed_uniform(F.lit(seed), F.col("sequence"), F.col(order)), order))})
    moved = each.select(*keys, "sequence", F.col("_to").alias("_at"), F.col(value).alias("_v"))
    return each.select(*keys, "sequence", "_at", order).join(moved, [*keys, "sequence", "_at"]).select(*keys, "sequence", order, F.col("_v").alias(value))


def region_keys(thresholds: dict[str, list[float]]) -> list[str]:
    """All `name=bucket;...` keys of the regions that thresholds cut, the last name fastest."""
    keys = [""]
    for name, ts in thresholds.items():
        keys = [f"{k};{name}={b}" if k else f"{name}={b}" for k in keys for b in range(len(ts) + 1)]
    return keys


def auto_cells(n: int) -> tuple[int, int]:
    """Cells and places per cell for a search budget of n evaluations."""
    half_up = lambda x: int(math.floor(x + 0.5))
    k = max(1, half_up(math.sqrt(n)))
    return k, max(4, half_up(math.sqrt(n / k)))


def auto_cell_counts(n: Column) -> Column:
    """`auto_cells` of a column: a struct of cells and places per cell."""
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(n) + 0.5))
    return F.struct(k.alias("k"), F.greatest(F.lit(4).cast("long"), F.floor(F.sqrt(n / k) + 0.5)).alias("p"))


def region_key_rows(sizes: DataFrame) -> DataFrame:
    """(key): `region_keys` from one row that holds the number of thresholds of each name, a column a name."""
    names = sizes.columns
    buckets = full_grid(sizes.select(*[(F.col(n) + 1).alias(n) for n in names]), names)
    return buckets.select(F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names]).alias("key"))
