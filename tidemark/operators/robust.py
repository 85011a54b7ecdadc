"""Robustness of points on a parameter grid: tolerance, depth, boxes, medoids, frontier, centres, roles.

A point is qualified, unqualified or unknown. Walks along an axis are windows over the line, not loops:
the next row that is not qualified ends the walk and says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import box_radius, grid_components, neighbourhood_objectives
from tidemark.operators.joins import axis_neighbours
from tidemark.operators.skyline import pareto
from tidemark.shared import removed, shared_folder, written

EPS = 1e-12
#: Rounds of medoid costs in one job, and the points they are worked out for at most.
CHAIN = 4
MOST_POINTS = 1 << 20
Bounds = dict[str, tuple[int, int, bool, bool]]


def filled(points: DataFrame, bounds: Bounds, keys: list[str] | None = None) -> DataFrame:
    """The whole grid of bounds (axis: first, last, whether each end is a legal limit) with the state of each point."""
    axes = list(bounds)
    every = points.select(*(keys or [])).distinct() if keys else points.sparkSession.range(1).drop("id")
    for a, (lo, hi, _, _) in bounds.items():
        every = every.withColumn(a, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return every.join(points, [*(keys or []), *axes], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))


def tolerance(points: DataFrame, bounds: Bounds, keys: list[str] | None = None) -> DataFrame:
    """(keys, axes, axis, direction, steps, stop) for each qualified point: how many qualified points follow, and what
    comes then: observed_failure, unknown_gap, legal_boundary or research_boundary."""
    grid, axes, keys = filled(points, bounds, keys), list(bounds), keys or []
    out = None
    for a, (lo, hi, legal_lo, legal_hi) in bounds.items():
        line = Window.partitionBy(*keys, *[x for x in axes if x != a], F.lit(0))
        stop = F.when(F.col("state") != "qualified", F.struct(F.col(a).alias("at"), F.col("state").alias("state")))
        for name, order, end, legal, step in (("up", F.col(a).asc(), hi + 1, legal_hi, 1), ("down", F.col(a).desc(), lo - 1, legal_lo, -1)):
            ahead = F.first(stop, ignorenulls=True).over(line.orderBy(order).rowsBetween(1, Window.unboundedFollowing))
            at = F.coalesce(ahead["at"], F.lit(end))
            why = F.when(ahead["state"] == "unqualified", "observed_failure").when(ahead["state"] == "unknown", "unknown_gap").otherwise("legal_boundary" if legal else "research_boundary")
            one = grid.select(*keys, *axes, "state", F.lit(a).alias("axis"), F.lit(name).alias("direction"), ((at - F.col(a)) * step - 1).cast("int").alias("steps"), why.alias("stop")).where("state = 'qualified'").drop("state")
            out = one if out is None else out.unionByName(one)
    return out


def point_geometry(points: DataFrame, bounds: Bounds, metric: str, keys: list[str] | None = None, radii: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each qualified point: depth of the nearest observed failure along an axis (0 if none), box radius, neighbourhood
    quality (mean share over the radii), stability and dispersion, and completeness: formal_bilateral, formal_unilateral
    (a walk ends at a legal limit) or provisional (one ends at the study's edge or in the unknown)."""
    keys, axes = keys or [], list(bounds)
    at = [*keys, *axes]
    walks = tolerance(points, bounds, keys).groupBy(*at).agg(
        F.coalesce(F.min(F.when(F.col("stop") == "observed_failure", F.col("steps") + 1)), F.lit(0)).alias("depth"),
        F.max(F.col("stop").isin("research_boundary", "unknown_gap")).alias("_cut"),
        F.max(F.col("stop") == "legal_boundary").alias("_legal"),
    )
    known = points.where("state != 'unknown'").withColumn("qualified", F.col("state") == "qualified")
    near = neighbourhood_objectives(known, keys, axes, ["qualified"], radii)
    quality = sum((F.col(f"qualified_{r}") for r in radii), F.lit(0.0)) / len(radii)
    near = near.select(*at, quality.alias("quality"), "stability")
    from tidemark.operators.joins import box_neighbours

    spread = None
    for r in radii:
        one = box_neighbours(known.select(*at, metric), keys, axes, r).select(*at, F.col(f"n_{metric}").alias("_v"))
        spread = one if spread is None else spread.unionByName(one)
    spread = spread.groupBy(*at).agg(F.stddev_pop("_v").alias("dispersion"))
    box = box_radius(known.select(*at, "qualified"), keys, axes, "qualified", max(radii))
    done = F.when(F.col("_cut"), "provisional").when(F.col("_legal"), "formal_unilateral").otherwise("formal_bilateral")
    return walks.join(near, at).join(spread, at).join(box, at).withColumn("completeness", done).drop("_cut", "_legal")


def medoid_costs(points: DataFrame, axes: list[str], most_rounds: int | None = None, most_points: int = MOST_POINTS) -> DataFrame:
    """(axes, cost): the sum of step distances from each point to all it reaches by single steps on qualified points.

    Points are numbered, and a row holds which of 64 starts have reached a point: a round sends what came in the last one to the neighbours, where it is
    joined bit by bit, and adds the round's number for each start that is new. Distances are the same both ways, so what a point adds up is its
    own cost. The rows are at most a sixty-fourth of the pairs of points that reach each other, are replaced in each round, and CHAIN rounds are one job.
    More than most_points points, and distances over most_rounds, where that is given, are refused, not left out. Repeated points are one; a point with a
    null coordinate reaches none."""
    spark = points.sparkSession
    numbered = points.select(*axes).distinct().withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*axes)) - 1)  # most_points rows at most
    numbered = written(numbered, ids := shared_folder(spark))
    n = numbered.count()
    if n > most_points:
        removed(spark, ids)
        raise ValueError(f"{n} points, {most_points} are allowed")
    to = numbered.select(*[F.col(a).alias(f"n_{a}") for a in axes], F.col("_p").alias("_q"))
    steps = axis_neighbours(numbered.select(*axes), [], axes).join(numbered, axes).join(to, [f"n_{a}" for a in axes]).select("_p", "_q")
    steps = written(steps, edges := shared_folder(spark))
    own = F.expr("shiftleft(1L, cast(_p % 64 as int))")
    state = written(numbered.select("_p", F.floor(F.col("_p") / 64).alias("_b"), own.alias("_seen"), own.alias("_new"), F.lit(0).cast("long").alias("_cost")), last := shared_folder(spark))
    nought, done = F.lit(0).cast("long"), 0
    while True:
        chain = CHAIN if most_rounds is None else min(CHAIN, most_rounds + 1 - done)
        for d in range(done + 1, done + chain + 1):
            came = state.where("_new <> 0").join(steps, "_p").groupBy(F.col("_q").alias("_p"), "_b").agg(F.bit_or("_new").alias("_came"))
            state = state.join(came, ["_p", "_b"], "full_outer")
            state = state.withColumn("_seen", F.coalesce("_seen", nought)).withColumn("_new", F.coalesce("_came", nought).bitwiseAND(F.bitwise_not("_seen")))
            state = state.select("_p", "_b", F.col("_seen").bitwiseOR(F.col("_new")).alias("_seen"), "_new", (F.coalesce("_cost", nought) + d * F.bit_count("_new")).alias("_cost"))
        state = written(state, folder := shared_folder(spark))
        removed(spark, last)
        last, done = folder, done + chain
        if state.where("_new <> 0").isEmpty():
            break
        if most_rounds is not None and done > most_rounds:
            for f in (ids, edges, last):
                removed(spark, f)
            raise ValueError(f"points farther than {most_rounds} steps")
    removed(spark, edges)
    return state.groupBy("_p").agg(F.sum("_cost").alias("cost")).join(numbered, "_p").select(*axes, "cost")


def tied_best(rows: DataFrame, group: list[str], value: str, second: str, third: str) -> DataFrame:
    """Rows of the largest value (to 1e-12), among those of the largest second and then third."""
    out = rows
    w = Window.partitionBy(*(group or [F.lit(0)]))
    for c in (value, second, third):
        out = out.withColumn("_m", F.max(c).over(w)).where(F.abs(F.col(c) - F.col("_m")) <= EPS).drop("_m")
    return out


def centres(frontier: DataFrame, group: str) -> DataFrame:
    """Of each group's frontier the most complete kind, then the largest box, the greatest depth and the smallest medoid cost,
    then what no other beats in both objectives."""
    rank = F.when(F.col("completeness") == "formal_bilateral", 2).when(F.col("completeness") == "formal_unilateral", 1).otherwise(0)
    out = frontier
    for c in (rank, F.col("radius"), F.col("depth"), -F.col("cost")):
        out = out.withColumn("_c", c)
        out = out.withColumn("_m", F.max("_c").over(Window.partitionBy(group))).where("_c = _m").drop("_c", "_m")
    return pareto(out, [group], ["log_ratio", "log_residual"], "id")


def analyse(points: DataFrame, bounds: Bounds) -> DataFrame:
    """(region, id, roles, provisional): the proposals of each connected region of qualified points.

    points: id, the axes, state, log_ratio, log_residual, composite. A region's frontier is what no other point dominates in the two
    ratios, box, quality, stability and (least) dispersion, where a provisional point does not dominate a formal one; its roles
    are robust_center, return_leader, drawdown_leader and composite_leader."""
    axes = list(bounds)
    geometry = point_geometry(points, bounds, "log_ratio")
    good = points.where("state = 'qualified'")
    node = F.xxhash64(*axes)
    region = grid_components(good, axes, node).withColumnRenamed("component", "region")
    rows = good.join(geometry, axes).join(region, axes).join(medoid_costs(good, axes), axes).withColumn("_calm", -F.col("dispersion"))
    front = pareto(rows, ["region"], ["log_ratio", "log_residual", "radius", "quality", "stability", "_calm"], "id", EPS, F.col("completeness") != "provisional")
    front = written(front)
    roles = [
        (centres(front, "region"), "robust_center"),
        (tied_best(front, ["region"], "log_ratio", "log_residual", "radius"), "return_leader"),
        (tied_best(front, ["region"], "log_residual", "log_ratio", "radius"), "drawdown_leader"),
        (tied_best(front, ["region"], "composite", "radius", "radius"), "composite_leader"),
    ]
    named = None
    for found, role in roles:
        one = found.select("region", "id", "completeness", F.lit(role).alias("role"))
        named = one if named is None else named.unionByName(one)
    return named.groupBy("region", "id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.max(F.col("completeness") == "provisional").alias("provisional"))
