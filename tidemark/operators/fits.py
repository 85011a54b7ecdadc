"""Models by key without the driver: linear solves, cells and mixtures as tables that rows are joined with.

Sums of products are added up before the shuffle and solved within the key's own row, by elimination on arrays, so a million
keys are a million rows and no plan grows with them. Cells are k-means rounds: rows meet their key's centres, one aggregation gives the
new ones. The centres are a row a key; they are written to the shared folder every few rounds, which cuts their lineage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.wrapping import bound
from tidemark.operators import places
from tidemark.shared import removed, shared_folder, written

#: Rounds of k-means in one job.
CHAIN = 4
#: Centres that move less, relative to their size, stand: the order of a sum shows no more than this.
STILL = 1e-12
#: Rounds of coordinate descent in one job; coefficients that move less in a round, relative to their size, stand; a spread of 0 in doubles.
SWEEPS = 100
STILL_FIT = 1e-11
FLAT = 1e-14


def solved(matrix: Column, n: int) -> Column:
    """The solutions of n equations, from an n x (n + k) augmented matrix (array of arrays): an n x k array, null where a pivot is below 1e-12.

    Gauss-Jordan elimination with the largest pivot of each column, the first of equals."""

    def eliminate(m: Column, p: Column) -> Column:
        sized = F.transform(F.sequence(p, F.lit(n - 1)), lambda r: F.struct(F.abs(m[r][p]).alias("v"), (-r).alias("r")))

        def with_best(best: Column) -> Column:
            at = -best["r"]
            pivot = F.transform(m[at], lambda x: x / m[at][p])

            def with_pivot(row: Column) -> Column:
                def rest(x: Column, i: Column) -> Column:
                    return F.when(i == p, row).otherwise(bound(F.when(i == at, m[p]).otherwise(x), lambda own: F.zip_with(own, row, lambda a, b: a - own[p] * b)))

                return F.transform(m, rest)

            return F.when(best["v"] >= 1e-12, bound(pivot, with_pivot))

        return F.when(m.isNotNull(), bound(F.array_max(sized), with_best))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, eliminate)
    return F.transform(done, lambda row: F.slice(row, n + 1, F.size(row) - n))


def least_squares(rows: DataFrame, keys: list[str], x: list[str], y: list[str], ridge: float = 1e-9) -> DataFrame:
    """(keys, n, one array of 1 + len(x) coefficients for each of y, the constant first): the least-squares fit of each key's rows.

    Rows with a null among x and y are left out. `ridge` is added to the diagonal; a key whose system is singular all the same has null
    coefficients."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    n = len(columns)
    there = rows.dropna(subset=[*x, *y])
    sums = [F.sum(columns[i] * columns[j]).alias(f"_x{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(columns[i] * F.col(c)).alias(f"_y{i}_{k}") for i in range(n) for k, c in enumerate(y)]
    per = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    matrix = F.array(*[F.array(*[F.col(f"_x{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for j in range(n)], *[F.col(f"_y{i}_{k}") for k in range(len(y))]) for i in range(n)])
    found = per.where("n > 0").withColumn("_s", solved(matrix, n))
    column = lambda k: F.transform("_s", lambda row: row[k])
    return found.select(*keys, "n", *[column(k).alias(c) for k, c in enumerate(y)])


def _sweep(w: Column, products: Column, targets: Column, l1: float, l2: float, n: int) -> Column:
    """One round of coordinate descent: each coefficient in turn takes its best value given the others."""

    def turn(w: Column, j: Column) -> Column:
        def at(row: Column) -> Column:
            rest = targets[j] - F.aggregate(F.zip_with(row, w, lambda g, v: g * v), F.lit(0.0), lambda s, x: s + x) + row[j] * w[j]
            cut = F.signum(rest) * F.greatest(F.abs(rest) - l1, F.lit(0.0))
            return F.transform(w, lambda v, i: F.when(i != j, v).when(row[j] + l2 > FLAT, cut / (row[j] + l2)).otherwise(0.0))

        return bound(products[j], at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), w, turn)


def sparse_least_squares(rows: DataFrame, keys: list[str], x: list[str], y: str, l1: float, l2: float = 0.0) -> DataFrame:
    """(keys, n, y: array of 1 + len(x) coefficients, the constant first): the fit of each key's rows that minimises half the mean squared error
    plus l1 times the sum of the coefficients' sizes plus l2 / 2 times that of their squares; the constant is free of both.

    Rows are read once, for sums of products about the means; descent by coordinates with soft thresholds then runs in each key's own row until
    no coefficient moves by more than STILL_FIT of its size, in jobs of SWEEPS rounds over the keys that are still moving. A column without spread has
    the coefficient 0. Rows with a null or a value that is no finite number are left out; a key without rows has no model."""
    if l1 < 0 or l2 < 0:
        raise ValueError("penalties are 0 or more")
    spark, m = rows.sparkSession, len(x)
    columns = [F.col(c).cast("double") for c in [*x, y]]
    there = rows.where(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in [*x, y]))
    means = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)]
    spread = [F.covar_pop(columns[i], columns[j]).alias(f"_c{i}_{j}") for i in range(m) for j in range(i, m + 1)]
    per = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *means, *spread).where("n > 0")
    products = F.array(*[F.array(*[F.col(f"_c{min(i, j)}_{max(i, j)}") for j in range(m)]) for i in range(m)])
    sums = per.select(*keys, "n", F.array(*[f"_m{i}" for i in range(m + 1)]).alias("_m"), products.alias("_g"), F.array(*[f"_c{i}_{m}" for i in range(m)]).alias("_t"))
    moving = written(sums.withColumn("_w", F.array_repeat(F.lit(0.0), m)), last := shared_folder(spark))
    done: DataFrame | None = None
    step = lambda w: _sweep(w, F.col("_g"), F.col("_t"), l1, l2, m)
    while True:
        turned = moving.withColumn("_w", F.aggregate(F.sequence(F.lit(2), F.lit(SWEEPS)), F.col("_w"), lambda w, _: step(w))).withColumn("_next", step(F.col("_w")))
        moved = F.exists(F.zip_with("_w", "_next", lambda a, b: F.abs(a - b) > STILL_FIT * (1 + F.abs(b))), lambda z: z)
        turned = written(turned.withColumns({"_moved": moved, "_w": F.col("_next")}).drop("_next"), folder := shared_folder(spark))
        removed(spark, last)
        settled = turned.where("NOT _moved").drop("_moved")
        done = settled if done is None else done.unionByName(settled)
        last, moving = f"{folder}-moving", turned.where("_moved").drop("_moved")
        if moving.limit(1).isEmpty():
            break
        moving = written(moving, last)
    constant = F.col("_m")[m] - F.aggregate(F.zip_with("_w", F.slice("_m", 1, m), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return done.select(*keys, "n", F.concat(F.array(constant), "_w").alias(y))


def line(coefficients: Column | str, x: list[str]) -> Column:
    """The constant plus the weighted sum of x."""
    c = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    return sum((c[i + 1] * F.col(v) for i, v in enumerate(x)), c[0])


def met(rows: DataFrame, models: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Rows beside their key's model; null keys are keys. Spark broadcasts the models where they are small enough."""
    if not keys:
        return rows.crossJoin(models)  # one row
    named = models.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [rows[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]
    return rows.join(named, on, how).drop(*[f"_key_{k}" for k in keys])


def predicted(rows: DataFrame, models: DataFrame, keys: list[str], x: list[str], response: str, to: str) -> DataFrame:
    """Adds the fitted value of a response for each row's key; null for a key without a model."""
    return met(rows, models.select(*keys, F.col(response).alias("_c")), keys).withColumn(to, line("_c", x)).drop("_c")


def starts(rows: DataFrame, keys: list[str], values: list[str], order: list[str], k: Column | int) -> DataFrame:
    """(keys, _c): the values at places floor((2i + 1) n / 2k) of each key's rows in order, i from 0. `order` tells all rows of a key apart, or equal rows apart from others."""
    k = F.lit(k) if isinstance(k, int) else k
    named = list(dict.fromkeys([*keys, *values, *order]))
    return _at_places(places.placed(rows.select(*named, k.alias("_k")), keys, order), keys, values)


def _at_places(at: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """`starts` of rows with their places _i among _n, and _k."""
    # place i is the last whose floor is not above the row's own; several i may share a row
    shares = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.floor((2 * i + 1) * F.col("_n") / (2 * F.col("_k"))) == F.col("_i"))
    some = at.select(*keys, F.explode(shares).alias("_p"), F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))
    return some.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias("_c"))


def nearest(rows: DataFrame, keys: list[str], values: list[str], centres: DataFrame, to: str = "component") -> DataFrame:
    """Adds the number of the nearest of the key's centres (squared distance; ties: the smaller number), and _c, the centres."""
    here = F.array(*[F.col(v).cast("double") for v in values])
    away = lambda c: F.aggregate(F.zip_with(here, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    best = F.array_min(F.transform("_c", lambda c, i: F.struct(away(c).alias("d"), i.alias("i"))))["i"]
    return met(rows, centres, keys, "inner").withColumn(to, best)


def cells(rows: DataFrame, keys: list[str], values: list[str], centres: DataFrame, k: int, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """The centres (keys, _c; k at most) after k-means over each key's rows, an empty cell keeping its centre.

    Until none moves by more than STILL of its size, or `rounds` times where that is given. Rows alike are one row of a weight in the rounds;
    `weight` names their number where rows are counted already."""
    spark, done = rows.sparkSession, 0
    counted = rows.select(*keys, *values, F.col(weight).alias("_w")) if weight else rows.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_w"))
    rows = written(counted, narrow := shared_folder(spark))
    state = written(centres.select(*keys, "_c"), last := shared_folder(spark))
    while rounds is None or done < rounds:
        steps = CHAIN if rounds is None else min(CHAIN, rounds - done)
        for _ in range(steps):
            placed = nearest(rows, keys, values, state)
            at = lambda i, v: F.when((F.col("component") == i) & F.col(v).isNotNull(), F.col("_w"))
            means = [F.array(*[F.sum(at(i, v) * F.col(v)) / F.sum(at(i, v)) for v in values]).alias(f"_m{i}") for i in range(k)]
            now = F.filter(F.array(*[F.when(F.size("_was") > i, F.when(F.col(f"_m{i}")[0].isNotNull(), F.col(f"_m{i}")).otherwise(F.get("_was", F.lit(i)))) for i in range(k)]), lambda c: c.isNotNull())
            state = placed.groupBy(*keys).agg(F.any_value("_c").alias("_was"), *means).withColumn("_c", now).select(*keys, "_was", "_c")
        moved = F.exists(F.zip_with("_was", "_c", lambda a, b: F.exists(F.zip_with(a, b, lambda p, q: F.abs(p - q) > STILL * (1 + F.abs(q))), lambda x: x)), lambda x: x)
        table = written(state.select(*keys, "_c", moved.alias("_moved")), folder := shared_folder(spark))
        removed(spark, last)
        last, done, state = folder, done + steps, table.select(*keys, "_c")
        if table.where("_moved").limit(1).isEmpty():
            break
    removed(spark, narrow)
    return state


def _moments(placed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, component, n, weight, mean, variance, cov) of rows of weight _w placed in components beside their centres _c.

    Sums are of the distances from the centre, which is about the mean, so nothing cancels."""
    gap = [F.col(v) - F.get("_c", F.col("component"))[i] for i, v in enumerate(values)]
    w, m = F.col("_w"), len(values)
    sums = [F.sum(w * gap[i]).alias(f"_s{i}") for i in range(m)] + [F.sum(w * gap[i] * gap[j]).alias(f"_s{i}_{j}") for i in range(m) for j in range(i, m)]
    per = placed.groupBy(*keys, "component").agg(F.sum("_w").alias("n"), *[F.min(F.get("_c", F.col("component"))[i]).alias(f"_at{i}") for i in range(m)], *sums)
    joint = lambda i, j: (F.col(f"_s{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    spread = [F.greatest(F.coalesce(joint(i, i), F.lit(0.0)), F.lit(1e-6)) for i in range(m)]
    cov = F.coalesce(joint(0, 1), F.lit(0.0)) if m == 2 else F.lit(0.0)
    per = per.select(*keys, "component", "n", F.array(*[F.col(f"_at{i}") + F.col(f"_s{i}") / F.col("n") for i in range(m)]).alias("mean"), F.array(*spread).alias("variance"), cov.alias("cov"))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    limit = 0.999 * F.sqrt(F.col("variance")[0] * F.col("variance")[len(values) - 1])
    return per.withColumns({"weight": F.col("n") / total, "cov": F.greatest(F.least("cov", limit), -limit)}).select(*keys, "component", "n", "weight", "mean", "variance", "cov")


def mixtures(rows: DataFrame, keys: list[str], values: list[str], order: list[str], k: Column, most: int, rounds: int | None = None) -> DataFrame:
    """(keys, k, component, n, weight, mean, variance, cov): k-means cells of one or two columns and their moments; mean and variance are arrays.

    `k` is an array column: the numbers of components that a row's key is fitted with, `most` at most, all at once. Cells start at places of the
    rows in `order` (`starts`) and settle (`cells`; with `rounds`, so many assignments are made). Variances are the sample's, 1e-6 at
    least, and the covariance (0 for one column) is held within 0.999 of what the variances allow. Rows with a null value are left
    out; an empty cell has no row."""
    group = [*keys, "k"]
    named = list(dict.fromkeys([*keys, *values, *order]))
    at = places.placed(rows.dropna(subset=values).select(*named, k.alias("_ks")), keys, order)  # one order for all numbers of components
    centres = _at_places(at.withColumn("k", F.explode("_ks")).withColumn("_k", F.col("k")), group, values)
    alike = written(at.groupBy(*keys, "_ks", *values).agg(F.count(F.lit(1)).alias("_w")))
    there = alike.withColumn("k", F.explode("_ks")).drop("_ks")
    if most > 1:
        centres = cells(there, group, values, centres, most, None if rounds is None else rounds - 1, "_w")
    return _moments(nearest(there, group, values, centres), group, values)


def mixture(rows: DataFrame, keys: list[str], values: list[str], order: list[str], k: int, rounds: int | None = None) -> DataFrame:
    """`mixtures` of k components for every key, without the column k."""
    return mixtures(rows, keys, values, order, F.array(F.lit(k)), k, rounds).drop("k")


def density(values: list[str]) -> Column:
    """The density of one or two columns under the component beside them."""
    d = [F.col(v) - F.col("mean")[i] for i, v in enumerate(values)]
    v = [F.col("variance")[i] for i in range(len(values))]
    if len(values) == 1:
        return F.exp(-d[0] * d[0] / (2 * v[0])) / F.sqrt(2 * math.pi * v[0])
    det = v[0] * v[1] - F.col("cov") * F.col("cov")
    q = (v[1] * d[0] * d[0] - 2 * F.col("cov") * d[0] * d[1] + v[0] * d[1] * d[1]) / det
    return F.exp(-q / 2) / (2 * math.pi * F.sqrt(det))


def losses(rows: DataFrame, model: DataFrame, keys: list[str], values: list[str], id_: str) -> DataFrame:
    """(keys, loss, se): the mean negative log density (1e-15 at least) of each key's rows under its mixture, and its standard error."""
    both = met(rows.dropna(subset=values), model, keys, "inner")
    per = both.groupBy(*keys, id_).agg((-F.log(F.greatest(F.sum(F.col("weight") * density(values)), F.lit(1e-15)))).alias("_l"))
    return per.groupBy(*keys).agg(F.avg("_l").alias("loss"), (F.coalesce(F.stddev_samp("_l"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def _selected(rows: DataFrame, keys: list[str], id_: str, two: Column, most: int, full: bool) -> tuple[DataFrame, DataFrame]:
    """(losses, fits) of rows (keys, id_, _a, _b, _o), where _b is 0 for keys of one column (not `two`): the losses of mixtures of 1 to `most`
    components fitted to the first four fifths by id_, and the mixtures of all rows if `full`, else of those.

    All keys, numbers of components and parts settle in the same rounds: they are part of the key."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    least, each = F.when(two, 12).otherwise(10), F.when(two, 5).otherwise(3)
    at = places.placed(rows.withColumn("_two", two), keys, [id_]).withColumn("_at", F.col("_i") + 1).drop("_i").withColumn("_cut", F.floor(F.col("_n") * 4 / 5))
    tried = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: (k * each < F.col("_cut")) & (F.col("_n") >= least))
    at = written(at.withColumn("_ks", F.when(F.size(tried) == 0, F.array(F.lit(1))).otherwise(tried)).withColumn("_split", F.size(tried) > 0))
    parts = F.array_compact(F.array(F.when(F.lit(full), F.lit("all")), F.when(F.col("_split") & (F.col("_at") <= F.col("_cut")), F.lit("train"))))
    group = [*keys, "_two", "_part"]
    fits = written(mixtures(at.withColumn("_part", F.explode(parts)), group, ["_a", "_b"], ["_o", id_], F.col("_ks"), most))
    rest = at.where("_split AND _at > _cut").withColumn("k", F.explode("_ks"))
    both = met(rest.drop("_two"), fits.where("_part = 'train'").drop("_part"), [*keys, "k"], "inner")
    here = F.when(F.col("_two"), density(["_a", "_b"])).otherwise(density(["_a"]))
    per = both.groupBy(*keys, "k", id_).agg((-F.log(F.greatest(F.sum(F.col("weight") * here), F.lit(1e-15)))).alias("_l"))
    judged = per.groupBy(*keys, "k").agg(F.avg("_l").alias("loss"), (F.coalesce(F.stddev_samp("_l"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    judged = judged.withColumn("_b", F.min(F.struct("loss", "k", "se")).over(w))
    first = F.min(F.when((F.col("k") <= F.col("_b.k")) & (F.col("loss") <= F.col("_b.loss") + F.col("_b.se")), F.col("k"))).over(w)
    judged = judged.withColumn("chosen", F.col("k") == first).select(*keys, "k", "loss", "se", "chosen")
    nothing = F.lit(None).cast("double")
    small = at.where("NOT _split").select(*keys).distinct().select(*keys, F.lit(1).alias("k"), nothing.alias("loss"), nothing.alias("se"), F.lit(True).alias("chosen"))
    return judged.unionByName(small), fits.where("_part = 'all'").drop("_part", "_two")


def component_losses(rows: DataFrame, keys: list[str], values: list[str], order: str | None, id_: str, most: int = 3) -> DataFrame:
    """(keys, k, loss, se, chosen): mixtures of 1 to `most` components of one or two columns fitted to the first four fifths of each key's rows by `id_`,
    judged on the rest.

    Cells start at places in `order`, or of the first column where that is None. chosen marks the fewest components within one standard error of
    the best loss. A count needs more than 3 rows a component (5 for two columns) to be tried; a key with fewer than 10 rows (12) is not split
    and chooses 1, with a null loss. Rows with a null value are left out."""
    there = rows.dropna(subset=values)
    b = F.col(values[1]) if len(values) == 2 else F.lit(0.0)
    there = there.select(*keys, id_, F.col(values[0]).cast("double").alias("_a"), b.cast("double").alias("_b"), F.col(order or values[0]).alias("_o"))
    return _selected(there, keys, id_, F.lit(len(values) == 2), most, False)[0]


def _kinds(rows: DataFrame, up: str, down: str) -> DataFrame:
    kind = F.when((F.col(up) > 0) & (F.col(down) > 0), "both").when(F.col(up) > 0, "up").when(F.col(down) > 0, "down").otherwise("zero")
    return rows.dropna(subset=[up, down]).withColumn("kind", kind)


def zero_masses(rows: DataFrame, keys: list[str], up: str, down: str) -> DataFrame:
    """(keys, kind, mass): the shares of rows in which neither (zero), one (up, down) or both of two moves are above 0. Rows with a null move are left out."""
    total = F.sum("_rows").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return _kinds(rows, up, down).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("_rows")).withColumn("mass", F.col("_rows") / total).drop("_rows")


def zero_inflated(rows: DataFrame, keys: list[str], up: str, down: str, order: str, most: int = 3) -> DataFrame:
    """(keys, kind, mass, component, weight, mean_up, mean_down, var_up, var_down, cov): the joint distribution of two moves of 0 or more.

    The masses are those of `zero_masses`. The logarithms of what is above 0 are mixtures (of one column, started in the order of the values,
    or of both, started in `order`), whose number of components is chosen as in `component_losses`. Parts that a kind does not have are mean 0,
    variance 1, covariance 0."""
    mass = zero_masses(rows, keys, up, down)
    one, nought = F.lit(1.0), F.lit(0.0)
    shape = ["kind", "mass", "component", "weight", "mean_up", "mean_down", "var_up", "var_down", "cov"]
    zero = mass.where("kind = 'zero'").withColumns({"component": F.lit(0), "weight": one, "mean_up": nought, "mean_down": nought, "var_up": one, "var_down": one, "cov": nought})
    typed = _kinds(rows, up, down).where("kind <> 'zero'")
    first = F.log(F.when(F.col("kind") == "down", F.col(down)).otherwise(F.col(up)))
    both = F.col("kind") == "both"
    typed = typed.select(*keys, "kind", order, first.alias("_a"), F.when(both, F.log(F.when(both, F.col(down)))).otherwise(0.0).alias("_b"), F.when(~both, first).alias("_o"))
    group = [*keys, "kind"]
    judged, fits = _selected(typed, group, order, both, most, True)
    fits = met(fits, judged.where("chosen").select(*group, "k"), [*group, "k"], "inner")
    fits = met(fits, mass, group, "inner")
    part = lambda column, without, own, other: F.when(F.col("kind") == without, F.lit(other)).otherwise(F.col(column)[own])
    second = lambda column: F.col(column)[F.when(both, 1).otherwise(0)]
    fits = fits.withColumns(
        {
            "mean_up": part("mean", "down", 0, 0.0),
            "var_up": part("variance", "down", 0, 1.0),
            "mean_down": F.when(F.col("kind") == "up", nought).otherwise(second("mean")),
            "var_down": F.when(F.col("kind") == "up", one).otherwise(second("variance")),
            "cov": F.when(both, F.col("cov")).otherwise(nought),
        }
    )
    return zero.select(*keys, *shape).unionByName(fits.select(*keys, *shape))
