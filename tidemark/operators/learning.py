"""Models as Spark jobs: sums of products, trees and clusters by Spark, scoring by expressions.

Models of a key are rows of a table (`fits`); nothing here grows a plan, or the driver, with the keys.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import inverse_normal, normal_cdf, radical_inverse
from tidemark.operators import fits, places


def folds_of(rows: DataFrame, keys: list[str], order: str, min_train: int, purge: int, folds: int) -> DataFrame:
    """Each row once per fold it serves in: adds fold and part (train or validation). Training expands and ends `purge` rows
    before the validation block; the last block runs to the end."""
    at = places.placed(rows, keys, [order])
    block = F.floor((F.col("_n") - min_train - purge) / folds)
    at = at.withColumn("_block", block).where("_block > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = min_train + purge + F.col("fold") * F.col("_block")
    end = F.when(F.col("fold") == folds - 1, F.col("_n")).otherwise(start + F.col("_block"))
    part = F.when(F.col("_i") < start - purge, "train").when((F.col("_i") >= start) & (F.col("_i") < end), "validation")
    return at.withColumn("part", part).where("part IS NOT NULL").drop("_i", "_n", "_block")


def basis(ratios: list[str], interactions: bool = False) -> dict[str, Column]:
    """Columns of the additive model: v = tanh(ln ratio) and its square for each ratio, products of pairs if asked."""
    v = {r: F.tanh(F.log(F.col(r))) for r in ratios}
    out = {f"{r}_v": c for r, c in v.items()} | {f"{r}_v2": c * c for r, c in v.items()}
    if interactions:
        out |= {f"{a}_x_{b}": v[a] * v[b] for i, a in enumerate(ratios) for b in ratios[i + 1 :]}
    return out


def regions_by_area(rows: DataFrame, keys: list[str], regions: int, area: str, slope: str, rounds: int | None = None) -> DataFrame:
    """Adds region: k-means cells of (area, slope), started at the points at the odd 2k-ths of the areas; they settle, or are assigned `rounds` times."""
    if regions == 1:
        return rows.withColumn("region", F.lit(0))
    values = [area, slope]
    centres = fits.cells(rows, keys, values, fits.starts(rows, keys, values, values, regions), regions, None if rounds is None else rounds - 1)
    return fits.nearest(rows, keys, values, centres, "region").drop("_c")


def geometry_model(train: DataFrame, keys: list[str], x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """(keys, region, weight, ca, cs, sa, ss, cov): linear fits of both responses on both features in each region, and the residuals' spread."""
    group = [*keys, "region"]
    models = fits.least_squares(train, group, list(x), list(y)).withColumnsRenamed({y[0]: "ca", y[1]: "cs"}).drop("n")
    rows = fits.met(train, models, group)
    rows = rows.withColumns({"_a": F.col(y[0]) - fits.line("ca", list(x)), "_s": F.col(y[1]) - fits.line("cs", list(x))})
    floor = lambda c: F.sqrt(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-9)))
    spread = rows.groupBy(*group).agg(F.any_value("ca").alias("ca"), F.any_value("cs").alias("cs"), F.count(F.lit(1)).alias("n"), floor(F.var_samp("_a")).alias("sa"), floor(F.var_samp("_s")).alias("ss"), F.coalesce(F.covar_samp("_a", "_s"), F.lit(0.0)).alias("cov"))
    limit = 0.999 * F.col("sa") * F.col("ss")
    spread = spread.withColumn("cov", F.greatest(F.least("cov", limit), -limit))
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return spread.select(*group, (F.col("n") / total).alias("weight"), "ca", "cs", "sa", "ss", "cov")


def geometry_scores(rows: DataFrame, model: DataFrame, keys: list[str], x: tuple[str, str], y: tuple[str, str], id_: str) -> DataFrame:
    """(keys, n, joint_nll, calibration_error): the joint density has area cut at 0; the calibration error is how far the
    deciles of both probability integral transforms are from even."""
    both = rows.select(*keys, id_, *x, *y).join(model, keys)
    line = lambda c: c[0] + c[1] * F.col(x[0]) + c[2] * F.col(x[1])
    both = both.withColumns({"_ma": line(F.col("ca")), "_ms": line(F.col("cs"))})
    sa, ss, cov = F.col("sa"), F.col("ss"), F.col("cov")
    da, ds = F.col(y[0]) - F.col("_ma"), F.col(y[1]) - F.col("_ms")
    det = sa * sa * ss * ss - cov * cov
    q = (ss * ss * da * da - 2 * cov * da * ds + sa * sa * ds * ds) / det
    whole = F.greatest(normal_cdf(F.col("_ma") / sa), F.lit(1e-12))
    density = F.exp(-q / 2) / (2 * math.pi * F.sqrt(det)) / whole
    pa = F.greatest(F.least((normal_cdf(da / sa) - normal_cdf(-F.col("_ma") / sa)) / whole, F.lit(1.0)), F.lit(0.0))
    per = both.groupBy(*keys, id_).agg(F.sum(F.col("weight") * density).alias("_f"), F.sum(F.col("weight") * pa).alias("_pa"), F.sum(F.col("weight") * normal_cdf(ds / ss)).alias("_ps"))
    n = F.count(F.lit(1))
    off = F.lit(0.0)
    for c in ("_pa", "_ps"):
        for k in range(10):
            off = off + F.abs(F.count_if(F.least(F.floor(F.col(c) * 10), F.lit(9)) == k) / n - 0.1)
    return per.groupBy(*keys).agg(n.alias("n"), F.avg(-F.log(F.greatest("_f", F.lit(1e-300)))).alias("joint_nll"), (off / 20).alias("calibration_error"))


def isotonic_calibrator(rows: DataFrame, keys: list[str], probability: str, label: str, bins: int = 10) -> DataFrame:
    """(keys, bin, value): a rising map from bins of the forecast to observed rates, each bin with two observations at the
    overall rate added. The best rising fit is the largest over starts at or before a bin of the least mean up to an end at or after it."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    per = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_y"))
    overall = per.groupBy(*keys).agg((F.sum("_y") / F.sum("_n")).alias("_rate"))
    every = overall.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(per, [*keys, "bin"], "left").select(*keys, "bin", (F.coalesce("_n", F.lit(0)) + 2.0).alias("_w"), (F.coalesce("_y", F.lit(0)) + 2 * F.col("_rate")).alias("_s"))
    listed = full.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "_w", "_s"))).alias("_l"))
    total = lambda i, j, f: F.aggregate(F.slice("_l", i + 1, j - i + 1), F.lit(0.0), lambda a, e: a + e[f])
    mean = lambda i, j: total(i, j, "_s") / total(i, j, "_w")
    value = lambda k: F.array_max(F.transform(F.sequence(F.lit(0), k), lambda i: F.array_min(F.transform(F.sequence(k, F.lit(bins - 1)), lambda j: mean(i, j)))))
    return listed.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), value)).alias("bin", "value"))


def six_regions(components: DataFrame, keys: list[str], direction: float, magnitude: float, samples: int = 256) -> DataFrame:
    """(keys, up_small ... down_large): probabilities of six regions under a zero-inflated mixture, by a fixed sequence of points.

    components: (keys, kind, mass, weight, mean_up, mean_down, var_up, var_down, cov) with kind up, down, both or zero; the
    mass is that of the kind."""
    points = components.withColumn("_i", F.explode(F.when(F.col("kind") == "zero", F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(samples)))))
    z1, z2 = (inverse_normal(F.greatest(F.least(radical_inverse(F.col("_i"), b), F.lit(1 - 1e-12)), F.lit(1e-12))) for b in (2, 3))
    corr = F.greatest(F.least(F.col("cov") / F.nullif(F.sqrt(F.col("var_up") * F.col("var_down")), F.lit(0.0)), F.lit(0.999)), F.lit(-0.999))
    up = F.when(F.col("kind").isin("up", "both"), F.exp(F.col("mean_up") + F.sqrt("var_up") * z1)).otherwise(0.0)
    down = F.when(F.col("kind") == "down", F.exp(F.col("mean_down") + F.sqrt("var_down") * z2)).when(F.col("kind") == "both", F.exp(F.col("mean_down") + F.sqrt("var_down") * (corr * z1 + F.sqrt(1 - corr * corr) * z2))).otherwise(0.0)
    points = points.withColumns({"_up": up, "_down": down, "_w": F.col("mass") * F.col("weight") / F.when(F.col("kind") == "zero", 1).otherwise(samples)})
    size = F.col("_up") + F.col("_down")
    lean = F.coalesce((F.col("_up") - F.col("_down")) / F.nullif(size, F.lit(0.0)), F.lit(0.0))
    side = F.when(lean > direction, "up").when(lean < -direction, "down").otherwise("balanced")
    named = points.withColumn("_r", F.concat(side, F.when(size >= magnitude, F.lit("_large")).otherwise(F.lit("_small"))))
    names = [f"{a}_{b}" for a in ("up", "balanced", "down") for b in ("small", "large")]
    whole = F.nullif(F.sum("_w"), F.lit(0.0))
    return named.groupBy(*keys).agg(*[(F.coalesce(F.sum(F.when(F.col("_r") == n, F.col("_w"))), F.lit(0.0)) / whole).alias(n) for n in names])


def projected_on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with parts of 0 or more that sum to 1."""
    s = np.sort(x)[::-1]
    t = (np.cumsum(s) - 1) / np.arange(1, len(x) + 1)
    return np.maximum(x - t[np.flatnonzero(s > t)[-1]], 0.0)


def activity_scale(rows: DataFrame, features: list[str], target: str, order: str, iterations: int = 300) -> dict:
    """ln(target) = c + weighted mean of ln(features): which features, and their weights (0 or more, sum 1).

    All subsets are fitted to the first four fifths of the rows, rows of one `order` together, and judged by the mean absolute error on
    the rest; the smallest within one standard error of the best wins. Where a subset's rows are cut comes from counts by `order`, added
    up before the shuffle. One aggregation gives every subset its sums of products, another its errors."""
    n = len(features)
    ok = [(F.col(f) > 0) for f in features]
    logs = rows.where(F.col(target) > 0).select(order, F.log(target).alias("_y"), *[F.when(c, F.log(f)).alias(f) for f, c in zip(features, ok)])
    masks = F.explode(F.filter(F.sequence(F.lit(1), F.lit((1 << n) - 1)), lambda m: sum((F.when((F.shiftright(m, i).bitwiseAND(1) == 1) & F.col(f).isNull(), 1).otherwise(0) for i, f in enumerate(features)), F.lit(0)) == 0))
    each = logs.withColumn("mask", masks)
    w = Window.partitionBy("mask")
    times = each.groupBy("mask", order).agg(F.count(F.lit(1)).alias("_c")).withColumns({"_to": F.sum("_c").over(w.orderBy(order)), "_n": F.sum("_c").over(w)})
    cuts = times.where("_n >= 20 AND _to <= floor(_n * 0.8)").groupBy("mask").agg(F.max(order).alias("_cut"))
    each = each.join(F.broadcast(cuts), "mask").withColumn("_train", F.col(order) <= F.col("_cut")).persist()  # cuts: a row a subset
    x = [F.lit(1.0), *[F.coalesce(F.col(f), F.lit(0.0)) for f in features]]

    def fit(part: DataFrame) -> dict[int, tuple[float, dict[str, float]]]:
        sums = [F.sum(a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(a * F.col("_y")).alias(f"xy_{i}") for i, a in enumerate(x)]
        out = {}
        for r in part.groupBy("mask").agg(F.count(F.lit(1)).alias("_rows"), *sums).collect():
            use = [0, *[i + 1 for i in range(n) if r["mask"] >> i & 1]]
            a = np.array([[r[f"xx_{i}_{j}"] for j in use] for i in use])
            b = np.array([r[f"xy_{i}"] for i in use])
            c = np.concatenate([[0.0], np.full(len(use) - 1, 1 / (len(use) - 1))])
            for _ in range(iterations):
                c = c - 0.02 / r["_rows"] * (a @ c - b)
                c[1:] = projected_on_simplex(c[1:])
            out[r["mask"]] = (float(c[0]), {features[i - 1]: float(v) for i, v in zip(use[1:], c[1:])})
        return out

    def error(models: dict[int, tuple[float, dict[str, float]]]) -> Column:
        out = F.lit(None).cast("double")
        for mask, (c, weights) in models.items():
            out = F.when(F.col("mask") == mask, F.abs(sum((v * F.col(f) for f, v in weights.items()), F.lit(c)) - F.col("_y"))).otherwise(out)
        return out

    models = fit(each.where("_train"))
    if not models:
        raise ValueError("too few rows with positive features")
    e = error(models)
    judged = each.where("NOT _train").groupBy("mask").agg(F.avg(e).alias("loss"), (F.coalesce(F.stddev_samp(e), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se")).collect()
    best = min(judged, key=lambda r: (r["loss"], r["mask"]))
    mask = min((r["mask"] for r in judged if r["loss"] <= best["loss"] + best["se"]), key=lambda m: (bin(m).count("1"), m))
    final = each.where(F.col("mask") == mask)
    model = fit(final)
    e = error(model)
    stats = final.agg(F.avg(e).alias("mean"), F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(e, F.lit(0.9)).alias("p90")).first()
    each.unpersist()
    return {"constant": math.exp(model[mask][0]), "weights": model[mask][1], "mean_error": stats["mean"], "median_error": stats["median"], "p90_error": stats["p90"]}


def forest(train: DataFrame, features: list[str], label: str, trees: int = 64, depth: int = 8, leaf: int = 3, seed: int = 7):
    """A random forest: bootstrap, square root of the features at a split."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(train)
    model = RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="_p", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt" if len(features) > 1 else "all", seed=seed)
    return model.fit(rows)


def forest_predictions(model, rows: DataFrame, features: list[str], mean: str = "mean", dispersion: str = "dispersion") -> DataFrame:
    """Adds the trees' mean and population deviation for each row."""
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_tree_{i}")
        out = tree.setPredictionCol(names[-1]).transform(out)
    total = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + x) / len(names)
    out = out.withColumn(mean, total)
    square = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + (x - F.col(mean)) * (x - F.col(mean)))
    return out.withColumn(dispersion, F.sqrt(square / len(names))).drop("_features", *names)


def surrogate_validation(examples: DataFrame, features: list[str], label: str, batch: str, trees: int = 64, seed: int = 7) -> DataFrame:
    """One row of error metrics of forests that each leave one batch out, against the median of the batches they saw:
    mae, rmse, median_error, p90_error, baseline_mae, coverage, can_guide."""
    judged = None
    for k, r in enumerate(examples.select(batch).distinct().orderBy(batch).collect()):  # one model for each batch
        seen, held = examples.where(F.col(batch) != r[0]), examples.where(F.col(batch) == r[0])
        middle = seen.agg(F.percentile(label, F.lit(0.5))).first()[0]
        one = forest_predictions(forest(seen, features, label, trees, seed=seed + k), held, features, "_mean", "_spread").select(F.abs(F.col("_mean") - F.col(label)).alias("e"), F.abs(F.lit(middle) - F.col(label)).alias("b"))
        judged = one if judged is None else judged.unionByName(one)
    judged = judged.persist()
    p90 = judged.agg(F.percentile("e", F.lit(0.9))).first()[0]
    mae, base = F.avg("e"), F.avg("b")
    return judged.agg(mae.alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.percentile("e", F.lit(0.5)).alias("median_error"), F.lit(p90).alias("p90_error"), base.alias("baseline_mae"), F.avg((F.col("e") <= p90).cast("double")).alias("coverage"), (mae < base).alias("can_guide"))


def proposals(scored: DataFrame, kind: str, count: int, order: str) -> DataFrame:
    """The first `count` candidates by a policy: conservative_performance (front of the lower bounds), qualification_boundary (an
    interval holds 0), model_uncertainty (front of the dispersions) or pure_coverage (the sequence itself).

    scored: return_ and drawdown_ mean, dispersion, lower and upper."""
    from tidemark.operators.skyline import pareto

    if kind == "conservative_performance":
        return pareto(scored, [], ["return_lower", "drawdown_lower"], order).orderBy(F.col("return_lower").desc(), F.col("drawdown_lower").desc(), order).limit(count)
    if kind == "qualification_boundary":
        holds = F.lit(False)
        for t in ("return", "drawdown"):
            holds = holds | ((F.col(f"{t}_lower") <= 0) & (F.col(f"{t}_upper") >= 0))
        return scored.where(holds).orderBy(F.least(F.abs("return_mean"), F.abs("drawdown_mean")), order).limit(count)
    if kind == "model_uncertainty":
        return pareto(scored, [], ["return_dispersion", "drawdown_dispersion"], order).orderBy(F.col("return_dispersion").desc(), F.col("drawdown_dispersion").desc(), order).limit(count)
    if kind == "pure_coverage":
        return scored.orderBy(order).limit(count)
    raise ValueError(f"unknown kind of proposal: {kind}")


def policy_value(mode: str, low: float, high: float, base: float, terms: dict[str, tuple[float, float]] | None = None, logit: float = 0.0, effects: dict[str, dict[str, float]] | None = None, value: float | None = None) -> Column:
    """A parameter's daily value: fixed, global, continuous (a bounded sigmoid of linear and quadratic terms of signals in [-1, 1],
    the base value where a signal is missing) or six_state (effects of direction, volatility and both)."""
    squash = lambda q: low + (high - low) / (1 + F.exp(-F.greatest(F.least(q, F.lit(700.0)), F.lit(-700.0))))
    if mode == "fixed":
        return F.lit(float(base))
    if mode == "global":
        return F.lit(float(value))
    if mode == "continuous":
        q, there = F.lit(float(logit)), F.lit(True)
        for name, (a, b) in (terms or {}).items():
            s = F.col(name)
            q, there = q + a * s + b * s * s, there & F.coalesce(s.between(-1, 1), F.lit(False))
        return F.when(there, squash(q)).otherwise(F.lit(float(base)))
    if mode == "six_state":
        effects = effects or {}
        for name, values in effects.items():
            if abs(sum(values.values())) > 1e-9:
                raise ValueError(f"{name} effects must sum to 0")
        pick = lambda name, key: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in effects[name].items() for x in kv]), key), F.lit(0.0)) if effects.get(name) else F.lit(0.0)
        q = logit + pick("direction", F.col("direction")) + pick("volatility", F.col("volatility")) + pick("interaction", F.concat_ws("_", "direction", "volatility"))
        return squash(q)
    raise ValueError(f"unknown mode: {mode}")


def combined_predictions(direction: DataFrame, joint: DataFrame, activity: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Out-of-fold parts that all three models have for a row, side by side. The activity model predicts ln(1 + x) of the features,
    which come back as x, 1e-12 at least."""
    decoded = activity.select(*keys, *[F.greatest(F.expm1(f), F.lit(1e-12)).alias(f) for f in features])
    return direction.join(joint, keys).join(decoded, keys)


def examples(features: DataFrame, targets: DataFrame, keys: list[str], kind: str, columns: list[str], available: Column | None = None) -> DataFrame:
    """(features' columns, target): rows with features at hand and an array of what is to be learnt.

    direction: 1.0 or 0.0 of one boolean; joint: the columns divided by `normaliser`, where that is above 0; activity: ln(1 + x)."""
    values = [F.col(c) for c in columns]
    if kind == "direction":
        target = F.array(*[v.cast("double") for v in values])
    elif kind == "joint":
        targets = targets.where("normaliser > 0")
        target = F.array(*[v / F.col("normaliser") for v in values])
    elif kind == "activity":
        target = F.array(*[F.log1p(v) for v in values])
    else:
        raise ValueError(f"unknown kind: {kind}")
    ready = features.where(available) if available is not None else features
    return ready.join(targets.select(*keys, target.alias("target")), keys)


def policy_signals(probabilities: dict[str, Column], activities: dict[str, tuple[Column, Column, Column]], deviation: Column | None = None) -> dict[str, Column]:
    """Signals in [-1, 1] for policy_value, null where they would leave it: 2p - 1 of probabilities, tanh(ln(predicted / median)) of
    activities (predicted, current, ratio to the median) and tanh of a trend deviation."""
    inside = lambda c: F.when(c.between(-1, 1), c)
    out = {name: inside(2 * p - 1) for name, p in probabilities.items()}
    for name, (ahead, now, ratio) in activities.items():
        median = now / F.nullif(ratio, F.lit(0.0))
        out[name] = inside(F.when((median > 0) & (ahead > 0), F.tanh(F.log(ahead / F.nullif(median, F.lit(0.0))))))
    if deviation is not None:
        out["occurrence_trend_deviation"] = inside(F.tanh(deviation))
    return out


def multiclass_reliability(rows: DataFrame, probabilities: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mean over classes of the share-weighted gap between forecast and observed rate in each bin."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("class"), F.col(p).alias("p"), (F.col(label) == i).cast("double").alias("y")) for i, p in enumerate(probabilities)]))
    one = rows.select(parts.alias("c")).select("c.class", "c.y", "c.p", F.least(F.floor(F.col("c.p") * bins), F.lit(bins - 1)).alias("bin"))
    per = one.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    total = F.sum("n").over(Window.partitionBy("class"))
    return per.withColumn("e", F.col("gap") * F.col("n") / total).groupBy("class").agg(F.sum("e").alias("e")).agg(F.avg("e").alias("reliability_error"))
