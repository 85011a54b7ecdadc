"""Evolution of strategy parameters: one Spark job evaluates a generation, the driver breeds the next.

The driver holds a population of bounded size; bars and paths stay in Spark. All draws come from one seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import strategy as S
from tidemark.operators.simulate import ghost_dca

STEP = 0.05
Gene = dict[str, float]


@dataclass(frozen=True)
class Config:
    """Size and length of an evolution, and how mutation grows while nothing improves."""

    population: int = 300
    generations: int = 25
    elites: int = 8
    tournament: int = 3
    patience: int = 5
    mutation: float = 0.15
    scale: float = 1.0
    ramp: float = 1.25
    mutation_most: float = 0.55
    scale_most: float = 3.0
    seed: int = 1


def on_lattice(gene: Gene) -> Gene:
    """Values at multiples of 0.05 within their bounds, whole months, and force thresholds in order."""
    out = {}
    for name, (low, high, _) in S.PARAMETERS.items():
        step = 1.0 if name == "soft_release_months" else STEP
        lo, hi = np.ceil(low / step - 1e-9) * step, np.floor(high / step + 1e-9) * step
        out[name] = round(float(min(max(np.floor(gene[name] / step + 0.5) * step, lo), hi)), 2)
    out["macro_bear_multiplier"] = max(out["macro_bear_multiplier"], out["macro_bull_multiplier"])
    low, high = sorted((out["force_empty_threshold"], out["force_full_threshold"]))
    return out | {"force_empty_threshold": low, "force_full_threshold": high}


def sample(rng: np.random.Generator) -> Gene:
    return on_lattice({n: rng.uniform(low, high) for n, (low, high, _) in S.PARAMETERS.items()})


def crossed(a: Gene, b: Gene, rng: np.random.Generator) -> Gene:
    return {n: a[n] if rng.random() < 0.5 else b[n] for n in S.PARAMETERS}


def mutated(gene: Gene, probability: float, scale: float, rng: np.random.Generator) -> Gene:
    """Each value moves with the probability, by a normal draw of a tenth of its range times the scale."""
    return on_lattice({n: gene[n] + rng.normal() * scale * (high - low) / 10 if rng.random() < probability else gene[n] for n, (low, high, _) in S.PARAMETERS.items()})


def key(gene: Gene) -> tuple[float, ...]:
    return tuple(gene[n] for n in S.PARAMETERS)


def next_generation(ranked: list[tuple[float, Gene]], config: Config, probability: float, scale: float, seen: set, rng: np.random.Generator) -> list[Gene]:
    """The elites, then children of tournament winners that were never tried; after 64 vain attempts fresh samples."""
    out = [g for _, g in ranked[: config.elites]]

    def winner() -> Gene:
        return ranked[min(rng.integers(len(ranked), size=config.tournament))][1]

    while len(out) < config.population:
        for attempt in range(1000):
            child = mutated(crossed(winner(), winner(), rng), probability, scale, rng) if attempt < 64 else sample(rng)
            if key(child) not in seen:
                break
        else:
            raise ValueError("no untried parameters left")
        seen.add(key(child))
        out.append(child)
    return out


def baselines(windows: DataFrame, spec: S.Spec) -> DataFrame:
    """(win, roi, dd) of the monthly purchase in each window."""
    from pyspark.sql import Window

    path = ghost_dca(windows.where("open_time_ms >= evaluation_ms").select("win", "open_time_ms", "open", "close"), ["win"], spec.initial, spec.monthly, spec.fee, spec.spread)
    peak = F.max("nav").over(Window.partitionBy("win").orderBy("open_time_ms"))
    rows = path.withColumn("_peak", peak)
    return rows.groupBy("win").agg((F.max_by("nav", "open_time_ms") / F.min_by("nav", "open_time_ms") - 1).alias("roi"), F.max((F.col("_peak") - F.col("nav")) / F.col("_peak")).alias("dd"))


def evaluate(bars: DataFrame, genes: list[Gene], spec: S.Spec = S.Spec(), penalty: float = 0.0, warmup_days: int = 1200) -> dict[int, float]:
    """Score of each gene (by place): all genes and windows are groups of one job."""
    spark = bars.sparkSession
    runs = spark.createDataFrame([(i, *key(g)) for i, g in enumerate(genes)], "run_id long, " + ", ".join(f"{n} double" for n in S.PARAMETERS))
    windows = S.crucible_windows(bars, [], warmup_days)
    paths = S.backtest(windows.select("win", "open_time_ms", "open", "high", "low", "close", "volume"), ["win"], runs, spec)
    meta = windows.select("win", "weight", "evaluation_ms").distinct()
    judged = paths.join(F.broadcast(meta), "win").where("open_time_ms >= evaluation_ms")
    scores = S.fitness(judged.select("run_id", "win", "weight", "open_time_ms", "nav", "trades"), baselines(windows, spec), penalty=penalty)
    return {r["run_id"]: r["score"] for r in scores.collect()}


def evolve(bars: DataFrame, config: Config = Config(), spec: S.Spec = S.Spec(), penalty: float = 0.0, start: list[Gene] | None = None) -> tuple[float, Gene, list[float]]:
    """Best score, its gene and the best score of each generation; equal seeds give equal results. bars: one series."""
    rng = np.random.default_rng(config.seed)
    genes = [on_lattice(g) for g in (start or [{n: v[2] for n, v in S.PARAMETERS.items()}])]
    seen = {key(g) for g in genes}
    while len(genes) < config.population:
        g = sample(rng)
        if key(g) not in seen:
            seen.add(key(g))
            genes.append(g)
    known: dict[tuple, float] = {}
    history, stale = [], 0
    probability, scale = config.mutation, config.scale
    bars = bars.persist()
    for generation in range(config.generations + 1):
        new = [g for g in genes if key(g) not in known]
        found = evaluate(bars, new, spec, penalty) if new else {}
        known |= {key(g): found.get(i, -99999.0) for i, g in enumerate(new)}
        ranked = sorted(((known[key(g)], g) for g in genes), key=lambda x: (-x[0], key(x[1])))
        better = not history or ranked[0][0] > history[-1]
        history.append(ranked[0][0])
        stale = 0 if better else stale + 1
        if generation == config.generations or stale >= config.patience:
            break
        probability, scale = (config.mutation, config.scale) if better else (min(config.mutation_most, probability * config.ramp), min(config.scale_most, scale * config.ramp))
        genes = next_generation(ranked, config, probability, scale, seen, rng)
    bars.unpersist()
    return ranked[0][0], ranked[0][1], history
