"""Fit of estimated to observed volumes, the calibration objective, and the parameter search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.functions import scalars as S
from viaflux.operators.network import CONNECTOR
from viaflux.params import BOUNDS, Params

FAILED = 1e9


def scatter(edges: DataFrame) -> DataFrame:
    """(sre, observed, estimated, geh, residual) of fixed edges with a positive observation."""
    e = edges.where(F.col("fixed") & (F.col("direction") != CONNECTOR) & (F.col("observed_vmd") > 0) & F.col("volume").isNotNull())
    return e.select("edge_seq", "sre", F.col("observed_vmd").alias("observed"), F.col("volume").alias("estimated"), S.geh(F.col("volume"), F.col("observed_vmd")).alias("geh"), (F.col("volume") - F.col("observed_vmd")).alias("residual"))


def fit_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """One row (for each of ``keys``): rmse, mae, mape, r2, geh_pct_under_5, n_observations and means; no row under two observations."""
    r, o = F.col("residual"), F.col("observed")
    m = rows.groupBy(*keys).agg(
        F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"), (F.avg(F.abs(r) / F.greatest(o, S.num(1))) * 100).alias("mape"),
        (1 - F.sum(r * r) / F.greatest(F.var_pop(o) * F.count(o), S.num(1))).alias("r2"), (F.avg((F.col("geh") < 5).cast("double")) * 100).alias("geh_pct_under_5"),
        F.count(F.lit(1)).alias("n_observations"), F.avg(o).alias("mean_observed"), F.avg("estimated").alias("mean_estimated"),
    )
    return m.where("n_observations >= 2")


def objective(metrics: DataFrame) -> DataFrame:
    """metrics with ``objective``, the value that calibration makes small."""
    return metrics.withColumn("objective", F.col("rmse") / F.greatest(F.col("mean_observed"), S.num(1)) + (100 - F.col("geh_pct_under_5")) / 100)


def held_out_folds(edges: DataFrame, folds: int = 5) -> DataFrame:
    """edges with ``fold``: all edges of a region share one, so a region's counts can be hidden together."""
    return edges.withColumn("fold", F.pmod(F.xxhash64(F.col("regional").cast("string")), F.lit(folds)).cast("int"))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of the metrics over folds."""
    return metrics.agg(*[f(c).alias(f"{c}_{n}") for c in ("r2", "rmse", "mae", "mape") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def differential_evolution(evaluate: Callable[[list[dict[str, float]]], list[float]], bounds: dict[str, tuple[float, float]] = BOUNDS, generations: int = 30, popsize: int = 10, seed: int = 42, tol: float = 0.01) -> tuple[dict[str, float], float]:
    """(best parameters, best value). ``evaluate`` gets a whole population, so that it can be one job.

    Best/1/bin with dithered scale in [0.5, 1), crossover 0.7, Latin-hypercube start. A failed
    candidate should be valued ``FAILED``.
    """
    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][i] for n in names]) for i in (0, 1))
    n, dim = popsize * len(names), len(names)
    cells = np.stack([rng.permutation(n) for _ in range(dim)], axis=1)
    pop = (cells + rng.random((n, dim))) / n
    value = lambda x: np.array(evaluate([dict(zip(names, (low + v * (high - low)).tolist())) for v in x]), float)
    fit = value(pop)
    for _ in range(generations):
        if np.std(fit) <= tol * abs(np.mean(fit)):
            break
        scale, best = rng.uniform(0.5, 1.0), pop[np.argmin(fit)]
        a, b = (pop[[rng.choice([j for j in range(n) if j != i]) for i in range(n)]] for _ in range(2))
        trial = best + scale * (a - b)
        out = (trial < 0) | (trial > 1)
        trial[out] = rng.random(out.sum())
        cross = rng.random((n, dim)) < 0.7
        cross[np.arange(n), rng.integers(0, dim, n)] = True
        trial = np.where(cross, trial, pop)
        got = value(trial)
        better = got <= fit
        pop[better], fit[better] = trial[better], got[better]
    i = int(np.argmin(fit))
    return dict(zip(names, (low + pop[i] * (high - low)).tolist())), float(fit[i])


def calibrate(run: Callable[[Params], DataFrame], p: Params, **options) -> tuple[Params, float]:
    """Search with ``run(params)`` giving one row of metrics; a run that fails or has too few observations is worth ``FAILED``."""

    def evaluate(population: list[dict[str, float]]) -> list[float]:
        out = []
        for values in population:
            try:
                row = objective(run(p.with_values(**values))).first()
                out.append(FAILED if row is None else row["objective"])
            except Exception as error:  # the search goes on without this candidate
                print(f"candidate failed: {error}")
                out.append(FAILED)
        return out

    best, value = differential_evolution(evaluate, **options)
    return p.with_values(**best), value
