"""Statistics of modules: expectation model, score terms, parameter search."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.penalty import Weights, folded_angle

FIRST, LAST, LEAST = 10, 50, 30  # ranks (from 0) that the regression uses; modules that it needs more than


def expectation_model(modules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """alpha, beta, rmse, r_squared of ln(rank) on score over the modules of ranks FIRST to LAST, for groups of more than LEAST.

    The best modules are left out as the real signal. modules: score and, for ties, module. If those ranks all have one
    score, no line is determined: alpha and r_squared are null then, beta and rmse NaN.
    """
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "module")
    ranked = modules.withColumn("r", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    used = ranked.where((F.col("all") > LEAST) & (F.col("r") > FIRST) & (F.col("r") <= LAST)).withColumn("y", F.log("r"))
    sxx, none = F.regr_sxx("y", "score"), F.lit(float("nan"))
    rmse = F.when(sxx != 0, F.sqrt((F.regr_syy("y", "score") - F.try_divide(F.pow(F.regr_sxy("y", "score"), 2), sxx)) / F.count(F.lit(1)))).otherwise(none)
    fit = used.groupBy(*by).agg(F.regr_intercept("y", "score").alias("alpha"), F.coalesce(F.regr_slope("y", "score"), none).alias("beta"), rmse.alias("rmse"), F.regr_r2("y", "score").alias("r_squared"), F.count(F.lit(1)).alias("n_"))
    return fit.where("n_ > 0").drop("n_")


def expected_modules(score: Column, alpha: Column, beta: Column, r_squared: Column) -> Column:
    """The number of modules of such a score by the model; null where it explains little."""
    return F.when(r_squared > 0.1, F.exp(alpha + beta * score))


def score_terms(columns: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """module, col, bonus, distance, bend, twist of two-sequence modules, their sum, and whether it is off the column's delta."""
    by = Window.partitionBy("module", "seq").orderBy("col")
    gaps = columns.withColumn("gap", F.col("begin") - F.lag("end").over(by) - 1)
    at = gaps.groupBy("module", "col").agg(F.sum("weight").alias("w"), F.min_by("gap", "seq").alias("x"), F.max_by("gap", "seq").alias("y"), F.max("delta").alias("delta"))
    s, off = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    turn = F.abs(off) * F.lit(2 * math.pi / weights.rotation)
    turn = turn - F.lit(2 * math.pi) * F.floor(turn / F.lit(2 * math.pi))
    angle = F.least(turn, F.lit(2 * math.pi) - turn)
    stepped = s.isNotNull() & (s > 0)
    terms = {
        "bonus": F.lit(weights.lam) * F.col("w"),
        "distance": F.when(stepped, -F.lit(weights.mu) * s / 2).otherwise(0.0),
        "bend": F.when(stepped, -F.lit(weights.nu) * off * off / s).otherwise(0.0),
        "twist": F.when(stepped, -F.lit(weights.xi) * angle * angle / s).otherwise(0.0),
    }
    out = at.select("module", "col", "delta", *(v.alias(k) for k, v in terms.items()))
    total = F.col("bonus") + F.col("distance") + F.col("bend") + F.col("twist")
    return out.withColumn("total", total).withColumn("off", F.abs(F.col("total") - F.col("delta")) > 0.1)


def term_summary(terms: DataFrame) -> DataFrame:
    """module, and the mean and population variance of each term."""
    names = ("bonus", "distance", "bend", "twist")
    return terms.groupBy("module").agg(*(f(n).alias(f"{label}_{n}") for n in names for f, label in ((F.avg, "mean"), (F.var_pop, "var"))))


def climb(value: Callable[[Weights], float], start: Weights = Weights(), rounds: int = 60, patience: int = 6, seed: int = 0) -> tuple[Weights, float]:
    """Weights of the highest value found by steps in random directions; after `patience` rounds without gain, from a new start.

    value is what a Spark job works out for the weights, say the score of good pairs over that of shuffled ones.
    """
    rng = np.random.default_rng(seed)
    now = np.array([start.lam, start.mu, start.nu, start.xi])
    made = lambda v: Weights(*(float(x) for x in v), start.rotation)
    best, best_value = now, value(made(now))
    here, idle, size = best_value, 0, 0.5
    for _ in range(rounds):
        direction = rng.normal(size=4)
        step = np.maximum(now + size * direction / np.linalg.norm(direction), 1e-3)
        got = value(made(step))
        if got > here:
            now, here, idle = step, got, 0
        else:
            idle += 1
        if here > best_value:
            best, best_value = now, here
        if idle > patience:
            now, idle = np.abs(rng.normal(size=4)) * 2 + 1e-3, 0
            here = value(made(now))
    return made(best), best_value


def angle_of(x: float, rotation: float = 10.4) -> float:
    return float(folded_angle(x, rotation))
