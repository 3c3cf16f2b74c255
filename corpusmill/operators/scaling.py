"""Iso-compute fits: the best model size of each budget, and the power law through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_by_budget(runs: DataFrame) -> DataFrame:
    """(compute_budget, parameters, final_loss) of the lowest loss; of equal losses the smaller model.

    Null losses, budgets and sizes are left out; repeated runs change nothing.
    """
    runs = runs.dropna(subset=["parameters", "compute_budget", "final_loss"])
    best = F.min(F.struct("final_loss", "parameters")).alias("b")
    return runs.groupBy("compute_budget").agg(best).select("compute_budget", "b.parameters", "b.final_loss")


def power_law(best: DataFrame) -> DataFrame:
    """(a, log10_alpha) of parameters = alpha budget^a, least squares in log space."""
    x, y = F.log10("compute_budget"), F.log10("parameters")
    return best.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("log10_alpha"))


def extrapolate(fit: DataFrame, budget: float) -> DataFrame:
    """(compute_budget, parameters, tokens) at a budget, tokens = C / 6N."""
    n = F.pow(F.lit(10.0), F.col("log10_alpha") + F.col("a") * F.log10(F.lit(budget)))
    return fit.select(F.lit(budget).alias("compute_budget"), n.alias("parameters"), (F.lit(budget) / (6 * n)).alias("tokens"))


def fit_series(fit: DataFrame, low: float, high: float, points: int = 1000) -> DataFrame:
    """(log10_budget, log10_parameters) at evenly spaced places."""
    at = F.lit(low) + F.col("id") * ((high - low) / (points - 1))
    series = fit.sparkSession.range(points).select(at.alias("log10_budget"))
    return series.crossJoin(F.broadcast(fit)).select("log10_budget", (F.col("log10_alpha") + F.col("a") * F.col("log10_budget")).alias("log10_parameters"))
