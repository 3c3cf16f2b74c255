"""Rewards of groups of rollouts and losses over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import arrays as A


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by `order`: rows delivered twice count once. Rows of equal order are alike
    by their text, so the choice can be repeated."""
    rows = F.struct(*[c for c in df.columns if c != key])
    picked = df.groupBy(key).agg(F.max_by(rows, F.struct(F.col(order), F.xxhash64(*[c for c in df.columns if c != key]))).alias("r"))
    return picked.select(key, "r.*")


def group_advantages(df: DataFrame, group: list[str], reward: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """df with advantage: (reward - group mean) / (sample std + eps), or without the division.

    Null rewards are left out of the mean and get null; a group of one has no std and gets 0. The
    statistics are aggregated and joined back, so a hot group isn't gathered into one task.
    """
    stats = df.groupBy(*group).agg(F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__std"))
    on = F.lit(True)
    left, right = df.alias("l"), stats.alias("r")
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = left.join(right, on)
    centred = F.col(f"l.{reward}") - F.col("__mean")
    scale = F.coalesce(F.col("__std"), F.lit(0.0)) + eps
    value = centred / scale if by_std else centred
    return joined.select("l.*", value.alias("advantage"))


def reward_stats(df: DataFrame, by: list[str], reward: str) -> DataFrame:
    """Mean and population std by group of columns."""
    return df.groupBy(*by).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"))


def best_in_group(df: DataFrame, group: list[str], key: str, reward: str) -> DataFrame:
    """The row of the highest reward of each group; of equal ones the lowest key."""
    best = F.min_by(F.struct(key, reward), F.struct((-F.col(reward)).alias("r"), F.col(key)))
    return df.where(F.col(reward).isNotNull()).groupBy(*group).agg(best.alias("b")).select(*group, f"b.{key}", f"b.{reward}")


def expand_rollouts(df: DataFrame, outputs: str, keep: list[str]) -> DataFrame:
    """A row for each output, the prompt's columns repeated."""
    return df.select(*keep, F.posexplode(outputs).alias("output_no", "output"))


def batch_loss(df: DataFrame, by: list[str], loss: str, mask: str, accumulate: int = 1) -> DataFrame:
    """Masked mean over all tokens of a batch (not a mean of means), divided by the accumulation steps."""
    sums = df.groupBy(*by).agg(F.sum(A.masked_sum(F.col(loss), F.col(mask))).alias("__s"), F.sum(A.total(F.col(mask))).alias("__m"))
    return sums.select(*by, (F.try_divide("__s", "__m") / accumulate).alias("loss"))


def running_mass(df: DataFrame, by: list[str], probability: str, ties: list[str]) -> DataFrame:
    """Cumulative probability in descending order, the relational form of top-p; equal ones by the columns `ties`."""
    w = Window.partitionBy(*by).orderBy(F.desc(probability), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mass", F.sum(probability).over(w))


def token_losses(df: DataFrame, by: list[str], loss: str) -> DataFrame:
    """Mean and sum of token losses by group of columns; `loss` is a column of numbers, one a token."""
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("summed_loss"))
