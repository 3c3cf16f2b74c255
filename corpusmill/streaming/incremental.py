"""Streams of rollouts and lines. An extension: Spark's own operators, no counterpart to be matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rewards(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rewards by window of logged_at: rows delivered twice count once, rows later than `late` are dropped."""
    once = stream.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["rollout_id"])
    return once.groupBy(F.window("logged_at", width).alias("w")).agg(
        F.count("reward").alias("n"), F.avg("reward").alias("mean_reward")
    ).select(F.col("w.start").alias("start"), "n", "mean_reward")


def append_batches(stream: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Every micro-batch's rows as JSON lines, exactly once by the sink's log."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
