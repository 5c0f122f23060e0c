"""Extension: running point-in-time snapshots and level smoothing over a stream of observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_snapshot(obs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Latest revision of each (entity, event_time) of a stream; state older than the watermark on event_time goes."""
    order = F.struct("available_at", "revision_id")
    return obs.withWatermark("event_time", delay).groupBy("entity", "event_time").agg(F.max_by("target", order).alias("target"), F.max("available_at").alias("available_at"))


def windowed_totals(obs: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Sums by entity and tumbling window of event_time; rows later than the watermark are dropped, as a stream must."""
    return obs.withWatermark("event_time", delay).groupBy("entity", F.window("event_time", width)).agg(F.sum("target").alias("target"), F.count("*").alias("n")).select("entity", F.col("window.start").alias("event_time"), "target", "n")


def streaming_level(obs: DataFrame, alpha: float) -> DataFrame:
    """Exponential level of each entity in arrival order, state carried from batch to batch: entity, n, level."""

    def update(key, frames, state):
        n, level = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["event_time", "revision_id"])
        for y in rows["target"].dropna():
            level = float(y) if n == 0 else level + alpha * (float(y) - level)
            n += 1
        state.update((n, level))
        yield pd.DataFrame({"entity": [key[0]], "n": [n], "level": [level]})

    return obs.groupBy("entity").applyInPandasWithState(update, "entity string, n long, level double", "n long, level double", "update", "NoTimeout")
