"""Walk-forward folds, scored origins and training-origin panels as index tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_horizon_weights(horizons: int) -> list[Decimal]:
    """1/H at 12 places; the remainder goes to the last."""
    each = (Decimal(1) / horizons).quantize(Decimal("1e-12"))
    return [each] * (horizons - 1) + [1 - each * (horizons - 1)]


def horizon_weights(horizons: int, given: list[str] | None = None) -> list[Decimal]:
    """Exact weights that are non-negative and sum to one."""
    weights = default_horizon_weights(horizons) if given is None else [Decimal(x) for x in given]
    if len(weights) != horizons or any(w < 0 for w in weights) or sum(weights) != 1:
        raise ValueError("horizon weights must be one for each horizon, non-negative and sum to 1")
    return weights


def evaluation_plan(indexed: DataFrame, min_train: int, horizon: int) -> DataFrame:
    """One row for each fold, entity and horizon 1..H. Every entity has the folds of the shortest; the last fold is confirmatory."""
    if min_train < 1 or horizon < 1:
        raise ValueError("min_train and horizon are positive")
    sizes = indexed.groupBy("entity").agg(F.count("*").alias("n"))
    aligned = sizes.agg(F.min("n").alias("aligned"))
    plan = sizes.select("entity").crossJoin(F.broadcast(aligned)).where(F.col("aligned") >= min_train + horizon)
    plan = plan.withColumn("train_end", F.explode(F.sequence(F.lit(min_train).cast("long"), F.col("aligned") - horizon)))
    plan = plan.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    role = F.when(F.col("train_end") + horizon == F.col("aligned"), "confirmatory_holdout").otherwise("development")
    return plan.select((F.col("train_end") - min_train).alias("fold"), role.alias("role"), "entity", (F.col("train_end") - 1).alias("origin_index"), "horizon", (F.col("train_end") + F.col("horizon") - 1).alias("target_index"))


def scored_origins(plan: DataFrame, indexed: DataFrame) -> DataFrame:
    """The plan with the origin's and the target's values, by two equi-joins on positions."""
    at = lambda c, o: indexed.select("entity", F.col("idx").alias(c), F.col("target").alias(o))
    return plan.join(at("origin_index", "origin_value"), ["entity", "origin_index"]).join(at("target_index", "realized"), ["entity", "target_index"])


def training_origin_panel(indexed: DataFrame, train_end: int, horizons: list[int]) -> DataFrame:
    """Origins of a training slice with all horizons inside it; a gap in the positions empties the panel."""
    inside = indexed.where(F.col("idx") < train_end)
    origins = inside.select("entity", F.col("idx").alias("origin_index"), F.col("target").alias("origin_value")).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    origins = origins.withColumn("target_index", F.col("origin_index") + F.col("horizon")).where(F.col("origin_index") + max(horizons) < train_end)
    targets = inside.select("entity", F.col("idx").alias("target_index"), F.col("target").alias("realized"))
    panel = origins.join(targets, ["entity", "target_index"], "left")
    gaps = panel.agg(F.sum(F.col("realized").isNull().cast("int")).alias("_gaps"))
    return panel.crossJoin(F.broadcast(gaps)).where("_gaps = 0").drop("_gaps")


def segment_training_rows(indexed: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of each entity at positions start <= idx < end."""
    return indexed.where((F.col("idx") >= start) & (F.col("idx") < end))


def recent_history_start(train_end: int, fraction: float) -> int:
    """First row of the recent fraction of a training slice."""
    return max(0, train_end - max(1, int(train_end * fraction)))
