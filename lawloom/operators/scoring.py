"""Losses, their aggregation over horizons and entities, and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_loss(loss_id: str, forecast: Column, realized: Column) -> Column:
    if loss_id == "squared_error":
        return (forecast - realized) * (forecast - realized)
    if loss_id == "absolute_error":
        return F.abs(forecast - realized)
    raise ValueError(f"unsupported point loss: {loss_id}")


def interval_score(coverage: Column, lower: Column, upper: Column, observed: Column) -> Column:
    """Width plus 2/alpha times what the observation lies outside by."""
    penalty = F.when(observed < lower, lower - observed).when(observed > upper, observed - upper).otherwise(0.0)
    return (upper - lower) + F.lit(2.0) / (1 - coverage) * penalty


def pinball_loss(level: Column, quantile: Column, observed: Column) -> Column:
    return F.when(observed >= quantile, level * (observed - quantile)).otherwise((1 - level) * (quantile - observed))


def brier_score(probability: Column, event: Column) -> Column:
    d = probability - event.cast("double")
    return d * d


def event_log_score(probability: Column, event: Column) -> Column:
    """-log p or -log(1-p); infinite where the forecast was certain and wrong."""
    p = probability
    hit = F.when(p <= 0, F.lit(float("inf"))).otherwise(-F.log(F.when(p > 0, p)))
    miss = F.when(p >= 1, F.lit(float("inf"))).otherwise(-F.log1p(-F.when(p < 1, p)))
    return F.when(event, hit).otherwise(miss)


def objective(objective_id: str, residual: Column, delta: float = 1.0, scale: float = 1.0) -> Column:
    """Row loss of a fit: squared, absolute, huber or gaussian_nll."""
    if objective_id == "squared":
        return residual * residual
    if objective_id == "absolute":
        return F.abs(residual)
    if objective_id == "huber":
        a = F.abs(residual)
        return F.when(a <= delta, 0.5 * residual * residual).otherwise(delta * (a - 0.5 * delta))
    if objective_id == "gaussian_nll":
        import math

        return F.lit(0.5 * math.log(2 * math.pi * scale * scale)) + residual * residual / (2 * scale * scale)
    raise ValueError(f"unknown objective: {objective_id}")


def horizon_means(losses: DataFrame, by: list[str]) -> DataFrame:
    """Mean loss and number of origins of each horizon."""
    return losses.groupBy(*by, "horizon").agg(F.count("*").alias("n_origins"), F.avg("loss").alias("mean_loss"))


def primary_score(losses: DataFrame, by: list[str], weights: list) -> DataFrame:
    """Single-entity mode: horizon means, rounded to 12 places, then their weighted sum."""
    w = F.create_map(*(x for h, v in enumerate(weights, 1) for x in (F.lit(h), F.lit(float(v)))))
    m = horizon_means(losses, by).withColumn("mean_loss", F.round("mean_loss", 12))
    return m.groupBy(*by).agg(F.sum(F.element_at(w, F.col("horizon")) * F.col("mean_loss")).alias("score"), F.min("n_origins").alias("n_origins"))


def entity_weighted_score(losses: DataFrame, by: list[str], weights: list, entity_weights: DataFrame) -> DataFrame:
    """Entity mode: each entity's weighted horizon means, then their weighted sum (entity_weights: entity, entity_weight)."""
    w = F.create_map(*(x for h, v in enumerate(weights, 1) for x in (F.lit(h), F.lit(float(v)))))
    m = horizon_means(losses, [*by, "entity"])
    own = m.groupBy(*by, "entity").agg(F.sum(F.element_at(w, F.col("horizon")) * F.col("mean_loss")).alias("own"))
    return own.join(entity_weights, "entity").groupBy(*by).agg(F.sum(F.col("entity_weight") * F.col("own")).alias("score"))


def guarded_panel(predictions: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Comparable, or why not: missing or extra rows, non-finite forecasts (one row, status and reasons)."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(predictions.withColumn("_p", F.lit(1)), keys, "full")
    bad = F.isnan("forecast") | F.col("forecast").isin(float("inf"), float("-inf"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    out = both.agg(n(F.col("_p").isNull()).alias("missing"), n(F.col("_e").isNull()).alias("extra"), n(F.coalesce(bad, F.lit(False))).alias("nonfinite"))
    reasons = F.array_compact(F.array(F.when(F.col("missing") > 0, "missing_rows"), F.when(F.col("extra") > 0, "extra_rows"), F.when(F.col("nonfinite") > 0, "nonfinite_forecast")))
    return out.withColumn("reason_codes", reasons).withColumn("status", F.when(F.size("reason_codes") == 0, "comparable").otherwise("not_comparable"))


def paired_differentials(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys: loss_difference = baseline - candidate, positive is good."""
    c = candidate.select(*keys, F.col("loss").alias("candidate_loss"))
    b = baseline.select(*keys, F.col("loss").alias("baseline_loss"))
    return c.join(b, keys).withColumn("loss_difference", F.col("baseline_loss") - F.col("candidate_loss"))


def same_keys(candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two panels have the same keys (one row): a full outer join counts what is on one side only."""
    c = candidate.select(*keys).distinct().withColumn("_c", F.lit(1))
    b = baseline.select(*keys).distinct().withColumn("_b", F.lit(1))
    out = c.join(b, keys, "full").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum((F.col("_c").isNull() | F.col("_b").isNull()).cast("long")), F.lit(0)).alias("n_unmatched"))
    return out.withColumn("status", F.when(F.col("n_unmatched") == 0, "comparable").otherwise("not_comparable"))


def practical_significance(mean_difference: Column, margin: float) -> Column:
    return F.when(mean_difference > margin, "candidate_better_than_margin").when(mean_difference < -margin, "candidate_worse_than_margin").otherwise("within_margin")


def group_means(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Mean difference by each column of ``by`` apart, in one pass of grouping sets: dimension, level, mean_loss_difference."""
    sets = diffs.select(F.explode(F.array(*(F.struct(F.lit(b).alias("dimension"), F.col(b).cast("string").alias("level")) for b in by))).alias("g"), "loss_difference")
    return sets.groupBy("g.dimension", "g.level").agg(F.count("*").alias("n"), F.avg("loss_difference").alias("mean_loss_difference"))


def rolling_degradation(diffs: DataFrame, order: list[str], by: list[str], window: int) -> DataFrame:
    """Trailing means over full windows; degraded where the latest difference is negative."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = diffs.withColumn("_n", F.row_number().over(w)).withColumn("mean_loss_difference", F.avg("loss_difference").over(w.rowsBetween(-(window - 1), 0)))
    return out.where(F.col("_n") >= window).drop("_n").withColumn("status", F.when(F.col("loss_difference") < 0, "degraded").otherwise("stable"))


def mean_interval(diffs: DataFrame, by: list[str]) -> DataFrame:
    """mean +- 1.96 s / sqrt(n)."""
    m = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("loss_difference").alias("mean_difference"), F.stddev_samp("loss_difference").alias("_s"))
    r = 1.96 * F.col("_s") / F.sqrt("n")
    return m.withColumn("lower", F.col("mean_difference") - r).withColumn("upper", F.col("mean_difference") + r).drop("_s")


def residual_summary(residuals: DataFrame, by: list[str]) -> DataFrame:
    return residuals.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("horizon").alias("n_horizons"), F.avg("residual").alias("mean_residual"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))


def residual_flags(rows: DataFrame) -> DataFrame:
    """Reasons why a residual row is invalid, as a sorted array; valid rows have none."""
    checks = {
        "nonfinite_residual": F.isnan("residual") | F.col("residual").isNull() | F.col("residual").isin(float("inf"), float("-inf")),
        "horizon_geometry_mismatch": F.col("target_index") != F.col("origin_index") + F.col("horizon"),
        "residual_mismatch": F.abs(F.col("realized") - F.col("forecast") - F.col("residual")) > 1e-9,
    }
    return rows.withColumn("reason_codes", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in sorted(checks.items())))))
