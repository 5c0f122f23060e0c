"""Forecast paths: from origin rows and fitted parameters to one row for each origin and horizon, and to probabilistic rows.

Parameters and states travel as maps beside the origin, so one plan serves all entities and folds.
A horizon without a parameter gives a null forecast, which ``emit`` leaves out; what the model forbids
(an entity that the fit hasn't seen, a state without a level) is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions import distributions
from lawloom.operators.composition import of_component, segment_of
from lawloom.operators.fits import recursive_affine

#: The forms of a fitted candidate that have a forecast path.
FORMS = ("analytic", "recursive", "spectral", "piecewise", "additive_residual", "regime_conditioned", "shared_plus_local")
TAU = 2 * math.pi


def _get(m: Column, key: str | Column) -> Column:
    return F.try_element_at(m, F.lit(key) if isinstance(key, str) else key)


def _key(before: str, h: Column, after: str) -> Column:
    return F.concat(F.lit(before), h.cast("string"), F.lit(after))


def next_affine(m: Column, origin: Column, h: Column, prefix: str = "") -> Column:
    """intercept + lag_coefficient x (...) after h steps; the intercept alone where there is no lag."""
    a, b = F.coalesce(_get(m, f"{prefix}intercept"), F.lit(0.0)), _get(m, f"{prefix}lag_coefficient")
    return F.when(b.isNull(), a).otherwise(recursive_affine(origin, a, b, h))


def direct_path(m: Column, origin: Column, h: Column) -> Column:
    """An affine map of the origin for each horizon; null for a horizon without an intercept."""
    return _get(m, _key("horizon_", h, "__intercept")) + F.coalesce(_get(m, _key("horizon_", h, "__lag_coefficient")), F.lit(0.0)) * origin


def rectified_path(m: Column, origin: Column, h: Column) -> Column:
    """The base recursion plus the horizon's correction."""
    return next_affine(m, origin, h, "rectify_base__") + F.coalesce(_get(m, _key("rectify_horizon_", h, "__intercept")), F.lit(0.0))


def analytic_path(m: Column, origin: Column, h: Column) -> Column:
    """Direct, rectified or recursive, as the parameters' names tell."""
    direct = F.exists(F.map_keys(m), lambda k: F.startswith(k, F.lit("horizon_")))
    return F.when(direct, direct_path(m, origin, h)).when(F.map_contains_key(m, "rectify_base__intercept"), rectified_path(m, origin, h)).otherwise(next_affine(m, origin, h))


def recursive_path(state: Column) -> Column:
    """The fitted level, or else the running mean, at every horizon."""
    return F.coalesce(_get(state, "level"), _get(state, "running_mean"), F.raise_error(F.lit("invalid_recursive_candidate_state")).cast("double"))


def spectral_path(m: Column, state: Column, h: Column, harmonics: list[int], season: int) -> Column:
    """Harmonics at the advancing phase. One harmonic goes by the plain names of its coefficients."""
    phase = F.coalesce(_get(state, "phase_index"), F.lit(0.0)) + h - 1
    out = F.lit(0.0)
    for k in harmonics:
        name = "{}_" + f"{k}_coefficient" if len(harmonics) > 1 else "{}_coefficient"
        angle = F.lit(TAU * k) * F.pmod(phase, F.lit(season)) / season
        out = out + F.coalesce(_get(m, name.format("cosine")), F.lit(0.0)) * F.cos(angle) + F.coalesce(_get(m, name.format("sine")), F.lit(0.0)) * F.sin(angle)
    return out


def piecewise_path(m: Column, origin: Column, h: Column, partition: Column, segments: list[tuple[str, float, float]]) -> Column:
    """The branch is chosen once, by the origin row; its recursion makes all horizons."""
    branch = segment_of(partition, segments)
    part = lambda name: _get(m, F.concat(branch, F.lit(f".{name}")))
    a, b = F.coalesce(part("intercept"), F.lit(0.0)), part("lag_coefficient")
    return F.when(b.isNull(), a).otherwise(recursive_affine(origin, a, b, h))


def additive_residual_path(m: Column, origin: Column, residual_lag: Column, h: Column, base: str, residual: str) -> Column:
    """The base path plus the residual path, which starts from the origin row's lagged residual (0 where missing)."""
    return analytic_path(of_component(base, m), origin, h) + analytic_path(of_component(residual, m), F.coalesce(residual_lag, F.lit(0.0)), h)


def regime_path(m: Column, origin: Column, h: Column, weights: dict[str, Column]) -> Column:
    """Weights of the origin row times the branches' paths."""
    return sum((w * analytic_path(of_component(k, m), origin, h) for k, w in weights.items()), F.lit(0.0))


def hard_switch(value: Column, branches: list[str]) -> dict[str, Column]:
    """Weight 1 for the branch that the origin row names; none named is an error."""
    known = value.isin(branches)
    return {b: F.when(known, (value == b).cast("double")).otherwise(F.raise_error(F.lit("unknown regime")).cast("double")) for b in branches}


def shared_local_path(m: Column, entity: Column, origin: Column, h: Column) -> Column:
    """Shared plus local intercept and slope; an entity without fitted local parameters is an error."""
    own = lambda name: _get(m, F.concat(F.lit(f"{name}__"), entity))
    local = F.coalesce(own("local_adjustment"), F.raise_error(F.concat(F.lit("unseen_entity_rule_violation: "), entity)).cast("double"))
    a = F.coalesce(_get(m, "shared_intercept"), F.lit(0.0)) + local
    shared, adjusted, replaced = _get(m, "shared_lag_coefficient"), own("local_lag_adjustment"), own("local_lag_coefficient")
    b = F.coalesce(replaced, F.coalesce(shared, F.lit(0.0)) + F.coalesce(adjusted, F.lit(0.0)))
    return F.when(shared.isNull() & adjusted.isNull() & replaced.isNull(), a).otherwise(recursive_affine(origin, a, b, h))


def forecast_path(origins: DataFrame, form: str, horizons: int, **options) -> DataFrame:
    """origins: origin_value and parameters (map), as the form needs them also state (map), entity, residual_lag_1. Adds horizon and forecast."""
    h, m, y = F.col("horizon"), F.col("parameters"), F.col("origin_value")
    make = {
        "analytic": lambda: analytic_path(m, y, h), "recursive": lambda: recursive_path(F.col("state")), "spectral": lambda: spectral_path(m, F.col("state"), h, options["harmonics"], options["season"]),
        "piecewise": lambda: piecewise_path(m, y, h, options["partition"], options["segments"]), "additive_residual": lambda: additive_residual_path(m, y, F.col("residual_lag_1"), h, options["base"], options["residual"]),
        "regime_conditioned": lambda: regime_path(m, y, h, options["weights"]), "shared_plus_local": lambda: shared_local_path(m, F.col("entity"), y, h),
    }
    if form not in make:
        raise ValueError(f"unsupported_prediction_candidate: {form}")
    return origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("forecast", make[form]())


def emit(paths: DataFrame, realized: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions with their realised values, origins and horizons that lack a forecast or a realised value, with the reason)."""
    both = paths.join(realized.select(*keys, "realized"), keys, "left")
    reason = F.when(F.col("forecast").isNull(), "missing_forecast").when(F.col("realized").isNull(), "missing_realized_value")
    both = both.withColumn("reason", reason)
    return both.where("reason is null").drop("reason"), both.where("reason is not null").select(*keys, "reason")


def base_scale(loss: Column, n: Column, largest_parameter: Column) -> Column:
    """Scale of a fit that kept no residuals: root mean loss, but at least 0.25 plus a twentieth of the largest parameter."""
    return F.greatest(F.sqrt(loss / n), 0.25 + 0.05 * F.abs(largest_parameter))


def quantile_shift(family: str, level: float, df: float | None = None) -> float:
    """The standard member's quantile at a level, on the driver: levels are few and fixed."""
    return distributions.ppf(family, level, {"location": 0.0, "scale": 1.0} | ({"df": df} if df else {}))


def probabilistic_rows(paths: DataFrame, kind: str, family: str = "gaussian", levels: tuple[float, ...] = (), threshold: float | None = None, operator: str = "greater_than", df: float | None = None) -> DataFrame:
    """paths: forecast and scale of each row. kind: distribution, interval (levels: coverages), quantile (levels) or event_probability (threshold).

    One row for each level, all native: the levels' standard quantiles are literals.
    """
    at, scale = F.col("forecast"), F.col("scale")
    if kind == "distribution":
        return paths.withColumn("family", F.lit(family)).withColumn("location", at)
    if kind == "event_probability":
        return paths.withColumn("event_probability", event_probability(family, at, scale, threshold, operator, df))
    if kind == "interval":
        z = F.array(*(F.struct(F.lit(c).alias("level"), F.lit(quantile_shift(family, 0.5 - c / 2, df)).alias("lo"), F.lit(quantile_shift(family, 0.5 + c / 2, df)).alias("hi")) for c in levels))
        out = paths.withColumn("_z", F.explode(z))
        return out.withColumn("nominal_coverage", F.col("_z.level")).withColumn("lower_bound", at + scale * F.col("_z.lo")).withColumn("upper_bound", at + scale * F.col("_z.hi")).drop("_z")
    if kind == "quantile":
        z = F.array(*(F.struct(F.lit(q).alias("level"), F.lit(quantile_shift(family, q, df)).alias("z")) for q in levels))
        out = paths.withColumn("_z", F.explode(z))
        return out.withColumn("level", F.col("_z.level")).withColumn("quantile", at + scale * F.col("_z.z")).drop("_z")
    raise ValueError(f"unsupported forecast object: {kind}")


def event(value: Column, operator: str, threshold: float) -> Column:
    """Whether the event happened: greater_than, greater_than_or_equal, less_than or less_than_or_equal the threshold."""
    compare = {"greater_than": value > threshold, "greater_than_or_equal": value >= threshold, "less_than": value < threshold, "less_than_or_equal": value <= threshold}
    if operator not in compare:
        raise ValueError(f"unknown event operator: {operator}")
    return compare[operator]


def event_probability(family: str, location: Column, scale: Column, threshold: float, operator: str, df: float | None = None) -> Column:
    """The distribution's mass on the event's side (no correction for a point mass at the threshold)."""
    y = F.lit(threshold)
    if family == "gaussian":
        below = distributions.normal_cdf((y - location) / scale)
    elif family == "laplace":
        below = distributions.laplace_cdf(y, location, scale)
    else:
        names = {"location": location, "scale": scale} | ({"df": F.lit(df)} if df else {})
        below = distributions.cdf_column(F.lit(family), y, F.create_map(*(x for k, v in names.items() for x in (F.lit(k), v))))
    return 1 - below if operator.startswith("greater") else below


def last_value_baseline(paths: DataFrame) -> DataFrame:
    """The same rows around the origin's own value: location moves, the scale stays."""
    return paths.withColumn("forecast", F.col("origin_value"))
