"""Composed models: piecewise, additive, regime-weighted and shared-local, at forecast time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.operators.fits import recursive_affine


def segment_of(value: Column, segments: list[tuple[str, float, float]]) -> Column:
    """Half-open [start, end); the last one is closed within 1e-12. Outside all: an error."""
    out = None
    for i, (name, lo, hi) in enumerate(segments):
        inside = (value >= lo) & ((value <= hi + 1e-12) if i == len(segments) - 1 else (value < hi))
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out.when(value.isNotNull(), F.raise_error(F.lit("unmatched piecewise segment")).cast("string"))


def regime_weights(columns: dict[str, Column]) -> dict[str, Column]:
    """Convex weights divided by their sum."""
    total = sum(columns.values(), F.lit(0.0))
    return {k: c / total for k, c in columns.items()}


def paths(origins: DataFrame, parameters: DataFrame, on: list[str], horizons: int) -> DataFrame:
    """Affine recursion from each origin: one row for each step (origins: origin_value; parameters: intercept, slope)."""
    out = origins.join(parameters, on).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    return out.withColumn("forecast", recursive_affine(F.col("origin_value"), F.col("intercept"), F.col("slope"), F.col("horizon")))


def regime_paths(branch_paths: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight times branch forecast; weights are fixed at the origin row."""
    j = branch_paths.join(weights, [k for k in [*keys, "branch"] if k in weights.columns])
    return j.groupBy(*keys, "horizon").agg(F.sum(F.col("weight") * F.col("forecast")).alias("forecast"))


def prefixed(component: str, mapping: Column) -> Column:
    """A component's map with its name before each key."""
    return F.transform_keys(mapping, lambda k, _: F.concat(F.lit(component + "."), k))


def of_component(component: str, mapping: Column) -> Column:
    """The entries of one component, names without the prefix."""
    own = F.map_filter(mapping, lambda k, _: F.startswith(k, F.lit(component + ".")))
    return F.transform_keys(own, lambda k, _: F.substr(k, F.lit(len(component) + 2)))


def spectral_path(origin_index: Column, horizon: Column, cosine: Column, sine: Column, harmonic: Column, season: int) -> Column:
    phase = F.lit(6.283185307179586) * harmonic * (origin_index + horizon) / season
    return cosine * F.cos(phase) + sine * F.sin(phase)
