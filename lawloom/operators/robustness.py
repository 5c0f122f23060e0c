"""Null comparison, perturbations and leakage canaries of a run: tables of runs, then one row for each decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions import coding
from lawloom.operators import falsification, fits

#: The canaries that a run must have.
CANARIES = ("future_target_level_feature", "late_available_target_copy", "holdout_membership_feature", "post_cutoff_revision_level_feature")
#: Retained rates that a perturbation family must reach.
THRESHOLDS = {"match_rate": 0.5, "gain_rate": 0.5, "win_rate": 0.5}


def shuffled(rows: DataFrame, count: int, seed: str) -> DataFrame:
    """``count`` seeded permutations of each series: the values keep their entity and get another position. Adds ``surrogate``."""
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    out = rows.select("entity", "idx", "target").withColumn("surrogate", k)
    place = Window.partitionBy("entity", "surrogate").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col("surrogate").cast("string"), F.col("idx").cast("string")), 256), "idx")
    return out.withColumn("idx", (F.row_number().over(place) - 1).cast("long"))


def gains(rows: DataFrame, step: str, by: list[str]) -> DataFrame:
    """gain_bits of each family, summed over the series that ``by`` (columns besides entity) tells apart."""
    key = F.concat_ws("#", F.col("entity"), *(F.col(c).cast("string") for c in by))
    own = rows.withColumn("series", key)
    series = own.select(F.col("series").alias("entity"), "idx", "target")
    names = own.select(F.col("series").alias("entity"), *by).distinct()
    return coding.description_gain(fits.fitted_values(series), series, step).join(names, "entity").groupBy("family", *by).agg(F.sum("gain_bits").alias("gain_bits"))


def surrogate_null(rows: DataFrame, family: str, step: str, count: int = 19, seed: str = "0", limit: float = 0.05) -> DataFrame:
    """One row: the family's description gain against those of permuted series."""
    observed = gains(rows, step, []).where(F.col("family") == family).select("family", F.col("gain_bits").alias("observed"))
    null = gains(shuffled(rows, count, seed), step, ["surrogate"]).where(F.col("family") == family).select("family", F.col("gain_bits").alias("statistic"))
    return falsification.null_p_value(observed, null, ["family"], limit).join(observed, "family")


def recent_history(rows: DataFrame, fraction: float, least: int = 3) -> DataFrame:
    """The last part of each series, numbered anew."""
    n = F.count("*").over(Window.partitionBy("entity"))
    keep = F.greatest(F.lit(least), F.floor(n * fraction))
    out = rows.withColumn("_n", n).withColumn("_k", keep).where(F.col("idx") >= F.col("_n") - F.col("_k"))
    return out.withColumn("idx", (F.col("idx") - F.greatest(F.col("_n") - F.col("_k"), F.lit(0))).cast("long")).drop("_n", "_k")


def coarsened(rows: DataFrame, step: str, multiplier: int) -> DataFrame:
    """Targets on a coarser lattice."""
    from decimal import Decimal

    wide = str(Decimal(step) * multiplier)
    return rows.withColumn("target", coding.representative(coding.quantize_index(F.col("target"), wide), wide))


def perturbation_runs(rows: DataFrame, family: str, baseline: str, step: str, losses: Callable[[DataFrame], DataFrame], fractions=(0.75, 0.5), multipliers=(2, 4)) -> DataFrame:
    """One row for each perturbed run: perturbation, run, canonical_match, gain_bits, beats_baseline.

    losses: rows of a series table -> (family, score). A run matches where the family would still be the best of those that gain.
    """
    out = None
    for kind, values, change in (("recent_history_truncation", fractions, lambda r, v: recent_history(r, v)), ("quantization_coarsening", multipliers, lambda r, v: coarsened(r, step, v))):
        for v in values:
            own = change(rows, v)
            table = gains(own, step, []).join(losses(own), "family")
            best = table.where((F.col("gain_bits") > 0) & (F.col("family") != baseline)).agg(F.min_by("family", F.struct("score", "family")).alias("best"))
            base = table.where(F.col("family") == baseline).agg(F.min("score").alias("base"))
            one = table.where(F.col("family") == family).crossJoin(F.broadcast(best)).crossJoin(F.broadcast(base))  # three single rows
            one = one.select(F.lit(kind).alias("perturbation"), F.lit(str(v)).alias("run"), F.coalesce(F.col("best") == F.col("family"), F.lit(False)).alias("canonical_match"), "gain_bits", (F.col("score") < F.col("base")).alias("beats_baseline"))
            out = one if out is None else out.unionByName(one)
    return out


def judged(runs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Retained rates of each perturbation and whether they reach the thresholds."""
    limits = THRESHOLDS if thresholds is None else thresholds
    r = falsification.perturbation_rates(runs, ["perturbation"])
    ok = F.lit(True)
    for name, limit in limits.items():
        ok = ok & (F.col(name) >= limit)
    return r.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def _count(found: DataFrame, what: Column) -> int:
    return found.where(what).limit(1).count()


def canaries(snap: DataFrame, plan: DataFrame, cutoff: str | None = None) -> dict[str, str]:
    """Each canary passes if its leak doesn't get through. snap: the frozen snapshot; plan: entity, role, origin_index, horizon.

    A target copy that was known only after the cutoff must not be in the snapshot, nor a second
    revision of a row beside the first; no row may be scored in development and in the holdout, and no
    plan row may look at its own time or earlier as its target.
    """
    late = _count(snap, F.col("available_at") > F.lit(cutoff)) if cutoff is not None and "available_at" in snap.columns else 0
    revised = _count(snap.groupBy("entity", "event_time").agg(F.count("*").alias("n")), F.col("n") > 1)
    roles = plan.groupBy("entity", "origin_index", "horizon").agg(F.count_distinct("role").alias("roles"))
    found = {"future_target_level_feature": _count(plan, F.col("horizon") < 1), "late_available_target_copy": late, "holdout_membership_feature": _count(roles, F.col("roles") > 1), "post_cutoff_revision_level_feature": revised}
    return {k: "failed" if found[k] else "passed" for k in CANARIES}


def final_status(null: str, stability: str, canary: dict[str, str]) -> tuple[str, list[str]]:
    """passed, abstained or failed, with the reasons. A null that isn't rejected is no failure."""
    reasons = [f"{k}_canary_failed" for k, s in sorted(canary.items()) if s != "passed"]
    reasons += ["canary_coverage_incomplete"] * (sorted(canary) != sorted(CANARIES))
    reasons += ["perturbation_failed"] * (stability == "failed") + ["null_comparison_failed"] * (null == "failed")
    if reasons:
        return "failed", reasons
    return ("abstained", []) if "abstained" in (null, stability) else ("passed", [])
