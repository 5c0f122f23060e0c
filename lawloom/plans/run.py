"""One run from observations to a claim: snapshot, audit, features by position, folds, fits, codes, scores, gates.

Row-level tables stay distributed; the driver sees one row per family at each decision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.functions import coding
from lawloom.operators import fits, folds, gates, inference, robustness, scoring, selection, snapshot


@dataclass(frozen=True)
class Request:
    """What to run. Weights are decimal texts that sum to 1; the step is the quantiser's."""

    cutoff: str | None = None
    min_train: int = 5
    horizon: int = 1
    loss: str = "absolute_error"
    weights: tuple[str, ...] | None = None
    step: str = "0.5"
    baseline: str = "constant"
    margin: float = 0.0
    max_lag: int = 4
    surrogates: int = 19
    seed: str = "0"


@dataclass
class Robustness:
    """Outcome of the null comparison, the perturbations and the canaries of a run."""

    status: str
    null: str
    p_value: float | None
    perturbations: dict[str, str]
    canaries: dict[str, str]
    reasons: list[str]


@dataclass
class Result:
    winner: str | None
    claim: dict
    scorecard: dict
    scores: dict[str, float]
    gains: dict[str, int]
    reasons: list[str] = field(default_factory=list)
    robustness: Robustness | None = None
    falsification: str = "passed"


def robust(snap: DataFrame, rows: DataFrame, family: str, request: Request) -> Robustness:
    """Null, perturbations and canaries of a family on a run's rows."""
    weights = folds.horizon_weights(request.horizon, list(request.weights) if request.weights else None)
    null = robustness.surrogate_null(rows, family, request.step, request.surrogates, request.seed).first()
    development = lambda r: scoring.primary_score(losses(r, request).where("role = 'development'"), ["family"], weights).select("family", "score")
    runs = robustness.perturbation_runs(rows.select("entity", "idx", "event_time", "target"), family, request.baseline, request.step, development)
    judged = {r["perturbation"]: r["status"] for r in robustness.judged(runs).collect()}
    canaries = robustness.canaries(snap, folds.evaluation_plan(rows, request.min_train, request.horizon), request.cutoff)
    stability = "abstained" if not judged else "failed" if "failed" in judged.values() else "passed"
    status, reasons = robustness.final_status(null["status"] if null else "abstained", stability, canaries)
    return Robustness(status, null["status"] if null else "abstained", null["p_value"] if null else None, judged, canaries, reasons)


def losses(rows: DataFrame, request: Request) -> DataFrame:
    """Loss of each scored origin, horizon and certified family."""
    plan = folds.evaluation_plan(rows, request.min_train, request.horizon)
    pred = fits.family_forecasts(fits.expanding_fits(rows), request.horizon).withColumnRenamed("step", "horizon")
    scored = folds.scored_origins(plan, rows).join(pred, ["entity", "origin_index", "horizon"])
    return scored.withColumn("loss", scoring.point_loss(request.loss, F.col("forecast"), F.col("realized")))


def run(observations: DataFrame, request: Request = Request()) -> Result:
    """observations: entity, event_time, available_at, target (and revision_id)."""
    snap = snapshot.freeze_snapshot(observations, request.cutoff)
    rows = snapshot.indexed(snap).select("entity", "idx", "event_time", "target")
    late = observations.where(F.col("event_time") > F.col("available_at")).limit(1).count() > 0
    coded = coding.description_gain(fits.fitted_values(rows), rows, request.step)
    gains = {r["family"]: int(r["g"]) for r in coded.groupBy("family").agg(F.sum("gain_bits").alias("g")).collect()}
    table = losses(rows, request)
    weights = folds.horizon_weights(request.horizon, list(request.weights) if request.weights else None)
    development = scoring.primary_score(table.where("role = 'development'"), ["family"], weights)
    scores = {r["family"]: r["score"] for r in development.collect()}
    final = {r["family"]: r["score"] for r in scoring.primary_score(table.where("role = 'confirmatory_holdout'"), ["family"], weights).collect()}
    admitted = [f for f in scores if gains.get(f, 0) > 0 and f != request.baseline]
    winner = min(admitted, key=lambda f: (scores[f], f), default=None)
    if winner is None:
        card = gates.scorecard(admissible=False, robustness="not_evaluated", beats_baseline=False, promotion_allowed=False, comparison="comparable", time_safety="passed", calibration="not_applicable_for_forecast_type", reasons=["description_gain_below_floor"])
        return Result(None, gates.claim(card), {k: d.status for k, d in card.items()}, scores, gains, card["descriptive"].reason_codes)
    keys = ["entity", "origin_index", "horizon"]
    diffs = scoring.paired_differentials(table.where(F.col("family") == winner), table.where(F.col("family") == request.baseline), keys)
    comparison = scoring.same_keys(table.where(F.col("family") == winner), table.where(F.col("family") == request.baseline), keys).first()["status"]
    one = diffs.where("horizon = 1").groupBy("origin_index").agg(F.avg("loss_difference").alias("loss_difference")).withColumn("all", F.lit("all"))
    test = inference.hac_mean_test(one, ["all"], "origin_index", "loss_difference", request.max_lag).first()
    own = robust(snap, rows, winner, request)
    findings = gates.dossier([{"reason_codes": own.reasons}] if own.reasons else [])
    n_eff = inference.effective_sample_size(one, ["all"], "origin_index", "loss_difference", request.max_lag).first()
    promoted = gates.promotion(test["mean"], (test["lower"], test["upper"]), request.margin, test["n"], n_eff["n_eff"])
    card = gates.scorecard(
        admissible=True, robustness=own.status, reasons=own.reasons, falsification=findings.status, beats_baseline=final[winner] < final[request.baseline], promotion_allowed=promoted.status == "passed", comparison=comparison,
        time_safety="blocked" if late else "passed", calibration="not_applicable_for_forecast_type",
    )
    return Result(winner, gates.claim(card), {k: d.status for k, d in card.items()}, scores, gains, promoted.reason_codes, own, findings.status)


def finalists(observations: DataFrame, request: Request = Request()) -> DataFrame:
    """Ranked families of each entity by code length."""
    rows = snapshot.indexed(snapshot.freeze_snapshot(observations, request.cutoff))
    c = coding.description_gain(fits.fitted_values(rows), rows, request.step).withColumn("structure_bits", F.lit(0)).withColumn("candidate_id", F.col("family"))
    return selection.ranked(c.where("admitted"), ["entity"])
