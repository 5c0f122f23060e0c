"""Decisions on collected scalars: scorecards, claims, dossiers, readiness. Plain functions of dictionaries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

#: Claim lanes from the lowest.
LANES = ("descriptive_structure", "predictively_supported", "mechanistically_compatible_hypothesis")


@dataclass
class Decision:
    status: str
    reason_codes: list[str] = field(default_factory=list)


def unique(codes: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(codes))


def descriptive(admissible: bool, robustness: str, reasons: Iterable[str] = ()) -> Decision:
    if not admissible:
        return Decision("failed", unique(reasons) or ["candidate_not_admissible"])
    return Decision("passed") if robustness in ("passed", "null_not_rejected") else Decision("failed", unique(reasons) or ["robustness_failed"])


def predictive(base: Decision, beats_baseline: bool, promotion_allowed: bool, comparison: str, time_safety: str, calibration: str, falsification: str = "passed") -> Decision:
    """Needs a passed descriptive gate; every unmet condition gives its reason."""
    if base.status != "passed":
        return Decision("blocked", ["descriptive_gate_not_passed"])
    checks = [
        (time_safety == "passed", "time_safety_blocked"), (comparison == "comparable", "scores_not_comparable"), (beats_baseline, "baseline_rule_failed"),
        (promotion_allowed, "confirmatory_promotion_not_allowed"), (calibration in ("passed", "not_applicable_for_forecast_type"), "calibration_failed"), (falsification == "passed", "falsification_failed"),
    ]
    reasons = [r for ok, r in checks if not ok]
    return Decision("failed" if reasons else "passed", reasons)


def mechanistic(base: Decision, requested: bool, evidence: str | None) -> Decision:
    if not requested:
        return Decision("not_requested")
    if base.status != "passed":
        return Decision("blocked", ["predictive_gate_not_passed"])
    return Decision("passed") if evidence == "passed" else Decision("failed", ["mechanistic_evidence_missing"])


def scorecard(**facts) -> dict[str, Decision]:
    d = descriptive(facts["admissible"], facts["robustness"], facts.get("reasons", ()))
    p = predictive(d, facts["beats_baseline"], facts["promotion_allowed"], facts["comparison"], facts["time_safety"], facts["calibration"], facts.get("falsification", "passed"))
    return {"descriptive": d, "predictive": p, "mechanistic": mechanistic(p, facts.get("mechanistic_requested", False), facts.get("mechanistic_evidence"))}


def claim(card: dict[str, Decision]) -> dict:
    """The highest lane whose gates passed, or an abstention with the descriptive reasons."""
    if card["descriptive"].status != "passed":
        return {"publication_mode": "abstention_only_publication", "claim_type": None, "reason_codes": card["descriptive"].reason_codes, "blocked_ceiling": LANES[0]}
    level = 0 if card["predictive"].status != "passed" else 2 if card["mechanistic"].status == "passed" else 1
    return {"publication_mode": "candidate_publication", "claim_type": LANES[level], "reason_codes": [], "blocked_ceiling": None}


def promotion_allowed(beats_baseline: bool, calibration_required: bool, calibration: str, test_required: bool, test: str) -> bool:
    return beats_baseline and (not calibration_required or calibration == "passed") and (not test_required or test == "passed")


def promotion(mean_difference: float, interval: tuple[float, float] | None, margin: float, n: int, n_eff: float, minimum: int = 25) -> Decision:
    """Whether a loss difference supports promotion: abstain on too little data, else all reasons against."""
    if n == 0:
        return Decision("abstained", ["no_pairs"])
    if n_eff < minimum:
        return Decision("abstained", ["effective_sample_size_below_minimum"])
    reasons = []
    if abs(mean_difference) <= 1e-12:
        reasons.append("baseline_tie")
    if mean_difference <= margin:
        reasons.append("insignificant_improvement")
    if interval is not None and interval[0] <= margin:
        reasons.append("uncertainty_interval_crosses_margin")
    return Decision("failed" if reasons else "passed", reasons)


def dossier(findings: Iterable[dict], transport: str = "not_requested", calibration: str = "not_applicable_for_forecast_type") -> Decision:
    """blocked over failed over passed. A finding has reason_codes and claim_effect."""
    found = list(findings)
    reasons = [r for f in found for r in f.get("reason_codes", ())]
    reasons += ["transport_failed"] if transport == "failed" else []
    reasons += ["stochastic_miscalibration"] if calibration in ("failed", "coverage_failed", "poor_coverage") else []
    if any(f.get("claim_effect") == "block_claim" for f in found) or "domain_violation" in reasons:
        return Decision("blocked", unique(reasons))
    return Decision("failed" if reasons else "passed", unique(reasons))


def robustness(null: str, perturbation: Iterable[str], canaries: Iterable[str]) -> Decision:
    """A null that isn't rejected still passes; failed perturbations or canaries don't."""
    reasons = ["perturbation_failed"] * any(s == "failed" for s in perturbation) + ["leakage_canary_failed"] * any(s == "failed" for s in canaries)
    return Decision("failed" if reasons else "passed", reasons + (["null_not_rejected"] if null == "null_not_rejected" else []))


def readiness(gates: dict[str, tuple[str, bool]], required: Iterable[str] = ()) -> Decision:
    """gates: id -> (status, required). blocked by failed or missing required gates, review_required by optional ones."""
    have = dict(gates) | {g: ("missing", True) for g in required if g not in gates}
    bad = {g: r for g, (s, r) in sorted(have.items()) if s in ("failed", "missing")}
    verdict = "blocked" if any(bad.values()) else "review_required" if bad else "ready"
    return Decision(verdict, [f"{g}_{have[g][0]}" for g in bad])


def comparison_universe(candidate: tuple[str, float], baseline: tuple[str, float], candidate_key: dict, baseline_key: dict, margin: float | None = None, pairs: Iterable[dict] = ()) -> dict:
    """Candidate and baseline (id, score) that were scored on the same geometry; keys that differ are an error."""
    differs = sorted(k for k in candidate_key.keys() | baseline_key.keys() if candidate_key.get(k) != baseline_key.get(k))
    if differs:
        raise ValueError(f"comparison_key_mismatch: {', '.join(differs)}")
    difference = baseline[1] - candidate[1]
    return {"candidate_id": candidate[0], "baseline_id": baseline[0], "candidate_score": candidate[1], "baseline_score": baseline[1], "comparison_key": dict(candidate_key), "practical_margin": margin, "beats_baseline": difference > (margin or 0.0), "paired_records": list(pairs)}


def manifest_digest(body: dict) -> str:
    import hashlib
    import json

    return "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def reproducibility_bundle(run_id: str, artifacts: dict[str, str], seeds: dict[str, str], environment: dict[str, str], outcome: dict) -> dict:
    """What a replay needs: artifact digests, seeds, environment, and the digest of the outcome that it must reach."""
    body = {"run_id": run_id, "artifacts": dict(sorted(artifacts.items())), "seeds": dict(sorted(seeds.items())), "environment": dict(sorted(environment.items())), "outcome_digest": manifest_digest(outcome)}
    return body | {"bundle_digest": manifest_digest(body)}


def publication_record(run_id: str, card: dict[str, Decision], bundle: dict, readiness_verdict: str) -> dict:
    """What is published of a run: its claim, or the abstention, with the bundle that backs it. A run that isn't ready publishes an abstention."""
    own = claim(card) if readiness_verdict == "ready" else {"publication_mode": "abstention_only_publication", "claim_type": None, "reason_codes": ["readiness_" + readiness_verdict], "blocked_ceiling": LANES[0]}
    body = {"run_id": run_id, **own, "bundle_digest": bundle["bundle_digest"]}
    return body | {"record_digest": manifest_digest(body)}


def verify_evidence(bundle: dict[str, str], sources: dict[str, bytes]) -> Decision:
    """Whether every source is there and has its digest."""
    now = evidence_bundle(sources)
    reasons = [f"evidence_missing:{k}" for k in sorted(bundle) if k not in now] + [f"evidence_changed:{k}" for k in sorted(bundle) if k in now and now[k] != bundle[k]] + [f"evidence_unknown:{k}" for k in sorted(now) if k not in bundle]
    return Decision("failed" if reasons else "passed", reasons)


def evidence_bundle(sources: dict[str, bytes]) -> dict[str, str]:
    """Digest of each source."""
    import hashlib

    return {k: "sha256:" + hashlib.sha256(v).hexdigest() for k, v in sorted(sources.items())}


def mechanistic_evidence(units: str, invariance: str, independent_sources: int) -> Decision:
    reasons = ["units_inconsistent"] * (units != "passed") + ["invariance_not_supported"] * (invariance != "passed") + ["external_evidence_not_independent"] * (independent_sources < 1)
    return Decision("failed" if reasons else "passed", reasons)
