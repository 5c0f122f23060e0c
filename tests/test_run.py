"""End-to-end runs and the search layer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.functions import expression
from lawloom.operators import gates, optimizers, robustness, search
from lawloom.plans import run


def observations(spark, value, n=60):
    rng = random.Random(2)
    rows = [(e, i, i, 1, float(round(value(i, rng), 3))) for e in ("a", "b") for i in range(n)]
    return spark.createDataFrame(rows, "entity string, event_time long, available_at long, revision_id long, target double")


def test_a_trend_is_claimed_and_noise_is_not(spark):
    out = run.run(observations(spark, lambda i, r: 3 * i + r.uniform(-1, 1), 150), run.Request(min_train=10, max_lag=1))
    assert out.winner in ("linear_trend", "drift") and out.claim["claim_type"] == "predictively_supported"
    noise = run.run(observations(spark, lambda i, r: r.uniform(-50, 50)), run.Request(min_train=10))
    assert noise.claim["claim_type"] != "predictively_supported"
    assert run.finalists(observations(spark, lambda i, r: 3.0 * i)).where("rank = 1").count() == 2


def test_late_knowledge_blocks_a_prediction(spark):
    df = observations(spark, lambda i, r: 3 * i + r.uniform(-1, 1), 150).withColumn("event_time", F.col("event_time") + 1)
    assert run.run(df, run.Request(min_train=10, max_lag=1)).claim["claim_type"] == "descriptive_structure"


def test_robustness_decides_about_claims(spark, monkeypatch):
    trend = observations(spark, lambda i, r: 3 * i + r.uniform(-1, 1), 150)
    request = run.Request(min_train=10, max_lag=1, surrogates=9)
    out = run.run(trend, request)
    own = out.robustness
    assert own.status == "passed" and own.p_value == pytest.approx(0.1) and set(own.canaries.values()) == {"passed"} and set(own.perturbations) == {"recent_history_truncation", "quantization_coarsening"}
    # a failed perturbation blocks the claim
    monkeypatch.setattr(robustness, "THRESHOLDS", {"gain_rate": 1.1})
    out = run.run(trend, request)
    assert out.robustness.status == "failed" and out.claim["publication_mode"] == "abstention_only_publication" and "perturbation_failed" in out.claim["reason_codes"]
    assert robustness.final_status("abstained", "passed", dict.fromkeys(robustness.CANARIES, "passed"))[0] == "abstained"
    assert robustness.final_status("null_not_rejected", "passed", dict.fromkeys(robustness.CANARIES, "passed"))[0] == "passed"
    assert robustness.final_status("null_rejected", "passed", {}) == ("failed", ["canary_coverage_incomplete"])


def test_surrogates_permute_each_series(spark):
    df = spark.createDataFrame([(e, i, float(i * (e == "a"))) for e in ("a", "b") for i in range(20)], "entity string, idx long, target double")
    rows = robustness.shuffled(df, 3, "s").collect()
    for e in ("a", "b"):
        for k in range(3):
            own = sorted((r["idx"], r["target"]) for r in rows if r["entity"] == e and r["surrogate"] == k)
            assert [i for i, _ in own] == list(range(20)) and sorted(y for _, y in own) == sorted(float(i * (e == "a")) for i in range(20))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, robustness.shuffled(df, 3, "s").collect()))
    assert [r["idx"] for r in robustness.recent_history(df.where("entity = 'a'"), 0.5).orderBy("idx").collect()] == list(range(10))
    assert {r["target"] for r in robustness.coarsened(df, "0.5", 4).collect()} == {float(x) for x in range(0, 21, 2)}


def test_publication_follows_from_the_card(spark):
    ok = dict(admissible=True, robustness="passed", beats_baseline=True, promotion_allowed=True, comparison="comparable", time_safety="passed", calibration="passed")
    bundle = gates.reproducibility_bundle("r", {"a": "sha256:1"}, {"s": "0"}, {"python": "3"}, {"score": 1.0})
    assert bundle == gates.reproducibility_bundle("r", {"a": "sha256:1"}, {"s": "0"}, {"python": "3"}, {"score": 1.0}) != gates.reproducibility_bundle("r", {"a": "sha256:1"}, {"s": "1"}, {"python": "3"}, {"score": 1.0})
    assert gates.publication_record("r", gates.scorecard(**ok), bundle, "ready")["claim_type"] == "predictively_supported"
    assert gates.publication_record("r", gates.scorecard(**ok), bundle, "blocked")["reason_codes"] == ["readiness_blocked"]
    evidence = gates.evidence_bundle({"x": b"1", "y": b"2"})
    assert gates.verify_evidence(evidence, {"x": b"1", "y": b"2"}).status == "passed"
    assert gates.verify_evidence(evidence, {"x": b"9", "z": b"3"}).reason_codes == ["evidence_missing:y", "evidence_changed:x", "evidence_unknown:z"]
    same = {"horizons": "1,2"}
    assert gates.comparison_universe(("c", 1.0), ("b", 2.0), same, same)["beats_baseline"]
    with pytest.raises(ValueError, match="comparison_key_mismatch: horizons"):
        gates.comparison_universe(("c", 1.0), ("b", 2.0), same, {"horizons": "1"})


def test_bounded_fits(spark):
    P = optimizers.Parameter
    x = np.linspace(0, 1, 30)
    y = 2 * np.exp(-3 * x) + 0.5
    residuals = lambda p: p["a"] * np.exp(-p["b"] * x) + p["c"] - y
    fit = optimizers.least_squares([P("a", 1.0), P("b", 1.0, 0.0, 10.0), P("c", 0.0)], residuals)
    assert fit.converged and fit.parameters == pytest.approx({"a": 2.0, "b": 3.0, "c": 0.5}, abs=1e-5)
    held = optimizers.least_squares([P("a", 1.0), P("b", 1.0, 0.0, 2.0), P("c", 0.5, fixed=True)], residuals)
    assert held.bound_hits == ("b",) and held.parameters["c"] == 0.5
    # at the bound no allowed step helps: a grid finds nothing better
    assert all(held.loss <= float(r @ r) + 1e-9 for a in np.linspace(1, 3, 41) for b in np.linspace(0, 2, 21) if (r := residuals({"a": a, "b": b, "c": 0.5})) is not None)
    bowl = optimizers.minimize([P("u", 3.0), P("v", -2.0, -5.0, -1.0)], lambda p: (p["u"] - 1) ** 2 + 10 * (p["v"] - p["u"] ** 2) ** 2)
    best = min(((u - 1) ** 2 + 10 * (v - u * u) ** 2, u, v) for u in np.linspace(-2, 3, 501) for v in np.linspace(-5, -1, 41))
    assert bowl.loss <= best[0] + 1e-9 and bowl.bound_hits == ("v",)
    assert optimizers.penalty([P("u", penalty=("l1", 2.0, 1.0)), P("v", penalty=("l2", 0.5, 0.0)), P("w")], {"u": -1.0, "v": 4.0, "w": 9.0}) == 12.0
    with pytest.raises(ValueError):
        optimizers.bind([P("a"), P("b", fixed=True)], [1.0, 2.0])
    rows = [(g, float(i), s * i + 1.0) for g, s in (("p", 2.0), ("q", -1.0)) for i in range(8)] + [("r", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    tree = ("add", ("mul", ("param", "s"), ("var", "x")), ("param", "c"))
    got = {r["g"]: r for r in optimizers.fit_expression(df, ["g"], "y", tree, [P("s"), P("c", penalty=("l2", 1e-9, 0.0))]).collect()}
    assert got["p"]["parameters"] == pytest.approx({"s": 2.0, "c": 1.0}, abs=1e-4) and got["q"]["parameters"]["s"] == pytest.approx(-1.0, abs=1e-4) and got["r"]["loss"] < 1e-9
    bad = optimizers.fit_expression(df, ["g"], "y", ("log", ("param", "c")), [P("c", -1.0)]).first()
    assert not bad["converged"] and bad["reason"] == "optimizer_numerical_failure"
    huber = optimizers.fit_expression(df.where("g = 'p'").unionByName(spark.createDataFrame([("p", 3.5, 900.0)], df.schema)), ["g"], "y", tree, [P("s", 1.0), P("c")], "huber_loss").first()
    assert huber["parameters"]["s"] == pytest.approx(2.0, abs=0.2)


def test_saturation_and_equivalence():
    v = lambda n: ("var", n)
    tree = ("add", ("lit", 0.0), ("mul", ("lit", 1.0), ("add", v("x"), ("mul", ("lit", 0.0), v("y")))))
    best, steps, whole = expression.saturate(tree, {"finite"})
    assert best == v("x") and whole and steps[-1][1] == best and {s[0] for s in steps} <= {"additive_identity", "multiplicative_identity", "zero_product", "commutativity", "associativity"}
    # a factor that only a commuted product shows
    hidden = ("div", ("mul", ("mul", v("a"), v("b")), v("c")), v("b"))
    assert expression.cost(expression.saturate(hidden, {"nonzero:b"})[0]) <= expression.cost(hidden)
    assert expression.validate_rewrite("additive_identity", ("add", v("x"), ("lit", 0.0)), v("x")) and not expression.validate_rewrite("additive_identity", ("add", v("x"), ("lit", 0.0)), v("y"))
    assert expression.validate_rewrite("unit_zero_identity", ("add", v("x"), ("lit", 0.0)), v("x"), {"unit_equal"}) and not expression.validate_rewrite("unit_zero_identity", ("add", v("x"), ("lit", 0.0)), v("x"))
    a, b = ("add", v("x"), ("add", v("y"), v("z"))), ("add", ("add", v("z"), v("x")), v("y"))
    assert expression.equivalence(a, b, ["x", "y", "z"]) == "equivalent" and expression.equivalent(a, b, ["x", "y", "z"])
    assert expression.equivalence(v("x"), ("mul", ("lit", 2.0), v("x")), ["x"]) == "different"
    assert expression.equivalence(("abs", v("x")), v("x"), ["x"]) == "undecided"  # the points are all positive


def test_candidates_are_unique_by_identity(spark):
    a = search.Candidate("x", "analytic", "affine", ("lag_2", "lag_1"))
    b = search.Candidate("y", "analytic", "affine", ("lag_1", "lag_2"))
    assert a.identity() == b.identity()

    def broken():
        raise ArithmeticError("no")

    found, runs = search.run_engines({"one": lambda: [a], "two": broken, "three": lambda: [b, *search.recursive_proposals([0.1])]}, ["symbolic"])
    assert [r.status for r in runs] == ["completed", "failed", "completed", "abstained"] and len(found) == 3
    assert search.candidate_rows(spark, found + [b]).count() == 3
    assert search.budget_report(runs, 1e9)["decision"] == "continue"
    with pytest.raises(ValueError):
        search.SearchPlan("unknown")
    assert len(search.analytic_proposals(["lag_1", "lag_2", "lag_12"], 12)) == 4 and len(search.spectral_proposals(12)) == 3
    assert ("var", "x") in search.neighbours(("add", ("var", "x"), ("lit", 0.0)))


def test_user_state_folds(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "entity string, idx int, target double")
    assert search.fold_state(df, ["entity"], "idx", "target", 1.0, lambda s, y: s * 0.5 + y).first()["state"] == pytest.approx(((((1 * 0.5 + 0) * 0.5 + 1) * 0.5 + 2) * 0.5 + 3) * 0.5 + 4)
