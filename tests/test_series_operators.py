"""Order-dependent and numeric operators against plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawloom.functions import coding, distributions, expression, programs
from lawloom.operators import calibration, composition, features, fits, folds, gates, inference, lineage, paths, scoring, selection, snapshot
from lawloom.sources import ingestion


@pytest.fixture(scope="module")
def late(spark):
    rng = random.Random(3)
    rows = [(e, i, i + rng.choice([0, 0, 0, 1, 5, 40, 200]), float(rng.randrange(1000))) for e in ("a", "b") for i in range(150)]
    return rows, snapshot.indexed(spark.createDataFrame(rows, "entity string, event_time long, available_at long, target double"))


@pytest.mark.parametrize("look_back, block", [(4, 16), (4, 3), (64, 4096)])
def test_legal_history_equals_the_loop(late, look_back, block):
    rows, df = late
    want = {}
    for e, t, a, _ in rows:
        legal = [y for f, s, b, y in rows if f == e and s < t and b <= a]
        if t >= 3 and len(legal) >= 3:
            want[e, t] = (legal[-1], legal[-2], sum(legal[-3:]) / 3)
    got = {(r["entity"], r["event_time"]): (r["lag_1"], r["lag_2"], r["rolling_mean_3"]) for r in features.legal_features(df, [1, 2], [3], look_back, block).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    by = snapshot.indexed_by(df.drop("idx"), F.floor(F.col("event_time") / 7))
    assert sorted((r["entity"], r["event_time"], r["idx"]) for r in by.collect()) == sorted((r["entity"], r["event_time"], r["idx"]) for r in df.collect())
    canaries = lambda n: sorted(map(tuple, features.late_source_canaries(df, [1, 4], [2], n).collect()))
    assert canaries(3) == canaries(10**6)
    assert features.has_late_rows(df, block) and not features.has_late_rows(df.withColumn("available_at", F.col("event_time")))


def test_snapshot_takes_the_last_revision_before_dropping_blanks(spark):
    rows = [("a", 1, 1, 1, 5.0), ("a", 1, 2, 0, None), ("a", 2, 1, 1, 7.0), ("a", 2, 1, 2, 8.0), ("a", 3, 9, 1, 1.0), ("b", 1, 1, 1, 2.0)]
    df = spark.createDataFrame(rows, "entity string, event_time int, available_at int, revision_id int, target double")
    got = sorted((r["entity"], r["event_time"], r["target"]) for r in snapshot.freeze_snapshot(df, 5).collect())
    assert got == [("a", 2, 8.0), ("b", 1, 2.0)]
    assert snapshot.freeze_snapshot(df.where("false")).count() == 0


def test_folds_and_weights(spark):
    df = snapshot.indexed(spark.createDataFrame([(e, t, float(t)) for e, n in (("a", 9), ("b", 8)) for t in range(n)], "entity string, event_time int, target double"))
    plan = folds.evaluation_plan(df, 3, 2).collect()
    assert len(plan) == 4 * 2 * 2 and {r["role"] for r in plan if r["fold"] == 3} == {"confirmatory_holdout"} and max(r["target_index"] for r in plan) == 7
    assert sum(folds.default_horizon_weights(7)) == 1
    with pytest.raises(ValueError):
        folds.horizon_weights(2, ["0.5", "0.4"])
    panel = folds.training_origin_panel(df, 6, [1, 3]).collect()
    assert len(panel) == 3 * 2 * 2 and all(r["realized"] == r["target_index"] for r in panel)
    assert folds.training_origin_panel(df.where("event_time <> 2"), 6, [1, 3]).count() == 0


def test_smoothing_equals_the_loop(spark):
    y = [3.0, 5.0, 4.0, 8.0, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "entity string, idx int, target double")
    got = {round(r["alpha"], 2): (r["level"], r["loss"], r["best"]) for r in fits.smoothing_grid(df).collect()}
    for alpha in fits.ALPHAS:
        level, loss = y[0], 0.0
        for v in y[1:]:
            loss += (v - level) ** 2
            level += alpha * (v - level)
        assert np.allclose(got[round(alpha, 2)][:2], (level, loss))
    assert sum(b for *_, b in got.values()) == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=30))
def test_skyline_members_are_not_dominated(points):
    kept = selection._skyline(points, ["min", "max"])
    better = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and a != b
    assert sorted(kept) == [i for i, p in enumerate(points) if not any(better(q, p) for q in points)]


def natural(n):
    a = math.floor(math.log2(n + 1))
    return a + 2 * math.floor(math.log2(a + 1)) + 1


def test_codes_equal_the_loop(spark):
    assert [coding.natural_code_length(n) for n in range(300)] == [natural(n) for n in range(300)]
    rng = random.Random(1)
    idx = [rng.choice([-2, -1, 0, 0, 0, 1, 5]) for _ in range(60)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(idx)], "entity string, idx int, index long")
    counts, bits = {}, []
    for p, v in enumerate(idx):
        c = counts.get(v, 0)
        bits.append(-math.log2((c + 1) / max(p + len(counts) + (0 if c else 1), 1)))
        counts[v] = c + 1
    got = [r["bits"] for r in coding.prequential_rows(df, ["entity"], "idx").orderBy("idx").collect()]
    assert np.allclose(got, bits)
    values = [0.15, 0.25, -0.25, 0.05, 2.675, -0.049]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(coding.quantize_index(F.col("v"), "0.1")).collect()]
    assert out == [2, 3, -3, 1, 27, 0]


def test_special_functions_equal_known_values():
    d = distributions
    assert math.isclose(d.t_ppf(0.975, 10), 2.228138852, abs_tol=1e-7)
    assert math.isclose(d.chi2_sf(3.841458821, 1), 0.05, abs_tol=1e-8)
    assert math.isclose(d.cdf("poisson", 3, {"rate": 2.5}), sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)), abs_tol=1e-10)
    assert math.isclose(d.cdf("negative_binomial", 4, {"mean": 3.0, "dispersion": 2.0}), sum(math.exp(d.log_likelihood("negative_binomial", k, {"mean": 3.0, "dispersion": 2.0})) for k in range(5)), abs_tol=1e-10)
    params = {
        "gaussian": {"location": 1, "scale": 2}, "student_t": {"location": 1, "scale": 2, "df": 4}, "laplace": {"location": 1, "scale": 2}, "log_normal": {"location": 0.1, "scale": 0.5}, "beta": {"alpha": 2.0, "beta": 3.0},
    }
    for family, p in params.items():
        for q in (0.05, 0.5, 0.9):
            x = d.ppf(family, q, p)
            assert math.isclose(d.cdf(family, x, p), q, abs_tol=1e-7)
            h = 1e-5
            assert math.isclose((d.cdf(family, x + h, p) - d.cdf(family, x - h, p)) / (2 * h), math.exp(d.log_likelihood(family, x, p)), rel_tol=1e-3)
    assert d.ppf("poisson", 0.5, {"rate": 2.5}) == 2 and 0 <= d.pit("bernoulli", 1, {"probability": 0.3}, "row") <= 1
    z = np.random.default_rng(0).normal(size=200000)
    assert math.isclose(d.gaussian_crps(0.7, 0, 1), np.abs(z - 0.7).mean() - 0.5 * np.abs(z[:100000] - z[100000:]).mean(), abs_tol=0.01)


def test_expression_language(spark):
    e = expression.parse_text("sqrt(x*x) + 0 + (x*y)/y")
    simple, trace = expression.simplify(e, {"nonzero:y"})
    assert "divide_common_factor" in trace and "additive_identity" in trace and expression.cost(simple) < expression.cost(e)
    assert expression.equivalent(e, simple, ["x", "y"], {"nonzero:y"}) and expression.equivalence(e, simple, ["x", "y"]) == "undecided"
    assert expression.from_json(expression.to_json(e)) == e
    df = spark.createDataFrame([(1.5, 2.0), (0.3, 4.0)], "x double, y double")
    tree = ("add", ("if", ("gt", ("var", "x"), ("lit", 1.0)), ("exp", ("var", "x")), ("neg", ("var", "y"))), ("protected_div", ("var", "x"), ("lit", 0.0)))
    got = [r[0] for r in df.select(expression.compile_expression(tree)).collect()]
    assert np.allclose(got, [expression.evaluate(tree, {"x": x, "y": y}) for x, y in ((1.5, 2.0), (0.3, 4.0))])
    with pytest.raises(Exception, match="domain error"):
        df.select(expression.compile_expression(("log", ("neg", ("var", "x"))))).collect()
    dx = expression.derivative(("mul", ("sin", ("var", "x")), ("pow2", ("var", "x"))), "x")
    assert math.isclose(expression.evaluate(dx, {"x": 0.7}), math.cos(0.7) * 0.49 + math.sin(0.7) * 1.4, rel_tol=1e-12)
    with pytest.raises(ValueError):
        expression.units(("add", ("var", "x"), ("var", "y")), {"x": (1, 0), "y": (0, 1)})
    assert expression.units(("div", ("var", "x"), ("var", "y")), {"x": (1, 0), "y": (0, 1)}) == (1, -1)
    for op in ("__import__('os')", "x.y", "x if y else z"):
        with pytest.raises(ValueError):
            expression.parse_text(op)


def test_programs():
    text = "(program (state (lit 1/3)) (next (add (state 0) (obs 0))) (emit (if (lt (state 0) (lit 2)) (state 0) (lit 2))))"
    p = programs.parse(text, max_nodes=20)
    assert programs.parse(programs.canonical(p), max_nodes=20) == p
    assert programs.start(p) == (Fraction(1, 3),)
    assert programs.step(p, (Fraction(1, 3),), (Fraction(1, 2),)) == (Fraction(1, 3), (Fraction(5, 6),))
    found = programs.enumerate_programs(max_nodes=4)
    assert found == sorted(set(found)) and all(programs.parse(t) for t in found)
    for bad in ("(program", "(program (state (lit 0)) (next (obs 3)) (emit (state 0)))", "(program (state (lit 0)) (next (exec 0)) (emit (state 0)))"):
        with pytest.raises(ValueError):
            programs.parse(bad)


def test_change_points_and_hac(spark):
    y = [0.0] * 20 + [10.0] * 20 + [3.0] * 20
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "entity string, idx long, v double")
    assert [r["at"] for r in inference.change_points(df, ["entity"], "idx", "v", 5.0).collect()] == [20, 40]
    assert sorted(r["at"] for r in inference.level_shifts(df, ["entity"], "idx", "v").collect()) == [20, 40]
    x = np.random.default_rng(0).normal(0.2, 1, 80)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "entity string, idx long, v double")
    r = inference.hac_mean_test(df, ["entity"], "idx", "v", 4).first()
    c = x - x.mean()
    var = sum((1 if k == 0 else 2 * (1 - k / 5)) * (c[k:] @ c[: len(c) - k]) for k in range(5)) / len(x) ** 2
    assert math.isclose(r["standard_error"], math.sqrt(var), rel_tol=1e-9) and 0 <= r["p_value"] <= 1
    boot = inference.stationary_bootstrap(df, ["entity"], "idx", "v", 4, 300, 1).first()
    assert boot["lower"] < boot["mean"] < boot["upper"]


def test_regimes_and_levels(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 0.3, 40), rng.normal(5, 0.3, 40)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "entity string, idx long, v double")
    p = inference.regime_switching(df, ["entity"], "idx", "v").where("regime = 1").orderBy("idx").collect()
    assert max(r["probability"] for r in p[:39]) < 0.1 and min(r["probability"] for r in p[41:]) > 0.9
    truth = spark.createDataFrame([("a", i, int(i >= 40)) for i in range(80)], "entity string, idx long, regime int")
    assert inference.posterior_calibration(inference.regime_switching(df, ["entity"], "idx", "v"), truth, ["entity"], "idx").first()["accuracy"] > 0.97
    levels = inference.local_level(df, ["entity"], "idx", "v")
    latent = spark.createDataFrame([("a", i, 0.0 if i < 40 else 5.0) for i in range(80)], "entity string, idx long, latent double")
    assert inference.latent_recovery(levels, latent, ["entity"], "idx").first()["rmse"] < 0.8


def test_calibration_bins(spark):
    df = spark.createDataFrame([("a", i, i / 9, i % 2 == 0) for i in range(10)], "g string, k int, p double, event boolean")
    sizes = lambda s, **o: [r["n"] for r in calibration.reliability_bins(df, ["g"], ["k"], s, **o).orderBy("bin").collect()]
    assert sizes("equal_mass", bins=4) == [3, 3, 3, 1] and sizes("adaptive_min_count", least=4) == [4, 6] and sizes("equal_width", bins=2) == [5, 5] and len(sizes("exact")) == 10


def test_ingestion(spark, tmp_path):
    known = "2024-02-01T00:00:00Z"
    rows = [("a", "2024-01-01T02:00:00.7+02:00", known, "1.5", "7", "true"), ("c", "2024-01-02T00:00:00Z", known, "nan", "x y", ""), ("b", "2024-01-03T00:00:00Z", known, " ", "2.50", None)]
    names = "series_id string, event_time string, available_at string, observed_value string, value string, flag string"
    spark.createDataFrame(rows, names).write.csv(f"{tmp_path}/in", header=True)
    got = {r["event_time"]: r for r in ingestion.admitted(ingestion.read_csv(spark, f"{tmp_path}/in")).collect()}
    a = got["2024-01-01T00:00:00Z"]
    # a side column named value is no target
    assert a["entity"] == "a" and a["target"] == 1.5 and a["side_information"] == {"value": "7", "flag": "true"} and a["source_id"] is None
    b = got["2024-01-02T00:00:00Z"]
    assert b["target"] is None and b["side_information"] == {"value": '"x y"'}
    assert len({r["payload_hash"] for r in got.values()}) == 3 and {r["position"] for r in got.values()} == {0}
    bad = lambda *row: ingestion.ingest(spark.createDataFrame([row], "entity string, event_time string, availability_time string, target string")).collect()
    with pytest.raises(Exception, match="invalid_timestamp"):
        bad("a", "2024-01-01 00:00:00", known, "1")
    with pytest.raises(Exception, match="missing_required_field: entity"):
        bad(" ", known, known, "1")
    with pytest.raises(Exception, match="missing_required_field: available_at"):
        bad("a", known, None, "1")
    with pytest.raises(Exception, match="nonfinite"):
        bad("a", known, known, "inf")
    with pytest.raises(ValueError, match="missing_required_field: available_at"):
        ingestion.ingest(spark.createDataFrame([("a", known, 1.0)], "entity string, event_time string, target double"))
    with pytest.raises(ValueError, match="missing_required_field: target"):
        ingestion.ingest(spark.createDataFrame([("a", known, known, 1.0)], "entity string, event_time string, available_at string, value double"))
    with pytest.raises(ValueError, match="empty_dataset"):
        ingestion.ingest(spark.createDataFrame([], "entity string, event_time string, available_at string, target double"))
    own = spark.createDataFrame([("a", known, known, 1.0)], "entity string, event_time string, available_at string, value double")
    assert ingestion.ingest(own, also={"target": "value"}).first()["target"] == 1.0
    ingestion.write_csv(ingestion.read_csv(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3


def test_forecast_paths(spark):
    one = spark.createDataFrame([(10.0, "x", {"intercept": 1.0, "lag_coefficient": 0.5}, {"level": 4.0}, None)], "origin_value double, entity string, parameters map<string,double>, state map<string,double>, residual_lag_1 double")
    values = lambda form, m=None, **o: [r["forecast"] for r in paths.forecast_path(one if m is None else one.withColumn("parameters", F.create_map(*(x for k, v in m.items() for x in (F.lit(k), F.lit(v))))), form, 2, **o).orderBy("horizon").collect()]
    assert values("analytic") == [6.0, 4.0] and values("recursive") == [4.0, 4.0]
    assert values("analytic", {"intercept": 3.0}) == [3.0, 3.0]
    assert values("analytic", {"horizon_1__intercept": 2.0, "horizon_1__lag_coefficient": 0.1}) == [3.0, None]
    assert values("additive_residual", {"b.intercept": 1.0, "r.intercept": 2.0, "r.lag_coefficient": 1.0}, base="b", residual="r") == [3.0, 5.0]
    assert values("shared_plus_local", {"shared_intercept": 1.0, "local_adjustment__x": 1.0}) == [2.0, 2.0]
    assert values("shared_plus_local", {"shared_intercept": 1.0, "local_adjustment__x": 1.0, "shared_lag_coefficient": 9.0, "local_lag_coefficient__x": 0.0}) == [2.0, 2.0]
    with pytest.raises(Exception, match="unseen_entity"):
        values("shared_plus_local", {"shared_intercept": 1.0})
    with pytest.raises(ValueError, match="unsupported_prediction_candidate"):
        values("other")
    z = spark.createDataFrame([(x / 7,) for x in range(-280, 281)], "z double")
    worst = z.withColumn("p", distributions.normal_cdf(F.col("z"))).toPandas().apply(lambda r: abs(r["p"] - (1 + math.erf(r["z"] / math.sqrt(2))) / 2), axis=1).max()
    assert worst < 1e-14


def test_algorithmic_path():
    # the program's own emits are what it sees after the origin
    text = "(program (state (lit 0)) (next (add (mul (lit 1/2) (obs 0)) (lit 1))) (emit (state 0)))"
    assert programs.path(text, [4.0, 8.0], 3) == [5.0, 3.5, 2.75]


def test_row_set_identity(spark):
    rows = [("a", i, i, float(i)) for i in range(50)]
    digest = lambda r, n=1: coding.row_set_id(spark.createDataFrame(r, "entity string, event_time long, available_at long, target double").repartition(n)).first()[0]
    assert digest(rows) == digest(rows[::-1], 7) != digest([*rows[:-1], ("a", 49, 49, 50.0)])
    assert digest(rows) != digest([*rows, rows[0]])  # repeats count


def test_literal_codes():
    code = coding.natural_code_length
    assert coding.literal_bits(True, "0.5") == coding.literal_bits(None, "0.5") == 1 and coding.literal_bits(-3, "0.5") == code(5) and coding.literal_bits(1.25, "0.5") == code(6)
    assert coding.literal_bits("ab", "0.5") == code(2) + code(97) + code(98) and coding.literal_bits("(a b)", "0.5", "program") == code(2) + code(5) + sum(map(code, b"(a b)"))
    assert coding.decimal_text("1.500") == "1.5" and coding.decimal_text("1E+2") == "100" and coding.decimal_text("0.00") == "0"
    with pytest.raises(ValueError):
        coding.literal_bits([], "0.5")
    with pytest.raises(ValueError):
        coding.resolve_step(None, "fixed_step_mid_tread", step="0")


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted((r["node"], r["depth"]) for r in lineage.closure(edges, roots).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    m = spark.createDataFrame([("r", "m", "h1")], "run_id string, manifest_id string, content_hash string")
    new = spark.createDataFrame([("r", "m", "h2"), ("r", "n", "h3")], m.schema)
    table, conflicts = lineage.upsert_manifests(m, new)
    assert table.count() == 2 and conflicts.count() == 1
    own = lineage.content_addressed(new, ["run_id", "content_hash"])
    assert {r["intact"] for r in lineage.verified(own).collect()} == {True}


def test_gates():
    ok = dict(admissible=True, robustness="passed", beats_baseline=True, promotion_allowed=True, comparison="comparable", time_safety="passed", calibration="passed")
    assert gates.claim(gates.scorecard(**ok))["claim_type"] == "predictively_supported"
    assert gates.claim(gates.scorecard(**ok | {"mechanistic_requested": True, "mechanistic_evidence": "passed"}))["claim_type"] == "mechanistically_compatible_hypothesis"
    assert gates.claim(gates.scorecard(**ok | {"beats_baseline": False}))["claim_type"] == "descriptive_structure"
    assert gates.claim(gates.scorecard(**ok | {"admissible": False}))["publication_mode"] == "abstention_only_publication"
    assert gates.dossier([{"reason_codes": ["domain_violation"]}]).status == "blocked" and gates.dossier([]).status == "passed"
    assert gates.readiness({"a": ("passed", True)}, ["b"]).status == "blocked" and gates.readiness({"a": ("failed", False)}).status == "review_required"
    assert gates.promotion(0.0, (-1, 1), 0.0, 100, 80.0).reason_codes == ["baseline_tie", "insignificant_improvement", "uncertainty_interval_crosses_margin"]
    assert gates.robustness("null_not_rejected", ["passed"], []).status == "passed"
    assert inference.resolve_conformal_method("split_conformal", [], None)["status"] == "blocked"


def test_composition(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    seg = [r[0] for r in df.select(composition.segment_of(F.col("x"), [("a", 0, 1), ("b", 1, 2)])).collect()]
    assert seg == ["a", "b", "b"]
    m = spark.createDataFrame([({"k": 1.0},)], "m map<string,double>")
    both = m.select(composition.of_component("c", composition.prefixed("c", F.col("m"))).alias("m")).first()["m"]
    assert both == {"k": 1.0}


def test_score_columns(spark):
    df = spark.createDataFrame([(0.9, True, 1.0, 2.0), (1.0, False, 3.0, 2.0)], "p double, e boolean, f double, y double")
    r = df.select(scoring.event_log_score(F.col("p"), F.col("e")).alias("l"), scoring.pinball_loss(F.lit(0.9), F.col("f"), F.col("y")).alias("q"), scoring.objective("huber", F.col("f") - F.col("y")).alias("h")).collect()
    assert math.isclose(r[0]["l"], -math.log(0.9)) and r[1]["l"] == math.inf and math.isclose(r[0]["q"], 0.9) and math.isclose(r[1]["q"], 0.1) and r[0]["h"] == 0.5


def test_streams(spark, tmp_path):
    from lawloom.streaming import snapshots

    rows = [("a", 0, 0, 1, 1.0), ("a", 0, 5, 2, 3.0), ("b", 0, 1, 3, 4.0), ("a", 86400, 90000, 4, 7.0)]
    df = spark.createDataFrame(rows, "entity string, e long, a long, revision_id long, target double").select("entity", F.timestamp_seconds(F.col("e") + 10**9).alias("event_time"), F.timestamp_seconds(F.col("a") + 10**9).alias("available_at"), "revision_id", "target")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")

    def finish(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = finish(snapshots.streaming_snapshot(stream()), "update", "snap")
    assert sorted((r["entity"], r["target"]) for r in got) == [("a", 3.0), ("a", 7.0), ("b", 4.0)]
    assert sorted(r["target"] for r in finish(snapshots.windowed_totals(stream()), "update", "totals")) == [4.0, 4.0, 7.0]
    level = {r["entity"]: r["level"] for r in finish(snapshots.streaming_level(stream(), 0.5), "update", "level")}
    assert level == {"a": 4.5, "b": 4.0}
