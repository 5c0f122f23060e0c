"""Queries over codes, probabilistic scores, panels, diagnostics, tests, selection and lineage, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lawloom.functions import coding, distributions, expression, programs
from lawloom.operators import calibration, composition, falsification, fits, inference, lineage, panel, scoring, selection
from lawloom.plans.queries_core import BASE, KEYS, LOSSES, PAIRS, R, S, daily, diffs_of, losses_of, monthly
from lawloom.plans.registry import query
from lawloom.sources.panels import I1, I4, table

STEP = "0.5"
#: Quantiser of step 0.5: times two, halves away from zero.
Q = "CAST(round(CAST(CAST({} AS VARCHAR) AS DECIMAL(28,9)) * 2) AS BIGINT)".format
NAT = "(length(bin(CAST({0} + 1 AS BIGINT))) - 1 + 2 * (length(bin(CAST(length(bin(CAST({0} + 1 AS BIGINT))) AS BIGINT))) - 1) + 1)".format
ZIG = "(CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END)".format
SGN = lambda e: NAT(ZIG(e))


@query("quantizer_indices", f"WITH {I1} SELECT entity, idx, {Q('target')} AS index, CAST({Q('target')} AS DOUBLE) * 0.5 AS representative FROM i1")
def quantizer_indices(spark, d):
    q = coding.quantize_index(F.col("target"), STEP)
    return daily(spark, d).select("entity", F.col("idx").cast("long").alias("idx"), q.alias("index"), coding.representative(q, STEP).alias("representative"))


@query("code_lengths", f"SELECT CAST(n AS BIGINT) AS n, CAST({NAT('n')} AS INT) AS natural_bits, CAST({SGN('(n - 500)')} AS INT) AS signed_bits FROM (SELECT unnest(range(0, 1000)) AS n)")
def code_lengths(spark, d):
    n = F.col("id")
    return spark.range(1000).select(n.alias("n"), coding.natural_bits(n).cast("int").alias("natural_bits"), coding.signed_bits(n - 500).cast("int").alias("signed_bits"))


@query("string_code_lengths", f"WITH b AS (SELECT n_name, unnest(list_transform(range(1, length(n_name) + 1), lambda i: ascii(substr(n_name, i, 1)))) AS b FROM nation) SELECT n_name AS name, CAST({NAT('any_value(length(n_name))')} + sum({NAT('b')}) AS INT) AS bits FROM b GROUP BY n_name")
def string_code_lengths(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), coding.string_bits(F.col("n_name")).cast("int").alias("bits"))


REF = f"""{I1}, rr AS (SELECT entity, idx, unnest([{{'r': 'raw_quantized_transformed_sequence', 'v': target}}, {{'r': 'naive_last_observation', 'v': target - coalesce(lag(target, 1) OVER w, 0.0)}}, {{'r': 'seasonal_naive', 'v': target - coalesce(lag(target, 7) OVER w, 0.0)}},
  {{'r': 'differenced_local_linear', 'v': target - CASE WHEN idx = 0 THEN 0.0 WHEN idx = 1 THEN lag(target, 1) OVER w ELSE lag(target, 1) OVER w + (lag(target, 1) OVER w - lag(target, 2) OVER w) END}}]) AS x FROM i1 WINDOW w AS (PARTITION BY entity ORDER BY idx)),
 ri AS (SELECT entity, idx, x.r AS reference, {Q('round(x.v, 9)')} AS index FROM rr)"""


@query("reference_descriptions", f"WITH {REF} SELECT entity, reference, count(*) AS n, CAST({NAT('count(*)')} + sum({SGN('index')}) + 5 AS BIGINT) AS reference_bits FROM ri GROUP BY 1, 2")
def reference_descriptions(spark, d):
    return coding.reference_bits(daily(spark, d), STEP, 7).select("entity", "reference", "n", F.col("reference_bits").cast("long").alias("reference_bits"))


@query("prequential_code", f"""WITH {REF}, q AS (SELECT entity, idx, CAST(round(index / 200.0) AS BIGINT) AS index FROM ri WHERE reference = 'naive_last_observation'),
 c AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY idx) - 1 AS p, row_number() OVER (PARTITION BY entity, index ORDER BY idx) - 1 AS c FROM q),
 a AS (SELECT *, coalesce(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM c)
 SELECT entity, count(*) AS n, {S("sum(-log2((c + 1) / greatest(p + a + CASE WHEN c = 0 THEN 1 ELSE 0 END, 1)))", 6)} AS laplace_bits,
  {S(f"sum(CASE WHEN c > 0 THEN -log2(c / (p + a)) ELSE CASE WHEN p + a = 0 THEN 0.0 ELSE -log2(a / (p + a)) END + {SGN('index')} END)", 6)} AS escape_bits FROM a GROUP BY entity""")
def prequential_code(spark, d):
    rows = coding.reference_indices(daily(spark, d), STEP, 7).where("reference = 'naive_last_observation'").withColumn("index", F.round(F.col("index") / 200.0).cast("long"))
    a = coding.prequential_rows(rows, ["entity"], "idx").groupBy("entity").agg(F.count("*").alias("n"), R(F.sum("bits")).alias("laplace_bits"))
    return a.join(coding.escape_rows(rows, ["entity"], "idx").groupBy("entity").agg(R(F.sum("bits")).alias("escape_bits")), "entity")


FITTED = f"""{I1}, g AS (SELECT entity, count(*) AS n, avg(target) AS ym, arg_min(target, idx) AS first, arg_max(target, idx) AS last, (count(*) * sum(idx * target) - sum(idx) * sum(target)) / (count(*) * sum(idx * idx) - sum(idx) * sum(idx)) AS slope FROM i1 GROUP BY entity),
 ft AS (SELECT i.entity, i.idx, i.target, unnest([{{'f': 'constant', 'v': ym, 'k': 1}}, {{'f': 'drift', 'v': first + (last - first) / (n - 1) * idx, 'k': 2}}, {{'f': 'linear_trend', 'v': ym - slope * (n - 1) / 2 + slope * idx, 'k': 2}}, {{'f': 'seasonal_naive', 'v': coalesce(lag(target, 2) OVER (PARTITION BY i.entity ORDER BY idx), target), 'k': 2}}]) AS x FROM i1 i JOIN g USING (entity)),
 fr AS (SELECT entity, x.f AS family, x.k AS k, {Q('round(target - x.v, 9)')} AS index FROM ft), fb AS (SELECT entity, family, any_value(k) AS k, CAST({NAT('count(*)')} + sum({SGN('index')}) AS BIGINT) AS data_bits FROM fr GROUP BY 1, 2),
 rb AS (SELECT entity, {NAT('count(*)')} + sum({SGN(Q('target'))}) + 5 AS reference_bits FROM i1 GROUP BY 1),
 dg AS (SELECT entity, family, data_bits, CAST(data_bits + 5 + {NAT('k')} AS BIGINT) AS total_bits, CAST(reference_bits AS BIGINT) AS reference_bits FROM fb JOIN rb USING (entity))"""


def gains_of(spark, d):
    rows = daily(spark, d)
    return coding.description_gain(fits.fitted_values(rows), rows, STEP)


@query("description_gains", f"WITH {FITTED} SELECT entity, family, data_bits, total_bits, reference_bits, reference_bits - total_bits AS gain_bits, reference_bits - total_bits > 0 AS admitted FROM dg")
def description_gains(spark, d):
    return gains_of(spark, d).select("entity", "family", "data_bits", "total_bits", F.col("reference_bits").cast("long").alias("reference_bits"), F.col("gain_bits").cast("long").alias("gain_bits"), "admitted")


@query("family_finalists", f"WITH {FITTED}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY total_bits, family) AS r FROM dg WHERE reference_bits > total_bits) SELECT entity, family, total_bits FROM r WHERE r = 1")
def family_finalists(spark, d):
    c = gains_of(spark, d).withColumn("structure_bits", F.lit(0)).withColumn("candidate_id", F.col("family"))
    return selection.ranked(selection.law_eligibility(c).where("reason is null"), ["entity"]).where("rank = 1").select("entity", "family", "total_bits")


FRONT = f"WITH {LOSSES}, m AS (SELECT entity, family, avg(loss) AS mae, stddev_samp(loss) AS sd FROM lss GROUP BY 1, 2), c AS (SELECT entity, family, {S('mae', 4)} AS mae, {S('sd', 4)} AS sd FROM m)"


def front_candidates(spark, d):
    return losses_of(spark, d).groupBy("entity", "family").agg(R(F.avg("loss"), 4).alias("mae"), R(F.stddev_samp("loss"), 4).alias("sd"))


@query("pareto_frontier", f"{FRONT} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.entity = c.entity AND a.mae <= c.mae AND a.sd <= c.sd AND (a.mae < c.mae OR a.sd < c.sd))")
def pareto_frontier(spark, d):
    return selection.frontier(front_candidates(spark, d), ["entity"], {"mae": "min", "sd": "min"})


@query("pareto_frontier_antijoin", f"{FRONT} SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.entity = c.entity AND a.mae <= c.mae AND a.sd <= c.sd AND (a.mae < c.mae OR a.sd < c.sd))")
def pareto_frontier_antijoin(spark, d):
    return selection.frontier_by_antijoin(front_candidates(spark, d), ["entity"], {"mae": "min", "sd": "min"})


@query("parts_price_size_frontier", "WITH c AS (SELECT p_brand, p_partkey, p_retailprice, p_size FROM part) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.p_brand = c.p_brand AND a.p_retailprice <= c.p_retailprice AND a.p_size >= c.p_size AND (a.p_retailprice < c.p_retailprice OR a.p_size > c.p_size))")
def parts_price_size_frontier(spark, d):
    return selection.frontier(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), ["p_brand"], {"p_retailprice": "min", "p_size": "max"})


@query("portfolio_winner", f"WITH {FITTED}, f AS (SELECT entity, family, total_bits, reference_bits - total_bits AS gain_bits FROM dg), pg AS (SELECT family, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, family LIMIT 1) SELECT f.entity, f.family, total_bits, CAST(row_number() OVER (ORDER BY total_bits, gain_bits DESC, entity) AS INT) AS rank FROM f JOIN pg USING (family)")
def portfolio_winner(spark, d):
    c = gains_of(spark, d).withColumn("structure_bits", F.lit(0)).withColumn("byte_length", F.lit(0)).withColumn("candidate_id", F.col("entity"))
    return selection.portfolio_winner(c, ["family"]).select("entity", "family", "total_bits", "rank")


@query("seeded_attempt_order", "WITH n AS (SELECT n_name AS candidate_id FROM nation), a AS (SELECT candidate_id, 0 AS restart FROM n ORDER BY sha256('7:0:' || candidate_id), candidate_id LIMIT 5), b AS (SELECT candidate_id, 1 AS restart FROM (SELECT * FROM n ANTI JOIN a USING (candidate_id)) ORDER BY sha256('7:1:' || candidate_id), candidate_id LIMIT 3) SELECT candidate_id, CAST(restart AS INT) AS restart FROM a UNION ALL SELECT candidate_id, CAST(restart AS INT) FROM b")
def seeded_attempt_order(spark, d):
    return selection.seeded_batches(table(spark, d, "nation").select(F.col("n_name").alias("candidate_id")), "7", 5, 8)


@query("unattempted_fallbacks", "SELECT n_name AS candidate_id FROM nation WHERE n_nationkey % 3 <> 0")
def unattempted_fallbacks(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("candidate_id"), "n_nationkey")
    return selection.unattempted(n.select("candidate_id"), n.where("n_nationkey % 3 = 0").select("candidate_id"), ["candidate_id"])


BANDS = f"WITH {LOSSES}, s AS (SELECT entity, family, stddev_pop(realized - forecast) AS sd FROM lss GROUP BY 1, 2), pr AS (SELECT l.*, s.sd * sqrt(horizon) AS sc FROM lss l JOIN s USING (entity, family))"


def bands_of(spark, d):
    rows = losses_of(spark, d).withColumn("residual", F.col("realized") - F.col("forecast"))
    sd = rows.groupBy("entity", "family").agg(F.stddev_pop("residual").alias("sd"))
    return rows.join(sd, ["entity", "family"]).withColumn("sc", distributions.horizon_scale(F.col("sd"), F.col("horizon"), "sqrt_horizon"))


@query("interval_coverage", f"""{BANDS}, iv AS (SELECT family, forecast, sc, realized, unnest([{{'c': 0.5, 'z': 0.6744897501960817}}, {{'c': 0.8, 'z': 1.2815515655446004}}, {{'c': 0.95, 'z': 1.959963984540054}}]) AS x FROM pr),
 m AS (SELECT family, CAST(x.c AS DOUBLE) AS nominal_coverage, count(*) AS n, avg(CASE WHEN realized BETWEEN forecast - x.z * sc AND forecast + x.z * sc THEN 1.0 ELSE 0.0 END) AS e FROM iv GROUP BY 1, 2)
 SELECT family, nominal_coverage, n, {S('e')} AS empirical_coverage, {S('abs(e - nominal_coverage)')} AS absolute_gap, {S('greatest(0.0, (e + 3.8414588206941236 / (2.0 * n) - 1.959963984540054 * sqrt(e * (1 - e) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n))')} AS coverage_lower_bound, CASE WHEN abs(e - nominal_coverage) <= 0.1 THEN 'passed' ELSE 'failed' END AS status FROM m""")
def interval_coverage(spark, d):
    z = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(z).alias("z")) for c, z in ((0.5, 0.6744897501960817), (0.8, 1.2815515655446004), (0.95, 1.959963984540054))))
    rows = bands_of(spark, d).withColumn("x", F.explode(z)).select("family", F.col("x.c").alias("nominal_coverage"), (F.col("forecast") - F.col("x.z") * F.col("sc")).alias("lower_bound"), (F.col("forecast") + F.col("x.z") * F.col("sc")).alias("upper_bound"), F.col("realized").alias("observed"))
    return calibration.interval_coverage(rows, ["family"]).select("family", "nominal_coverage", "n", *(R(c).alias(c) for c in ("empirical_coverage", "absolute_gap", "coverage_lower_bound")), "status")


@query("quantile_hits", f"""{BANDS}, q AS (SELECT family, forecast, sc, realized, unnest([{{'l': 0.1, 'z': -1.2815515655446004}}, {{'l': 0.5, 'z': 0.0}}, {{'l': 0.9, 'z': 1.2815515655446004}}]) AS x FROM pr), m AS (SELECT family, CAST(x.l AS DOUBLE) AS level, count(*) AS n, avg(CASE WHEN realized <= forecast + x.z * sc THEN 1.0 ELSE 0.0 END) AS h FROM q GROUP BY 1, 2)
 SELECT family, level, n, {S('h')} AS hit_rate, CASE WHEN abs(h - level) <= 0.15 THEN 'passed' ELSE 'failed' END AS status FROM m""")
def quantile_hits(spark, d):
    z = F.array(*(F.struct(F.lit(c).alias("l"), F.lit(z).alias("z")) for c, z in ((0.1, -1.2815515655446004), (0.5, 0.0), (0.9, 1.2815515655446004))))
    rows = bands_of(spark, d).withColumn("x", F.explode(z)).select("family", F.col("x.l").alias("level"), (F.col("forecast") + F.col("x.z") * F.col("sc")).alias("value"), F.col("realized").alias("observed"))
    return calibration.quantile_hits(rows, ["family"]).select("family", "level", "n", R("hit_rate").alias("hit_rate"), "status")


@query("proper_scores", f"""{BANDS}, e AS (SELECT *, greatest(least(forecast / 2000.0, 1.0), 0.0) AS p, realized >= 1000.0 AS ev, forecast - 1.2815515655446004 * sc AS lo, forecast + 1.2815515655446004 * sc AS hi FROM pr)
 SELECT family, {S('avg((hi - lo) + 10.0 * CASE WHEN realized < lo THEN lo - realized WHEN realized > hi THEN realized - hi ELSE 0 END)', 3)} AS interval_score, {S('avg(CASE WHEN realized >= hi THEN 0.9 * (realized - hi) ELSE 0.1 * (hi - realized) END)', 3)} AS pinball, {S('avg((p - CASE WHEN ev THEN 1 ELSE 0 END) * (p - CASE WHEN ev THEN 1 ELSE 0 END))', 6)} AS brier,
  {S('avg((realized - forecast) * (realized - forecast) / (sc * sc) / 2 + ln(sc * sqrt(2 * pi())))', 5)} AS log_score FROM e GROUP BY family""")
def proper_scores(spark, d):
    r = bands_of(spark, d)
    z = 1.2815515655446004
    lo, hi = F.col("forecast") - z * F.col("sc"), F.col("forecast") + z * F.col("sc")
    p = F.greatest(F.least(F.col("forecast") / 2000.0, F.lit(1.0)), F.lit(0.0))
    return r.groupBy("family").agg(R(F.avg(scoring.interval_score(F.lit(0.8), lo, hi, F.col("realized"))), 3).alias("interval_score"), R(F.avg(scoring.pinball_loss(F.lit(0.9), hi, F.col("realized"))), 3).alias("pinball"), R(F.avg(scoring.brier_score(p, F.col("realized") >= 1000.0))).alias("brier"), R(F.avg(distributions.gaussian_log_score(F.col("realized"), F.col("forecast"), F.col("sc"))), 5).alias("log_score"))


@query("pit_uniformity_laplace", f"{BANDS}, u AS (SELECT family, CASE WHEN realized < forecast THEN exp((realized - forecast) / sc) / 2 ELSE 1 - exp(-(realized - forecast) / sc) / 2 END AS u FROM pr), k AS (SELECT family, u, row_number() OVER (PARTITION BY family ORDER BY u) AS i, count(*) OVER (PARTITION BY family) AS n FROM u) SELECT family, count(*) AS n, {S('max(greatest(i / n - u, u - (i - 1) / n))', 5)} AS max_ks_distance, {S('avg(u)', 5)} AS mean_pit FROM k GROUP BY family")
def pit_uniformity_laplace(spark, d):
    rows = bands_of(spark, d).withColumn("u", distributions.laplace_cdf(F.col("realized"), F.col("forecast"), F.col("sc")))
    return calibration.ks_uniform(rows, ["family"]).select("family", "n", R("max_ks_distance", 5).alias("max_ks_distance"), R("mean_pit", 5).alias("mean_pit"))


#: The normal distribution function of abs(z) below 7.07, as in distributions.normal_cdf.
HORNER = lambda c, x: "(" * (len(c) - 1) + f"CAST({c[0]!r} AS DOUBLE)" + "".join(f" * {x} + {v!r})" for v in c[1:])
TAIL = f"CASE WHEN abs(z) > 37 THEN 0.0 WHEN abs(z) < 7.07106781186547 THEN exp(-z * z / 2) * {HORNER(distributions.HART_ABOVE, 'abs(z)')} / {HORNER(distributions.HART_BELOW, 'abs(z)')} ELSE exp(-z * z / 2) / (abs(z) + 1 / (abs(z) + 2 / (abs(z) + 3 / (abs(z) + 4 / (abs(z) + 0.65))))) / sqrt(2 * pi()) END"
PHI = f"CASE WHEN z > 0 THEN 1 - ({TAIL}) ELSE {TAIL} END"


@query("gaussian_crps_and_pit", f"""{BANDS}, zz AS (SELECT family, sc, (realized - forecast) / sc AS z FROM pr), u AS (SELECT family, sc, z, {PHI} AS u FROM zz), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY u) AS i, count(*) OVER (PARTITION BY family) AS n FROM u)
 SELECT family, count(*) AS n, {S('max(greatest(i / n - u, u - (i - 1) / n))', 5)} AS max_ks_distance, {S('avg(sc * (z * (2 * u - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))', 3)} AS crps FROM k GROUP BY family""")
def gaussian_crps_and_pit(spark, d):
    y, at, sc = F.col("realized"), F.col("forecast"), F.col("sc")
    rows = bands_of(spark, d).withColumn("u", distributions.gaussian_pit(y, at, sc)).withColumn("crps", distributions.crps(y, at, sc))
    return calibration.ks_uniform(rows, ["family"]).join(rows.groupBy("family").agg(F.avg("crps").alias("crps")), "family").select("family", "n", R("max_ks_distance", 5).alias("max_ks_distance"), R("crps", 3).alias("crps"))


@query("student_t_log_scores", f"{BANDS} SELECT family, {S('avg(lgamma(2.5) - lgamma(3.0) + 0.5 * ln(5 * pi()) + ln(sc) + 3.0 * ln(1 + (realized - forecast) * (realized - forecast) / (sc * sc) / 5))', 5)} AS student_t, {S('avg(abs(realized - forecast) / sc + ln(2 * sc))', 5)} AS laplace FROM pr GROUP BY family")
def student_t_log_scores(spark, d):
    y, at, sc = F.col("realized"), F.col("forecast"), F.col("sc")
    return bands_of(spark, d).groupBy("family").agg(R(F.avg(distributions.student_t_log_score(y, at, sc, 5.0)), 5).alias("student_t"), R(F.avg(distributions.laplace_log_score(y, at, sc)), 5).alias("laplace"))


REL = "WITH e AS (SELECT o_orderpriority AS grp, o_orderkey AS k, round(o_totalprice / 600000.0, 2) AS p, o_orderstatus = 'F' AS event FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, k) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM e)"


def _rel(name: str, strategy: str, bin_sql: str):
    @query(name, f"{REL} SELECT grp, CAST({bin_sql} AS INT) AS bin, count(*) AS n, {S('avg(p)')} AS mean_p, {S('avg(CASE WHEN event THEN 1.0 ELSE 0.0 END)')} AS frequency FROM f GROUP BY 1, 2")
    def run(spark, d):
        rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") / 600000.0, 2).alias("p"), (F.col("o_orderstatus") == "F").alias("event"))
        return calibration.reliability_bins(rows, ["grp"], ["k"], strategy, 10, 40).select("grp", "bin", "n", R("mean_p").alias("mean_p"), R("frequency").alias("frequency"))

    return run


_rel("reliability_equal_width", "equal_width", "least(floor(p * 10), 9)")
_rel("reliability_equal_mass", "equal_mass", "floor((rn - 1) / ceil(n / 10))")
_rel("reliability_adaptive", "adaptive_min_count", "least(floor((rn - 1) / 40), greatest(floor(n / 40) - 1, 0))")


@query("reliability_exact", f"{REL}, g AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY p) - 1 AS b FROM f) SELECT grp, CAST(b AS INT) AS bin, count(*) AS n, {S('avg(p)')} AS mean_p, {S('avg(CASE WHEN event THEN 1.0 ELSE 0.0 END)')} AS frequency FROM g GROUP BY 1, 2")
def reliability_exact(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") / 600000.0, 2).alias("p"), (F.col("o_orderstatus") == "F").alias("event"))
    return calibration.reliability_bins(rows, ["grp"], ["k"]).select("grp", F.col("bin").cast("int").alias("bin"), "n", R("mean_p").alias("mean_p"), R("frequency").alias("frequency"))


@query("partial_pooling", f"WITH {I4}, o AS (SELECT entity, count(*) AS n, sum(target) AS s FROM i4 GROUP BY 1), g AS (SELECT sum(s) / sum(n) AS g, arg_min(n, entity) AS n1 FROM o) SELECT entity, n, {S('g', 4)} AS global_mean, {S('n1 / (n1 + 1.0)')} AS shrinkage, {S('g + n1 / (n1 + 1.0) * (s / n - g)', 4)} AS pooled_mean FROM o, g")
def partial_pooling(spark, d):
    return panel.partial_pooling(monthly(spark, d)).select("entity", "n", R("global_mean", 4).alias("global_mean"), R("shrinkage").alias("shrinkage"), R("pooled_mean", 4).alias("pooled_mean"))


@query("leave_one_entity_out", f"WITH {I4}, e AS (SELECT DISTINCT entity FROM i4), p AS (SELECT e.entity, avg(target) AS p FROM e JOIN i4 ON i4.entity <> e.entity GROUP BY 1) SELECT i4.entity, count(*) AS n, {S('any_value(p)', 3)} AS prediction, {S('avg((target - p) * (target - p)) / 1e6', 3)} AS mse FROM i4 JOIN p USING (entity) GROUP BY 1")
def leave_one_entity_out(spark, d):
    return panel.leave_one_entity_out(monthly(spark, d)).select("entity", "n", R("prediction", 3).alias("prediction"), R(F.col("mse") / 1e6, 3).alias("mse"))


@query("leave_one_entity_out_splits", f"WITH {I4}, o AS (SELECT entity, count(*) AS n FROM i4 GROUP BY 1) SELECT entity AS held_out, 'test' AS role, n AS n_rows, CAST(1 AS BIGINT) AS n_entities FROM o UNION ALL SELECT entity, 'train', CAST((SELECT sum(n) FROM o) - n AS BIGINT), (SELECT count(*) FROM o) - 1 FROM o")
def leave_one_entity_out_splits(spark, d):
    return panel.leave_one_entity_out_splits(monthly(spark, d))


@query("shared_structure", f"WITH {I4}, o AS (SELECT entity, count(*) AS n, sum(target) AS s FROM i4 GROUP BY 1), g AS (SELECT sum(s) / sum(n) AS g, arg_min(n, entity) AS n1 FROM o), f AS (SELECT n1 / (n1 + 1.0) * (s / n - g) AS o FROM o, g) SELECT count(*) AS n_entities, {S('max(o) - min(o)', 3)} AS offset_range, 'passed' AS leakage_status FROM f")
def shared_structure(spark, d):
    return panel.shared_structure(monthly(spark, d), "target", ["lag_1"]).select("n_entities", R("offset_range", 3).alias("offset_range"), "leakage_status")


def _env(name: str, policy: str, sql: str, **options):
    @query(name, f"WITH {I4}, {sql} SELECT environment, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM env GROUP BY 1")
    def run(spark, d):
        own = {k: (v(spark) if callable(v) else v) for k, v in options.items()}
        return panel.environment_sizes(panel.environments(monthly(spark, d), policy, ["event_time", "entity"], **own))

    return run


_env("environments_entity", "entity", "env AS (SELECT *, entity AS environment FROM i4)")
_env("environments_rolling_era", "rolling_era", "o AS (SELECT *, row_number() OVER (ORDER BY event_time, entity) - 1 AS i, count(*) OVER () AS n FROM i4), env AS (SELECT *, 'era_' || CAST(CAST(floor(i / ceil(n / 4)) + 1 AS BIGINT) AS VARCHAR) AS environment FROM o)")
_env("environments_volatility", "volatility_regime", "o AS (SELECT *, coalesce(abs(target - lag(target) OVER (ORDER BY event_time, entity)), 0) AS dd FROM i4), m AS (SELECT list_sort(list(dd))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM o), env AS (SELECT o.*, CASE WHEN dd > m THEN 'high_volatility' ELSE 'low_volatility' END AS environment FROM o, m)")
_env("environments_intervention", "intervention_window", "w AS (SELECT * FROM (VALUES ('a', TIMESTAMP '1996-01-01', TIMESTAMP '1997-06-01'), ('b', TIMESTAMP '1997-01-01', TIMESTAMP '1998-01-01')) t(k, s, e)), env AS (SELECT i4.*, coalesce(k, 'outside_intervention') AS environment FROM i4 LEFT JOIN w ON event_time BETWEEN s AND e)",
     windows=lambda spark: spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'1996-01-01', TIMESTAMP_NTZ'1997-06-01'), ('b', TIMESTAMP_NTZ'1997-01-01', TIMESTAMP_NTZ'1998-01-01') AS t(window_id, start, end)"))


ERA = f"WITH {BASE}, res AS (SELECT a4.entity, idx, 'era_' || CAST(CAST(floor(idx / 24) AS BIGINT) AS VARCHAR) AS environment, target - intercept - slope * lag_1 AS r FROM a4 JOIN base USING (entity))"


def residuals_of(spark, d):
    rows = fits.ar1_pairs(monthly(spark, d))
    base = fits.affine_fit(rows, ["entity"], "lag_1", "target").drop("n")
    out = rows.join(base, "entity").withColumn("residual", F.col("target") - F.col("intercept") - F.col("slope") * F.col("lag_1"))
    return out.withColumn("environment", F.concat(F.lit("era_"), F.floor(F.col("idx") / 24).cast("string")))


@query("residual_invariance", f"{ERA}, m AS (SELECT environment, avg(abs(r)) AS m FROM res GROUP BY 1) SELECT {S('max(m)', 3)} AS max_mean_abs, {S('min(m)', 3)} AS min_mean_abs, {S('max(m) - min(m)', 3)} AS spread FROM m")
def residual_invariance(spark, d):
    return panel.residual_invariance(residuals_of(spark, d)).select(*(R(c, 3).alias(c) for c in ("max_mean_abs", "min_mean_abs", "spread")))


@query("environment_parameter_stability", f"{ERA}, m AS (SELECT entity AS parameter, environment, avg(r) AS v FROM res GROUP BY 1, 2) SELECT parameter, CASE WHEN count(*) < (SELECT count(DISTINCT environment) FROM m) THEN CAST('inf' AS DOUBLE) ELSE {S('max(v) - min(v)', 3)} END AS range_value FROM m GROUP BY 1")
def environment_parameter_stability(spark, d):
    m = residuals_of(spark, d).groupBy(F.col("entity").alias("parameter"), "environment").agg(F.avg("residual").alias("value"))
    return panel.parameter_stability(m).select("parameter", R("range", 3).alias("range_value"))


@query("support_stability", "WITH s AS (SELECT DISTINCT c_mktsegment AS e, c_nationkey AS t FROM customer WHERE c_acctbal > 9000), p AS (SELECT a.e AS a, b.e AS b, (SELECT count(*) FROM s x JOIN s y USING (t) WHERE x.e = a.e AND y.e = b.e) AS i, (SELECT count(DISTINCT t) FROM s WHERE e IN (a.e, b.e)) AS u FROM (SELECT DISTINCT e FROM s) a JOIN (SELECT DISTINCT e FROM s) b ON a.e < b.e) SELECT round(coalesce(min(i / u), 1.0), 6) + 0.0 AS min_jaccard FROM p")
def support_stability(spark, d):
    s = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("environment"), F.col("c_nationkey").alias("term"))
    return panel.support_stability(s).select(R("min_jaccard").alias("min_jaccard"))


ENVL = f"{ERA}, m AS (SELECT environment, avg(abs(r)) AS loss, avg(CASE WHEN entity < '3' THEN abs(r) END) AS train_loss, avg(CASE WHEN entity >= '3' THEN abs(r) END) AS holdout_loss FROM res GROUP BY 1)"


def env_losses(spark, d):
    a = F.abs("residual")
    return residuals_of(spark, d).groupBy("environment").agg(F.avg(a).alias("loss"), F.avg(F.when(F.col("entity") < "3", a)).alias("train_loss"), F.avg(F.when(F.col("entity") >= "3", a)).alias("holdout_loss"))


@query("holdout_stability", f"{ENVL} SELECT {S('greatest(0.0, max(holdout_loss - train_loss))', 3)} AS max_degradation FROM m")
def holdout_stability(spark, d):
    return panel.holdout_stability(env_losses(spark, d)).select(R("max_degradation", 3).alias("max_degradation"))


@query("transport", f"{ENVL}, t AS (SELECT max(CASE WHEN environment <> 'era_0' THEN loss END) - min(CASE WHEN environment = 'era_0' THEN loss END) AS dd FROM m) SELECT {S('dd', 3)} AS degradation, CASE WHEN dd <= 50 THEN 'passed' ELSE 'failed' END AS status FROM t")
def transport(spark, d):
    return panel.transport(env_losses(spark, d), ["era_0"], 50.0).select(R("degradation", 3).alias("degradation"), "status")


@query("residual_diagnostics", f"""{ERA}, a AS (SELECT entity, idx, r, avg(r) OVER (PARTITION BY entity) AS m, lag(r) OVER (PARTITION BY entity ORDER BY idx) AS p FROM res), sg AS (SELECT entity, idx, sign(r) AS s, lag(sign(r)) OVER (PARTITION BY entity ORDER BY idx) AS q FROM res WHERE r <> 0), ru AS (SELECT entity, 1 + coalesce(sum(CASE WHEN s <> q THEN 1 ELSE 0 END), 0) AS runs FROM sg GROUP BY 1)
 SELECT entity, count(*) AS n, {S('stddev_pop(r)', 3)} AS scale, {S('sum((r - m) * (p - m)) / sum((r - m) * (r - m))', 5)} AS autocorrelation, {S('max(abs(r - m)) / stddev_pop(r)', 4)} AS max_standardized, CAST(any_value(runs) AS BIGINT) AS sign_runs FROM a JOIN ru USING (entity) GROUP BY 1""")
def residual_diagnostics(spark, d):
    return falsification.residual_diagnostics(residuals_of(spark, d).select("entity", "idx", "residual"), ["entity"], "idx").select("entity", "n", R("scale", 3).alias("scale"), R("autocorrelation", 5).alias("autocorrelation"), R("max_standardized", 4).alias("max_standardized"), "sign_runs")


@query("residual_sequence_signal", f"{ERA}, p AS (SELECT entity, r AS y, lag(r) OVER (PARTITION BY entity ORDER BY idx) AS x FROM res), c AS (SELECT entity, sum(x * y) / sum(x * x) AS c FROM p WHERE x IS NOT NULL GROUP BY 1) SELECT entity, count(*) AS n_pairs, {S('any_value(c)', 5)} AS coefficient, {S('avg(abs(y - c * x)) / avg(abs(y))', 5)} AS mae_ratio, {S('1 - avg((y - c * x) * (y - c * x)) / var_pop(y)', 5)} AS r_squared FROM p JOIN c USING (entity) WHERE x IS NOT NULL GROUP BY 1")
def residual_sequence_signal(spark, d):
    return falsification.sequence_signal(residuals_of(spark, d).select("entity", "idx", "residual"), ["entity"], "idx").select("entity", "n_pairs", *(R(c, 5).alias(c) for c in ("coefficient", "mae_ratio", "r_squared")))


@query("window_parameter_stability", f"WITH {I4}, p AS (SELECT entity, CAST(floor(idx / 20) AS BIGINT) AS w, avg(target) AS v FROM i4 WHERE idx < 60 GROUP BY 1, 2) SELECT entity, {S('(max(v) - min(v)) / greatest(abs(avg(v)), 1e-12)', 5)} AS relative_range FROM p GROUP BY 1")
def window_parameter_stability(spark, d):
    p = monthly(spark, d).where("idx < 60").groupBy("entity", F.floor(F.col("idx") / 20).alias("window")).agg(F.avg("target").alias("value")).withColumn("parameter", F.lit("level"))
    return falsification.window_stability(p, ["entity"], 0.5).select("entity", R("relative_range", 5).alias("relative_range"))


@query("null_p_values", f"{ERA}, o AS (SELECT entity, abs(sum(r * p)) AS observed FROM (SELECT entity, r, lag(r) OVER (PARTITION BY entity ORDER BY idx) AS p FROM res) GROUP BY 1), s AS (SELECT entity, k, abs(sum(r * p)) AS statistic FROM (SELECT entity, k, r, lag(r) OVER (PARTITION BY entity, k ORDER BY md5(CAST(k AS VARCHAR) || ':' || CAST(idx AS VARCHAR))) AS p FROM res, (SELECT unnest(range(0, 19)) AS k)) GROUP BY 1, 2) SELECT entity, count(*) AS n_surrogates, {S('(1 + count(*) FILTER (statistic >= observed)) / (count(*) + 1)')} AS p_value FROM s JOIN o USING (entity) GROUP BY 1")
def null_p_values(spark, d):
    r = residuals_of(spark, d).select("entity", "idx", "residual")
    stat = lambda rows, by, order: rows.withColumn("p", F.lag("residual").over(Window.partitionBy(*by).orderBy(order))).groupBy(*by).agg(F.abs(F.sum(F.col("residual") * F.col("p"))).alias("statistic"))
    sur = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(18)))).withColumn("o", F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("idx").cast("string"))))
    out = falsification.null_p_value(stat(r, ["entity"], "idx").withColumnRenamed("statistic", "observed"), stat(sur, ["entity", "k"], "o"), ["entity"], 0.05)
    return out.select("entity", "n_surrogates", R("p_value").alias("p_value"))


@query("perturbation_rates", "SELECT o_orderpriority AS family, count(*) AS n_runs, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS match_rate, round(avg(CASE WHEN o_totalprice - 200000 > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS gain_rate FROM orders GROUP BY 1")
def perturbation_rates(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), (F.col("o_orderstatus") == "F").alias("canonical_match"), (F.col("o_totalprice") - 200000).alias("gain_bits"), F.lit(None).cast("boolean").alias("beats_baseline"))
    return falsification.perturbation_rates(runs, ["family"]).select("family", "n_runs", R("match_rate").alias("match_rate"), R("gain_rate").alias("gain_rate"))


@query("counterexamples", "SELECT o_orderkey AS case_id, CAST(len(list_filter([CASE WHEN o_orderstatus = 'P' THEN 1 END, CASE WHEN abs(o_totalprice - 250000) > 240000 THEN 1 END, CASE WHEN o_custkey % 97 > 90 THEN 1 END], lambda x: x IS NOT NULL)) AS INT) AS n_reasons FROM orders WHERE o_orderstatus = 'P' OR abs(o_totalprice - 250000) > 240000 OR o_custkey % 97 > 90")
def counterexamples(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_totalprice") - 250000).alias("error"), (F.col("o_custkey") % 97).alias("distance"), (F.col("o_orderstatus") != "P").alias("in_domain"))
    return falsification.counterexamples(cases, 240000, 90).select("case_id", F.size("reason_codes").alias("n_reasons"))


@query("recovery_rates", "WITH r AS (SELECT c_mktsegment AS track, CASE c_nationkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'missed' END AS status, c_acctbal > 0 AS h, c_custkey % 2 = 0 AS a FROM customer) SELECT track, count(*) AS n, round(avg(CASE WHEN status IN ('exact', 'near') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS recovery_rate, round(count(*) FILTER (a AND h) / nullif(count(*) FILTER (a), 0), 6) + 0.0 AS false_claim_rate FROM r GROUP BY 1")
def recovery_rates(spark, d):
    k = F.col("c_nationkey") % 3
    r = table(spark, d, "customer").select(F.col("c_mktsegment").alias("track"), F.when(k == 0, "exact").when(k == 1, "near").otherwise("missed").alias("status"), (F.col("c_acctbal") > 0).alias("holistic"), (F.col("c_custkey") % 2 == 0).alias("adversarial"))
    return falsification.recovery_rates(r, ["track"]).select("track", "n", R("recovery_rate").alias("recovery_rate"), R("false_claim_rate").alias("false_claim_rate"))


CP = "WITH t AS (SELECT DISTINCT event_type AS entity, CAST(epoch(ts) / 86400 AS BIGINT) AS at FROM events WHERE value > 150), d AS (SELECT DISTINCT event_type AS entity, CAST(epoch(ts) / 86400 AS BIGINT) AS at FROM events WHERE value BETWEEN 100 AND 110)"


def change_sets(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("entity"), F.round(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double") / 86400 + (F.date_format("ts", "SSSSSS").cast("double") / 1e6 / 86400)).cast("long").alias("at"), "value")
    return e.where("value > 150").select("entity", "at").distinct(), e.where("value between 100 and 110").select("entity", "at").distinct()


@query("change_point_hausdorff", f"{CP}, a AS (SELECT t.entity, t.at, min(abs(t.at - d.at)) AS m FROM t JOIN d USING (entity) GROUP BY 1, 2), b AS (SELECT d.entity, d.at, min(abs(t.at - d.at)) AS m FROM t JOIN d USING (entity) GROUP BY 1, 2) SELECT entity, max(m) AS hausdorff FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def change_point_hausdorff(spark, d):
    return falsification.hausdorff(*change_sets(spark, d), ["entity"])


@query("change_point_metrics")
def change_point_metrics(spark, d):
    return falsification.change_point_metrics(*change_sets(spark, d), ["entity"], 1)


AC = f"{PAIRS}, x AS (SELECT entity, origin_index AS t, diff AS v FROM df WHERE horizon = 1), cx AS (SELECT entity, t, v - avg(v) OVER (PARTITION BY entity) AS v, count(*) OVER (PARTITION BY entity) AS n FROM x), g AS (SELECT a.entity, a.n, k AS lag, coalesce(sum(a.v * b.v), 0) AS s FROM cx a CROSS JOIN (SELECT unnest(range(0, 5)) AS k) LEFT JOIN cx b ON b.entity = a.entity AND b.t = a.t - k GROUP BY 1, 2, 3)"


@query("effective_sample_size", f"WITH {AC} SELECT entity, n, {S('round(n / greatest(1.0, 1 + 2 * sum(CASE WHEN lag > 0 AND lag <= greatest(1, floor(sqrt(n))) AND lag < n THEN s ELSE 0 END) / sum(CASE WHEN lag = 0 THEN s END)), 6)', 5)} AS n_eff FROM g GROUP BY 1, 2")
def effective_sample_size(spark, d):
    return inference.effective_sample_size(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 4).select("entity", "n", R("n_eff", 5).alias("n_eff"))


@query("pair_policy", f"WITH {AC}, e AS (SELECT entity, n, n / greatest(1.0, 1 + 2 * sum(CASE WHEN lag > 0 AND lag <= greatest(1, floor(sqrt(n))) AND lag < n THEN s ELSE 0 END) / sum(CASE WHEN lag = 0 THEN s END)) AS e FROM g GROUP BY 1, 2) SELECT entity, CAST(floor(n / 3) AS BIGINT) AS blocks, CASE WHEN e < 25 OR floor(n / 3) < 8 THEN 'abstain' WHEN e < 50 THEN 'human_review' ELSE 'run' END AS decision FROM e")
def pair_policy(spark, d):
    e = inference.effective_sample_size(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 4)
    return inference.pair_policy(e, 3).select("entity", F.col("blocks").cast("long").alias("blocks"), "decision")


@query("hac_mean_errors", f"WITH {AC}, v AS (SELECT entity, n, sum(CASE WHEN lag = 0 THEN s ELSE 2 * (1 - lag / 5.0) * s END) AS v FROM g GROUP BY 1, 2), m AS (SELECT entity, avg(v) AS m FROM x GROUP BY 1) SELECT entity, n, {S('m', 4)} AS mean, {S('sqrt(greatest(v, 0)) / n', 4)} AS standard_error FROM v JOIN m USING (entity)")
def hac_mean_errors(spark, d):
    return inference.hac_mean_test(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 4).select("entity", "n", R("mean", 4).alias("mean"), R("standard_error", 4).alias("standard_error"))


@query("hac_mean_test")
def hac_mean_test(spark, d):
    return inference.hac_mean_test(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 4).select("entity", R("lower", 4).alias("lower"), R("upper", 4).alias("upper"), R("p_value", 6).alias("p_value"))


@query("stationary_bootstrap")
def stationary_bootstrap(spark, d):
    return inference.stationary_bootstrap(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 5, 200, 7).select("entity", "n", R("lower", 4).alias("lower"), R("upper", 4).alias("upper"), "p_value")


@query("declared_tests", f"WITH {I1} SELECT entity, 'failed' AS status FROM i1 GROUP BY 1")
def declared_tests(spark, d):
    """The test is declared without an implementation, so its status is fixed; nothing is computed."""
    return inference.declared_test("giacomini_white_conditional_predictive_ability", diffs_of(spark, d), ["entity"], "origin_index", "loss_difference")


@query("ljung_box", f"WITH {AC}, z AS (SELECT entity, s AS z FROM g WHERE lag = 0) SELECT entity, n, {S('n * (n + 2) * sum((s / z) * (s / z) / (n - lag))', 4)} AS q FROM g JOIN z USING (entity) WHERE lag > 0 GROUP BY 1, 2")
def ljung_box(spark, d):
    return inference.ljung_box(diffs_of(spark, d).where("horizon = 1"), ["entity"], "origin_index", "loss_difference", 4).select("entity", "n", R("q", 4).alias("q"))


@query("cusum_stability", f"WITH {I1}, c AS (SELECT entity, idx, target, sum(target - m) OVER (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, avg(target) OVER (PARTITION BY entity) AS m FROM i1)), s AS (SELECT entity, count(*) AS n, max(abs(c)) / (stddev_samp(target) * sqrt(count(*))) AS s FROM c GROUP BY 1) SELECT entity, n, {S('s', 5)} AS statistic, CASE WHEN s > 1.3581 THEN 'unstable' ELSE 'stable' END AS status FROM s")
def cusum_stability(spark, d):
    return inference.cusum(daily(spark, d), ["entity"], "idx", "target").select("entity", "n", R("statistic", 5).alias("statistic"), "status")


@query("level_shifts", f"WITH {I1}, f AS (SELECT entity, idx, CAST(floor(target / 500) AS BIGINT) AS l, lag(CAST(floor(target / 500) AS BIGINT)) OVER (PARTITION BY entity ORDER BY idx) AS p FROM i1) SELECT entity, idx AS at FROM f WHERE p IS NOT NULL AND l <> p")
def level_shifts(spark, d):
    rows = daily(spark, d).withColumn("level", F.floor(F.col("target") / 500))
    return inference.level_shifts(rows, ["entity"], "idx", "level").withColumn("at", F.col("at").cast("long"))


@query("change_points")
def change_points(spark, d):
    return inference.change_points(monthly(spark, d).withColumn("idx", F.col("idx").cast("long")), ["entity"], "idx", "target")


@query("local_level_states")
def local_level_states(spark, d):
    return inference.local_level(monthly(spark, d), ["entity"], "idx", "target").select("entity", "idx", R("smoothed", 3).alias("smoothed"))


@query("regime_probabilities")
def regime_probabilities(spark, d):
    rows = monthly(spark, d)
    return inference.regime_identifiability(inference.regime_switching(rows, ["entity"], "idx", "target"), rows, ["entity"], "idx", "target").select("entity", R("min_separation", 2).alias("min_separation"), R("mean_confidence", 4).alias("mean_confidence"))


@query("lineage_closure", """WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS parent, 'nation:' || n_nationkey AS child FROM nation UNION SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem),
 c AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT c.root, e.child, c.depth + 1 FROM c JOIN e ON e.parent = c.node) SELECT root, node, CAST(min(depth) AS INT) AS depth FROM c GROUP BY 1, 2""")
def lineage_closure(spark, d):
    """What each region leads to, over nations, suppliers and the parts they deliver."""
    name = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    edges = table(spark, d, "nation").select(name("region", "n_regionkey").alias("parent"), name("nation", "n_nationkey").alias("child"))
    edges = edges.unionByName(table(spark, d, "supplier").select(name("nation", "s_nationkey").alias("parent"), name("supplier", "s_suppkey").alias("child")))
    edges = edges.unionByName(table(spark, d, "lineitem").select(name("supplier", "l_suppkey").alias("parent"), name("part", "l_partkey").alias("child")).distinct())
    return lineage.closure(edges, table(spark, d, "region").select(name("region", "r_regionkey").alias("node"))).select("root", "node", "depth")


@query("manifest_upsert", "SELECT 'r' || (n_regionkey) AS run_id, n_name AS manifest_id, 'sha256:' || sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS content_hash FROM nation")
def manifest_upsert(spark, d):
    n = lineage.content_addressed(table(spark, d, "nation"), ["n_name", "n_nationkey"]).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("run_id"), F.col("n_name").alias("manifest_id"), "content_hash")
    return lineage.register(n.where("manifest_id < 'NATION_15'"), n)


@query("manifest_conflicts", "SELECT 'r' || n_regionkey AS run_id, n_name AS manifest_id FROM nation WHERE n_nationkey % 3 = 0")
def manifest_conflicts(spark, d):
    """A third of the incoming manifests come with another payload."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("run_id"), F.col("n_name").alias("manifest_id"), "n_nationkey")
    of = lambda c: n.select("run_id", "manifest_id", lineage.digest(c).alias("content_hash"))
    again = F.when(F.col("n_nationkey") % 3 == 0, F.lit("changed")).otherwise(F.col("manifest_id"))
    return lineage.upsert_manifests(of(F.col("manifest_id")), of(again))[1].select("run_id", "manifest_id")


MANIFESTS = "m AS (SELECT DISTINCT 'order:' || l_orderkey AS manifest_id, 'r' || (l_orderkey % 5) AS run_id FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'parts' FROM lineitem)"


def manifests_of(spark, d):
    li = table(spark, d, "lineitem")
    name = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    m = li.select(name("order", "l_orderkey").alias("manifest_id"), F.concat(F.lit("r"), (F.col("l_orderkey") % 5).cast("string")).alias("run_id")).unionByName(li.select(name("part", "l_partkey").alias("manifest_id"), F.lit("parts").alias("run_id"))).distinct()
    return li.select(name("order", "l_orderkey").alias("parent"), name("part", "l_partkey").alias("child")).distinct(), m


@query("referenced_manifests", f"WITH {MANIFESTS} SELECT manifest_id, run_id FROM m WHERE manifest_id IN (SELECT 'part:' || l_partkey FROM lineitem WHERE l_orderkey = 1)")
def referenced_manifests(spark, d):
    return lineage.referenced_manifests(*manifests_of(spark, d), "order:1").select("manifest_id", "run_id")


@query("manifest_referrers", f"WITH {MANIFESTS} SELECT manifest_id, run_id FROM m WHERE manifest_id IN (SELECT 'order:' || l_orderkey FROM lineitem WHERE l_partkey = 7)")
def manifest_referrers(spark, d):
    return lineage.referrers(*manifests_of(spark, d), "part:7").select("manifest_id", "run_id")


@query("manifests_of_run", f"WITH {MANIFESTS} SELECT manifest_id, run_id FROM m WHERE run_id = 'r3'")
def manifests_of_run(spark, d):
    return lineage.manifests_of_run(manifests_of(spark, d)[1], "r3").select("manifest_id", "run_id")


@query("replay_differences", f"""WITH {LOSSES}, m AS (SELECT entity, family, {S('avg(loss)', 4)} AS mae, {S("avg(CASE WHEN horizon = 3 AND family = 'drift' THEN loss + 1 ELSE loss END)", 4)} AS again FROM lss GROUP BY 1, 2)
 SELECT entity, family, mae, 'recorded' AS side FROM m WHERE mae <> again UNION ALL SELECT entity, family, again, 'replayed' FROM m WHERE mae <> again""")
def replay_differences(spark, d):
    """One family's losses are disturbed in the replay, so both of its versions are reported."""
    mean = lambda c: losses_of(spark, d).groupBy("entity", "family").agg(R(F.avg(c), 4).alias("mae"))
    disturbed = F.when((F.col("horizon") == 3) & (F.col("family") == "drift"), F.col("loss") + 1).otherwise(F.col("loss"))
    return lineage.replay_differences(mean(F.col("loss")), mean(disturbed)).select("entity", "family", "mae", "side")


@query("expression_columns", f"SELECT l_orderkey, l_linenumber, {S('ln(l_extendedprice) * sqrt(l_quantity) + CASE WHEN l_discount > 0.05 THEN tanh(l_tax) ELSE 1 / (1 + exp(-l_discount)) END', 6)} AS v FROM lineitem")
def expression_columns(spark, d):
    tree = ("add", ("mul", ("log", ("var", "l_extendedprice")), ("sqrt", ("var", "l_quantity"))), ("if", ("gt", ("var", "l_discount"), ("lit", 0.05)), ("tanh", ("var", "l_tax")), ("sigmoid", ("var", "l_discount"))))
    tree = expression.simplify(("mul", tree, ("lit", 1.0)))[0]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(expression.compile_expression(tree)).alias("v"))


@query("sequence_expressions", f"WITH {I1} SELECT entity, idx, {S('target - lag(target) OVER w')} AS difference, {S('avg(target) OVER (PARTITION BY entity ORDER BY idx ROWS 2 PRECEDING)')} AS mean_3, {S('(idx % 7) / 7.0')} AS phase FROM i1 WINDOW w AS (PARTITION BY entity ORDER BY idx)")
def sequence_expressions(spark, d):
    w = Window.partitionBy("entity").orderBy("idx")
    go = lambda e: expression.compile_expression(e, window=w)
    return daily(spark, d).select("entity", F.col("idx").cast("long").alias("idx"), R(go(("finite_difference", ("var", "target")))).alias("difference"), R(go(("rolling_mean", ("var", "target"), ("lit", 3)))).alias("mean_3"), R(go(("seasonal_phase", ("var", "idx"), ("lit", 7.0)))).alias("phase"))


@query("piecewise_segments", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'middle' ELSE 'high' END AS segment FROM lineitem")
def piecewise_segments(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", composition.segment_of(F.col("l_quantity"), [("low", 0, 10), ("middle", 10, 30), ("high", 30, 50)]).alias("segment"))


@query("affine_forecast_paths", f"WITH {BASE}, o AS (SELECT entity, idx, target FROM i4 WHERE idx >= 60) SELECT o.entity, idx AS origin_index, h AS horizon, {S('CASE h WHEN 1 THEN intercept + slope * target WHEN 2 THEN intercept + slope * (intercept + slope * target) ELSE intercept + slope * (intercept + slope * (intercept + slope * target)) END', 3)} AS forecast FROM o JOIN base USING (entity), (SELECT CAST(unnest([1, 2, 3]) AS INT) AS h)")
def affine_forecast_paths(spark, d):
    rows = monthly(spark, d)
    p = fits.affine_fit(fits.ar1_pairs(rows), ["entity"], "lag_1", "target")
    o = rows.where("idx >= 60").select("entity", F.col("idx").cast("long").alias("origin_index"), F.col("target").alias("origin_value"))
    return composition.paths(o, p, ["entity"], 3).select("entity", "origin_index", "horizon", R("forecast", 3).alias("forecast"))


@query("program_fits")
def program_fits(spark, d):
    texts = ["(program (state (lit 0)) (next (obs 0)) (emit (state 0)))", "(program (state (lit 0)) (next (add (mul (lit 1/2) (obs 0)) (mul (lit 1/2) (state 0)))) (emit (state 0)))"]
    return programs.fit_programs(daily(spark, d), texts).select("entity", "program", R("loss", 2).alias("loss"))


@query("trend_winners_by_entity", f"WITH {LOSSES}, m AS (SELECT entity, family, round(avg(loss), 4) AS mae FROM lss GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mae, family) AS r FROM m) SELECT entity, family FROM r WHERE r = 1")
def trend_winners_by_entity(spark, d):
    m = losses_of(spark, d).groupBy("entity", "family").agg(R(F.avg("loss"), 4).alias("mae"))
    return selection.ranked(m, ["entity"], ("mae", "family")).where("rank = 1").select("entity", "family")
