"""Queries over forecast paths and probabilistic rows, one for each form, at every origin of the monthly series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lawloom.functions import programs
from lawloom.operators import fits, panel, paths
from lawloom.plans.queries_core import BASE, OLS, R, S, monthly
from lawloom.plans.queries_evidence import TAIL
from lawloom.plans.registry import query
from lawloom.sources.panels import I1, I4, daily_totals

H = "(SELECT CAST(unnest([1, 2, 3]) AS INT) AS horizon) h"
#: a + b(a + b(...)) after 1, 2 and 3 steps from y.
STEPS = "CASE horizon WHEN 1 THEN {a} + {b} * {y} WHEN 2 THEN {a} + {b} * ({a} + {b} * {y}) ELSE {a} + {b} * ({a} + {b} * ({a} + {b} * {y})) END".format
OUT = f"entity, idx AS origin_index, horizon, {S('forecast', 3)} AS forecast"


def origins_of(spark, d):
    """entity, idx, origin_value, parameters (the affine fit of the whole series)."""
    rows = monthly(spark, d)
    base = fits.affine_fit(fits.ar1_pairs(rows), ["entity"], "lag_1", "target")
    m = F.create_map(F.lit("intercept"), F.col("intercept"), F.lit("lag_coefficient"), F.col("slope"))
    return rows.select("entity", F.col("idx").cast("long").alias("idx"), F.col("target").alias("origin_value")).join(base.select("entity", m.alias("parameters")), "entity")


def shown(df):
    return df.select("entity", F.col("idx").alias("origin_index"), "horizon", R("forecast", 3).alias("forecast"))


@query("analytic_paths", f"WITH {BASE}, f AS (SELECT entity, idx, horizon, {STEPS(a='intercept', b='slope', y='target')} AS forecast FROM i4 JOIN base USING (entity), {H}) SELECT {OUT} FROM f")
def analytic_paths(spark, d):
    return shown(paths.forecast_path(origins_of(spark, d), "analytic", 3))


DIRECT = f"{I4}, dp AS (SELECT a.entity, a.idx, b.idx - a.idx AS horizon, a.target AS x, b.target AS y FROM i4 a JOIN i4 b ON a.entity = b.entity AND b.idx - a.idx BETWEEN 1 AND 3), df AS (SELECT entity, horizon, s AS slope, ym - s * xm AS intercept FROM (SELECT entity, horizon, {OLS(x='x', y='y')} AS s, avg(y) AS ym, avg(x) AS xm FROM dp GROUP BY 1, 2))"


@query("direct_paths", f"WITH {DIRECT}, f AS (SELECT entity, idx, horizon, intercept + slope * target AS forecast FROM i4 JOIN df USING (entity) WHERE horizon < 3) SELECT {OUT} FROM f")
def direct_paths(spark, d):
    """The fit knows two horizons; the third has no parameters and no row."""
    rows = monthly(spark, d)
    own = fits.affine_fit(fits.direct_pairs(rows, 2), ["entity", "horizon"], "origin_value", "realized")
    name = lambda x: F.concat(F.lit("horizon_"), F.col("horizon").cast("string"), F.lit(f"__{x}"))
    entry = F.array(F.struct(name("intercept").alias("k"), F.col("intercept").alias("v")), F.struct(name("lag_coefficient").alias("k"), F.col("slope").alias("v")))
    m = own.groupBy("entity").agg(F.map_from_entries(F.flatten(F.collect_list(entry))).alias("parameters"))
    out = paths.forecast_path(origins_of(spark, d).drop("parameters").join(m, "entity"), "analytic", 3)
    return shown(out.where(F.col("forecast").isNotNull())).withColumn("horizon", F.col("horizon").cast("long"))


@query("rectified_paths", f"""WITH {BASE}, r AS (SELECT a.entity, b.idx - a.idx AS horizon, avg(b.target - CASE b.idx - a.idx WHEN 1 THEN intercept + slope * a.target ELSE intercept + slope * (intercept + slope * a.target) END) AS c FROM i4 a JOIN i4 b ON a.entity = b.entity AND b.idx - a.idx BETWEEN 1 AND 2 JOIN base ON base.entity = a.entity GROUP BY 1, 2),
 f AS (SELECT i4.entity, idx, h.horizon, {STEPS(a='intercept', b='slope', y='target').replace('CASE horizon', 'CASE h.horizon')} + coalesce(c, 0.0) AS forecast FROM i4 JOIN base USING (entity), {H} LEFT JOIN r ON r.entity = i4.entity AND r.horizon = h.horizon) SELECT {OUT} FROM f""")
def rectified_paths(spark, d):
    """Corrections for two horizons; the third is the plain recursion."""
    fit = fits.rectified_fit(monthly(spark, d), 2)
    key = F.concat(F.lit("rectify_horizon_"), F.col("horizon").cast("string"), F.lit("__intercept"))
    base = F.array(F.struct(F.lit("rectify_base__intercept").alias("k"), F.first("intercept").alias("v")), F.struct(F.lit("rectify_base__lag_coefficient").alias("k"), F.first("slope").alias("v")))
    m = fit.groupBy("entity").agg(F.map_from_entries(F.concat(F.collect_list(F.struct(key.alias("k"), F.col("correction").alias("v"))), base)).alias("parameters"))
    return shown(paths.forecast_path(origins_of(spark, d).drop("parameters").join(m, "entity"), "analytic", 3))


@query("recursive_paths", f"WITH {I4}, f AS (SELECT entity, idx, horizon, avg(target) OVER (PARTITION BY entity, horizon ORDER BY idx ROWS UNBOUNDED PRECEDING) AS forecast FROM i4, {H}) SELECT {OUT} FROM f")
def recursive_paths(spark, d):
    w = Window.partitionBy("entity").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    o = origins_of(spark, d).withColumn("state", F.create_map(F.lit("running_mean"), F.avg("origin_value").over(w)))
    return shown(paths.forecast_path(o, "recursive", 3))


@query("spectral_paths", f"WITH {I4}, f AS (SELECT entity, idx, horizon, 100 * cos(2 * pi() * ((idx + 1 + horizon - 1) % 12) / 12) - 40 * sin(2 * pi() * ((idx + 1 + horizon - 1) % 12) / 12) + 7 * cos(2 * pi() * 3 * ((idx + horizon) % 12) / 12) AS forecast FROM i4, {H}) SELECT {OUT} FROM f")
def spectral_paths(spark, d):
    m = F.create_map(*(x for k, v in (("cosine_1_coefficient", 100.0), ("sine_1_coefficient", -40.0), ("cosine_3_coefficient", 7.0)) for x in (F.lit(k), F.lit(v))))
    o = origins_of(spark, d).withColumn("parameters", m).withColumn("state", F.create_map(F.lit("phase_index"), ((F.col("idx") + 1) % 12).cast("double")))
    return shown(paths.forecast_path(o, "spectral", 3, harmonics=[1, 3], season=12))


@query("piecewise_paths", f"WITH {I4}, m AS (SELECT entity, avg(target) AS g FROM i4 GROUP BY 1), f AS (SELECT entity, idx, horizon, CASE WHEN target / g < 1 THEN {STEPS(a='50.0', b='0.9', y='target')} ELSE 80.0 END AS forecast FROM i4 JOIN m USING (entity), {H}) SELECT {OUT} FROM f")
def piecewise_paths(spark, d):
    m = F.create_map(*(x for k, v in (("low.intercept", 50.0), ("low.lag_coefficient", 0.9), ("high.intercept", 80.0)) for x in (F.lit(k), F.lit(v))))
    share = F.col("origin_value") / F.avg("origin_value").over(Window.partitionBy("entity"))
    o = origins_of(spark, d).withColumn("share", share).withColumn("parameters", m)
    return shown(paths.forecast_path(o, "piecewise", 3, partition=F.col("share"), segments=[("low", 0.0, 1.0), ("high", 1.0, 1e6)]))


@query("additive_residual_paths", f"WITH {BASE}, r AS (SELECT entity, idx, target, intercept, slope, coalesce(target - intercept - slope * lag(target) OVER (PARTITION BY entity ORDER BY idx), 0.0) AS e FROM i4 JOIN base USING (entity)), f AS (SELECT entity, idx, horizon, {STEPS(a='intercept', b='slope', y='target')} + {STEPS(a='1.0', b='0.5', y='e')} AS forecast FROM r, {H}) SELECT {OUT} FROM f")
def additive_residual_paths(spark, d):
    o = origins_of(spark, d)
    p, before = F.col("parameters"), F.lag("origin_value").over(Window.partitionBy("entity").orderBy("idx"))
    o = o.withColumn("residual_lag_1", F.col("origin_value") - p["intercept"] - p["lag_coefficient"] * before)
    m = F.create_map(F.lit("base.intercept"), p["intercept"], F.lit("base.lag_coefficient"), p["lag_coefficient"], F.lit("residual.intercept"), F.lit(1.0), F.lit("residual.lag_coefficient"), F.lit(0.5))
    return shown(paths.forecast_path(o.withColumn("parameters", m), "additive_residual", 3, base="base", residual="residual"))


@query("regime_conditioned_paths", f"WITH {I4}, f AS (SELECT entity, idx, horizon, CASE WHEN idx % 3 = 0 THEN 10.0 ELSE {STEPS(a='5.0', b='0.8', y='target')} END AS forecast FROM i4, {H}) SELECT {OUT} FROM f")
def regime_conditioned_paths(spark, d):
    """A hard switch: the origin row names its regime."""
    m = F.create_map(*(x for k, v in (("calm.intercept", 5.0), ("calm.lag_coefficient", 0.8), ("rough.intercept", 10.0)) for x in (F.lit(k), F.lit(v))))
    o = origins_of(spark, d).withColumn("parameters", m).withColumn("regime", F.when(F.col("idx") % 3 == 0, "rough").otherwise("calm"))
    return shown(paths.forecast_path(o, "regime_conditioned", 3, weights=paths.hard_switch(F.col("regime"), ["calm", "rough"])))


@query("shared_local_paths", f"WITH {BASE}, g AS (SELECT avg(intercept) AS si, avg(slope) AS ss FROM base), f AS (SELECT entity, idx, horizon, {STEPS(a='(si + (intercept - si))', b='(ss + (slope - ss))', y='target')} AS forecast FROM i4 JOIN base USING (entity), g, {H}) SELECT {OUT} FROM f")
def shared_local_paths(spark, d):
    """Every entity's map holds all entities' local parameters, as the fit of a panel does."""
    rows = monthly(spark, d)
    base = fits.affine_fit(fits.ar1_pairs(rows), ["entity"], "lag_1", "target")
    own = lambda name: F.concat(F.lit(f"{name}__"), F.col("entity"))
    g = base.agg(F.avg("intercept").alias("si"), F.avg("slope").alias("ss"))
    local = F.array(F.struct(own("local_adjustment").alias("k"), (F.col("intercept") - F.col("si")).alias("v")), F.struct(own("local_lag_adjustment").alias("k"), (F.col("slope") - F.col("ss")).alias("v")))
    shared = F.array(F.struct(F.lit("shared_intercept").alias("k"), F.first("si").alias("v")), F.struct(F.lit("shared_lag_coefficient").alias("k"), F.first("ss").alias("v")))
    m = base.crossJoin(F.broadcast(g)).agg(F.map_from_entries(F.concat(F.flatten(F.collect_list(local)), shared)).alias("parameters"))
    o = origins_of(spark, d).drop("parameters").crossJoin(F.broadcast(m))  # one row: the panel's parameters
    return shown(paths.forecast_path(o, "shared_plus_local", 3))


@query("algorithmic_paths", f"WITH {I4}, y AS (SELECT entity, arg_max(target, idx) AS y FROM i4 GROUP BY 1), f AS (SELECT entity, horizon, CASE horizon WHEN 1 THEN 0.5 * y + 1 WHEN 2 THEN 0.5 * (0.5 * y + 1) + 1 ELSE 0.5 * (0.5 * (0.5 * y + 1) + 1) + 1 END AS forecast FROM y, {H}) SELECT entity, horizon, {S('forecast', 3)} AS forecast FROM f")
def algorithmic_paths(spark, d):
    """A program whose state is half of what it sees, plus one; after the series it sees its own emits."""
    text = "(program (state (lit 0)) (next (add (mul (lit 1/2) (obs 0)) (lit 1))) (emit (state 0)))"
    return programs.program_paths(monthly(spark, d), text, 3).select("entity", "horizon", R("forecast", 3).alias("forecast"))


@query("missing_forecast_rows", f"WITH {I4}, n AS (SELECT entity, idx, target, horizon, lead(target, horizon) OVER (PARTITION BY entity, horizon ORDER BY idx) AS realized FROM i4, {H}) SELECT entity, idx AS origin_index, horizon, CASE WHEN horizon = 2 THEN 'missing_forecast' ELSE 'missing_realized_value' END AS reason FROM n WHERE horizon = 2 OR realized IS NULL")
def missing_forecast_rows(spark, d):
    """The direct fit knows horizons 1 and 3 only; the last origins have nothing realised."""
    m = F.create_map(F.lit("horizon_1__intercept"), F.lit(1.0), F.lit("horizon_3__intercept"), F.lit(3.0))
    out = paths.forecast_path(origins_of(spark, d).withColumn("parameters", m), "analytic", 3)
    realized = fits.direct_pairs(monthly(spark, d), 3).select("entity", F.col("idx").cast("long").alias("idx"), "horizon", "realized")
    return paths.emit(out, realized, ["entity", "idx", "horizon"])[1].withColumnRenamed("idx", "origin_index")


SCALED = f"{BASE}, sd AS (SELECT a4.entity, stddev_pop(target - intercept - slope * lag_1) AS sd FROM a4 JOIN base USING (entity) GROUP BY 1), pr AS (SELECT entity, idx, horizon, {STEPS(a='intercept', b='slope', y='target')} AS forecast, sd * sqrt(horizon) AS scale FROM i4 JOIN base USING (entity) JOIN sd USING (entity), {H})"


def scaled_paths(spark, d):
    from lawloom.functions.distributions import horizon_scale

    rows = fits.ar1_pairs(monthly(spark, d))
    o = origins_of(spark, d)
    p = F.col("parameters")
    res = rows.join(o.groupBy("entity").agg(F.first("parameters").alias("parameters")), "entity").withColumn("residual", F.col("target") - p["intercept"] - p["lag_coefficient"] * F.col("lag_1"))
    sd = res.groupBy("entity").agg(F.stddev_pop("residual").alias("sd"))
    return paths.forecast_path(o.join(sd, "entity"), "analytic", 3).withColumn("scale", horizon_scale(F.col("sd"), F.col("horizon"), "sqrt_horizon"))


@query("probabilistic_intervals", f"WITH {SCALED}, z AS (SELECT unnest([{{'c': 0.5, 'z': 0.6744897501960817}}, {{'c': 0.9, 'z': 1.6448536269514722}}]) AS x) SELECT entity, idx AS origin_index, horizon, CAST(x.c AS DOUBLE) AS nominal_coverage, {S('forecast - x.z * scale', 3)} AS lower_bound, {S('forecast + x.z * scale', 3)} AS upper_bound FROM pr, z")
def probabilistic_intervals(spark, d):
    out = paths.probabilistic_rows(scaled_paths(spark, d), "interval", levels=(0.5, 0.9))
    return out.select("entity", F.col("idx").alias("origin_index"), "horizon", "nominal_coverage", R("lower_bound", 3).alias("lower_bound"), R("upper_bound", 3).alias("upper_bound"))


@query("probabilistic_quantiles", f"WITH {SCALED}, z AS (SELECT unnest([{{'q': 0.1, 'z': ln(0.2)}}, {{'q': 0.5, 'z': 0.0}}, {{'q': 0.95, 'z': -ln(0.1)}}]) AS x) SELECT entity, idx AS origin_index, horizon, CAST(x.q AS DOUBLE) AS level, {S('forecast + x.z * scale', 3)} AS quantile FROM pr, z")
def probabilistic_quantiles(spark, d):
    out = paths.probabilistic_rows(scaled_paths(spark, d), "quantile", "laplace", (0.1, 0.5, 0.95))
    return out.select("entity", F.col("idx").alias("origin_index"), "horizon", "level", R("quantile", 3).alias("quantile"))


@query("event_probabilities", f"WITH {SCALED}, v AS (SELECT *, (800.0 - forecast) / scale AS z FROM pr), t AS (SELECT *, {TAIL} AS t FROM v) SELECT entity, idx AS origin_index, horizon, {S('CASE WHEN z > 0 THEN t ELSE 1 - t END')} AS event_probability FROM t")
def event_probabilities(spark, d):
    out = paths.probabilistic_rows(scaled_paths(spark, d), "event_probability", threshold=800.0)
    return out.select("entity", F.col("idx").alias("origin_index"), "horizon", R("event_probability").alias("event_probability"))


@query("event_outcomes", f"WITH {I4} SELECT entity, idx, target > 800 AS above, target >= 800 AS at_least, target < 800 AS below, target <= 800 AS at_most FROM i4")
def event_outcomes(spark, d):
    ops = {"above": "greater_than", "at_least": "greater_than_or_equal", "below": "less_than", "at_most": "less_than_or_equal"}
    return monthly(spark, d).select("entity", F.col("idx").cast("long").alias("idx"), *(paths.event(F.col("target"), op, 800.0).alias(k) for k, op in ops.items()))


@query("last_value_baseline", f"WITH {SCALED} SELECT p.entity, p.idx AS origin_index, horizon, {S('target - 1.6448536269514722 * scale', 3)} AS lower_bound, {S('target + 1.6448536269514722 * scale', 3)} AS upper_bound FROM pr p JOIN i4 ON i4.entity = p.entity AND i4.idx = p.idx")
def last_value_baseline(spark, d):
    out = paths.probabilistic_rows(paths.last_value_baseline(scaled_paths(spark, d)), "interval", levels=(0.9,))
    return out.select("entity", F.col("idx").alias("origin_index"), "horizon", R("lower_bound", 3).alias("lower_bound"), R("upper_bound", 3).alias("upper_bound"))


@query("base_scales", f"WITH {BASE}, s AS (SELECT a4.entity, sum((target - intercept - slope * lag_1) * (target - intercept - slope * lag_1)) AS loss, count(*) AS n, any_value(greatest(abs(intercept), abs(slope))) AS p FROM a4 JOIN base USING (entity) GROUP BY 1) SELECT entity, {S('greatest(sqrt(loss / n), 0.25 + 0.05 * p)', 3)} AS scale FROM s")
def base_scales(spark, d):
    rows = fits.ar1_pairs(monthly(spark, d))
    base = fits.affine_fit(rows, ["entity"], "lag_1", "target").drop("n")
    e = F.col("target") - F.col("intercept") - F.col("slope") * F.col("lag_1")
    s = rows.join(base, "entity").groupBy("entity").agg(F.sum(e * e).alias("loss"), F.count("*").alias("n"), F.first(F.greatest(F.abs("intercept"), F.abs("slope"))).alias("p"))
    return s.select("entity", R(paths.base_scale(F.col("loss"), F.col("n"), F.col("p")), 3).alias("scale"))


@query("environments_label", f"WITH {I1}, e AS (SELECT *, CASE WHEN idx % 4 = 0 THEN ' ' WHEN idx % 4 = 1 THEN NULL ELSE 'label_' || (idx % 4) END AS label FROM i1), v AS (SELECT *, coalesce(nullif(trim(label), ''), 'missing_label') AS environment FROM e) SELECT environment, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM v GROUP BY 1")
def environments_label(spark, d):
    from lawloom.operators.snapshot import indexed

    i = F.col("idx") % 4
    rows = indexed(daily_totals(spark, d)).withColumn("label", F.when(i == 0, " ").when(i > 1, F.concat(F.lit("label_"), i.cast("string"))))
    return panel.environment_sizes(panel.environments(rows, "explicit_label", ["event_time"]))
