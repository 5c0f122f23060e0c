"""Queries over quantiser policies, code length terms, comparison keys and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawloom.functions import coding
from lawloom.operators import fits, robustness
from lawloom.plans.queries_core import BASE, R, S, daily, monthly
from lawloom.plans.queries_evidence import NAT, SGN, Q
from lawloom.plans.registry import query
from lawloom.sources.panels import I1, I4, table

LATTICE = "CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(28,9)) * {1}) AS BIGINT)".format


@query("resolved_steps", f"WITH {I1}, m AS (SELECT max(abs(target)) AS m FROM i1) SELECT 'fixed_step_mid_tread' AS mode, CAST(0.25 AS DOUBLE) AS step UNION ALL SELECT 'measurement_resolution_mid_tread', CAST(0.01 AS DOUBLE) UNION ALL SELECT 'scale_adaptive_mid_tread', {S('m * 0.01')} FROM m")
def resolved_steps(spark, d):
    rows = daily(spark, d)
    given = {"fixed_step_mid_tread": {"step": "0.250"}, "measurement_resolution_mid_tread": {"resolution": "0.01"}, "scale_adaptive_mid_tread": {"fraction": "0.01"}}
    out = [(mode, float(coding.resolve_step(rows, mode, **options))) for mode, options in given.items()]
    return spark.createDataFrame(out, "mode string, step double").select("mode", R("step").alias("step"))


@query("codelength_terms", f"""WITH {BASE}, r AS (SELECT a4.entity, {Q('round(target - intercept - slope * lag_1, 9)')} AS i FROM a4 JOIN base USING (entity)), dt AS (SELECT entity, CAST({NAT('count(*)')} + sum({SGN('i')}) AS BIGINT) AS l_data FROM r GROUP BY 1),
 p AS (SELECT entity, CAST({SGN(LATTICE('round(intercept, 6)', 4))} + {SGN(LATTICE('round(slope, 6)', 4))} AS BIGINT) AS l_params FROM base)
 SELECT entity, CAST(5 AS BIGINT) AS l_family, CAST(1 AS BIGINT) AS l_structure, CAST({SGN('12')} AS BIGINT) AS l_literals, l_params, CAST({SGN(LATTICE('0.75', 2))} AS BIGINT) AS l_state, l_data, CAST(5 + 1 + {SGN('12')} + l_params + {SGN(LATTICE('0.75', 2))} + l_data AS BIGINT) AS l_total FROM p JOIN dt USING (entity)""")
def codelength_terms(spark, d):
    """Parameters on a lattice of a quarter, a state on one of a half, one literal (12), one structure bit."""
    rows = fits.ar1_pairs(monthly(spark, d))
    base = fits.affine_fit(rows, ["entity"], "lag_1", "target").drop("n")
    res = rows.join(base, "entity").withColumn("index", coding.quantize_index(F.round(F.col("target") - F.col("intercept") - F.col("slope") * F.col("lag_1"), 9), "0.5"))
    own = coding.sequence_bits(res, ["entity"]).join(base, "entity").withColumn("structure_bits", F.lit(1)).withColumn("literal_bits", F.lit(coding.literal_bits(12, "0.5")))
    own = own.withColumn("parameters", F.create_map(F.lit("intercept"), F.round("intercept", 6), F.lit("slope"), F.round("slope", 6))).withColumn("state", F.create_map(F.lit("level"), F.lit(0.75)))
    out = coding.codelength_terms(own, coding.lattice_steps("0.5", parameter_step="0.25"))
    return out.select("entity", "l_family", "l_structure", "l_literals", "l_params", "l_state", "l_data", "l_total")


@query("comparison_keys", """SELECT 'orders' AS grp, count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT year(o_orderdate)) = 1 AS comparable, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'quantization_mode_mismatch' WHEN count(DISTINCT year(o_orderdate)) > 1 THEN 'horizon_geometry_mismatch' END AS reason_code FROM orders
 UNION ALL SELECT 'nation', count(DISTINCT n_regionkey) = 1, CASE WHEN count(DISTINCT n_regionkey) > 1 THEN 'horizon_geometry_mismatch' END FROM nation UNION ALL SELECT 'region', count(DISTINCT length(r_name) > 0) = 1, NULL FROM region""")
def comparison_keys(spark, d):
    """Keys that differ in two fields (the first is named), in one, in none."""
    key = lambda name, mode, geometry: coding.comparable(table(spark, d, name).select(mode.alias("quantization_mode"), geometry.alias("horizon_geometry"))).withColumn("grp", F.lit(name))
    out = key("orders", F.col("o_orderstatus"), F.year("o_orderdate"))
    return out.unionByName(key("nation", F.lit("fixed"), F.col("n_regionkey"))).unionByName(key("region", F.lit("fixed"), F.length("r_name") > 0))


@query("recent_history", f"WITH {I4}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM i4) SELECT entity, CAST(idx - (n - greatest(3, floor(n * 0.75))) AS BIGINT) AS idx, target FROM n WHERE idx >= n - greatest(3, floor(n * 0.75))")
def recent_history(spark, d):
    return robustness.recent_history(monthly(spark, d), 0.75).select("entity", "idx", "target")


@query("coarsened_targets", f"WITH {I4} SELECT entity, idx, CAST({LATTICE('target', '0.5')} AS DOUBLE) * 2 AS target FROM i4")
def coarsened_targets(spark, d):
    return robustness.coarsened(monthly(spark, d), "0.5", 4).select("entity", F.col("idx").cast("long").alias("idx"), "target")


@query("surrogate_gains")
def surrogate_gains(spark, d):
    return robustness.surrogate_null(daily(spark, d), "linear_trend", "0.5", 9).select("family", "n_surrogates", R("p_value").alias("p_value"), "observed")
