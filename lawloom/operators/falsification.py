"""Residual diagnostics, null comparisons, perturbations, stability and efficacy metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def residual_diagnostics(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Mean, population scale, lag-1 autocorrelation, sign runs and largest standardised residual."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_m", F.avg("residual").over(w)).withColumn("_p", F.lag("residual").over(w.orderBy(order)))
    sign = F.signum("residual")
    nonzero = rows.where(sign != 0).withColumn("_s", sign).withColumn("_c", (F.col("_s") != F.lag("_s").over(w.orderBy(order))).cast("int"))
    runs = nonzero.groupBy(*by).agg((F.coalesce(F.sum("_c"), F.lit(0)) + 1).cast("long").alias("sign_runs"))
    d, p = F.col("residual") - F.col("_m"), F.col("_p") - F.col("_m")
    m = r.groupBy(*by).agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("scale"), F.sum(d * p).alias("_c"), F.sum(d * d).alias("_v"), F.max(F.abs(d)).alias("_x"))
    m = m.withColumn("autocorrelation", F.when(F.col("_v") > 0, F.col("_c") / F.when(F.col("_v") > 0, F.col("_v"))))
    m = m.withColumn("max_standardized", F.when(F.col("scale") > 0, F.col("_x") / F.when(F.col("scale") > 0, F.col("scale"))))
    return m.drop("_c", "_v", "_x").join(runs, by, "left")


def sequence_signal(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """AR(1) without intercept on residuals: coefficient, share of the mean absolute error that is left, and R2."""
    w = Window.partitionBy(*by).orderBy(order)
    p = rows.withColumn("x", F.lag("residual").over(w)).where(F.col("x").isNotNull()).withColumnRenamed("residual", "y")
    c = p.groupBy(*by).agg(F.when(F.sum(F.col("x") * F.col("x")) <= 1e-9, 0.0).otherwise(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("coefficient"))
    e = F.col("y") - F.col("coefficient") * F.col("x")
    m = p.join(c, by).groupBy(*by, "coefficient").agg(F.count("*").alias("n_pairs"), F.avg(F.abs(e)).alias("_a"), F.avg(F.abs("y")).alias("_z"), F.avg(e * e).alias("_e"), F.var_pop("y").alias("_v"))
    ratio = F.col("_a") / F.when(F.col("_z") > 1e-9, F.col("_z"))
    r2 = F.when(F.col("_v") <= 1e-9, F.when(ratio <= 1e-9, 1.0).otherwise(0.0)).otherwise(1 - F.col("_e") / F.when(F.col("_v") > 0, F.col("_v")))
    return m.select(*by, "n_pairs", "coefficient", F.coalesce(ratio, F.lit(0.0)).alias("mae_ratio"), r2.alias("r_squared"))


def window_stability(parameters: DataFrame, by: list[str], limit: float) -> DataFrame:
    """parameters: window, parameter, value. Relative range of each parameter that all windows have."""
    n = parameters.groupBy(*by).agg(F.count_distinct("window").alias("_w"))
    m = parameters.groupBy(*by, "parameter").agg(F.max("value").alias("_x"), F.min("value").alias("_i"), F.avg("value").alias("_a"), F.count_distinct("window").alias("_n"))
    m = m.join(n, by).where("_n = _w") if by else m.crossJoin(F.broadcast(n)).where("_n = _w")
    r = (F.col("_x") - F.col("_i")) / F.greatest(F.abs("_a"), F.lit(1e-12))
    return m.select(*by, "parameter", r.alias("relative_range"), F.when(r <= limit, "passed").otherwise("failed").alias("status"))


def null_p_value(observed: DataFrame, surrogates: DataFrame, by: list[str], limit: float) -> DataFrame:
    """(1 + surrogates at or above the observed) / (B + 1)."""
    j = surrogates.join(observed, by)
    m = j.groupBy(*by).agg(F.count("*").alias("n_surrogates"), F.sum((F.col("statistic") >= F.col("observed")).cast("long")).alias("_k"))
    p = (1 + F.col("_k")) / (F.col("n_surrogates") + 1)
    return m.select(*by, "n_surrogates", p.alias("p_value"), F.when(p <= limit, "null_rejected").otherwise("null_not_rejected").alias("status"))


def perturbation_rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """runs: canonical_match, gain_bits, beats_baseline. Retained rates of each family; null without evidence."""
    rate = lambda c: F.avg(F.when(c.isNotNull(), c.cast("double")))
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), rate(F.col("canonical_match")).alias("match_rate"), rate(F.col("gain_bits") > 0).alias("gain_rate"), rate(F.col("beats_baseline")).alias("win_rate"))


def aggregate_metrics(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metrics: family, metric, value. Smallest value of each metric over the families against its threshold."""
    limit = F.element_at(F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v)))), F.col("metric"))
    m = metrics.groupBy("metric").agg(F.min("value").alias("min_value"), F.count("*").alias("n_families")).withColumn("threshold", limit)
    return m.withColumn("status", F.when(F.col("min_value").isNull(), "abstained").when(F.col("min_value") >= F.col("threshold"), "passed").otherwise("failed"))


def counterexamples(cases: DataFrame, tolerance: float, max_distance: float) -> DataFrame:
    """cases: case_id, error, distance, in_domain. Those that fail, with sorted reasons."""
    r = F.array_compact(F.array(F.when(~F.col("in_domain"), "domain_violation"), F.when(F.abs("error") > tolerance, "error_tolerance_exceeded"), F.when(F.col("distance") > max_distance, "extrapolation_distance_exceeded")))
    return cases.withColumn("reason_codes", r).where(F.size("reason_codes") > 0)


def recovery_rates(records: DataFrame, by: list[str]) -> DataFrame:
    """records: status (exact, near, missed), holistic, adversarial. Recovery, false claims among adversarial rows, non-abstention."""
    adv = F.col("adversarial")
    return records.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("status").isin("exact", "near").cast("double")).alias("recovery_rate"),
        (F.sum((adv & F.col("holistic")).cast("long")) / F.nullif(F.sum(adv.cast("long")), F.lit(0))).alias("false_claim_rate"),
        F.avg((F.col("status") != "abstained").cast("double")).alias("non_abstention_rate"),
    )


def hausdorff(truth: DataFrame, detected: DataFrame, by: list[str]) -> DataFrame:
    """Hausdorff distance of two sets of positions (column ``at``) of each group: nearest neighbours by a sorted union, not by pairs."""
    both = truth.select(*by, "at", F.lit("t").alias("side")).unionByName(detected.select(*by, "at", F.lit("d").alias("side"))).distinct()
    before, after = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    other = lambda w, f: f(F.when(F.col("side") == "t", F.lit(None)).otherwise(F.col("at"))).over(w), lambda w, f: f(F.when(F.col("side") == "d", F.lit(None)).otherwise(F.col("at"))).over(w)
    near = lambda o: F.least(F.col("at") - o(before, F.max), o(after, F.min) - F.col("at"))
    r = both.withColumn("_d", F.when(F.col("side") == "t", near(other[0])).otherwise(near(other[1])))
    return r.groupBy(*by).agg(F.max("_d").alias("hausdorff"), F.count_distinct("side").alias("_n")).where("_n = 2").drop("_n")


def change_point_metrics(truth: DataFrame, detected: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """Precision, recall and mean delay of a greedy one-to-one match in the order of truth; sets of one group meet in a task."""
    t = truth.groupBy(*by).agg(F.sort_array(F.collect_set("at")).alias("t"))
    d = detected.groupBy(*by).agg(F.sort_array(F.collect_set("at")).alias("d"))

    @F.pandas_udf("struct<n_matched:long,delay:double>")
    def match(t: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(t, d):
            free, delays = list(b if b is not None else []), []
            for x in a if a is not None else []:
                near = [y for y in free if abs(y - x) <= tolerance]
                if near:
                    y = min(near, key=lambda v: (abs(v - x), v))
                    free.remove(y)
                    delays.append(abs(y - x))
            out.append((len(delays), sum(delays) / len(delays) if delays else None))
        return pd.DataFrame(out, columns=["n_matched", "delay"])

    j = t.join(d, by, "full").withColumn("_m", match("t", "d"))
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return j.select(*by, "_m.n_matched", (F.col("_m.n_matched") / F.nullif(n("d"), F.lit(0))).alias("precision"), (F.col("_m.n_matched") / F.nullif(n("t"), F.lit(0))).alias("recall"), F.col("_m.delay").alias("mean_delay"))
