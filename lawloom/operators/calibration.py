"""Calibration diagnostics of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 97.5 % point of the normal distribution.
Z = 1.959963984540054


def ks_uniform(rows: DataFrame, by: list[str], u: str = "u") -> DataFrame:
    """Largest distance of the sorted values to the uniform distribution, and their mean."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_i", F.row_number().over(w.orderBy(u))).withColumn("_n", F.count("*").over(w))
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col(u), F.col(u) - (F.col("_i") - 1) / F.col("_n"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.max(gap).alias("max_ks_distance"), F.avg(u).alias("mean_pit"))


def wilson_lower(successes: Column, n: Column, z: float = Z) -> Column:
    p, z2 = successes / n, z * z
    margin = z * F.sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))
    return F.greatest(F.lit(0.0), (p + z2 / (2.0 * n) - margin) / (1 + z2 / n))


def interval_coverage(rows: DataFrame, by: list[str], threshold: float = 0.1) -> DataFrame:
    """rows: nominal_coverage, lower_bound, upper_bound, observed. Empirical coverage of each level."""
    hit = ((F.col("lower_bound") <= F.col("observed")) & (F.col("observed") <= F.col("upper_bound"))).cast("double")
    m = rows.groupBy(*by, "nominal_coverage").agg(F.count("*").alias("n"), F.sum(hit).alias("_h"))
    m = m.withColumn("empirical_coverage", F.col("_h") / F.col("n")).withColumn("absolute_gap", F.abs(F.col("empirical_coverage") - F.col("nominal_coverage")))
    return m.withColumn("coverage_lower_bound", wilson_lower(F.col("_h"), F.col("n"))).drop("_h").withColumn("status", F.when(F.col("absolute_gap") <= threshold, "passed").otherwise("failed"))


def quantile_hits(rows: DataFrame, by: list[str], threshold: float = 0.15) -> DataFrame:
    """rows: level, value, observed. Share of observations at or below each quantile."""
    m = rows.groupBy(*by, "level").agg(F.count("*").alias("n"), F.avg((F.col("observed") <= F.col("value")).cast("double")).alias("hit_rate"))
    m = m.withColumn("absolute_gap", F.abs(F.col("hit_rate") - F.col("level")))
    return m.withColumn("status", F.when(F.col("absolute_gap") <= threshold, "passed").otherwise("failed"))


def reliability_bins(rows: DataFrame, by: list[str], order: list[str], strategy: str = "exact", bins: int = 10, least: int = 30) -> DataFrame:
    """rows: p, event. Bins by exact value, equal width, equal mass (ceil(n/k) each) or chunks of ``least`` with a short tail merged."""
    p = F.col("p")
    w = Window.partitionBy(*by)
    rn, n = F.row_number().over(w.orderBy("p", *order)), F.count("*").over(w)
    if strategy == "exact":
        rows = rows.withColumn("bin", F.dense_rank().over(w.orderBy("p")) - 1)
    elif strategy == "equal_width":
        rows = rows.withColumn("bin", F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int"))
    elif strategy == "equal_mass":
        rows = rows.withColumn("bin", F.floor((rn - 1) / F.ceil(n / bins)).cast("int"))
    elif strategy == "adaptive_min_count":
        rows = rows.withColumn("bin", F.least(F.floor((rn - 1) / least), F.greatest(F.floor(n / least) - 1, F.lit(0))).cast("int"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    m = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("event").cast("double")).alias("frequency"))
    return m.withColumn("absolute_gap", F.abs(F.col("mean_p") - F.col("frequency")))


def partition_status(coverage: DataFrame, minimum_count: int, lower_bound: float) -> DataFrame:
    """Gate of each calibration partition: blocked without enough rows, failed below the bound."""
    status = F.when(F.col("n") < minimum_count, "blocked").when(F.col("coverage_lower_bound") < lower_bound, "failed").otherwise("passed")
    return coverage.withColumn("status", status)


def roll_up(partitions: DataFrame) -> DataFrame:
    """blocked over failed over passed (one row)."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long")
    out = partitions.agg(n("blocked").alias("n_blocked"), n("failed").alias("n_failed"), n("passed").alias("n_passed"))
    return out.withColumn("status", F.when(F.col("n_blocked") > 0, "blocked").when(F.col("n_failed") > 0, "failed").otherwise("passed"))
