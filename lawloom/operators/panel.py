"""Panel pooling, leave-one-entity-out, environments, invariance and transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partial_pooling(rows: DataFrame, ridge: float = 1.0) -> DataFrame:
    """Global mean and shrunken offsets; the strength n/(n+ridge) is the first entity's for all."""
    own = rows.where(F.col("target").isNotNull()).groupBy("entity").agg(F.count("*").alias("n"), F.sum("target").alias("s"))
    g = own.agg((F.sum("s") / F.sum("n")).alias("global_mean"), F.min_by("n", "entity").alias("_n1"))
    out = own.crossJoin(F.broadcast(g)).withColumn("shrinkage", F.col("_n1") / (F.col("_n1") + ridge))
    offset = F.col("shrinkage") * (F.col("s") / F.col("n") - F.col("global_mean"))
    return out.select("entity", "n", "global_mean", "shrinkage", offset.alias("offset"), (F.col("global_mean") + offset).alias("pooled_mean"))


def leave_one_entity_out(rows: DataFrame) -> DataFrame:
    """Squared error on each entity of the mean of all others, from group sums: one shuffle, no entity is read twice."""
    own = rows.where(F.col("target").isNotNull()).groupBy("entity").agg(F.count("*").alias("n"), F.sum("target").alias("s"), F.sum(F.col("target") * F.col("target")).alias("ss"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    out = own.crossJoin(F.broadcast(total)).where("tn > n").withColumn("prediction", (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")))
    p, n = F.col("prediction"), F.col("n")
    return out.select("entity", "n", "prediction", ((F.col("ss") - 2 * p * F.col("s") + n * p * p) / n).alias("mse"))


def leave_one_entity_out_splits(rows: DataFrame) -> DataFrame:
    """(held_out, role, n_rows, n_entities) of each split, by totals minus groups."""
    own = rows.groupBy("entity").agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("tn"), F.count("*").alias("te"))
    both = own.crossJoin(F.broadcast(total))
    test = both.select(F.col("entity").alias("held_out"), F.lit("test").alias("role"), F.col("n").alias("n_rows"), F.lit(1).cast("long").alias("n_entities"))
    return test.unionByName(both.select(F.col("entity").alias("held_out"), F.lit("train").alias("role"), (F.col("tn") - F.col("n")).alias("n_rows"), (F.col("te") - 1).alias("n_entities")))


def leave_one_entity_out_rows(rows: DataFrame, held_out: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of the split that holds one entity out."""
    return rows.where(F.col("entity") != held_out), rows.where(F.col("entity") == held_out)


def invariance(parameter_range: float, spread: float, min_jaccard: float, degradation: float, limits: dict[str, float]) -> tuple[str, list[str]]:
    """All four measures against their limits: passed, or failed with every reason."""
    checks = (("parameter_instability", parameter_range <= limits["parameter_range"]), ("residual_variance", spread <= limits["residual_spread"]), ("support_instability", min_jaccard >= limits["support_jaccard"]), ("holdout_degradation", degradation <= limits["holdout_degradation"]))
    reasons = [name for name, ok in checks if not ok]
    return ("failed" if reasons else "passed"), reasons


def shared_structure(rows: DataFrame, target: str, features: list[str], ridge: float = 1.0) -> DataFrame:
    """Leakage gate (the target named among the features), pooling and the spread of the offsets (one row)."""
    leak = target in features
    p = partial_pooling(rows, ridge)
    return p.agg(F.count("*").alias("n_entities"), F.max("global_mean").alias("global_mean"), (F.max("offset") - F.min("offset")).alias("offset_range"), F.lit("blocked" if leak else "passed").alias("leakage_status"))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_i``, the position from 0 in the whole table's order."""
    first, rest = order[0], order[1:] or [order[0]]
    times = rows.groupBy(first).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1
    return rows.withColumn("_j", inside).join(times.select(first, before.alias("_b")), first).withColumn("_i", F.col("_b") + F.col("_j")).drop("_j", "_b").select(*rows.columns, "_i")


def _changes(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_d``, the absolute change from the row before in the whole table's order (0 for the first, and beside a null)."""
    first, rest = order[0], order[1:] or [order[0]]
    inside = Window.partitionBy(first).orderBy(*rest)
    last = rows.groupBy(first).agg(F.max_by(F.struct("target"), F.struct(*rest)).alias("_l"))
    last = last.select(first, F.lag("_l").over(Window.orderBy(first)).getField("target").alias("_p"))
    r = rows.withColumn("_n", F.row_number().over(inside)).withColumn("_q", F.lag("target").over(inside)).join(last, first)
    before = F.when(F.col("_n") == 1, F.col("_p")).otherwise(F.col("_q"))
    return r.withColumn("_d", F.coalesce(F.abs(F.col("target") - before), F.lit(0.0))).select(*rows.columns, "_d")


def environments(rows: DataFrame, policy: str, order: list[str], eras: int = 4, label: str = "label", windows: DataFrame | None = None) -> DataFrame:
    """Adds ``environment`` by policy: explicit_label, entity, rolling_era, volatility_regime or intervention_window.

    Eras and regimes order the whole table: rows are ordered inside each value of the first ordering
    column, and only a table with one row for each such value (a time) is ordered as a whole.
    """
    if policy == "explicit_label":
        return rows.withColumn("environment", F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("missing_label")))
    if policy == "entity":
        return rows.withColumn("environment", F.col("entity"))
    if policy == "rolling_era":
        n = rows.agg(F.count("*").alias("_n"))
        r = _positions(rows, order).crossJoin(F.broadcast(n))  # one row
        return r.withColumn("environment", F.concat(F.lit("era_"), (F.floor(F.col("_i") / F.ceil(F.col("_n") / eras)) + 1).cast("string"))).drop("_i", "_n")
    if policy == "volatility_regime":
        d = _changes(rows, order)
        upper = d.agg((-F.expr("percentile_disc(0.5) within group (order by -_d)")).alias("_m"))  # the upper median
        return d.crossJoin(F.broadcast(upper)).withColumn("environment", F.when(F.col("_d") > F.col("_m"), "high_volatility").otherwise("low_volatility")).drop("_d", "_m")
    if policy == "intervention_window":
        w = windows.select(F.col("window_id").alias("_w"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        t = F.col(order[0])
        return rows.join(w, (t >= F.col("_s")) & (t <= F.col("_e")), "left").withColumn("environment", F.coalesce("_w", F.lit("outside_intervention"))).drop("_w", "_s", "_e")
    raise ValueError(f"unknown policy: {policy}")


def environment_sizes(rows: DataFrame, least: int = 1) -> DataFrame:
    m = rows.groupBy("environment").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))
    return m.where(F.col("n_rows") >= least)


def residual_invariance(residuals: DataFrame) -> DataFrame:
    """Spread of the environments' mean absolute residuals (one row)."""
    m = residuals.groupBy("environment").agg(F.avg(F.abs("residual")).alias("m"))
    return m.agg(F.max("m").alias("max_mean_abs"), F.min("m").alias("min_mean_abs"), (F.max("m") - F.min("m")).alias("spread"))


def parameter_stability(parameters: DataFrame) -> DataFrame:
    """parameters: environment, parameter, value. Range of each; infinite where an environment lacks it."""
    n = parameters.agg(F.count_distinct("environment").alias("_e"))
    m = parameters.groupBy("parameter").agg((F.max("value") - F.min("value")).alias("_r"), F.count_distinct("environment").alias("_n"))
    return m.crossJoin(F.broadcast(n)).select("parameter", F.when(F.col("_n") < F.col("_e"), F.lit(float("inf"))).otherwise(F.col("_r")).alias("range"))


def support_stability(supports: DataFrame) -> DataFrame:
    """supports: environment, term. Smallest Jaccard similarity between two environments' term sets (1 if there is one)."""
    s = supports.groupBy("environment").agg(F.collect_set("term").alias("terms"))
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, F.col("a.environment") < F.col("b.environment"))  # environments are few by design
    union = F.size(F.array_union("a.terms", "b.terms"))
    return pairs.agg(F.coalesce(F.min(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a.terms", "b.terms")) / union)), F.lit(1.0)).alias("min_jaccard"))


def holdout_stability(losses: DataFrame) -> DataFrame:
    """losses: environment, train_loss, holdout_loss. Worst degradation, at least 0."""
    return losses.agg(F.greatest(F.lit(0.0), F.max(F.col("holdout_loss") - F.col("train_loss"))).alias("max_degradation"))


def transport(losses: DataFrame, source: list[str], limit: float) -> DataFrame:
    """Worst loss of a target environment over the best of the sources (one row)."""
    is_source = F.col("environment").isin(source)
    m = losses.agg(F.max(F.when(~is_source, F.col("loss"))).alias("_t"), F.min(F.when(is_source, F.col("loss"))).alias("_s"))
    d = F.col("_t") - F.col("_s")
    return m.select(d.alias("degradation"), F.when(d <= limit, "passed").otherwise("failed").alias("status"))


def gate(value: Column, limit: float) -> Column:
    return F.when(value <= limit, "passed").otherwise("failed")
