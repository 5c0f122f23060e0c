"""Queries over snapshots, features, folds, fits and scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.operators import features, fits, folds, scoring, snapshot
from lawloom.plans.registry import query
from lawloom.sources import ingestion
from lawloom.sources.panels import I1, I4, P1, P2, P3, P5, daily_totals, erasures, late_arrivals, monthly_totals, revisions, table

CUTOFF, MIN_TRAIN, HORIZON = "2024-01-20 00:00:00", 5, 3
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")
SDAY = "strftime({}, '%Y-%m-%d')".format


def R(c, places: int = 6):
    return F.round(c, places)


def S(e: str, places: int = 6) -> str:
    return f"(round({e}, {places}) + 0.0)"


def daily(spark, d) -> DataFrame:
    return snapshot.indexed(daily_totals(spark, d))


def monthly(spark, d) -> DataFrame:
    return snapshot.indexed(monthly_totals(spark, d))


@query("ingest_observations", f"""WITH {P2} SELECT entity, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS event_time, strftime(date_trunc('second', available_at), '%Y-%m-%dT%H:%M:%SZ') AS available_at,
 target, revision_id, source_id, CAST(revision_id AS VARCHAR) AS side_revision, len(props) AS props_length FROM p2""")
def ingest_observations(spark, d):
    rows = ingestion.ingest(revisions(spark, d))
    side = lambda k: F.element_at("side_information", k)
    return rows.select("entity", "event_time", "available_at", "target", "revision_id", "source_id", side("revision_id").alias("side_revision"), F.length(F.regexp_replace(F.regexp_replace(side("props"), r'^"|"$', ""), r'\\"', '"')).cast("long").alias("props_length"))


@query("ingest_side_values", """SELECT o_orderpriority AS entity, CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS flag, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS count,
 '"' || o_orderstatus || ' \\"quoted\\""' AS label, '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"' AS moment, CASE WHEN o_orderstatus = 'P' THEN CAST(4 AS INT) ELSE CAST(7 AS INT) END AS fields FROM orders""")
def ingest_side_values(spark, d):
    """Side columns as text and typed: truth values, whole numbers, text with quotes, times, blanks."""
    o, status = table(spark, d, "orders"), F.col("o_orderstatus")
    rows = o.select(
        F.col("o_orderpriority").alias("entity"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"), F.col("o_orderdate").alias("available_at"), F.col("o_totalprice").cast("string").alias("target"), F.col("o_orderkey").alias("key"),
        F.when(status == "F", " TRUE").when(status == "O", "False ").otherwise(" ").alias("flag"), F.when(status != "P", F.concat(F.lit("+"), F.col("o_custkey").cast("string"))).alias("count"), F.concat(status, F.lit(' "quoted"')).alias("label"), F.col("o_orderdate").alias("moment"),
        F.when(status == "P", float("nan")).otherwise(F.col("o_totalprice")).alias("price"), F.create_map(F.lit("a"), status, F.lit("b"), F.lit(None).cast("string")).alias("nested"),
    )
    side = lambda k: F.try_element_at("side_information", F.lit(k)).alias(k)
    return ingestion.ingest(rows).select("entity", side("key"), side("flag"), side("count"), side("label"), side("moment"), F.size("side_information").alias("fields"))


@query("target_transforms", f"""WITH {I1}, l AS (SELECT *, lag(target) OVER (PARTITION BY entity ORDER BY idx) AS p FROM i1)
 SELECT entity, {SDAY('event_time')} AS day, {S('target')} AS price_close, {S('target / p - 1')} AS daily_return, {S('ln(target / p)')} AS log_return, CASE WHEN target > p THEN 1.0 ELSE 0.0 END::DOUBLE AS next_day_up FROM l WHERE p IS NOT NULL""")
def target_transforms(spark, d):
    out = ingestion.target_transforms(daily_totals(spark, d).withColumnRenamed("target", "close"))
    return out.select("entity", DAY("event_time").alias("day"), *(R(c).alias(c) for c in ("price_close", "daily_return", "log_return", "next_day_up")))


@query("price_rows", f"WITH {P1} SELECT 'sym_' || entity AS entity, strftime(event_time + INTERVAL 22 HOUR, '%Y-%m-%d %H') AS known, target FROM p1")
def price_rows(spark, d):
    out = ingestion.price_rows(daily_totals(spark, d).withColumnRenamed("target", "close"), 22, F.concat(F.lit("sym_"), F.col("entity")))
    return out.select("entity", F.date_format("available_at", "yyyy-MM-dd HH").alias("known"), "target")


@query("snapshot_latest_revision", f"""WITH {P5}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, event_time ORDER BY available_at DESC, revision_id DESC) AS r FROM p5 WHERE available_at <= TIMESTAMP '{CUTOFF}')
 SELECT entity, {SDAY('event_time')} AS day, revision_id, target FROM r WHERE r = 1 AND target IS NOT NULL""")
def snapshot_latest_revision(spark, d):
    return snapshot.freeze_snapshot(erasures(spark, d), CUTOFF).select("entity", DAY("event_time").alias("day"), "revision_id", "target")


@query("snapshot_provenance", f"WITH {P5} SELECT source_id, count(*) AS raw_count, count(target) AS coded_count FROM p5 GROUP BY source_id")
def snapshot_provenance(spark, d):
    return snapshot.source_provenance(erasures(spark, d))


@query("side_information_fields", "SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def side_information_fields(spark, d):
    return snapshot.side_information_fields(revisions(spark, d).select(F.from_json("props", "map<string,string>").alias("side_information")))


@query("panel_series_id", f"WITH {P1} SELECT 'panel:' || sha256(string_agg(entity, '|' ORDER BY entity)) AS series_id, CAST(count(*) AS INT) AS entity_count FROM (SELECT DISTINCT entity FROM p1)")
def panel_series_id(spark, d):
    return snapshot.panel_series_id(daily_totals(spark, d))


@query("time_safety_audit", f"""WITH {P3}, a AS (SELECT count(*) AS row_count, CAST(count(*) FILTER (available_at > TIMESTAMP '{CUTOFF}') AS BIGINT) AS future_availability, CAST(count(*) FILTER (event_time > available_at) AS BIGINT) AS future_event_time,
 strftime(date_trunc('second', min(available_at)), '%Y-%m-%d %H:%M:%S') AS min_available_at, strftime(date_trunc('second', max(available_at)), '%Y-%m-%d %H:%M:%S') AS max_available_at FROM p3)
 SELECT *, CASE WHEN future_availability > 0 OR future_event_time > 0 THEN 'blocked' ELSE 'passed' END AS status FROM a""")
def time_safety_audit(spark, d):
    return snapshot.time_safety_audit(late_arrivals(spark, d), CUTOFF)


LATE = P3 + ", s3 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_time) - 1 AS idx FROM p3)"


@query("legal_history_features", f"""WITH {LATE}, j AS (SELECT c.entity, c.idx, s.target, row_number() OVER (PARTITION BY c.entity, c.idx ORDER BY s.event_time DESC) AS r
  FROM s3 c JOIN s3 s ON s.entity = c.entity AND s.event_time < c.event_time AND s.available_at <= c.available_at WHERE c.idx >= 3)
 SELECT entity, idx, {S('max(CASE WHEN r = 1 THEN target END)')} AS lag_1, {S('max(CASE WHEN r = 2 THEN target END)')} AS lag_2, {S('avg(target) FILTER (r <= 3)')} AS rolling_mean_3 FROM j GROUP BY entity, idx HAVING count(*) >= 3""")
def legal_history_features(spark, d):
    rows = features.legal_features(snapshot.indexed_by(late_arrivals(spark, d), F.date_trunc("hour", "event_time")).drop("revision_id"), [1, 2], [3])
    return rows.select("entity", F.col("idx").cast("long").alias("idx"), R("lag_1").alias("lag_1"), R("lag_2").alias("lag_2"), R("rolling_mean_3").alias("rolling_mean_3"))


@query("feature_view_on_time", f"""WITH {I1}, f AS (SELECT entity, idx, lag(target) OVER w AS lag_1, avg(target) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM i1 WINDOW w AS (PARTITION BY entity ORDER BY idx))
 SELECT entity, idx, {S('lag_1')} AS lag_1, {S('m')} AS rolling_mean_3 FROM f WHERE idx >= 3""")
def feature_view_on_time(spark, d):
    rows = features.feature_view(daily(spark, d), [1], [3])
    return rows.select("entity", F.col("idx").cast("long").alias("idx"), R("lag_1").alias("lag_1"), R("rolling_mean_3").alias("rolling_mean_3"))


@query("late_source_canaries", f"""WITH {LATE} SELECT c.entity, c.idx, count(*) AS n_blocked, CAST(min(s.idx) AS BIGINT) AS first_blocked FROM s3 c JOIN s3 s ON s.entity = c.entity AND s.idx BETWEEN c.idx - 3 AND c.idx - 1 AND s.available_at > c.available_at WHERE c.idx >= 3 GROUP BY 1, 2""")
def late_source_canaries(spark, d):
    rows = features.late_source_canaries(snapshot.indexed_by(late_arrivals(spark, d), F.date_trunc("hour", "event_time")), [1], [3])
    return rows.select("entity", F.col("idx").cast("long").alias("idx"), F.size("blocked").cast("long").alias("n_blocked"), F.element_at("blocked", 1).cast("long").alias("first_blocked"))


PLAN = f"""{I1}, n1 AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM i1 GROUP BY entity)), e1 AS (SELECT DISTINCT entity FROM i1),
 plan AS (SELECT CAST(t - {MIN_TRAIN} AS BIGINT) AS fold, CASE WHEN t + {HORIZON} = n THEN 'confirmatory_holdout' ELSE 'development' END AS role, entity, CAST(t - 1 AS BIGINT) AS origin_index, CAST(h AS INT) AS horizon, CAST(t + h - 1 AS BIGINT) AS target_index
  FROM (SELECT entity, n, unnest(range({MIN_TRAIN}, n - {HORIZON} + 1)) AS t FROM e1, n1), (SELECT unnest(range(1, {HORIZON} + 1)) AS h))"""


def plan_of(spark, d):
    return folds.evaluation_plan(daily(spark, d), MIN_TRAIN, HORIZON)


@query("evaluation_plan", f"WITH {PLAN} SELECT * FROM plan")
def evaluation_plan(spark, d):
    return plan_of(spark, d)


@query("scored_origins", f"WITH {PLAN} SELECT p.*, a.target AS origin_value, b.target AS realized FROM plan p JOIN i1 a ON a.entity = p.entity AND a.idx = origin_index JOIN i1 b ON b.entity = p.entity AND b.idx = target_index")
def scored_origins(spark, d):
    out = folds.scored_origins(plan_of(spark, d), daily(spark, d))
    return out.select("fold", "role", "entity", "origin_index", "horizon", "target_index", "origin_value", "realized")


@query("training_origin_panel", f"WITH {I1} SELECT a.entity, a.idx AS origin_index, h AS horizon, b.idx AS target_index, a.target AS origin_value, b.target AS realized FROM i1 a, (SELECT CAST(unnest([1, 3]) AS INT) AS h), i1 b WHERE b.entity = a.entity AND b.idx = a.idx + h AND a.idx + 3 < 20")
def training_origin_panel(spark, d):
    out = folds.training_origin_panel(daily(spark, d), 20, [1, 3])
    return out.select("entity", F.col("origin_index").cast("long").alias("origin_index"), "horizon", F.col("target_index").cast("long").alias("target_index"), "origin_value", "realized")


@query("segment_training_rows", f"WITH {I1} SELECT entity, count(*) AS n, {S('avg(target)')} AS mean_target FROM i1 WHERE idx >= 10 AND idx < 20 GROUP BY entity")
def segment_training_rows(spark, d):
    rows = folds.segment_training_rows(daily(spark, d), folds.recent_history_start(20, 0.5), 20)
    return rows.groupBy("entity").agg(F.count("*").alias("n"), R(F.avg("target")).alias("mean_target"))


FITS = f"""{I1}, fits AS (SELECT entity, idx, target, avg(target) OVER w AS mean, first(target) OVER w AS first, coalesce(lag(target) OVER (PARTITION BY entity ORDER BY idx), target) AS seasonal_anchor,
  CASE WHEN idx = 0 THEN 0.0 ELSE (target - first(target) OVER w) / idx END AS drift_slope,
  CASE WHEN idx = 0 THEN 0.0 ELSE ((idx + 1) * sum(idx * target) OVER w - idx * (idx + 1) / 2 * sum(target) OVER w) / ((idx + 1) * (idx * (idx + 1) * (2 * idx + 1) / 6) - (idx * (idx + 1) / 2) * (idx * (idx + 1) / 2)) END AS trend_slope, sum(target) OVER w AS sy
  FROM i1 WINDOW w AS (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING)),
 fit AS (SELECT *, (sy - trend_slope * idx * (idx + 1) / 2) / (idx + 1) AS trend_intercept FROM fits)"""
FAMS = f"""fam AS (SELECT entity, idx AS origin_index, step, unnest([{{'family': 'constant', 'f': mean}}, {{'family': 'drift', 'f': first + drift_slope * (idx + step)}}, {{'family': 'linear_trend', 'f': trend_intercept + trend_slope * (idx + step)}}, {{'family': 'seasonal_naive', 'f': seasonal_anchor}}]) AS x FROM fit, (SELECT unnest(range(1, {HORIZON} + 1)) AS step)),
 lss AS (SELECT p.fold, p.role, p.entity, p.origin_index, p.horizon, x.family AS family, x.f AS forecast, b.target AS realized, abs(x.f - b.target) AS loss FROM plan p JOIN fam ON fam.entity = p.entity AND fam.origin_index = p.origin_index AND fam.step = p.horizon JOIN i1 b ON b.entity = p.entity AND b.idx = p.target_index)"""
LOSSES = f"{PLAN}, {FITS[len(I1) + 2:]}, {FAMS}"


def losses_of(spark, d, loss: str = "absolute_error") -> DataFrame:
    """fold, role, entity, origin_index, horizon, family, forecast, realized, loss of every scored origin and certified family."""
    rows = daily(spark, d)
    pred = fits.family_forecasts(fits.expanding_fits(rows), HORIZON).withColumnRenamed("step", "horizon")
    scored = folds.scored_origins(plan_of(spark, d), rows).join(pred, ["entity", "origin_index", "horizon"])
    return scored.withColumn("loss", scoring.point_loss(loss, F.col("forecast"), F.col("realized")))


@query("family_fits", f"WITH {FITS} SELECT entity, idx, {S('mean')} AS mean, {S('drift_slope')} AS drift_slope, {S('trend_intercept', 4)} AS trend_intercept, {S('trend_slope', 4)} AS trend_slope, {S('seasonal_anchor')} AS seasonal_anchor FROM fit")
def family_fits(spark, d):
    f = fits.expanding_fits(daily(spark, d))
    return f.select("entity", F.col("idx").cast("long").alias("idx"), R("mean").alias("mean"), R("drift_slope").alias("drift_slope"), R("trend_intercept", 4).alias("trend_intercept"), R("trend_slope", 4).alias("trend_slope"), R("seasonal_anchor").alias("seasonal_anchor"))


@query("walk_forward_family_losses", f"WITH {LOSSES} SELECT entity, family, count(*) AS n_origins, {S('avg(loss)', 4)} AS mae FROM lss WHERE horizon = 1 GROUP BY entity, family")
def walk_forward_family_losses(spark, d):
    return losses_of(spark, d).where("horizon = 1").groupBy("entity", "family").agg(F.count("*").alias("n_origins"), R(F.avg("loss"), 4).alias("mae"))


@query("confirmatory_losses", f"WITH {LOSSES} SELECT entity, family, horizon, {S('loss', 4)} AS loss FROM lss WHERE role = 'confirmatory_holdout'")
def confirmatory_losses(spark, d):
    return losses_of(spark, d).where("role = 'confirmatory_holdout'").select("entity", "family", "horizon", R("loss", 4).alias("loss"))


@query("primary_scores", f"""WITH {LOSSES}, m AS (SELECT entity, family, horizon, count(*) AS n, round(avg(loss), 12) AS m FROM lss GROUP BY 1, 2, 3)
 SELECT entity, family, {S("sum(CASE horizon WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END * m)", 4)} AS score, min(n) AS n_origins FROM m GROUP BY 1, 2""")
def primary_scores(spark, d):
    w = folds.horizon_weights(3, ["0.5", "0.3", "0.2"])
    return scoring.primary_score(losses_of(spark, d), ["entity", "family"], w).select("entity", "family", R("score", 4).alias("score"), "n_origins")


@query("entity_weighted_scores", f"""WITH {LOSSES}, m AS (SELECT entity, family, horizon, avg(loss) AS m FROM lss GROUP BY 1, 2, 3), o AS (SELECT entity, family, sum(CASE horizon WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END * m) AS o FROM m GROUP BY 1, 2)
 SELECT family, {S('sum(o * w)', 4)} AS score FROM o JOIN (SELECT entity, count(*) / sum(count(*)) OVER () AS w FROM i1 GROUP BY entity) USING (entity) GROUP BY family""")
def entity_weighted_scores(spark, d):
    n = daily(spark, d).groupBy("entity").agg(F.count("*").alias("n"))
    w = n.select("entity", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("entity_weight"))
    return scoring.entity_weighted_score(losses_of(spark, d), ["family"], folds.horizon_weights(3, ["0.5", "0.3", "0.2"]), w).select("family", R("score", 4).alias("score"))


@query("panel_guard", f"WITH {LOSSES}, k AS (SELECT DISTINCT entity, origin_index, horizon FROM lss WHERE family = 'drift'), e AS (SELECT entity, origin_index, horizon FROM plan) SELECT CAST((SELECT count(*) FROM e ANTI JOIN k USING (entity, origin_index, horizon)) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS nonfinite, 'comparable' AS status")
def panel_guard(spark, d):
    keys = ["entity", "origin_index", "horizon"]
    return scoring.guarded_panel(losses_of(spark, d).where("family = 'drift'"), plan_of(spark, d), keys).drop("reason_codes")


PAIRS = LOSSES + ", c AS (SELECT * FROM lss WHERE family = 'linear_trend'), b AS (SELECT * FROM lss WHERE family = 'constant'), df AS (SELECT c.entity, c.origin_index, c.horizon, c.loss AS candidate_loss, b.loss AS baseline_loss, b.loss - c.loss AS diff FROM c JOIN b USING (entity, origin_index, horizon))"
KEYS = ["entity", "origin_index", "horizon"]


def diffs_of(spark, d):
    rows = losses_of(spark, d)
    return scoring.paired_differentials(rows.where("family = 'linear_trend'"), rows.where("family = 'constant'"), KEYS)


@query("paired_comparators", f"WITH {LOSSES}, b AS (SELECT * FROM lss WHERE family = 'constant') SELECT l.family, count(*) AS n_pairs, {S('avg(b.loss - l.loss)', 4)} AS mean_difference, CASE WHEN avg(b.loss - l.loss) > 1.0 THEN 'candidate_better_than_margin' WHEN avg(b.loss - l.loss) < -1.0 THEN 'candidate_worse_than_margin' ELSE 'within_margin' END AS status FROM lss l JOIN b USING (entity, origin_index, horizon) WHERE l.family <> 'constant' GROUP BY 1")
def paired_comparators(spark, d):
    rows = losses_of(spark, d)
    base = rows.where("family = 'constant'").select(*KEYS, F.col("loss").alias("_b"))
    j = rows.where("family <> 'constant'").join(base, KEYS).groupBy("family").agg(F.count("*").alias("n_pairs"), F.avg(F.col("_b") - F.col("loss")).alias("m"))
    return j.select("family", "n_pairs", R("m", 4).alias("mean_difference"), scoring.practical_significance(F.col("m"), 1.0).alias("status"))


@query("key_set_equality", f"""WITH {LOSSES}, c AS (SELECT DISTINCT {', '.join(KEYS)} FROM lss WHERE family = 'linear_trend' AND horizon < 3), b AS (SELECT DISTINCT {', '.join(KEYS)} FROM lss WHERE family = 'constant' AND origin_index % 2 = 0),
 u AS (SELECT * FROM c UNION SELECT * FROM b), i AS (SELECT * FROM c INTERSECT SELECT * FROM b) SELECT count(*) AS n_keys, count(*) - (SELECT count(*) FROM i) AS n_unmatched, CASE WHEN count(*) = (SELECT count(*) FROM i) THEN 'comparable' ELSE 'not_comparable' END AS status FROM u""")
def key_set_equality(spark, d):
    """Two panels that differ on both sides."""
    rows = losses_of(spark, d)
    return scoring.same_keys(rows.where("family = 'linear_trend' and horizon < 3"), rows.where("family = 'constant' and origin_index % 2 = 0"), KEYS)


@query("prequential_group_means", f"WITH {PAIRS} SELECT 'horizon' AS dimension, CAST(horizon AS VARCHAR) AS level, count(*) AS n, {S('avg(diff)', 4)} AS mean_loss_difference FROM df GROUP BY horizon UNION ALL SELECT 'entity', entity, count(*), {S('avg(diff)', 4)} FROM df GROUP BY entity")
def prequential_group_means(spark, d):
    return scoring.group_means(diffs_of(spark, d), ["horizon", "entity"]).withColumn("mean_loss_difference", R("mean_loss_difference", 4))


@query("rolling_degradation", f"WITH {PAIRS}, w AS (SELECT entity, origin_index, diff, row_number() OVER x AS rn, avg(diff) OVER (PARTITION BY entity ORDER BY origin_index ROWS 4 PRECEDING) AS m FROM df WHERE horizon = 1 WINDOW x AS (PARTITION BY entity ORDER BY origin_index)) SELECT entity, origin_index, {S('m', 4)} AS mean_loss_difference, CASE WHEN diff < 0 THEN 'degraded' ELSE 'stable' END AS status FROM w WHERE rn >= 5")
def rolling_degradation(spark, d):
    out = scoring.rolling_degradation(diffs_of(spark, d).where("horizon = 1"), ["origin_index"], ["entity"], 5)
    return out.select("entity", "origin_index", R("mean_loss_difference", 4).alias("mean_loss_difference"), "status")


@query("mean_difference_interval", f"WITH {PAIRS} SELECT entity, count(*) AS n, {S('avg(diff)', 4)} AS mean_difference, {S('avg(diff) - 1.96 * stddev_samp(diff) / sqrt(count(*))', 4)} AS lower, {S('avg(diff) + 1.96 * stddev_samp(diff) / sqrt(count(*))', 4)} AS upper FROM df GROUP BY entity")
def mean_difference_interval(spark, d):
    out = scoring.mean_interval(diffs_of(spark, d), ["entity"])
    return out.select("entity", "n", *(R(c, 4).alias(c) for c in ("mean_difference", "lower", "upper")))


@query("residual_summary", f"WITH {LOSSES} SELECT family, count(*) AS n, count(DISTINCT horizon) AS n_horizons, {S('avg(realized - forecast)', 4)} AS mean_residual, {S('sqrt(avg((realized - forecast) * (realized - forecast)))', 4)} AS rmse FROM lss GROUP BY family")
def residual_summary(spark, d):
    rows = losses_of(spark, d).withColumn("residual", F.col("realized") - F.col("forecast"))
    return scoring.residual_summary(rows, ["family"]).select("family", "n", "n_horizons", R("mean_residual", 4).alias("mean_residual"), R("rmse", 4).alias("rmse"))


@query("residual_validation", f"""WITH {LOSSES}, r AS (SELECT family, horizon = 3 AS shifted, origin_index % 7 = 0 AS wrong, origin_index % 11 = 0 AS missing FROM lss), c AS (SELECT family, shifted, wrong AND NOT missing AS wrong, missing FROM r)
 SELECT family, count(*) AS n, CAST(count(*) FILTER (shifted) AS BIGINT) AS n_geometry, CAST(count(*) FILTER (wrong) AS BIGINT) AS n_mismatch, CAST(count(*) FILTER (missing) AS BIGINT) AS n_nonfinite, CAST(count(*) FILTER (shifted OR wrong OR missing) AS BIGINT) AS n_invalid FROM c GROUP BY family""")
def residual_validation(spark, d):
    """Rows spoiled on purpose: a shifted target, a residual that isn't realized minus forecast, a missing one."""
    rows = losses_of(spark, d)
    origin, h = F.col("origin_index"), F.col("horizon")
    residual = F.when(origin % 11 == 0, None).otherwise(F.col("realized") - F.col("forecast") + F.when(origin % 7 == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("target_index", origin + h + F.when(h == 3, 1).otherwise(0)).withColumn("residual", residual)
    has = lambda c: F.sum(F.array_contains("reason_codes", c).cast("long"))
    return scoring.residual_flags(rows).groupBy("family").agg(F.count("*").alias("n"), has("horizon_geometry_mismatch").alias("n_geometry"), has("residual_mismatch").alias("n_mismatch"), has("nonfinite_residual").alias("n_nonfinite"), F.sum((F.size("reason_codes") > 0).cast("long")).alias("n_invalid"))


AR = I4 + ", l4 AS (SELECT *, lag(target) OVER (PARTITION BY entity ORDER BY idx) AS lag_1 FROM i4), a4 AS (SELECT * FROM l4 WHERE lag_1 IS NOT NULL)"
OLS = "(count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / (count(*) * sum({x} * {x}) - sum({x}) * sum({x}))".format


@query("affine_ar1_fits", f"WITH {AR}, f AS (SELECT entity, count(*) AS n, {OLS(x='lag_1', y='target')} AS slope, avg(target) AS ym, avg(lag_1) AS xm FROM a4 GROUP BY entity) SELECT entity, n, {S('ym - slope * xm', 3)} AS intercept, {S('slope', 5)} AS slope FROM f")
def affine_ar1_fits(spark, d):
    return fits.affine_fit(fits.ar1_pairs(monthly(spark, d)), ["entity"], "lag_1", "target").select("entity", "n", R("intercept", 3).alias("intercept"), R("slope", 5).alias("slope"))


@query("direct_horizon_fits", f"WITH {I4}, p AS (SELECT a.entity, h AS horizon, a.target AS x, b.target AS y FROM i4 a, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS h), i4 b WHERE b.entity = a.entity AND b.idx = a.idx + h), f AS (SELECT entity, horizon, count(*) AS n, {OLS(x='x', y='y')} AS slope, avg(y) AS ym, avg(x) AS xm FROM p GROUP BY 1, 2) SELECT entity, horizon, n, {S('ym - slope * xm', 3)} AS intercept, {S('slope', 5)} AS slope FROM f")
def direct_horizon_fits(spark, d):
    return fits.affine_fit(fits.direct_pairs(monthly(spark, d), 3), ["entity", "horizon"], "origin_value", "realized").select("entity", "horizon", "n", R("intercept", 3).alias("intercept"), R("slope", 5).alias("slope"))


BASE = f"{AR}, base AS (SELECT entity, s AS slope, ym - s * xm AS intercept FROM (SELECT entity, {OLS(x='lag_1', y='target')} AS s, avg(target) AS ym, avg(lag_1) AS xm FROM a4 GROUP BY entity))"


@query("rectified_fits", f"WITH {BASE}, p AS (SELECT a.entity, h AS horizon, a.target AS x, b.target AS y FROM i4 a, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS h), i4 b WHERE b.entity = a.entity AND b.idx = a.idx + h) SELECT p.entity, horizon, {S('avg(y - CASE horizon WHEN 1 THEN intercept + slope * x WHEN 2 THEN intercept + slope * (intercept + slope * x) ELSE intercept + slope * (intercept + slope * (intercept + slope * x)) END)', 3)} AS correction FROM p JOIN base USING (entity) GROUP BY 1, 2")
def rectified_fits(spark, d):
    return fits.rectified_fit(monthly(spark, d), 3).select("entity", "horizon", R("correction", 3).alias("correction"))


@query("running_mean_losses", f"WITH {I4}, r AS (SELECT entity, target, avg(target) OVER (PARTITION BY entity ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM i4) SELECT entity, count(*) AS n, {S('avg(abs(target - f))', 3)} AS mae FROM r WHERE f IS NOT NULL GROUP BY entity")
def running_mean_losses(spark, d):
    return fits.running_mean(monthly(spark, d)).groupBy("entity").agg(F.count("*").alias("n"), R(F.avg(F.abs(F.col("target") - F.col("forecast"))), 3).alias("mae"))


@query("smoothing_grid", f"""WITH RECURSIVE {I4}, g AS (SELECT k / 20.0 AS alpha FROM (SELECT unnest(range(1, 20)) AS k)),
 s AS (SELECT entity, alpha, idx, CAST(target AS DOUBLE) AS level, CAST(0 AS DOUBLE) AS loss FROM i4, g WHERE idx = 0
  UNION ALL SELECT s.entity, s.alpha, i.idx, s.level + s.alpha * (i.target - s.level), s.loss + (i.target - s.level) * (i.target - s.level) FROM s JOIN i4 i ON i.entity = s.entity AND i.idx = s.idx + 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY entity, alpha ORDER BY idx DESC) AS r FROM s)
 SELECT entity, {S('alpha', 2)} AS alpha, {S('level', 3)} AS level, {S('loss / 1e6', 3)} AS loss FROM f WHERE r = 1""")
def smoothing_grid(spark, d):
    return fits.smoothing_grid(monthly(spark, d)).select("entity", R("alpha", 2).alias("alpha"), R("level", 3).alias("level"), R(F.col("loss") / 1e6, 3).alias("loss"))


@query("spectral_fits", f"""WITH {I4}, c AS (SELECT entity, h AS harmonic, target AS y, cos(2 * pi() * h * idx / 12) AS c, sin(2 * pi() * h * idx / 12) AS s FROM i4, (SELECT CAST(unnest([1, 2]) AS INT) AS h)),
 m AS (SELECT entity, harmonic, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * y) AS cy, sum(s * y) AS sy FROM c GROUP BY 1, 2)
 SELECT entity, harmonic, {S('(ss * cy - cs * sy) / (cc * ss - cs * cs)', 3)} AS cosine, {S('(cc * sy - cs * cy) / (cc * ss - cs * cs)', 3)} AS sine FROM m""")
def spectral_fits(spark, d):
    return fits.spectral_fit(monthly(spark, d), [1, 2], 12).select("entity", "harmonic", R("cosine", 3).alias("cosine"), R("sine", 3).alias("sine"))


@query("fourier_reconstruction", f"""WITH {I1}, n AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM i1), k AS (SELECT CAST(unnest(range(0, 4)) AS INT) AS harmonic),
 c AS (SELECT entity, any_value(n) AS n, harmonic, sum(target * cos(2 * pi() * harmonic * idx / n)) * CASE WHEN harmonic = 0 OR 2 * harmonic = any_value(n) THEN 1.0 ELSE 2.0 END / any_value(n) AS c, sum(target * sin(2 * pi() * harmonic * idx / n)) * CASE WHEN harmonic = 0 OR 2 * harmonic = any_value(n) THEN 1.0 ELSE 2.0 END / any_value(n) AS s FROM n JOIN k ON harmonic <= floor(n / 2) GROUP BY entity, harmonic)
 SELECT i1.entity, idx, {S('sum(c * cos(2 * pi() * harmonic * idx / n) + s * sin(2 * pi() * harmonic * idx / n))', 4)} AS fitted, {S('max(CASE WHEN harmonic = 2 THEN c END)', 4)} AS cosine_2, {S('max(CASE WHEN harmonic = 2 THEN s END)', 4)} AS sine_2 FROM i1 JOIN c USING (entity) GROUP BY 1, 2""")
def fourier_reconstruction(spark, d):
    """A spectrum cut after three harmonics, and the series that it gives."""
    rows = daily(spark, d)
    spectrum = fits.fourier(rows, 3)
    second = spectrum.where("harmonic = 2").select("entity", R("cosine", 4).alias("cosine_2"), R("sine", 4).alias("sine_2"))
    return fits.fourier_values(rows, spectrum).join(second, "entity", "left").select("entity", F.col("idx").cast("long").alias("idx"), R("fitted", 4).alias("fitted"), "cosine_2", "sine_2")


@query("piecewise_fits", f"WITH {AR}, m AS (SELECT entity, avg(target) AS g FROM i4 GROUP BY entity), p AS (SELECT a4.*, CASE WHEN lag_1 < g THEN 'below' ELSE 'above' END AS branch FROM a4 JOIN m USING (entity)), f AS (SELECT entity, branch, count(*) AS n, {OLS(x='lag_1', y='target')} AS slope, avg(target) AS ym, avg(lag_1) AS xm FROM p GROUP BY 1, 2) SELECT entity, branch, n, {S('ym - slope * xm', 2)} AS intercept, {S('slope', 4)} AS slope FROM f")
def piecewise_fits(spark, d):
    rows = monthly(spark, d).withColumn("g", F.avg("target").over(Window.partitionBy("entity")))
    return fits.piecewise_fit(rows, F.col("g")).select("entity", "branch", "n", R("intercept", 2).alias("intercept"), R("slope", 4).alias("slope"))


@query("additive_residual_fits", f"WITH {BASE}, r AS (SELECT a4.entity, idx, target - intercept - slope * lag_1 AS r FROM a4 JOIN base USING (entity)), q AS (SELECT entity, r AS y, coalesce(lag(r) OVER (PARTITION BY entity ORDER BY idx), 0.0) AS x FROM r), f AS (SELECT entity, count(*) AS n, {OLS(x='x', y='y')} AS slope FROM q GROUP BY 1) SELECT entity, n, {S('slope', 4)} AS residual_slope FROM f")
def additive_residual_fits(spark, d):
    return fits.additive_residual_fit(monthly(spark, d)).select("entity", "n", R("slope", 4).alias("residual_slope"))


@query("regime_conditioned_fits", f"""WITH {AR}, w AS (SELECT entity, lag_1 AS x, target AS y, unnest([{{'b': 'early', 'w': 1.0 / (1 + idx)}}, {{'b': 'late', 'w': idx / (1.0 + idx)}}]) AS z FROM a4), m AS (SELECT entity, z.b AS branch, sum(z.w) AS sw, sum(z.w * x) AS sx, sum(z.w * y) AS sy, sum(z.w * x * x) AS sxx, sum(z.w * x * y) AS sxy FROM w GROUP BY 1, 2)
 SELECT entity, branch, {S('(sw * sxy - sx * sy) / (sw * sxx - sx * sx)', 4)} AS slope FROM m""")
def regime_conditioned_fits(spark, d):
    i = F.col("idx").cast("double")
    return fits.regime_fit(monthly(spark, d), {"early": 1 / (1 + i), "late": i / (1 + i)}).select("entity", "branch", R("slope", 4).alias("slope"))


@query("shared_local_fits", f"WITH {BASE}, z AS (SELECT arg_min(intercept, entity) AS si, arg_min(slope, entity) AS ss FROM base) SELECT entity, {S('intercept - si', 3)} AS local_intercept, {S('slope - ss', 5)} AS local_slope FROM base, z")
def shared_local_fits(spark, d):
    return fits.shared_local_fit(monthly(spark, d)).select("entity", R("local_intercept", 3).alias("local_intercept"), R("local_slope", 5).alias("local_slope"))


@query("mean_offset_fits", f"WITH {I4} SELECT entity, count(*) AS n, {S('avg(target) - (SELECT avg(target) FROM i4)', 3)} AS offset_value, {S('(sum(target * target) - sum(target) * sum(target) / count(*)) / 1e6', 3)} AS sse FROM i4 GROUP BY entity")
def mean_offset_fits(spark, d):
    return fits.mean_offset_fit(monthly(spark, d)).select("entity", "n", R("offset", 3).alias("offset_value"), R(F.col("sse") / 1e6, 3).alias("sse"))


@query("two_lag_least_squares")
def two_lag_least_squares(spark, d):
    w = Window.partitionBy("entity").orderBy("idx")
    rows = monthly(spark, d).withColumn("lag_1", F.lag("target", 1).over(w)).withColumn("lag_2", F.lag("target", 2).over(w)).where("lag_2 is not null")
    return fits.least_squares_fit(rows, ["entity"], ["lag_1", "lag_2"], "target").select("entity", "n", F.transform("coefficients", lambda c: F.round(c, 4)).alias("coefficients"))


@query("joint_rollout_fits")
def joint_rollout_fits(spark, d):
    return fits.joint_rollout_fit(monthly(spark, d), 3).select("entity", R("intercept", 4).alias("intercept"), R("slope", 4).alias("slope"), R("loss", 2).alias("loss"))


@query("sparse_and_latent_fits")
def sparse_and_latent_fits(spark, d):
    w = Window.partitionBy("entity").orderBy("idx")
    rows = monthly(spark, d).withColumn("lag_1", F.lag("target", 1).over(w)).withColumn("lag_2", F.lag("target", 2).over(w)).where("lag_2 is not null")
    a = fits.sparse_fit(rows, ["entity"], ["lag_1", "lag_2"], "target").select("entity", F.transform("coefficients", lambda c: F.round(c, 4)).alias("lasso"))
    b = fits.latent_fit(rows, ["entity"], ["lag_1", "lag_2"], "target").select("entity", R("slope", 4).alias("latent_slope"))
    return a.join(b, "entity")
