"""Point-in-time snapshots of revisable observations, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freeze_snapshot(obs: DataFrame, cutoff=None) -> DataFrame:
    """Rows known at the cutoff (default: all), the last revision of each entity and time, blanks gone.

    The winner by (available_at, revision_id, payload_hash) is taken before null targets go, so a later
    blank revision erases a value. ``row_number() = 1`` lets Spark limit each group before the shuffle.
    """
    seen = obs if cutoff is None else obs.where(F.col("available_at") <= F.lit(cutoff).cast(obs.schema["available_at"].dataType))
    order = [F.col(c).desc_nulls_last() for c in ("available_at", "revision_id", "payload_hash") if c in obs.columns]
    last = Window.partitionBy("entity", "event_time").orderBy(*order)
    return seen.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r").where(F.col("target").isNotNull())


def indexed_by(rows: DataFrame, bucket: Column) -> DataFrame:
    """``indexed`` for long series: numbers rows inside (entity, bucket), where buckets follow event_time, and adds what earlier buckets hold."""
    r = rows.withColumn("_b", bucket)
    n = r.groupBy("entity", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("entity").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("entity", "_b").orderBy("event_time")) - 1
    return r.withColumn("_i", inside).join(n.select("entity", "_b", before.alias("_before")), ["entity", "_b"]).withColumn("idx", F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def indexed(rows: DataFrame) -> DataFrame:
    """idx: position of a row in its entity's series, from 0."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("entity").orderBy("event_time")) - 1)


def source_provenance(obs: DataFrame) -> DataFrame:
    """Raw and coded (non-null) rows of each source."""
    return obs.groupBy("source_id").agg(F.count("*").alias("raw_count"), F.count("target").alias("coded_count"))


def side_information_fields(obs: DataFrame, side: str = "side_information") -> DataFrame:
    """Distinct keys of a map column."""
    return obs.select(F.explode(F.map_keys(side)).alias("field")).distinct()


def panel_series_id(obs: DataFrame) -> DataFrame:
    """The entity's name if there is one, else a hash of the sorted panel (one row)."""
    panel = obs.select("entity").distinct().agg(F.sort_array(F.collect_list("entity")).alias("panel"))
    return panel.select(F.when(F.size("panel") == 1, F.element_at("panel", 1)).otherwise(F.concat(F.lit("panel:"), F.sha2(F.array_join("panel", "|"), 256))).alias("series_id"), F.size("panel").alias("entity_count"))


def time_safety_flags(cutoff) -> dict[str, Column]:
    limit = F.lit(cutoff).cast("timestamp_ntz")
    return {"future_availability": F.col("available_at") > limit, "future_event_time": F.col("event_time") > F.col("available_at")}


def time_safety_audit(snapshot: DataFrame, cutoff) -> DataFrame:
    """One row: counts of both kinds of violation and whether the run is blocked."""
    flags = time_safety_flags(cutoff)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = snapshot.agg(F.count("*").alias("row_count"), *(count(c).alias(k) for k, c in flags.items()), F.date_format(F.min("available_at"), "yyyy-MM-dd HH:mm:ss").alias("min_available_at"), F.date_format(F.max("available_at"), "yyyy-MM-dd HH:mm:ss").alias("max_available_at"))
    return out.withColumn("status", F.when((F.col("future_availability") > 0) | (F.col("future_event_time") > 0), "blocked").otherwise("passed"))
