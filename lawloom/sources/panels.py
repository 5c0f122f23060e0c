"""Observation panels over the driver's tables: entity, event_time, available_at, revision_id, target, source_id.

The tables have no bitemporal columns, so each panel states where its clocks come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: one row for each event type and day; known when the day's last event is."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("entity"), F.date_trunc("day", "ts").alias("event_time")).agg(F.max("ts").alias("available_at"), F.round(F.sum("value"), 6).alias("target"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: each event of a user revises the user's value of that day."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("entity"), F.date_trunc("day", "ts").alias("event_time"), F.col("ts").alias("available_at"), F.col("event_id").alias("revision_id"),
        F.col("value").alias("target"), F.col("event_type").alias("source_id"), F.col("props"),
    )


def erasures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: P2 where error events erase the value."""
    return revisions(spark, sf_dir).withColumn("target", F.when(F.col("source_id") != "error", F.col("target")))


def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: an event becomes known k hours after it happens."""
    e = table(spark, sf_dir, "events")
    hours = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("entity"), F.col("ts").alias("event_time"), (F.col("ts") + F.make_dt_interval(hours=hours)).alias("available_at"), F.col("event_id").alias("revision_id"), F.col("value").alias("target"))


def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4: order value by priority and month, in thousands; known at the month's end."""
    o = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate")
    out = o.groupBy(F.col("o_orderpriority").alias("entity"), month.alias("event_time")).agg(F.round(F.sum("o_totalprice") / 1000, 6).alias("target"))
    return out.withColumn("available_at", F.col("event_time") + F.expr("interval 1 month"))


P1 = "p1 AS (SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_time, max(ts) AS available_at, round(sum(value), 6) AS target FROM events GROUP BY 1, 2)"
P2 = "p2 AS (SELECT CAST(user_id AS VARCHAR) AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_time, ts AS available_at, event_id AS revision_id, value AS target, event_type AS source_id, props FROM events)"
P5 = P2 + ", p5 AS (SELECT * REPLACE (CASE WHEN source_id <> 'error' THEN target END AS target) FROM p2)"
P3 = "p3 AS (SELECT event_type AS entity, ts AS event_time, ts + to_hours(CAST(json_extract_string(props, '$.k') AS INT)) AS available_at, event_id AS revision_id, value AS target FROM events)"
P4 = "p4 AS (SELECT o_orderpriority AS entity, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS event_time, round(sum(o_totalprice) / 1000, 6) AS target FROM orders GROUP BY 1, 2)"
#: Series positions from 0 for each entity.
I1 = P1 + ", i1 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_time) - 1 AS idx FROM p1)"
I4 = P4 + ", i4 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_time) - 1 AS idx FROM p4)"
