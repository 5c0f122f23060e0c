"""Sources and sinks of observations: CSV, Parquet and DataFrames to the canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accepted names of the canonical columns, in order of preference.
ALIASES = {
    "entity": ("entity", "series_id"),
    "event_time": ("event_time",),
    "available_at": ("availability_time", "available_at"),
    "target": ("target", "observed_value"),
    "source_id": ("source_id",),
}
#: What a row must have; only the target and the source may be missing.
REQUIRED = ("entity", "event_time", "available_at")
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})$"


def alias_of(columns: list[str], field: str, also: dict[str, str] | None = None) -> str | None:
    """The first alias that is a column, whatever its values; ``also`` names a column of the caller's."""
    return next((a for a in (*ALIASES[field], *([also[field]] if also and field in also else [])) if a in columns), None)


def canonical_timestamp(text: Column) -> Column:
    """ISO-8601 text with an offset as UTC text in whole seconds; anything else is an error."""
    t = F.trim(text)
    bad = F.raise_error(F.concat(F.lit("invalid_timestamp: "), t))
    parsed = F.when(t.rlike(ISO_WITH_OFFSET), F.to_timestamp(t)).when(t.isNotNull(), bad.cast("timestamp"))
    return F.date_format(F.date_trunc("second", F.to_utc_timestamp(parsed, F.current_timezone())), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def finite(value: Column) -> Column:
    """The value; NaN and infinities are errors."""
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), F.raise_error(F.lit("nonfinite_numeric_value")).cast("double")).otherwise(value)


def target_value(text: Column) -> Column:
    """Blank and NaN text are null; infinities are errors."""
    t = F.lower(F.trim(text))
    return finite(F.when((t == "") | (t == "nan") | t.isNull(), None).otherwise(t.cast("double")))


def typed_side_value(text: Column) -> Column:
    """JSON text of a cell: true/false, integers, decimals (finite), else a string; blanks are null."""
    t = F.trim(text)
    low = F.lower(t)
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(t, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    number = finite(t.try_cast("double")).cast("string")
    return F.when(t == "", None).when(low.isin("true", "false"), low).when(t.rlike(r"^[+-]?\d+$"), t.cast("decimal(38,0)").cast("string")).when(t.rlike(r"^[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?$"), number).otherwise(quoted)


def side_value(c: Column, kind) -> Column:
    """JSON text of a side column of any type: text by its looks, times in canonical form, nested values as they are without their nulls; NaN is missing."""
    name = kind.typeName()
    if name == "string":
        return typed_side_value(c)
    if name in ("timestamp", "timestamp_ntz", "date"):
        return F.concat(F.lit('"'), F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    if name in ("float", "double"):
        return finite(F.when(~F.isnan(c), c.cast("double"))).cast("string")
    if name in ("struct", "map", "array"):
        return F.to_json(F.filter(c, lambda x: x.isNotNull()) if name == "array" else F.map_filter(c, lambda _, v: v.isNotNull()) if name == "map" else c)
    return F.lower(c.cast("string"))


def ingest(df: DataFrame, source_label: str = "dataframe", also: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows of text or typed columns: entity, event_time, available_at (UTC text), target, source_id, side_information (JSON texts), payload_hash.

    A row without an entity or one of the two times is an error, and so is an empty table; nothing is
    filled in. Every column that is no alias is side information. ``also`` names columns to take for a
    canonical one. A column ``revision_id`` is side information, too, and also carried along for tables that number their revisions.
    """
    cols = df.columns
    pick = {f: alias_of(cols, f, also) for f in ALIASES}
    for f in (*REQUIRED, "target"):
        if pick[f] is None:
            raise ValueError(f"missing_required_field: {f} (accepted: {', '.join(ALIASES[f])})")
    if df.limit(1).count() == 0:
        raise ValueError(f"empty_dataset: {source_label}")
    need = lambda c, f: F.coalesce(c, F.raise_error(F.lit(f"missing_required_field: {f}")).cast("string"))
    time = lambda f: F.col(pick[f]) if df.schema[pick[f]].dataType.simpleString() == "string" else F.date_format(F.col(pick[f]).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    excluded = {a for names in ALIASES.values() for a in names} | {c for c in pick.values() if c}
    rest = sorted(c for c in cols if c not in excluded)
    side = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), side_value(F.col(f"`{c}`"), df.schema[c].dataType)))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    value = F.col(pick["target"])
    out = df.select(
        need(text(F.col(pick["entity"])), "entity").alias("entity"), *(need(canonical_timestamp(text(time(f))), f).alias(f) for f in ("event_time", "available_at")),
        (target_value(value) if df.schema[pick["target"]].dataType.simpleString() == "string" else finite(F.when(~F.isnan(value.cast("double")), value.cast("double")))).alias("target"),
        (text(F.col(pick["source_id"])) if pick["source_id"] else F.lit(None).cast("string")).alias("source_id"), side.alias("side_information"),
        *([F.col("revision_id").cast("long").alias("revision_id")] if "revision_id" in cols else []),
    )
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("entity", "event_time", "available_at", "target", "source_id")]
    return out.withColumn("payload_hash", F.sha2(F.concat_ws("|", *parts, F.to_json(F.map_from_entries(F.array_sort(F.map_entries("side_information"))))), 256))


def admitted(rows: DataFrame) -> DataFrame:
    """Ingested rows with their place in the data set's total order: entity, the two times, payload. Numbered by entity, so no task sorts the whole table."""
    w = Window.partitionBy("entity").orderBy("event_time", "available_at", "payload_hash")
    return rows.withColumn("position", F.row_number().over(w) - 1)


def entity_panel(rows: DataFrame) -> DataFrame:
    """The distinct entities, sorted when shown."""
    return rows.select("entity").distinct()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; types are decided by ``ingest``, never inferred."""
    return ingest(spark.read.csv(path, header=True, inferSchema=False), "csv")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return ingest(spark.read.parquet(path), "parquet")


def observed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("target").isNotNull())


def write_csv(rows: DataFrame, path: str) -> None:
    flat = rows.withColumn("side_information", F.to_json("side_information")) if "side_information" in rows.columns else rows
    flat.write.mode("overwrite").csv(path, header=True)


def write_content_addressed(rows: DataFrame, path: str, columns: list[str], by: str = "run_id") -> None:
    """JSON payloads keyed by their hash, one row for each hash, partitioned by run."""
    from lawloom.operators.lineage import content_addressed

    content_addressed(rows, columns).select(by, "content_hash", "payload").dropDuplicates([by, "content_hash"]).write.mode("append").partitionBy(by).parquet(path)


def target_transforms(history: DataFrame) -> DataFrame:
    """history: entity, event_time, close. price_close, daily_return, log_return, next_day_up from the second row on."""
    w = Window.partitionBy("entity").orderBy("event_time")
    p = F.lag("close").over(w)
    out = history.withColumn("_p", p).where(F.col("_p").isNotNull())
    return out.select("entity", "event_time", F.col("close").alias("price_close"), (F.col("close") / F.col("_p") - 1).alias("daily_return"), F.log(F.col("close") / F.col("_p")).alias("log_return"), F.when(F.col("close") > F.col("_p"), 1.0).otherwise(0.0).alias("next_day_up"))


def price_rows(history: DataFrame, hour: int, symbol: Column) -> DataFrame:
    """Observation rows of daily prices: known ``hour`` hours after the day starts."""
    return history.select(symbol.alias("entity"), "event_time", (F.col("event_time") + F.make_dt_interval(hours=F.lit(hour))).alias("available_at"), F.col("close").alias("target"))
