"""Features from legal history: past rows that were known when the current row became known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the bounded look-back reads at first, and rows of a block of a series.
LOOK_BACK, BLOCK = 64, 4096


def in_blocks(indexed: DataFrame, before: int, block: int = BLOCK) -> DataFrame:
    """Rows by block of their series (column ``_k``), each block with the ``before`` last rows of the one before it (``_own`` is false there): windows need no whole series."""
    blocks = -(-before // block)
    own = F.floor(F.col("idx") / block)
    last = F.floor((F.col("idx") + before) / block)
    return indexed.withColumn("_k", F.explode(F.sequence(own, F.least(last, own + blocks)))).withColumn("_own", F.col("_k") == F.floor(F.col("idx") / block))


def has_late_rows(indexed: DataFrame, block: int = BLOCK) -> bool:
    """Whether any row became known before its predecessor; without such rows plain lags are legal. Blocks hand on their maximum."""
    rows = indexed.select("entity", "idx", "event_time", "available_at", F.floor(F.col("idx") / block).alias("_k"))
    tops = rows.groupBy("entity", "_k").agg(F.max("available_at").alias("_m"))
    tops = tops.select("entity", "_k", F.max("_m").over(Window.partitionBy("entity").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)).alias("_m"))
    inside = F.max("available_at").over(Window.partitionBy("entity", "_k").orderBy("event_time").rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("_i", inside).join(tops, ["entity", "_k"])
    return seen.where(F.greatest("_i", "_m") > F.col("available_at")).limit(1).count() > 0


def fast_features(indexed: DataFrame, lags: list[int], means: list[int]) -> DataFrame:
    """Lags and trailing means by position; legal only where no row is late."""
    w = Window.partitionBy("entity").orderBy("event_time")
    cols = [F.lag("target", k).over(w).alias(f"lag_{k}") for k in lags] + [F.avg("target").over(w.rowsBetween(-m, -1)).alias(f"rolling_mean_{m}") for m in means]
    return indexed.select("*", *cols).where(F.col("idx") >= max([*lags, *means]))


def legal_features(indexed: DataFrame, lags: list[int], means: list[int], look_back: int = LOOK_BACK, block: int = BLOCK) -> DataFrame:
    """Row t uses row s only if s.event_time < t.event_time and s.available_at <= t.available_at.

    lag_k is the k-th most recent legal row; rows before the warm-up or with too little legal history
    go. A bounded look-back inside blocks of (entity, position) settles most rows in one sort. Rows that
    are left look eight times as far back, by an equi-join on blocks of that reach, until no row has
    further history; a row meets at most two blocks at each reach, and no task gets a whole series.
    """
    from lawloom.sources.tables import stored

    need, cols = max([*lags, *means]), indexed.columns
    indexed = stored(indexed, "legal-rows")
    w = Window.partitionBy("entity", "_k").orderBy("event_time").rowsBetween(-look_back, -1)
    past = in_blocks(indexed, look_back, block).withColumn("_past", F.collect_list(F.struct("event_time", "available_at", "target")).over(w)).where(F.col("_own") & (F.col("idx") >= need))
    legal = F.filter("_past", lambda s: (s["event_time"] < F.col("event_time")) & (s["available_at"] <= F.col("available_at")))
    past = past.select(*cols, F.slice(F.transform(F.reverse(legal), lambda s: s["target"]), 1, need).alias("_legal"))
    settled = stored(past, "legal-near")
    out, todo, reach = settled.where(F.size("_legal") >= need), settled.where((F.size("_legal") < need) & (F.col("idx") > look_back)).drop("_legal"), look_back
    while todo.limit(1).count():
        reach *= 8
        own = F.floor(F.col("idx") / reach)
        sources = indexed.select(F.col("entity").alias("_e"), F.floor(F.col("idx") / reach).alias("_b"), F.col("idx").alias("_i"), F.col("event_time").alias("_t"), F.col("available_at").alias("_a"), F.col("target").alias("_y"))
        asks = todo.select("entity", "idx", "event_time", "available_at", F.explode(F.array(own, own - 1)).alias("_k"))
        met = asks.join(sources, (F.col("entity") == F.col("_e")) & (F.col("_k") == F.col("_b")) & (F.col("_i") < F.col("idx")) & (F.col("_i") >= F.col("idx") - reach) & (F.col("_t") < F.col("event_time")) & (F.col("_a") <= F.col("available_at")))
        rank = F.row_number().over(Window.partitionBy("entity", "idx").orderBy(F.col("_i").desc()))
        found = met.select("entity", "idx", "_i", "_y").withColumn("_r", rank).where(F.col("_r") <= need).groupBy("entity", "idx").agg(F.sort_array(F.collect_list(F.struct("_r", "_y"))).alias("_l"))
        all_ = stored(todo.join(found.select("entity", "idx", F.transform("_l", lambda x: x["_y"]).alias("_legal")), ["entity", "idx"], "left").select(*cols, "_legal"), "legal-far")
        enough = F.coalesce(F.size("_legal"), F.lit(0)) >= need
        out, todo = out.unionByName(all_.where(enough)), all_.where(~enough & (F.col("idx") > reach)).drop("_legal")
    mean = lambda m: F.aggregate(F.slice("_legal", 1, m), F.lit(0.0), lambda a, x: a + x) / m
    return out.select(*cols, *(F.element_at("_legal", k).alias(f"lag_{k}") for k in lags), *(mean(m).alias(f"rolling_mean_{m}") for m in means))


def feature_view(indexed: DataFrame, lags: list[int], means: list[int]) -> DataFrame:
    """Plain lags where an audit shows that they are legal, else legal history."""
    return legal_features(indexed, lags, means) if has_late_rows(indexed) else fast_features(indexed, lags, means)


def late_source_canaries(indexed: DataFrame, lags: list[int], means: list[int], block: int = BLOCK) -> DataFrame:
    """Rows whose positional sources weren't known yet: entity, idx and the blocked positions."""
    far = max([*lags, *means])
    w = Window.partitionBy("entity", "_k").orderBy("event_time").rowsBetween(-far, -1)
    wanted = sorted({*lags, *(k for m in means for k in range(1, m + 1))})
    out = in_blocks(indexed, far, block).withColumn("_past", F.collect_list(F.struct("idx", "available_at")).over(w)).where(F.col("_own") & (F.col("idx") >= far))
    bad = F.filter("_past", lambda s: (s["available_at"] > F.col("available_at")) & (F.col("idx") - s["idx"]).isin(wanted))
    return out.select("entity", "idx", F.array_sort(F.transform(bad, lambda s: s["idx"])).alias("blocked")).where(F.size("blocked") > 0)
