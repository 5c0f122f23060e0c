"""Manifests and their lineage as tables: insert-or-verify, neighbours, closure, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """JSON with sorted keys (a hash domain of its own: numbers print as Spark prints them)."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def digest(json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(json, 256))


def content_addressed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """payload and content_hash of each row; write partitioned by run, read by hash."""
    return rows.withColumn("payload", canonical_json(*columns)).withColumn("content_hash", digest(F.col("payload")))


def verified(rows: DataFrame) -> DataFrame:
    """Whether each payload still has its hash."""
    return rows.withColumn("intact", F.col("content_hash") == digest(F.col("payload")))


def register(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table with the incoming manifests; a known key with another hash is an error."""
    table, conflicts = upsert_manifests(existing, incoming)
    bad = conflicts.limit(1).collect()
    if bad:
        raise ValueError(f"manifest_conflict: {bad[0]['run_id']}/{bad[0]['manifest_id']}")
    return table


def upsert_manifests(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with new keys added, incoming rows whose key exists with another hash): ``register`` raises on the second."""
    keys = ["run_id", "manifest_id"]
    known = existing.select(*keys, F.col("content_hash").alias("_h"))
    conflicts = incoming.join(known, keys).where("content_hash <> _h").drop("_h")
    return existing.unionByName(incoming.dropDuplicates([*keys, "content_hash"]).join(known, keys, "left_anti")), conflicts


def children(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent") == parent).select("child")


def parents(edges: DataFrame, child: str) -> DataFrame:
    return edges.where(F.col("child") == child).select("parent")


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of all that the roots reach, by least depth.

    A join per generation; only the newest rows go on. What was reached is kept as one table per
    generation, so the check for new rows reads keys that were written once. It ends by itself: a
    generation without a new row is the last, and there are at most as many as nodes.
    """
    from lawloom.sources.tables import stored

    reached = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct(), "closure")
    newest, depth = reached, 0
    while True:
        depth += 1
        step = newest.join(edges, newest.node == edges.parent).select("root", F.col("child").alias("node")).distinct()
        newest = stored(step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if newest.limit(1).count() == 0:
            return reached
        reached = reached.unionByName(newest)


def referenced_manifests(edges: DataFrame, manifests: DataFrame, parent: str) -> DataFrame:
    """Manifests that one refers to."""
    return manifests.join(children(edges, parent).withColumnRenamed("child", "manifest_id"), "manifest_id", "left_semi")


def referrers(edges: DataFrame, manifests: DataFrame, child: str) -> DataFrame:
    """Manifests that refer to one."""
    return manifests.join(parents(edges, child).withColumnRenamed("parent", "manifest_id"), "manifest_id", "left_semi")


def manifests_of_run(manifests: DataFrame, run_id: str) -> DataFrame:
    """A run's manifests; a table partitioned by run reads that partition only."""
    return manifests.where(F.col("run_id") == run_id)


def read_payload(rows: DataFrame, content_hash: str) -> str:
    """The payload of one hash; a missing one, or one that no longer has its hash, is an error."""
    found = verified(rows.where(F.col("content_hash") == content_hash).select("payload", "content_hash").limit(1)).collect()
    if not found:
        raise KeyError(f"unknown content hash: {content_hash}")
    if not found[0]["intact"]:
        raise ValueError(f"artifact_hash_mismatch: {content_hash}")
    return found[0]["payload"]


def replay_differences(first: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that are in one result only, counted with repeats (empty: the replay agrees)."""
    return first.exceptAll(again).withColumn("side", F.lit("recorded")).unionByName(again.exceptAll(first).withColumn("side", F.lit("replayed")))


def latest_states(log: DataFrame) -> DataFrame:
    """Last state of each run and step in an append-only log."""
    return log.groupBy("run_id", "step").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("at"))
