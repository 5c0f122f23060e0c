"""The corpus pipeline: quality, near-duplicates, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of documents, but for the last, which returns each row's place. ``run`` writes every stage as
Parquet to the shared folder and reads it again for the next.

In every stage: an empty table gives an empty result with the same columns; columns of any name, also
those that operators use inside, pass through unchanged; a null text counts as an empty one; texts of
any length are read whole; null doc_ids, languages and sources take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lawloom.llm.common import stored, table
from lawloom.llm.decontamination import drop_contaminated
from lawloom.llm.mixing import mix_documents
from lawloom.llm.quality import reject_low_quality
from lawloom.llm.sharding import shard_documents
from lawloom.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least 0.3; rules are fitted on a bounded sample of the labels. Repeated rows score alike; without labels of both kinds the score is the labels' share."""
    return reject_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are 0.8 similar in five-word shingles: the smallest doc_id, null last, then the least text key. Of repeated rows one stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item of five tokens or more; repeated rows go or stay together."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights; a row is repeated for each epoch that takes it. Null languages and sources are leaves of their own; ties in the seeded order go by doc_id, tokens and text."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, repeated rows included."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]
#: Trees, trees of fingerprints and seeds aren't SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
