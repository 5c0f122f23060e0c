"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers 0..N-1; a keyed Feistel network on the smallest even number of bits
that holds N, walked until it lands below N, permutes them; shard = p mod S and slot = p div S. Both
follow from the row number alone (``place``), counts differ by at most one, slots have no gaps.

Row numbers: rows fall into buckets by a hash of their key, a bounded table of bucket counts gives
offsets and a window numbers the rows of each bucket by (doc_id, crc, size). They depend on the rows
only, not on files, partitions or executors.

Edge cases: null text counts as no bytes (crc 0); null doc_ids come first; rows equal in doc_id, crc
and size are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawloom.llm.common import U64, mix, stored, table, text_or_empty

SHARDS, SEED, ROUNDS = 40, 20240229, 4
ROWS_PER_BUCKET, MAX_BUCKETS = 512, 1 << 20


def half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, half: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """One pass of the balanced network on 2*half bits."""
    mask, h = U64((1 << half) - 1), U64(half)
    left, right = x >> h, x & mask
    for r in range(rounds):
        key = U64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        left, right = right, left ^ (mix(right ^ key) & mask)
    return left << h | right


def permute(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Cycle walking: repeat the network for values of n and above until all lie below n."""
    half = half_bits(n)
    out = feistel(x.astype(np.uint64), half, seed)
    while len(far := np.flatnonzero(out >= U64(n))):
        out[far] = feistel(out[far], half, seed)
    return out


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(permute(np.array([row], np.uint64), n, seed)[0])
    return p % shards, p // shards


def number_rows(rows: DataFrame, order: tuple[str, ...], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds row_number (0..N-1) and n_rows. No task gets more than a bucket; only bucket counts (at most MAX_BUCKETS) meet in one."""
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // rows_per_bucket)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return (
        rows.withColumn("_i", F.row_number().over(inner) - 1)
        .join(counts, "_bucket")  # rows lie by bucket already
        .withColumn("row_number", F.col("_before") + F.col("_i"))
        .withColumn("n_rows", F.lit(n).cast("long"))
        .drop("_bucket", "_i", "_before")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row of docs."""
    text = text_or_empty()
    slim = stored(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")

    @F.pandas_udf("long")
    def permuted(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(n.iloc[0]), seed).astype(np.int64) if len(row) else [], dtype="int64")

    out = number_rows(slim, ("doc_id", "text_crc32", "size"), rows_per_bucket).withColumn("_p", permuted("row_number", "n_rows"))
    return out.select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns; the law held is ``rows``."""
    out = shard_rows(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
