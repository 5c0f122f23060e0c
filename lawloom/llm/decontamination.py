"""Benchmark decontamination with spaced seeds.

Tokens are words without ASCII punctuation, lower-cased (A-Z and the Latin-1 capitals). A span of
``SPAN`` aligned tokens of which at least 80 % agree (so at most ``SPAN // 5`` substitutions) is an
overlap; an item shorter than ``SPAN`` must overlap as a whole by the same share, and items of fewer
than ``LEAST`` tokens aren't looked for. The span is cut into substitutions + 2 blocks and each pair
of blocks is a fixed mask that ignores the other positions: k substitutions leave two blocks whole, so
every overlap agrees on a mask and none is missed.

A pass over the documents hashes all masks at every token position and asks a bitmap of the
benchmark's hashes, whose size is fixed (``BITS``; false alarms grow with the benchmark, nothing is
lost). What passes is kept as regions: token hashes around the hits. Hits then join the benchmark's
hashes, give (region, item, diagonal) candidates, and each is verified token by token around the hit.

Edge cases: null texts have no tokens; null doc_ids are reported as null; repeated rows are reported
once; repeated items are each reported; an empty table on either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import BASES, U64, byte_columns, chunks, mix, rolling, row_key, span_hashes, stored, table, text_or_empty, unwrapped, words_of, wrapped

SPAN, LEAST, BITS = 13, 5, 1 << 24
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def substitutions(span: int) -> int:
    return span // 5


def blocks(span: int) -> list[tuple[int, int]]:
    """(offset, width) of the blocks that a span is cut into."""
    k = substitutions(span) + 2
    cuts = [span * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def masks(span: int) -> list[tuple[int, int]]:
    """Pairs of block numbers; a mask looks at those blocks only."""
    return list(combinations(range(len(blocks(span))), 2))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of consecutive texts and the token offsets of each text."""
    low = _LOWER[data]
    capital = np.zeros(len(data), bool)
    if len(data) > 1:
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[capital] += 32
    keep = ~_PUNCTUATION[data]
    moved = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    starts, ends, rows = words_of(low[keep], moved[offsets])
    return span_hashes(low[keep], starts, ends), np.searchsorted(rows, np.arange(len(offsets)), side="left")


def seeds(values: np.ndarray, span: int) -> list[np.ndarray]:
    """For each mask, the hash at every position where a span starts."""
    n = len(values) - span + 1
    if n <= 0:
        return [np.empty(0, np.uint64) for _ in masks(span)]
    parts = {}
    for i, (at, width) in enumerate(blocks(span)):
        parts[i] = mix(rolling(values, width, BASES[0])[at : at + n])
    return [mix(parts[a] * U64(0x9E3779B97F4A7C15) + parts[b] * U64(0xC2B2AE3D27D4EB4F) + U64(span * 64 + m)) for m, (a, b) in enumerate(masks(span))]


def _each_text(batch, column: int):
    """(row, token hashes) of an Arrow batch."""
    data, offsets = byte_columns(batch.column(column))
    for a, b in chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        values, at = tokens(data[offsets[a] : offsets[b]], part)
        for i in range(a, b):
            yield i, values[at[i - a] : at[i - a + 1]]


def benchmark_tokens(items: DataFrame) -> DataFrame:
    """item_id and tokens (hashes) of each item."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = [v.view(np.int64).tolist() for _, v in _each_text(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["item_id", "tokens"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", text_or_empty().alias("t")).mapInArrow(run, f"item_id {kind}, tokens array<long>")


def benchmark_seeds(own: DataFrame, span: int, least: int) -> DataFrame:
    """own: seq, tokens of distinct items. (seed, seq, at) for each mask and position."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[], [], []]
            for seq, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(toks) < least:
                    continue
                values = np.array(toks, np.int64).view(np.uint64)
                for one in seeds(values, min(span, len(values))):
                    out[0] += one.view(np.int64).tolist()
                    out[1] += [seq] * len(one)
                    out[2] += range(len(one))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["seed", "seq", "at"])

    return own.select("seq", "tokens").mapInArrow(run, "seed long, seq long, at int")


def _bitmap(seeded: DataFrame) -> np.ndarray:
    """Two bits of each seed in a bitmap of BITS bits; at most BITS / 64 words reach the driver."""
    two = seeded.select(F.explode(F.array(F.col("seed").bitwiseAND(BITS - 1), F.shiftrightunsigned("seed", 32).bitwiseAND(BITS - 1))).alias("b"))
    words = two.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v")).groupBy("w").agg(F.expr("bit_or(v)").alias("v"))
    out = np.zeros(BITS // 64, np.int64)
    for r in words.collect():
        out[r["w"]] = r["v"]
    return out.view(np.uint8)


def _regions(docs: DataFrame, bitmap: np.ndarray, spans: list[int]) -> DataFrame:
    """Stretches of tokens around positions where a seed passes the bitmap."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITS / 8 bytes, whatever the benchmark

    def run(batches: Iterator) -> Iterator:
        bits, low = shared.value, U64(BITS - 1)

        def passed(h: np.ndarray) -> np.ndarray:
            b = (h & low).astype(np.int64)
            at = np.flatnonzero(bits[b >> 3] >> (b & 7).astype(np.uint8) & 1)
            b = (h[at] >> U64(32) & low).astype(np.int64)
            return at[(bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)]

        for batch in batches:
            data, offsets = byte_columns(batch.column(2))
            rows, starts, toks, hit_at, hit_seed = [], [], [], [], []
            for a, b in chunks(offsets):
                values, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pos, seed, length = [], [], []
                for span in spans:
                    for one in seeds(values, span):
                        hit = passed(one)
                        pos.append(hit)
                        seed.append(one[hit])
                        length.append(np.full(len(hit), span))
                pos, seed, length = np.concatenate(pos), np.concatenate(seed), np.concatenate(length)
                doc = np.searchsorted(at, pos, side="right") - 1
                fine = pos + length <= at[doc + 1] if len(pos) else np.zeros(0, bool)  # a span lies in one document
                order = np.flatnonzero(fine)[np.argsort(pos[fine], kind="stable")]
                pos, seed, doc = pos[order], seed[order], doc[order]
                if not len(pos):
                    continue
                cut = np.flatnonzero((np.diff(pos) > SPAN) | (np.diff(doc) > 0)) + 1
                for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(pos)]])):
                    d = doc[i]
                    first, last = max(at[d], pos[i] - 2 * SPAN), min(at[d + 1], pos[j - 1] + 3 * SPAN)
                    rows.append(a + int(d))
                    starts.append(int(first - at[d]))
                    toks.append(values[first:last].view(np.int64).tolist())
                    hit_at.append((pos[i:j] - first).tolist())
                    hit_seed.append(seed[i:j].view(np.int64).tolist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()), pa.array(toks, pa.list_(pa.int64())), pa.array(hit_at, pa.list_(pa.int32())), pa.array(hit_seed, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "start", "tokens", "hit_at", "hit_seed"],
            )

    return docs.select(*row_key(), text_or_empty().alias("t")).mapInArrow(run, f"doc_id {kind}, text_hash long, start long, tokens array<long>, hit_at array<int>, hit_seed array<long>")


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, span: int) -> tuple[int, int, int] | None:
    """(item position, length, agreeing tokens) of the stretch from the first to the last qualifying span along a diagonal; None without one."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if b - a < span:
        return None
    same = doc[a + diagonal : b + diagonal] == item[a:b]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[span:] - sums[:-span] >= span - substitutions(span))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + span
    return a + first, last - first, int(sums[last] - sums[first])


def verified_overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, seq, doc_token, item_token, n_tokens, n_same of each verified diagonal; the items' ids and token lists). seq: hash of an item's tokens."""
    import pyarrow as pa

    toks = stored(benchmark_tokens(items), "benchmark-tokens")
    own = toks.groupBy("tokens").agg(F.count("*").alias("n")).select(F.xxhash64("tokens").alias("seq"), "tokens")
    own = stored(own.where(F.size("tokens") >= least), "benchmark-items")
    seeded = stored(benchmark_seeds(own, span, least), "benchmark-seeds")
    spans = sorted({r["s"] for r in own.select(F.least(F.size("tokens"), F.lit(span)).alias("s")).distinct().collect()}) or [span]  # at most span - least + 1 values
    regions = stored(_regions(docs, _bitmap(seeded), spans), "regions").withColumn("region", F.xxhash64("doc_id", "text_hash", "start"))
    hits = regions.select("region", F.explode(F.arrays_zip("hit_at", "hit_seed")).alias("h")).select("region", F.col("h.hit_at").alias("pos"), F.col("h.hit_seed").alias("seed"))
    candidates = hits.join(seeded, "seed").select("region", "seq", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    full = candidates.join(regions.select("region", "doc_id", "text_hash", "start", F.col("tokens").alias("doc_tokens")), "region").join(own.select("seq", "tokens"), "seq")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def verify(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            rows = []
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                item = cols[4][i].values.to_numpy()
                doc = cols[3][i].values.to_numpy()
                diagonal = cols[1][i].as_py()
                if (found := overlap(doc, item, diagonal, min(span, len(item)))) is not None:
                    rows.append(i)
                    out[0].append(cols[2][i].as_py() + found[0] + diagonal)
                    for k in range(3):
                        out[k + 1].append(found[k])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(5).take(at), batch.column(6).take(at), cols[0].take(at), *(pa.array(out[k], pa.int64()) for k in range(4))],
                names=["doc_id", "text_hash", "seq", "doc_token", "item_token", "n_tokens", "n_same"],
            )

    found = full.select("seq", "diagonal", "start", "doc_tokens", "tokens", "doc_id", "text_hash").mapInArrow(verify, f"doc_id {kind}, text_hash long, seq long, doc_token long, item_token long, n_tokens long, n_same long")
    return found, toks


def find_overlaps(docs: DataFrame, items: DataFrame, span: int = SPAN, least: int = LEAST) -> DataFrame:
    """One row for each document and item that overlap: doc_id, text_hash, item_id, doc_token, item_token, n_tokens, n_same (of the longest overlap)."""
    found, toks = verified_overlaps(docs, items, span, least)
    best = found.groupBy("doc_id", "text_hash", "seq").agg(F.max(F.struct("n_same", "n_tokens", -F.col("doc_token"), -F.col("item_token"))).alias("m"))
    best = best.select("doc_id", "text_hash", "seq", (-F.col("m.col3")).alias("doc_token"), (-F.col("m.col4")).alias("item_token"), "m.n_tokens", "m.n_same")
    names = toks.select("item_id", F.xxhash64("tokens").alias("seq"))
    return best.join(names, "seq").drop("seq")


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps with a benchmark item, once for each item."""
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_same")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that overlap with an item; which items, and how many, doesn't matter.

    A null text overlaps with nothing; repeated rows go or stay together; empty tables give an empty
    result or all rows; columns of any name pass through.
    """
    bad = stored(verified_overlaps(docs, items)[0].select("doc_id", "text_hash").distinct(), "contaminated")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    return unwrapped(wrapped(docs, *row_key()).alias("d").join(bad.alias("b"), on, "left_anti"), docs.columns)
