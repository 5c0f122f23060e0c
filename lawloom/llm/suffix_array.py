"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms.

``sieve`` sets aside text that can't hold a repeated ``window``-byte string and deals out what is left
as stretches of bytes, so that all occurrences of a window meet in one task. There the stretches of
different buckets of texts are shards: each shard's transform is built once, the transforms are merged
by refining the interleave of their rows (``transforms``), and the runs of rows whose common prefixes
reach the window are the repeated intervals; an interval's smallest doc_id decides for each of its
windows. A stretch alone at its anchor needs no merge.

Edge cases: null text has no bytes; a null doc_id is never smaller, so nothing is removed there and it
removes nothing; rows with equal doc_id don't remove from each other; repeated rows give repeated
results; texts shorter than the window keep all; a text of any length is searched in pieces; an empty
table gives an empty result; other columns, whatever their names, are ignored. doc_id is returned as
long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lawloom.llm.common import BYTE_VALUES, table
from lawloom.llm.sieve import byte_pieces, dedup, digest
from lawloom.llm.transforms import interval_minima

WINDOW, GRAM = 50, 20
#: Shards that a block of stretches is made of.
SHARDS = 8
#: Raw text that one slice of the sketch stands for.
BYTES_PER_SLICE = 48 << 20


def _cut(data: np.ndarray, offsets: np.ndarray, window: int):
    return byte_pieces(data, offsets, window, BYTE_VALUES[0])


def _judge(lengths, data, begins, deal, doc, bucket, window: int = WINDOW) -> np.ndarray:
    return interval_minima(lengths, data, bucket % SHARDS, doc, window)


def _finish(data: bytes, spans: np.ndarray | None, window: int = WINDOW) -> tuple:
    if spans is None:
        return len(data), 0, 0, digest(data), None
    if spans[0, 1] < 0:  # a copy of a smaller document: all its windows start there, too
        gone = len(data) >= window
        return len(data), len(data) if gone else 0, int(gone), digest(b"" if gone else data), [0, len(data)] if gone else None
    edges = spans.ravel().tolist()
    kept = b"".join(data[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(data)]))
    return len(data), len(data) - len(kept), len(spans), digest(kept), edges


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bytes_per_slice: int = BYTES_PER_SLICE, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and span_edges (begin, end, begin, ... of removed runs; null: none) of every row of docs."""
    import pyarrow as pa

    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("span_edges", pa.list_(pa.int64()))])
    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_edges array<long>"
    judge = lambda *a: _judge(*a, window=window)
    finish = lambda data, spans: _finish(data, spans, window)
    return dedup(docs, _cut, judge, finish, schema, ddl, window, gram, 0, "suffix", bytes_per_slice, **options)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents")).drop("span_edges")
