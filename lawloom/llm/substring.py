"""Substring dedup over word windows: count-min prefilter, then exact groups.

First pass: ``sieve`` adds up the count-min sketches of all partitions; estimates are never too low.
Second pass: only windows estimated repeated are dealt out, as stretches of words, by their anchor; in
the anchor's task windows are grouped by their words themselves, and a window goes from a document if
a smaller doc_id holds it too. Windows of texts that equal a smaller document's need no group: all of
them are repeated.

Edge cases: null text has no words; a null doc_id is never smaller, so nothing is removed there and it
removes nothing; rows with equal doc_id don't remove from each other; repeated rows give repeated
results; documents with fewer words than the window keep all; a text of any length is searched in
pieces; an empty table gives an empty result; other columns, whatever their names, are ignored. doc_id
is returned as long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lawloom.llm.common import CHUNK_BYTES, chunks, span_hashes, table, words_of
from lawloom.llm.sieve import Piece, dedup, digest

WINDOW, GRAM = 50, 12
#: Raw text that one slice of the sketch stands for.
BYTES_PER_SLICE = 256 << 20
#: Words of a long text in one piece.
PIECE_WORDS = CHUNK_BYTES // 8


def _piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, row: int, base: int) -> Piece:
    """Words with one space after each."""
    lo = int(starts[0]) if len(starts) else 0
    raw = data[lo : int(ends[-1]) if len(ends) else 0]
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = raw.take(np.repeat(starts - lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    return Piece(span_hashes(raw, starts - lo, ends - lo), first, row, base, out, at, 1)


def _cut(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[Piece]:
    for a, b in chunks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        starts, ends, rows = words_of(raw, own)
        if b > a + 1 or len(starts) <= PIECE_WORDS:
            yield _piece(raw, starts, ends, np.searchsorted(rows, np.arange(b - a + 1), side="left"), a, 0)
            continue
        for base in range(0, len(starts), PIECE_WORDS):
            s, e = (x[base : base + PIECE_WORDS + window - 1] for x in (starts, ends))
            yield _piece(raw, s, e, np.array([0, len(s)]), a, base)


def _judge(lengths, data, begins, deal, doc, bucket, window: int = WINDOW) -> np.ndarray:
    """Windows of one anchor grouped by their words."""
    whole, marks = data.tobytes(), np.flatnonzero(data == 0x20)
    out: list[int] = []
    held: dict[bytes, int] = {}
    keys: list[bytes] = []
    anchor = None
    begins = begins.tolist()

    def done():
        out.extend(map(held.__getitem__, keys))
        keys.clear()
        held.clear()

    first = np.searchsorted(marks, begins).tolist()
    for i, (n, own, least) in enumerate(zip(lengths.tolist(), deal.tolist(), doc.tolist())):
        if own != anchor:
            done()
            anchor = own
        inner = marks[first[i] : first[i] + n - 1]
        lo = [begins[i], *(inner[: n - window] + 1).tolist()]
        hi = [*inner[window - 1 :].tolist(), begins[i + 1]]
        for x, y in zip(lo, hi):
            key = whole[x:y]
            keys.append(key)
            if least < held.get(key, least + 1):
                held[key] = least
    done()
    return np.array(out, np.int64)


def _finish(data: bytes, spans: np.ndarray | None, window: int = WINDOW) -> tuple:
    words = data.split()
    if spans is None:
        return len(words), 0, digest(b" ".join(words)), None
    if spans[0, 1] < 0:  # a copy of a smaller document: all its windows start there, too
        gone = len(words) >= window
        return len(words), len(words) if gone else 0, digest(b"" if gone else b" ".join(words)), "" if gone else None
    edges = spans.ravel().tolist()
    left = [w for a, b in zip([0, *edges[1::2]], [*edges[::2], len(words)]) for w in words[a:b]]
    kept = b" ".join(left)
    return len(words), len(words) - len(left), digest(kept), kept.decode()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bytes_per_slice: int = BYTES_PER_SLICE, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null: nothing is removed) of every row of docs."""
    import pyarrow as pa

    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    judge = lambda *a: _judge(*a, window=window)
    finish = lambda data, spans: _finish(data, spans, window)
    return dedup(docs, _cut, judge, finish, schema, "n_words long, n_removed long, kept_sha256 string, kept_text string", window, gram, 1, "substring", bytes_per_slice, **options)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM s),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM g, (SELECT unnest(range(0, 50)) AS j)),
p AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(1, len(w) + 1) ELSE [0] END) AS p FROM d),
x AS (SELECT p.doc_id, CASE WHEN p.p > 0 THEN w[p.p] END AS word, p.p, c.p IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p)
SELECT doc_id, CAST(count(word) AS BIGINT) AS n_words, CAST(count(CASE WHEN gone THEN 1 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY p), '')) AS kept_sha256 FROM x GROUP BY doc_id
"""
