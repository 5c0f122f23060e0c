"""Line dedup with content-defined chunks of lines.

A chunk is a non-blank line up to the next non-blank one, with the blank lines between, at every
line; so a passage of two lines or more that occurs again consists of chunks that occur again,
whatever stands around it, and none is missed. A chunk that occurs more than once in the whole table,
in one document or in many, is kept at its first place (smallest doc_id, then first line) and removed
everywhere else: a line goes if it lies in such a chunk. Chunks of one line repeated over and over
don't overlap. Places are grouped by the bytes themselves, so equal hashes of different chunks remove
nothing.

Shuffles: slim rows (hash, id, place) to find repeated hashes, with partial sums; then only the bytes
of chunks whose hash is repeated. Whole texts are shuffled once, to meet their candidate places.

Edge cases: null text has no lines and no bytes; a null doc_id comes last in the order of places; rows
equal in doc_id and text count as one place and stay whole or lose the same chunks; lines are split at
\\n only and keep other bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import row_key, stored, table, text_or_empty

MIN_LINES = 2


def chunk_spans(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, last line + 1) of the chunks, in order: all pairs of consecutive non-blank lines.

    A pair equal to the one before it, with which it shares a line, is left out; where that leaves the
    last line of a run of equal lines without a pair, a chunk of three covers it.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    out: list[tuple[int, int]] = []
    for k, (i, j) in enumerate(zip(full, full[1:])):
        if out and out[-1][1] == i + 1 and lines[out[-1][0] : i + 1] == lines[i : j + 1]:
            if k + 2 == len(full) or lines[i : j + 1] != lines[j : full[k + 2] + 1]:
                out.append((out[-1][0], j + 1))
            continue
        out.append((i, j + 1))
    return out


def eligible(lines: list[bytes], span: tuple[int, int]) -> bool:
    """Two non-blank lines at least."""
    return span[1] - span[0] >= MIN_LINES and sum(1 for x in lines[span[0] : span[1]] if x.strip()) >= 2


def lines_of(text: bytes) -> list[bytes]:
    return text.split(b"\n") if text else []


def _slim(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, text_hash, start) of eligible chunks."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            hashes, at, starts = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary())):
                lines = lines_of(text.as_py() or b"")
                if len(lines) < MIN_LINES:
                    continue
                for a, b in chunk_spans(lines):
                    if eligible(lines, (a, b)):
                        hashes.append(xxhash.xxh64_intdigest(b"\n".join(lines[a:b])) - (1 << 63))
                        at.append(i)
                        starts.append(a)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32())], names=["chunk", "doc_id", "text_hash", "start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*row_key(), text_or_empty().alias("t")).mapInArrow(run, f"chunk long, doc_id {kind}, text_hash long, start int")


def _resolved(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text_hash, t, starts. Rows without starts get their figures at once; the others keep their text and their candidate chunks."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_lines long, kept_sha256 string, t string, chunks array<struct<start:int,n:int,bytes:binary>>"
    chunk_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # small batches: chunks repeat the bytes of their text
                n, size = 0, 0
                part = batch.slice(at, 256)
                texts, starts = part.column(2), part.column(3).to_pylist()
                n_lines, shas, kept, chunks = [], [], [], []
                for text, own in zip(texts.to_pylist(), starts):
                    raw = (text or "").encode()
                    lines = lines_of(raw)
                    n_lines.append(len(lines))
                    if own is None:
                        shas.append(hashlib.sha256(raw).hexdigest())
                        kept.append(None)
                        chunks.append(None)
                    else:
                        wanted = set(own)
                        shas.append(None)
                        kept.append(text)
                        chunks.append([{"start": a, "n": b - a, "bytes": b"\n".join(lines[a:b])} for a, b in chunk_spans(lines) if a in wanted])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_lines, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string()), pa.array(chunks, chunk_type)], names=["doc_id", "text_hash", "n_lines", "kept_sha256", "t", "chunks"])
                at += 256

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines, removed (runs of lines: start, n), and text without them for the rows that lose some."""
    slim = stored(_slim(docs), "line-chunks")
    repeated = slim.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk")
    starts = slim.join(repeated, "chunk").groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))
    keyed = docs.select(*row_key(), text_or_empty().alias("t"))
    on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    rows = stored(_resolved(keyed.alias("d").join(starts.alias("s"), on, "left").select("d.doc_id", "d.text_hash", "d.t", "s.starts")), "line-candidates")
    plain, open_ = rows.where("chunks is null"), rows.where("chunks is not null")
    places = stored(open_.select("doc_id", "text_hash", F.explode("chunks").alias("c")).select("doc_id", "text_hash", "c.start", "c.n", "c.bytes"), "line-places")
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"), F.col("start").alias("d"))
    firsts = stored(places.groupBy("bytes").agg(F.min(rank).alias("first")), "line-firsts")
    gone = places.withColumn("rank", rank).join(firsts, "bytes").where("rank <> first").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("removed"))
    on = F.col("o.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("o.text_hash") == F.col("g.text_hash"))
    done = open_.alias("o").join(gone.alias("g"), on, "left").select("o.doc_id", "o.text_hash", "o.n_lines", "o.t", "g.removed")
    return plain.select("doc_id", "text_hash", "n_lines", "kept_sha256", F.lit(None).cast("string").alias("kept_text"), F.lit(None).cast("array<struct<start:int,n:int>>").alias("removed")).unionByName(_rebuilt(done))


def _rebuilt(rows: DataFrame) -> DataFrame:
    import pyarrow as pa

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_lines long, kept_sha256 string, kept_text string, removed array<struct<start:int,n:int>>"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts, spans = [], []
            for text, gone in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                merged = None
                if gone:
                    drop = {i for g in gone for i in range(g["start"], g["start"] + g["n"])}
                    text = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in drop)
                    merged = []
                    for i in sorted(drop):
                        if i - 1 in drop:
                            merged[-1]["n"] += 1
                        else:
                            merged.append({"start": i, "n": 1})
                texts.append(text)
                spans.append(merged)
            shas = [hashlib.sha256((x or "").encode()).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas), pa.array(texts, pa.string()), pa.array(spans, batch.column(4).type)], names=["doc_id", "text_hash", "n_lines", "kept_sha256", "kept_text", "removed"])

    return rows.mapInArrow(run, schema)


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    n = F.coalesce(F.aggregate("removed", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_lines", n.alias("n_removed"), F.coalesce(F.when(F.size("removed") >= 0, F.size("removed")), F.lit(0)).cast("long").alias("n_chunks"), "kept_sha256")
