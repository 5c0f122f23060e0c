"""Shared plumbing of the corpus operators: shared-folder tables, byte batches, hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Words are maximal runs outside space and \x09-\x0D.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Bytes that separate words.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text that a vectorised step handles at once (a longer text is handled whole).
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a local session gets a folder of its own; a cluster, which could not share it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
    return f"{base or '/tmp/checkpoints'}/lawloom"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column ``row`` beside columns of one's own, so no name of the input can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def unwrapped(rows: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    return rows.select(*(F.col(row).getField(c).alias(c) for c in columns))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells rows apart where doc_id may repeat or be null: the id and 64 bits of the text."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_columns(column) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and int64 offsets of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, last row + 1) of consecutive rows that hold at most limit bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            a = np.ones(size, dtype=np.uint64)
            k = 1
            step = b
            while k < size:
                m = min(k, size - k)
                a[k : k + m] = a[:m] * U64(step)
                k *= 2
                step = step * step % (1 << 64)
            out.append(a)
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of width values (uint64, wrapping), before mixing."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return (sums[width:] - sums[: n + 1 - width]) * down[: n + 1 - width]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


_RNG = np.random.Generator(np.random.PCG64(0x1F0E3D))
#: Two random 64-bit values for each byte.
BYTE_VALUES = _RNG.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    space = IS_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[0] = len(data) > 0 and not space[0]
    edge[-1] = len(data) > 0 and not space[-1]
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    base = BASES[which]
    up, down = powers(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[which][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U64(0x632BE59BD9B4E019))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the row of every word of consecutive texts; a word never spans two texts."""
    starts, ends = word_spans(data)
    if len(offsets) > 2 and len(starts):
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        at = np.searchsorted(starts, inner, side="left") - 1
        cut = np.unique(inner[(at >= 0) & (inner > starts[np.maximum(at, 0)]) & (inner < ends[np.maximum(at, 0)])])
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows
