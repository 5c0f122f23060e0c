"""Repeated windows of units (words or bytes): a count-min prefilter, exact groups, removal.

Every window of ``window`` units has an anchor: the least hash among the ``gram``-unit runs inside it.
Equal windows have equal anchors, so an anchor is in at least as many texts as any of its windows.

1. Rows are dealt to buckets by (doc_id, text); a bucket is a partition of bounded bytes. Rows whose
   text equals a smaller doc_id's are known from a slim table of digests and go no further.
2. First pass: each bucket fills a count-min sketch of the anchors of its texts (two rows of ``width``
   counters for each slice of the hash space) and ships its non-zero counters. A slice's task adds the
   buckets' sketches up into fixed arrays and tells each bucket which of its own counters came to two
   or more. Counters never fall short, so no repeated window is lost. Slices follow the corpus, so the
   arrays are bounded at every size; nothing is broadcast.
3. Second pass: each bucket reads the estimates. Consecutive windows of one anchor that is estimated in
   two texts form a *stretch*; equal stretches of a bucket become one, with the places it stands at.
   Stretches are dealt out by anchor; the windows of an anchor estimated in over ``HOT`` texts are
   dealt out one by one, by their own hash.
4. The task of an anchor compares stretches by their units and finds for each window the smallest
   doc_id that holds it; how is the operator's own method. What a bucket has to remove goes back to it.

The dealt texts are shuffled once; the three passes read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawloom.llm.common import BASES, CHUNK_BYTES, U64, byte_columns, chunks, mix, rolling, sliding_min, stored, text_or_empty

#: Counters of a row of a slice's sketch; raw bytes of text in a bucket; texts beyond which an anchor's windows are dealt one by one.
WIDTH, BUCKET_BYTES, HOT = 1 << 24, 12 << 20, 8192
#: Bytes of stretches that a task judges at once, where the anchors allow.
BLOCK_BYTES = 1 << 20


@dataclass
class Piece:
    """Consecutive texts of a bucket, or a part of a long one.

    values: hash of each unit; first: first unit of each text, then the end; row: the first text's
    number in the bucket; base: units of that text before the piece; data: the units' bytes with ``gap``
    bytes between two units; at: begin of each unit in data, then the end plus gap.
    """

    values: np.ndarray
    first: np.ndarray
    row: int
    base: int
    data: np.ndarray
    at: np.ndarray
    gap: int


#: Pieces of texts given as bytes and offsets; a piece of a long text overlaps with the next by window - 1 units.
Cut = Callable[[np.ndarray, np.ndarray, int], Iterator[Piece]]
#: lengths (units), data, at (unit begins), deal, doc of distinct stretches -> for each window of each, in order, the smallest doc.
Judge = Callable[..., np.ndarray]


def window_anchors(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows that lie in one text: their start and the anchor's hash. first: first unit of each text, then the end."""
    if len(values) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding_min(mix(rolling(values, gram, BASES[0])), window - gram + 1)
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= ends)
    return starts, least[starts]


def stretches(piece: Piece, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First unit, number of windows, anchor and text of each run of windows with one anchor."""
    starts, anchors = window_anchors(piece.values, piece.first, window, gram)
    row = np.searchsorted(piece.first, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (anchors[1:] != anchors[:-1]) | (np.diff(row) != 0)
    begin = np.flatnonzero(new)
    return starts[begin], np.diff(np.append(begin, len(starts))), anchors[begin], row[begin]


def cells_of(anchors: np.ndarray, slices: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of each anchor and its counter in each of the two rows, (n, 2), the second row counted on from width."""
    own = ((anchors & U64(0xFFFFFFFF)) * U64(slices) >> U64(32)).astype(np.int64)
    rows = [(mix(anchors ^ U64(salt)) & U64(width - 1)).astype(np.int64) + i * width for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47))]
    return own, np.stack(rows, axis=1)


def pack(cells: np.ndarray) -> bytes:
    """Ascending numbers as 32-bit steps, low halves before high halves (which are mostly zero)."""
    return np.diff(cells, prepend=0).astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, "<u2").reshape(2, -1)
    return np.cumsum(halves[0].astype(np.int64) | halves[1].astype(np.int64) << 16)


class Bucket:
    """A bucket's rows: its distinct (doc_id, text) in order, and the texts that need a search."""

    def __init__(self, rows, info) -> None:
        import pyarrow as pa

        self.ids, self.shas = rows.column("doc_id").to_pylist(), rows.column("sha").to_pylist()
        self.texts = rows.column("t").cast(pa.large_binary())
        seconds = info.column("sha").to_pylist() if info.num_rows else []
        firsts = {s: f for s, f in zip(seconds, info.column("first").to_pylist() if info.num_rows else []) if s is not None}
        self.copy = [d is not None and s in firsts and firsts[s] < d for d, s in zip(self.ids, self.shas)]
        at: dict = {}
        for i, k in enumerate(zip(self.ids, self.shas)):
            at.setdefault(k, i)
        known = sorted((k for k in at if k[0] is not None))
        #: number of each distinct row, and of each row (None: no doc_id)
        self.number = {k: i for i, k in enumerate(known)}
        self.doc = np.array([k[0] for k in known], np.int64)
        self.searched = np.array([i for i, k in enumerate(known) if not self.copy[at[k]]], np.int64)
        picked = self.texts.take(pa.array([at[known[i]] for i in self.searched.tolist()], pa.int64()))
        self.data, self.offsets = byte_columns(picked)


def _sketch(cut: Cut, window: int, gram: int, slices: int, width: int):
    import pyarrow as pa

    def run(key, rows, info):
        bucket = Bucket(rows, info)
        held, texts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for piece in cut(bucket.data, bucket.offsets, window):
            _, _, anchors, row = stretches(piece, window, gram)
            held.append(anchors)
            texts.append(piece.row + row)
        anchors, texts = np.concatenate(held), np.concatenate(texts)
        order = np.lexsort((texts, anchors))
        anchors, texts = anchors[order], texts[order]
        once = np.ones(len(anchors), bool)
        once[1:] = (anchors[1:] != anchors[:-1]) | (texts[1:] != texts[:-1])
        own, cells = cells_of(anchors[once], slices, width)
        cells = (own[:, None] * (2 * width) + cells).ravel()
        cells, counts = np.unique(cells, return_counts=True)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        full, begin = np.unique(cells // (2 * width), return_index=True)
        ends = np.append(begin, len(cells))
        out = [(pack(cells[a:b] - s * 2 * width), counts[a:b].tobytes()) for s, a, b in zip(full.tolist(), ends[:-1].tolist(), ends[1:].tolist())]
        return pa.table([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), key[0].as_py(), np.int32)), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["slice", "bucket", "cells", "counts"])

    return run


def _add_up(width: int, hot: int):
    """Rows of a slice follow one another: their counters are added into fixed arrays, then read back for each bucket."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        own, rows, counters = None, [], np.zeros(2 * width, np.uint16)

        def done():
            out: tuple[list, list, list] = ([], [], [])
            for bucket, raw in rows:
                cells = unpack(raw)
                told = counters[cells]
                more = cells[told > 1]
                if len(more):
                    out[0].append(bucket)
                    out[1].append(pack(more))
                    out[2].append(pack(cells[told > hot]))
            for _, raw in rows:
                counters[unpack(raw)] = 0
            n = len(out[0])
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([own] * n, pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "slice", "cells", "hot"])

        for batch in batches:
            for s, bucket, raw, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != own:
                    if rows:
                        yield done()
                    own, rows = s, []
                cells = unpack(raw)
                counters[cells] = np.minimum(counters[cells].astype(np.uint32) + np.frombuffer(counts, np.uint16), 65535)
                rows.append((bucket, raw))
        if rows:
            yield done()

    return run


def _estimates(info, column: str, width: int) -> np.ndarray:
    """The counters told to a bucket, as one ascending list over all slices."""
    import pyarrow.compute as pc

    told = info.filter(pc.is_valid(info.column("slice"))) if info.num_rows else info
    parts = [s * 2 * width + unpack(raw) for s, raw in sorted(zip(told.column("slice").to_pylist(), told.column(column).to_pylist()))]
    return np.concatenate([np.empty(0, np.int64), *parts])


def _held(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys if len(sorted_) else np.zeros(keys.shape, bool)


def _gather(data: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """The byte ranges as an Arrow array."""
    import pyarrow as pa

    n = hi - lo
    ends = np.cumsum(n)
    body = data.take(np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(body)])


def _repeated(cut: Cut, window: int, gram: int, slices: int, width: int):
    """Distinct stretches of a bucket whose anchor is estimated in two texts."""
    import pyarrow as pa

    schema = pa.schema([("deal", pa.int64()), ("s", pa.binary()), ("bucket", pa.int32()), ("doc", pa.int64()), ("most", pa.int64()), ("places", pa.binary())])

    def run(key, rows, info):
        bucket = Bucket(rows, info)
        more, hot = _estimates(info, "cells", width), _estimates(info, "hot", width)
        deals, strings, places, docs = [], [], [], []
        for piece in cut(bucket.data, bucket.offsets, window) if len(more) else ():
            begin, count, anchors, row = stretches(piece, window, gram)
            own, cells = cells_of(anchors, slices, width)
            cells += own[:, None] * (2 * width)
            fine = np.flatnonzero(_held(more, cells).all(axis=1))
            if not len(fine):
                continue
            begin, count, anchors, row = begin[fine], count[fine], anchors[fine], row[fine]
            deal = anchors
            many = _held(hot, cells[fine]).all(axis=1)
            if many.any():
                n = np.where(many, count, 1)
                of = np.repeat(np.arange(len(n)), n)
                begin = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                single = mix(rolling(piece.values, window, BASES[1]))
                deal = np.where(many[of], single[begin], anchors[of])
                count, row = np.where(many[of], 1, count[of]), row[of]
            deals.append(deal.view(np.int64))
            strings.append(_gather(piece.data, piece.at[begin], piece.at[begin + count + window - 1] - piece.gap))
            number = bucket.searched[piece.row + row]
            docs.append(bucket.doc[number])
            offset = begin - piece.first[row] + np.where(row == 0, piece.base, 0)
            places.append(number << 32 | offset)
        if not deals:
            return schema.empty_table()
        texts = pa.chunked_array(strings).combine_chunks()
        deals, places, docs = np.concatenate(deals), np.concatenate(places), np.concatenate(docs)
        codes = texts.dictionary_encode().indices.to_numpy()
        order = np.lexsort((places, codes, deals))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(codes[order]) != 0) | (np.diff(deals[order]) != 0)
        begin = np.flatnonzero(new)
        lead = order[begin]
        docs = docs[order]
        flat = np.append(begin, len(order)) * 8
        told = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(flat.astype(np.int32)), pa.py_buffer(places[order].tobytes())])
        return pa.table(
            [pa.array(deals[lead]), texts.take(pa.array(lead)).cast(pa.binary()), pa.array(np.full(len(lead), key[0].as_py(), np.int32)), pa.array(np.minimum.reduceat(docs, begin)), pa.array(np.maximum.reduceat(docs, begin)), told],
            schema=schema,
        )

    return run


def _judged(window: int, gap: int, judge: Judge):
    """(bucket, places, runs) of what has to go: for the stretch at each place, runs of windows (offset, number, smallest doc)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def block(rows):
        deal, text, bucket = rows.column(0).to_numpy(), rows.column(1).combine_chunks(), rows.column(2)
        doc, most = rows.column(3).to_numpy(), rows.column(4).to_numpy()
        text = (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_binary())
        new = np.ones(len(deal), bool)
        new[1:] = (np.diff(deal) != 0) | pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        lead = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, lead)
        data, at = byte_columns(text.take(pa.array(lead)))
        edges = deal[lead]
        alone = np.ones(len(lead), bool)
        alone[1:] &= edges[1:] != edges[:-1]
        alone[:-1] &= edges[1:] != edges[:-1]
        # units of a stretch: its bytes, or its words with one byte between
        if gap:
            marks = np.flatnonzero(data == 0x20)
            inner = np.searchsorted(marks, at)
            units = np.diff(inner) + 1
        else:
            units = np.diff(at)
        n = units - window + 1
        # equal windows have equal anchors: a stretch alone at its anchor shares no window
        smallest = np.repeat(least, n)
        shared = np.flatnonzero(~alone)
        if len(shared):
            own, begins = text.take(pa.array(lead[shared])), None
            data, begins = byte_columns(own)
            smallest[np.repeat(~alone, n)] = judge(units[shared], data, begins, edges[shared], least[shared], bucket.to_numpy()[lead[shared]])
        # runs of windows with one smallest doc
        string = np.repeat(np.arange(len(lead)), n)
        first = np.ones(len(string), bool)
        first[1:] = (np.diff(string) != 0) | (np.diff(smallest) != 0)
        run = np.flatnonzero(first)
        begin = (np.cumsum(n) - n)[string[run]]
        runs = np.stack([run - begin, np.diff(np.append(run, len(string))), smallest[run]], axis=1)
        bound = np.searchsorted(string[run], np.arange(len(lead) + 1)) * 24
        runs = pa.BinaryArray.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(runs).tobytes())])
        lowest = np.minimum.reduceat(smallest, np.cumsum(n) - n)
        gone = np.flatnonzero(most > lowest[of])
        take = pa.array(gone)
        return pa.RecordBatch.from_arrays([bucket.take(take).combine_chunks(), rows.column(5).take(take).combine_chunks(), runs.take(pa.array(of[gone]))], names=["bucket", "places", "runs"])

    def run(batches: Iterator) -> Iterator:
        held: list = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append(part)
                size += part.get_total_buffer_size() * part.num_rows // max(batch.num_rows, 1)
                if size > BLOCK_BYTES:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    keys = whole.column(0).to_numpy()
                    edge = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                    if edge:
                        yield block(whole.slice(0, edge))
                        whole = whole.slice(edge)
                    held = whole.combine_chunks().to_batches()
                    size = whole.nbytes
        if held and (whole := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield block(whole)

    return run


def spans_of(bucket: Bucket, info, window: int) -> dict[int, np.ndarray]:
    """Number of a distinct row -> its removed runs of units (begin, end), ascending and maximal."""
    import pyarrow.compute as pc

    told = info.filter(pc.is_valid(info.column("places"))) if info.num_rows else info
    if not told.num_rows:
        return {}
    places, runs = told.column("places").to_pylist(), told.column("runs").to_pylist()
    n_places, n_runs = np.array([len(x) // 8 for x in places]), np.array([len(x) // 24 for x in runs])
    place, part = np.frombuffer(b"".join(places), np.int64), np.frombuffer(b"".join(runs), np.int64).reshape(-1, 3)
    # every place of a row with every run of that row
    runs_each = np.repeat(n_runs, n_places)
    of = np.repeat(np.arange(len(place)), runs_each)
    first_run = np.repeat(np.cumsum(n_runs) - n_runs, n_places)
    which = first_run[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs_each) - runs_each, runs_each)
    number, begin = place[of] >> 32, (place[of] & 0xFFFFFFFF) + part[which, 0]
    gone = part[which, 2] < bucket.doc[number]
    number, begin, end = number[gone], begin[gone], (begin + part[which, 1] + window - 1)[gone]
    order = np.lexsort((begin, number))
    number, begin, end = number[order], begin[order], end[order]
    if not len(number):
        return {}
    # rows laid one after the other with room between, so one running maximum serves all
    room = int(end.max()) + 2
    lo, reach = number * room + begin, np.maximum.accumulate(number * room + end)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(lo)) - 1
    own = number[head]
    spans = np.stack([lo[head] - own * room, reach[last] - own * room], axis=1)
    cut = np.flatnonzero(np.diff(own, prepend=-1))
    return {int(own[a]): spans[a:b] for a, b in zip(cut.tolist(), np.append(cut[1:], len(own)).tolist())}


def _result(window: int, finish: Callable[[bytes, np.ndarray | None], tuple], schema):
    import pyarrow as pa

    def run(key, rows, info):
        bucket = Bucket(rows, info)
        spans = spans_of(bucket, info, window)
        out: list[tuple] = []
        for doc, sha, copy, text in zip(bucket.ids, bucket.shas, bucket.copy, bucket.texts):
            own = np.array([[0, -1]]) if copy else spans.get(bucket.number.get((doc, sha), -1))
            out.append(finish(text.as_py() or b"", own))
        return pa.table([rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), schema))], names=["doc_id", *(f.name for f in schema)]) if out else pa.table([rows.column("doc_id"), *(pa.array([], f.type) for f in schema)], names=["doc_id", *(f.name for f in schema)])

    return run


def dedup(docs: DataFrame, cut: Cut, judge: Judge, finish: Callable, schema, ddl: str, window: int, gram: int, gap: int, name: str, bytes_per_slice: int, bucket_bytes: int = BUCKET_BYTES, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and what ``finish`` makes of its text and removed runs of units (begin, end; one run to -1: a copy of a smaller document)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).withColumn("sha", F.unhex(F.sha2("t", 256)))
    slim = stored(keyed.select("doc_id", "sha", F.octet_length("t").cast("long").alias("n")), f"{name}-digests")
    total = int(slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    cores = spark.sparkContext.defaultParallelism
    buckets, slices = max(2 * cores, -(-total // bucket_bytes)), max(1, -(-total // bytes_per_slice))
    number = F.pmod(F.xxhash64("doc_id", "sha"), F.lit(buckets)).cast("int").alias("bucket")
    # a bucket is a partition, so no partition gets several by chance
    dealt = keyed.select("doc_id", "t", "sha", number).repartitionById(buckets, F.col("bucket"))

    # equal texts: every bucket learns the smallest doc_id of its texts that others share
    same = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1")
    copies = slim.join(same, "sha").where("doc_id > first").select(number, "sha", "first").distinct()
    columns = {"sha": "binary", "first": "long", "slice": "int", "cells": "binary", "hot": "binary", "places": "binary", "runs": "binary"}

    def told(*tables: DataFrame) -> DataFrame:
        out = None
        for x in tables:
            x = x.select("bucket", *(F.col(c) if c in x.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()))
            out = x if out is None else out.unionByName(x)
        return out.repartitionById(buckets, F.col("bucket"))

    def meet(info: DataFrame, run, result: str) -> DataFrame:
        return dealt.groupBy("bucket").cogroup(info.groupBy("bucket")).applyInArrow(run, result)

    copies = stored(copies, f"{name}-copies")
    sketches = meet(told(copies), _sketch(cut, window, gram, slices, width), "slice int, bucket int, cells binary, counts binary")
    estimates = sketches.repartition(max(2 * slices, 2), "slice").sortWithinPartitions("slice", "bucket").mapInArrow(_add_up(width, hot), "bucket int, slice int, cells binary, hot binary")
    found = meet(told(copies, estimates), _repeated(cut, window, gram, slices, width), "deal long, s binary, bucket int, doc long, most long, places binary")
    gone = found.repartition(max(4 * slices, 8), "deal").sortWithinPartitions("deal", "s", "doc", "bucket").mapInArrow(_judged(window, gap, judge), "bucket int, places binary, runs binary")
    return meet(told(copies, gone), _result(window, finish, schema), f"doc_id long, {ddl}")


def byte_pieces(data: np.ndarray, offsets: np.ndarray, window: int, values: np.ndarray) -> Iterator[Piece]:
    """Units are bytes; values: the hash of each byte value."""
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        for base in range(0, max(hi - lo, 1), CHUNK_BYTES) if b == a + 1 else (0,):
            raw = data[lo + base : min(hi, lo + base + CHUNK_BYTES + window - 1)] if b == a + 1 else data[lo:hi]
            first = np.array([0, len(raw)]) if b == a + 1 else offsets[a : b + 1] - lo
            yield Piece(values[raw], first, a, base, raw, np.arange(len(raw) + 1), 0)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
