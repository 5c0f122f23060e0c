"""SimHash near-duplicates found with BK-trees.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes of a text's shingles. Distinct
fingerprints are linked at ``radius`` bits or fewer; components of the links are the classes.

Search. A BK-tree over all fingerprints can't be broadcast (its size follows the data) and a query
that follows only edges within the radius still visits most of it, as random fingerprints lie at much
the same distance. So the trees are sharded by content: with four blocks of 16 bits, fingerprints
within three bits agree on a whole block; within that block's rest, on one of four sub-blocks. Each
fingerprint goes to the 16 shard trees of its (block, sub-block) values, which replaces the broadcast;
a shard larger than ``SHARD`` is divided by sub-blocks of its remaining bits, up to three more times,
after which it can hold 2**15 fingerprints at most. Each shard tree is built in a task, its children
keyed by the distance to the parent; a query follows only edges within the radius. A shard emits a
spanning forest of its links, so copies are never expanded into pairs. Components come from
alternating star contraction on tables in the shared folder.

Edge cases: null text has no words (fingerprint zero); null doc_ids take part and are never a
component_id unless all of a class are null; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import U64, mix, stored, table, text_or_empty, unwrapped, wrapped

RADIUS, SHINGLE, SEED, SHARD = 3, 3, 42, 2048
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_PLACE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of the lower-cased words; fewer words: the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    ends = (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; repeats count."""
    n = len(hashes)
    if not n:
        return 0
    places = hashes.view(np.uint8).reshape(n, 8) + _BYTE_PLACE
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, *keep: Column | str, width: int = SHINGLE, text: str = "text") -> DataFrame:
    """keep columns and fp (the fingerprint as a signed long)."""
    import pyarrow as pa

    rows = docs.select(*keep, text_or_empty(text).alias("_text"))
    schema = rows.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            fps = [fingerprint(t.as_buffer().to_pybytes() if hasattr(t, "as_buffer") else t, width) for t in batch.column(at).cast(pa.binary())]
            signed = np.array(fps, np.uint64).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(signed, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    __slots__ = ("root", "kids")

    def __init__(self) -> None:
        self.root: int | None = None
        self.kids: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = x
            self.kids[x] = {}
            return
        at = self.root
        while (d := (at ^ x).bit_count()) and (below := self.kids[at].get(d)) is not None:
            at = below
        if d:
            self.kids[at][d] = x
            self.kids[x] = {}

    def near(self, x: int, radius: int) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                out.append(at)
            kids = self.kids[at]
            if len(kids) > 2 * radius + 1:
                todo += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
            else:
                todo += [v for k, v in kids.items() if d - radius <= k <= d + radius]
        return out


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius among distinct fingerprints."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in fps:
        parent[x] = x
        for y in tree.near(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                out.append((x, y))
        tree.add(x)
    return out


#: Bits left after each level are cut into four; a key names the blocks taken and holds their bits.
def _split(bits: tuple[int, ...]) -> list[tuple[int, ...]]:
    n, out, at = len(bits), [], 0
    for i in range(4):
        size = n // 4 + (i < n % 4)
        out.append(bits[at : at + size])
        at += size
    return out


def _paths(levels: int) -> list[tuple[int, ...]]:
    """For each path of block choices, the bits that a shard key holds."""
    paths = [((), tuple(range(64)))]
    for _ in range(levels):
        paths = [(held + part, tuple(b for b in rest if b not in part)) for held, rest in paths for part in _split(rest)]
    return [held for held, _ in paths]


def shard_keys(levels: int):
    """uint64 fingerprints -> an array of keys per fingerprint: one for each path of block choices (unique across paths)."""
    masks = [sum(1 << b for b in held) for held in _paths(levels)]

    def keys(fps: np.ndarray) -> np.ndarray:
        # mix is a bijection on 64 bits, so distinct values under one mask stay distinct; the path number is kept beside it.
        return np.stack([mix(fps & U64(m)) for m in masks], axis=1)

    return keys, len(masks)


def _keyed(fps: DataFrame, levels: int) -> DataFrame:
    """(view, path, key, fp) rows of each fingerprint at a depth of block choices."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        keys, n = shard_keys(levels)
        for batch in batches:
            all_view, all_fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for at in range(0, len(all_fp), max(1, 65536 // n)):
                view, fp = all_view[at : at + max(1, 65536 // n)], all_fp[at : at + max(1, 65536 // n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(view, n), pa.int32()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(fp))), pa.array(keys(fp.view(np.uint64)).ravel().view(np.int64)), pa.array(np.repeat(fp, n))],
                    names=["view", "path", "key", "fp"],
                )

    return fps.select("view", "fp").mapInArrow(run, "view int, path int, key long, fp long")


SHARD_KEY = ["view", "path", "key"]


def _shard_forests(shards: DataFrame, radius: int) -> DataFrame:
    """A forest of each shard: (view, a, b). Rows of a shard follow one another in a sorted partition."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held: tuple | None = None
        group: list[int] = []
        out: list[tuple[int, int, int]] = []

        def done():
            if len(group) > 1:
                out.extend((held[0], x, y) for x, y in forest(group, radius))

        for batch in batches:
            for *own, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).to_numpy().view(np.uint64).tolist()):
                if own != held:
                    done()
                    held, group = own, []
                group.append(fp)
            if len(out) > 50000:
                yield _pairs(out)
                out = []
        done()
        yield _pairs(out)

    def _pairs(links: list[tuple[int, int, int]]):
        both = np.array([x[1:] for x in links], np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int32()), pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], names=["view", "a", "b"])

    return shards.repartition(*SHARD_KEY).sortWithinPartitions(*SHARD_KEY, "fp").mapInArrow(run, "view int, a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (view, a < b) among the distinct fingerprints (view, fp) of each view; their components equal those of all links within the radius."""
    if radius > 3:
        raise ValueError("four blocks find at most three differing bits")
    found = None
    level = 2
    while True:
        keyed = _keyed(fps, level)
        sizes = stored(keyed.groupBy(*SHARD_KEY).agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
        last = level >= 5
        light = sizes if last else sizes.where(F.col("n") <= shard)
        part = _shard_forests(keyed.join(light.select(*SHARD_KEY), SHARD_KEY), radius)
        found = part if found is None else found.unionByName(part)
        if last or not sizes.where(F.col("n") > shard).limit(1).count():
            return found.distinct()
        # both ends of a link that a large shard hides lie in that shard, so only its members go on
        heavy = sizes.where(F.col("n") > shard).select(*SHARD_KEY)
        fps = stored(keyed.join(heavy, SHARD_KEY).select("view", "fp").distinct(), "heavy-fps")
        level += 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): alternating large-star and small-star until nothing changes, after at most some log² rounds."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "star-min")
        small = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = stored(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    # every node but the roots is now one step from its root
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def classes(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """prints: doc_id, fp. Returns fp and component_id, the smallest doc_id of its class."""
    own = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    found = components(links(own.select(F.lit(0).alias("view"), "fp"), radius, shard))
    rooted = own.join(found, own.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted-fps")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "class-ids")
    return stored(rooted.join(least, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs."""
    prints = stored(with_fingerprint(docs, "doc_id", width=width), "fingerprints")
    return prints.join(classes(prints, radius, shard), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Views of a text for similarity search: each is a key of ``DEPTH`` min-wise samples of its five-word shingles, so texts of
#: similarity s share one with probability s**5, however they differ; twenty views find 99.96 % of pairs of exactly 0.8, more above.
VIEWS, DEPTH, WIDTH, SIMILARITY, SKETCH = 20, 5, 5, 0.8, 256
#: Shingles that a task holds of one part of a group.
BLOCK = 1 << 19
_SAMPLES = np.random.Generator(np.random.PCG64(0x5EED)).integers(0, 1 << 64, size=(2, 64 * DEPTH), dtype=np.uint64) | U64(1)


def view_keys(hashes: np.ndarray, views: int = VIEWS) -> np.ndarray:
    """uint64 key of each view of a set of shingle hashes; equal for all empty sets."""
    n = views * DEPTH
    least = np.full(n, (1 << 64) - 1, np.uint64)
    times, plus = _SAMPLES[0, :n, None], _SAMPLES[1, :n, None]
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048] * times + plus).min(axis=1))
    keys = np.zeros(views, np.uint64)
    for column in least.reshape(views, DEPTH).T:
        keys = mix(keys ^ column)
    return keys


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def shingle_sketch(text: bytes, width: int = WIDTH, size: int = SKETCH) -> np.ndarray:
    """The least ``size`` of the distinct 32-bit shingle hashes, sorted; all of them where there are fewer."""
    return np.unique((shingle_hashes(text, width) >> U64(32)).astype(np.uint32))[:size]


def similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two shingle sets from their sketches: exact up to ``size`` shingles in all, else an estimate (deviation 0.025)."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())


def similar_forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of sets whose Jaccard similarity is ``least`` or more; its edges are such pairs.

    Breadth first: each set reached is held against all that aren't reached yet and of fitting size, by whole counts.
    """
    p, q = Fraction(str(least)).as_integer_ratio()
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist())]
    left, flat, mark = np.arange(len(sets)), ids, np.zeros(len(values), bool)
    out, todo = [], []

    def drop(gone: np.ndarray) -> None:
        nonlocal left, flat
        flat = flat[np.repeat(~gone, sizes[left])]
        left = left[~gone]

    while len(left):
        if not todo:
            todo.append(int(left[0]))
            drop(np.arange(len(left)) == 0)
            continue
        x = todo.pop()
        size = sizes[left]
        lo, hi = np.searchsorted(size * q, p * sizes[x]), np.searchsorted(size * p, q * sizes[x], side="right")
        if lo >= hi:
            continue
        begin, end = int(size[:lo].sum()), int(size[:hi].sum())
        mark[own[x]] = True
        sums = np.concatenate([[0], np.cumsum(mark[flat[begin:end]])])
        mark[own[x]] = False
        last = np.cumsum(size[lo:hi])
        shared = sums[last] - sums[last - size[lo:hi]]
        gone = np.zeros(len(left), bool)
        gone[lo:hi] = shared * q >= p * (size[lo:hi] + sizes[x] - shared)
        if gone.any():
            found = left[gone].tolist()
            out += [(int(order[x]), int(order[y])) for y in found]
            todo += found
            drop(gone)
    return out


def _view_rows(texts: DataFrame, views: int) -> DataFrame:
    """texts: tk, t. (tk, size, keys, fp): the number of distinct shingles, a key for each view, the SimHash fingerprint."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            sizes, keys, fps = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", WIDTH)
                own = np.unique(hashes)
                sizes.append(len(own))
                keys.append(view_keys(own, views).view(np.int64))
                fps.append(fingerprint_of(hashes))
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signed)], names=["tk", "size", "keys", "fp"])

    return texts.select("tk", "t").mapInArrow(run, "tk binary, size long, keys array<long>, fp long")


def _set_rows(texts: DataFrame) -> DataFrame:
    """texts: tk, t. (tk, hashes): the bytes of the distinct shingle hashes."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py() or b"").tobytes() for t in part.column(1).cast(pa.binary())], pa.binary())], names=["tk", "hashes"])

    return texts.select("tk", "t").mapInArrow(run, "tk binary, hashes binary")


GROUP_KEY = ["view", "key", "i", "j"]


def _group_forests(rows: DataFrame, least: float) -> DataFrame:
    """rows: GROUP_KEY, tk, hashes. Verified links (a, b) that join what is similar within each group."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held: tuple | None = None
        keys: list[bytes] = []
        sets: list[np.ndarray] = []

        def done():
            found = similar_forest(sets, least) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in found], pa.binary()), pa.array([keys[y] for _, y in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for *own, tk, hashes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if own != held:
                    if len(sets) > 1:
                        yield done()
                    held, keys, sets = own, [], []
                keys.append(tk)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield done()

    return rows.repartition(*GROUP_KEY).sortWithinPartitions(*GROUP_KEY).mapInArrow(run, "a binary, b binary")


def similar_texts(texts: DataFrame, views: int = VIEWS, least: float = SIMILARITY, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between texts (tk, t) that are ``least`` similar in five-word shingles; ``many`` marks keys that may repeat.

    Candidates come from two searches. SimHash: texts whose fingerprints the BK-trees link within the
    radius, with all that follows from the links, are a group. Three bits of one fingerprint miss most
    pairs of 0.8, so min-wise views search besides: texts with one key of a view are a group, too. Every pair of a group is looked at on the whole shingle sets
    unless links join it already, so the components are those of all similar pairs of the group. Views
    with the same members are looked at once; a group of over ``block`` shingles is dealt out by pairs of
    its parts. Shingle sets are made only for texts that share a key.
    """
    rows = stored(_view_rows(texts, views).dropDuplicates(["tk"]), "view-rows")
    flat = rows.select("tk", "size", F.posexplode("keys").alias("view", "key"))
    roots = components(links(rows.select(F.lit(0).alias("view"), "fp").distinct(), radius))
    near = rows.join(roots, rows.fp == roots.node, "left").select("tk", "size", F.lit(-1).alias("view"), F.coalesce("root", "fp").alias("key"))
    flat = flat.unionByName(stored(near, "simhash-groups"))
    same = [F.count("*").alias("n"), F.sum(F.col("size") + 1).alias("total"), F.expr("bit_xor(xxhash64(tk))").alias("x"), F.expr("bit_xor(xxhash64(tk, 1))").alias("y")]
    groups = flat.groupBy("view", "key").agg(*same).where("n > 1")
    groups = groups.groupBy("n", "total", "x", "y").agg(F.min(F.struct("view", "key")).alias("g")).select("g.view", "g.key", F.ceil(F.col("total") / block).cast("int").alias("parts"))
    members = stored(flat.join(stored(groups, "view-groups"), ["view", "key"]).select("view", "key", "parts", "tk"), "view-members")
    part = F.expr("cast(pmod(xxhash64(tk, 2), parts) as int)")
    other = F.explode(F.expr("case when parts > 1 then filter(sequence(0, parts - 1), o -> o <> p) else array(0) end"))
    members = members.withColumn("p", part).select("view", "key", "p", "tk", other.alias("o")).select("view", "key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "tk")
    wanted = texts.join(stored(members.select("tk").distinct(), "view-texts"), "tk")
    single = wanted.where("not many").unionByName(wanted.where("many").dropDuplicates(["tk"]))
    sets = stored(_set_rows(single), "shingle-sets")
    return _group_forests(members.join(sets, "tk").select(*GROUP_KEY, "tk", "hashes"), least).distinct()


def one_of_each(docs: DataFrame, views: int = VIEWS, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of equal or similar texts: the smallest doc_id (null last), then the least text key.

    Null texts are empty ones and a class of their own; repeated rows leave one; a null doc_id stays only
    where its class has no other; an empty table gives an empty result; columns of any name pass through.
    Texts travel once, to meet the list of rows that stay.
    """
    key = F.unhex(F.md5(text_or_empty().cast("binary"))).alias("tk")
    rows = stored(docs.select(F.col("doc_id"), key), "text-keys")
    own = rows.groupBy("tk").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    texts = docs.select(key, text_or_empty().alias("t"), F.col("doc_id").alias("own"))
    # of equal texts only the first goes on
    firsts = stored(own, "text-firsts")
    unique = texts.join(firsts.where("n > 1").select("tk", "first", "n"), "tk", "left").where(F.col("n").isNull() | F.col("own").eqNullSafe(F.col("first"))).select("tk", F.col("n").isNotNull().alias("many"), "t")
    found = stored(similar_texts(unique, views, least), "similar-texts")
    roots = components(found)
    place = F.struct(F.col("first").isNull().alias("a"), F.col("first").alias("doc_id"), F.col("tk").alias("tk"))
    tops = firsts.join(roots, firsts.tk == roots.node, "left").groupBy(F.coalesce("root", "tk").alias("root")).agg(F.min(place).alias("p"))
    stay = tops.select(F.col("p.doc_id").alias("first"), F.col("p.tk").alias("tk"))
    counts = rows.groupBy("doc_id", "tk").agg(F.count("*").alias("n"))
    on = F.col("f.first").eqNullSafe(F.col("c.doc_id")) & (F.col("f.tk") == F.col("c.tk"))
    stay = stored(stay.alias("f").join(counts.alias("c"), on).select("c.doc_id", "c.tk", "c.n"), "stay")
    on = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.tk") == F.col("s.tk"))
    kept = wrapped(docs, F.col("doc_id"), key).alias("d").join(stay.alias("s"), on).select("d.row", "d.doc_id", "d.tk", "s.n")
    single, repeated = kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["doc_id", "tk"])
    return unwrapped(single.unionByName(repeated), docs.columns)
