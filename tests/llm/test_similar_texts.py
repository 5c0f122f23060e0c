"""Near-duplicate search of the pipeline: long edits, hubs, similarities about the limit."""

import random

import numpy as np

from lawloom.llm import simhash


def words(rng, n):
    return [f"{rng.randrange(10**6):x}" for _ in range(n)]


def whole(text):
    return {tuple(text[i : i + 5]) for i in range(len(text) - 4)}


def exact(a, b):
    a, b = whole(a), whole(b)
    return len(a & b) / len(a | b)


def keys(text):
    return simhash.view_keys(np.unique(simhash.shingle_hashes(" ".join(text).encode(), simhash.WIDTH)))


def test_appended_and_cut_passages_share_a_view():
    rng = random.Random(11)
    met = {}
    for n in (100, 300, 1000):
        for _ in range(60):
            text = words(rng, n)
            more = text + words(rng, int((n - 4) * 0.25))
            at = rng.randrange(n // 2)
            cut = text[:at] + text[at + int((n - 4) * 0.2) - 8 :]
            for kind, other in (("appended", more), ("cut", cut)):
                if 0.8 <= exact(text, other) < 0.85:
                    met.setdefault(kind, []).append(bool((keys(text) == keys(other)).any()))
    for kind in ("appended", "cut"):
        assert len(met[kind]) >= 60 and np.mean(met[kind]) >= 0.99


def kept(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in simhash.one_of_each(docs).collect()}


def test_copies_with_a_long_footer_go(spark):
    rng = random.Random(12)
    texts = [words(rng, 300) for _ in range(60)]
    assert kept(spark, texts + [t + words(rng, 30) for t in texts]) == set(range(60))


def components(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == r) for r in root}


def edited_copies(rng, n, copies, edits):
    text = words(rng, n)
    out = [text]
    for _ in range(copies):
        own = list(text)
        for i in rng.sample(range(n // 6), edits):
            own[i * 6] = f"{rng.randrange(10**6):x}"
        out.append(own)
    return out


def test_forest_joins_all_similar_pairs():
    rng = random.Random(13)
    texts = [t for k in range(8) for t in edited_copies(rng, 300, 12, 1 + k)] + [[], [], ["one"]]
    rng.shuffle(texts)
    sets = [simhash.shingle_set(" ".join(t).encode()) for t in texts]
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    found = simhash.similar_forest(sets)
    assert all((max(e), min(e)) in alike for e in found)
    assert components(len(sets), found) == components(len(sets), alike)
    assert len(alike) > len(found) > 60


def test_copies_like_their_original_but_not_one_another_go(spark):
    rng = random.Random(14)
    groups = [edited_copies(rng, 300, 30, 6) for _ in range(8)]
    for original, *copies in groups:
        assert all(exact(original, c) >= 0.8 for c in copies) and sum(exact(a, b) < 0.8 for a, b in zip(copies, copies[1:])) > 20
    assert len(kept(spark, [t for g in groups for t in g[1:] + g[:1]])) == len(groups)


def test_parts_of_a_large_group_are_settled_together(spark):
    rng = random.Random(15)
    texts = [" ".join(t) for t in edited_copies(rng, 300, 40, 6)]
    rows = spark.createDataFrame([(t.encode(), t, False) for t in texts], "tk binary, t string, many boolean")
    found = simhash.similar_texts(rows, block=1500).collect()
    at = {t.encode(): i for i, t in enumerate(texts)}
    assert len(components(len(texts), [(at[bytes(r["a"])], at[bytes(r["b"])]) for r in found])) == 1


def test_long_texts_about_the_limit_are_settled_exactly():
    rng = random.Random(16)
    for n in (1000, 3000):
        for more, joined in ((0.245, True), (0.25, True), (0.256, False), (0.27, False)):
            for _ in range(8):
                text = words(rng, n)
                other = text + words(rng, int((n - 4) * more))
                assert (exact(text, other) >= 0.8) == joined
                sets = [simhash.shingle_set(" ".join(t).encode()) for t in (text, other)]
                assert bool(simhash.similar_forest(sets)) == joined
