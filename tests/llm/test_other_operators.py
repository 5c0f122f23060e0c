"""Near-duplicates, decontamination, filters, mixing, quality, sharding, media."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lawloom.llm import decontamination, media, mixing, quality, sharding, simhash, url_filter


def plain_fingerprint(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(items, radius=3):
    fps = sorted({f for _, f in items})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for d, f in items:
        r = root(f)
        if d is not None and (r not in least or d < least[r]):
            least[r] = d
    return {(d, f): least.get(root(f)) for d, f in items}


def test_simhash_equals_brute_force(docs, rows):
    items = [(r[0], plain_fingerprint(r[1])) for r in rows]
    want = plain_components(items)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"], int(r["fingerprint"], 16)]


def test_simhash_divides_large_shards(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 1, 2, 2, 3, 4, 9, 30) for _ in range(30)}
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    want = plain_components(list(enumerate(sorted(fps))))
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.classes(prints, shard=8).collect()}
    assert all(got[f] == c for (_, f), c in want.items())


def test_bk_tree_finds_all_near():
    rng = np.random.default_rng(4)
    xs = [int(x) for x in rng.integers(0, 1 << 12, 300)]
    tree = simhash.BKTree()
    for x in xs:
        tree.add(x)
    for q in xs[:40]:
        assert sorted(tree.near(q, 2)) == sorted({x for x in xs if (x ^ q).bit_count() <= 2})


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_one_of_each_keeps_one_row_of_similar_texts(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sets = [shingles(t) for _, t in got]
    alike = [(a, b) for i, a in enumerate(sets) for b in sets[:i] if a and len(a & b) >= 0.8 * len(a | b)]
    assert not alike
    assert len({t or "" for _, t in got}) == len(got)
    every = [(r[0], r[1], shingles(r[1])) for r in rows]
    for d, t, s in every:  # a text without a similar one stays
        if s and sum(1 for _, u, v in every if u == t or v and len(s & v) >= 0.7 * len(s | v)) == 1:
            assert (d, t) in got
    ids = [d for d, _ in got]
    assert 0 in ids and not {80, 81, 85} & set(ids) and len({*range(60, 75)} & set(ids)) == 1 and ids.count(94) == 1


def test_sketches_give_exact_similarity_of_short_texts(rows):
    texts = [r[1] for r in rows if r[1]][:40]
    for a in texts[:12]:
        for b in texts:
            x, y = shingles(a), shingles(b)
            if len(x | y) <= 256:
                assert math.isclose(simhash.similarity(simhash.shingle_sketch(a.encode()), simhash.shingle_sketch(b.encode())), len(x & y) / len(x | y))


def test_empty_near_duplicates(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    low = "".join(c for c in low if not (33 <= ord(c) < 127 and not c.isalnum()))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def overlaps(doc, item, span):
    n = min(span, len(item))
    for i in range(len(doc) - n + 1):
        for j in range(len(item) - n + 1):
            if sum(a == b for a, b in zip(doc[i : i + n], item[j : j + n])) >= n - n // 5:
                return True
    return False


def test_decontamination_equals_brute_force(spark, docs, rows):
    texts = [r[1] or "" for r in rows]
    w, far = texts[4].split(), next(r[1] for r in rows if r[0] == 93)
    items = [
        (0, " ".join(w[3:30])), (1, " ".join(x if i % 6 else "Other!" for i, x in enumerate(w[5:40]))), (2, "nothing of this occurs anywhere at all in any of these documents here"),
        (3, " ".join(far.split()[8000:8007]).upper() + "!"), (4, "w1 w2"), (5, None), (6, " ".join(w[3:30])), (7, " ".join(far.split()[20:60])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("tokens", F.lit(1))
    own = {i: plain_tokens(t) for i, t in items}
    want = {(r[0], i) for r in rows for i, t in own.items() if len(t) >= 5 and overlaps(plain_tokens(r[1]), t, 13)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_overlaps(docs, bench).collect()}
    assert got == want and {i for _, i in want} >= {0, 3, 6, 7}
    assert 3 in {i for _, i in want}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    bad = {d for d, _ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in bad)


def test_every_mask_pair_meets_all_substitutions():
    from itertools import combinations

    for span in range(5, 16):
        k = decontamination.substitutions(span)
        cuts = decontamination.blocks(span)
        for wrong in combinations(range(span), k):
            whole = {i for i, (a, n) in enumerate(cuts) if not any(a <= p < a + n for p in wrong)}
            assert any(set(m) <= whole for m in decontamination.masks(span))


CLASHES = ["_n", "_tk", "_e", "_text_hash", "_text", "row", "tk", "n", "epochs", "text_hash", "size", "view", "key", "fp", "_d", "_id", "_t", "_h", "node", "root", "tokens", "seq", "a.b"]


def test_stages_keep_columns_of_any_name(spark, docs, rows):
    own = docs.drop("d64", "t", "bucket").select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
    item = spark.createDataFrame([(0, " ".join((rows[4][1] or "").split()[3:30]), 1)], "item_id long, text string, tokens int")
    labels = spark.createDataFrame([(i, int(i % 9 > 0), 0, "x") for i in range(60)], "doc_id long, quality int, toxic int, text string")
    stages = [simhash.one_of_each, lambda d: decontamination.drop_contaminated(d, item), mixing.mix_documents, lambda d: quality.reject_low_quality(d, labels)]
    for stage in stages:
        out = stage(own)
        assert out.columns == own.columns
        got = out.collect()
        assert got and all(r[c] == i for r in got for i, c in enumerate(CLASHES))
        known = Counter((r[0], r[1]) for r in rows)
        assert all((r["doc_id"], r["text"]) in known for r in got)
        empty = stage(own.where("false"))
        assert empty.columns == own.columns and empty.count() == 0
    assert sharding.shard_documents(own).count() == len(rows) and sharding.shard_documents(own.where("false")).count() == 0


def test_empty_decontamination(docs, none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_overlaps(docs, bench).count() == 0
    assert decontamination.find_overlaps(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


URLS = [
    "http://a.example.org/es/1", "https://example.org/en/123", "http://example.org", "http://EXAMPLE.org/en/2?x=1", "http://x.com/fr/#f", "http://com/de/", "http://xcom/de/", "ftp://my-org/", "http://org/de/", None,
    "no scheme", "", "http://x.net/casino/1", "http://x.net/casinos/1", "://org/", "http://h.org:80/es/", "http://example.org/es", "http://u@example.org/en/1", "http://a://org/x",
    "http://casino.x.net/", "http://my-poker.net/a", "http://pokers.net/a", "http://10.0.0.1:80/a", "http://10.0.0.1.net/a", "http://x.net/a/setup.exe", "http://x.net/setup.exe/a", "http://x.net/setup.exe?b", "http://x.net" + "/a" * 15, "http://x.net" + "/a" * 16,
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for text, verdict in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")):
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    bad = any(t in url_filter.WORDS for part in (host, path) for t in re.findall("[0-9A-Za-z]+", part)) or any(path.endswith(f".{e}") for e in url_filter.ENDINGS)
    bad = bad or re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}(:\d+)?", host) or path.count("/") >= 16
    return host, path, *(best or (None, "block" if bad else "allow"))


def test_url_filter_equals_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host long")
    got = sorted(tuple(r) for r in url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [g[1:] for g in got] == [plain_verdict(u) for u in URLS + URLS[:3]]
    assert url_filter.filter_urls(pages.where("false")).count() == 0
    plan = url_filter.filter_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan


def test_a_hundred_thousand_rules_give_the_same_verdicts(spark):
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, token long")
    many = url_filter.RULES + tuple(url_filter.host_path_rule(f"host{i}.net/p{i % 97}/", "block") for i in range(100_000))
    more = pages.unionByName(spark.createDataFrame([(900 + i, f"http://a.host{i * 9973}.net/p{(i * 9973 + i % 2) % 97}/x", 0) for i in range(10)], pages.schema))
    out = url_filter.filter_urls(more, many)
    got = {r["page_id"]: r for r in out.collect()}
    assert [tuple(got[i][k] for k in ("host", "path", "rule", "verdict")) for i in range(len(URLS) + 3)] == [plain_verdict(u) for u in URLS + URLS[:3]]
    for i in range(10):
        assert (got[900 + i]["rule"], got[900 + i]["verdict"]) == ((f"host{i * 9973}.net/p{i * 9973 % 97}/", "block") if i % 2 == 0 else (None, "allow"))
    assert max(r["n_candidates"] for r in got.values()) < 10 and "Python" not in out._jdf.queryExecution().toString()
    assert url_filter.filter_urls(pages.where("false"), many).count() == 0


def test_feistel_is_a_permutation_and_computable():
    for n in (1, 2, 3, 40, 999, 4097):
        p = sharding.permute(np.arange(n, dtype=np.uint64), n)
        assert sorted(p.tolist()) == list(range(n))
        assert sharding.place(n - 1, n) == (int(p[-1]) % 40, int(p[-1]) // 40)
    assert sharding.feistel(np.arange(64, dtype=np.uint64), 3, 5).max() < 64


def test_shards_are_level_and_slots_gapless(docs, rows, none):
    got = sharding.shard_rows(docs, shards=7, rows_per_bucket=9).collect()
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["shard"], r["slot"]) == sharding.place(r["row_number"], len(rows), 7)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = {(r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.shard_rows(docs.repartition(5), shards=7, rows_per_bucket=9).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"]) for r in got}
    assert sharding.shard_documents(none).count() == 0


def fill(budget, children):
    """children: name -> (weight, cap)."""
    order = sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    out, left = {}, budget
    for i, k in enumerate(order):
        w, cap = children[k]
        if cap * sum(children[x][0] for x in order[i:]) <= left * w:
            out[k] = cap
            left -= cap
        else:
            total = sum(children[x][0] for x in order[i:])
            return out | {x: left * children[x][0] // total for x in order[i:]}
    return out


def key(name):
    return "?" if name is None else "=" + name


def test_mixing_equals_plain_budgets(docs, rows, none):
    docs = docs.unionByName(docs.limit(1).selectExpr("900L as doc_id", "'one two three' as text", "'?' as lang", "'?' as source", "n_chars", "d64", "t", "bucket"))
    rows = [*rows, (900, "one two three", "?", "?", 0)]
    leaves, members = Counter(), defaultdict(list)
    for d, t, lang, src, _ in rows:
        digits = re.search(r"\d+", src or "")
        leaf = (f"d{int(digits[0]) % 4}" if digits else "other", key(lang), key(src))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        leaves[leaf] += n
        members[leaf].append((d, n))
    weight = lambda name, table: table.get(name.removeprefix("="), table["other"])
    total = sum(leaves.values())
    cap = lambda pre: sum(2 * n for k, n in leaves.items() if k[: len(pre)] == pre)
    dom = fill(total * 60 // 100, {k: (weight(k, mixing.DOMAIN_WEIGHTS), cap((k,))) for k in {x[0] for x in leaves}})
    budgets = {}
    for k, b in dom.items():
        lng = fill(b, {x: (weight(x, mixing.LANGUAGE_WEIGHTS), cap((k, x))) for x in {y[1] for y in leaves if y[0] == k}})
        for x, c in lng.items():
            for s, v in fill(c, {z: (1, cap((k, x, z))) for z in {y[2] for y in leaves if y[:2] == (k, x)}}).items():
                budgets[k, x, s] = v
    want = Counter()
    for leaf, b in budgets.items():
        if not leaves[leaf]:
            continue
        whole, rest = divmod(b, leaves[leaf])
        for e in range(whole):
            want.update((d, leaf, e) for d, _ in members[leaf])
        if rest:
            cum = 0
            for d, n in sorted(members[leaf], key=lambda m: (hashlib.md5(f"17:{whole}:{'' if m[0] is None else m[0]}".encode()).hexdigest(), m[0] is not None, m[0] or 0, m[1])):
                cum += n
                if cum <= rest:
                    want[d, leaf, whole] += 1
    got = Counter((r["doc_id"], (r["domain"], key(r["lang"]), key(r["source"])), r["epoch"]) for r in mixing.mix(docs, rows_per_bucket=4).collect())
    assert got == want
    assert Counter((r["doc_id"], (r["domain"], key(r["lang"]), key(r["source"])), r["epoch"]) for r in mixing.mix(docs).collect()) == want
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_quality_separates_held_out_rows(spark, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = [x["score"] for x in r if x["quality"] == 1], [x["score"] for x in r if x["quality"] == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    base = max(len(good), len(bad)) / len(r)
    right = sum(x["predicted"] == x["quality"] for x in r) / len(r)
    assert min(len(good), len(bad)) > 50 and auc > 0.95 and right > (1 + base) / 2
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 300 and all(abs(x.weight) > 0 for x in model.rules)
    assert quality.score(none, model, "doc_id").count() == 0
    # repeated rows, repeated labels' documents and further columns change nothing
    again = quality.train(docs.unionByName(docs).withColumn("_id", F.lit(1)).withColumn("_t", F.lit("x")).withColumn("quality", F.lit(0)), labels.withColumn("text", F.lit("y")))
    assert again == model


def test_quality_statistics_equal_plain_counts(docs):
    got = docs.select("text", *(c.alias(k) for k, c in quality.statistics(F.coalesce("text", F.lit(""))).items())).collect()
    for r in got:
        t = r["text"] or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
        many = lambda cs: sum(c in cs for c in t)
        of_words = lambda x: x / len(w) if w else 0.0
        function = sum(bool(re.match(rf"({'|'.join(quality.FUNCTION_WORDS.split())})([,.]|$)", x)) for x in w)
        want = [
            len(t), len(w), of_words(len(t)), sum(c.isupper() for c in t) / len(t) if t else 0.0, of_words(many("#$%&*|+=<>{}[]\\^~_@")), of_words(many("!?")), of_words(many(".,;:")),
            many("0123456789") / len(t) if t else 0.0, of_words(len(set(w))), len(t) / len(lines), len(set(lines)) / len(lines), of_words(function),
        ]
        assert np.allclose([r[k] for k in quality.NAMES], want), t[:60]


def test_quality_columns_equal_the_model(docs, rows):
    x = np.random.default_rng(0).random((300, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7)).astype(float)
    model = quality.fit_rules(x, y, quality.NAMES)
    assert ((model.predict(x, quality.NAMES) >= 0.5) == (y == 1)).mean() > 0.97
    stats = docs.select("doc_id", "text", *(c.alias(k) for k, c in quality.statistics(F.coalesce("text", F.lit(""))).items())).collect()
    want = sorted(model.predict(np.array([[r[n] for n in quality.NAMES] for r in stats]), quality.NAMES).tolist())
    got = sorted(r["score"] for r in quality.score(docs, model, "doc_id").collect())
    assert np.allclose(got, want) and len(got) == len(rows)


def test_quality_without_both_classes():
    assert quality.fit_rules(np.zeros((0, 12)), np.zeros(0), quality.NAMES).rules == ()
    p = quality.fit_rules(np.zeros((5, 12)), np.ones(5), quality.NAMES).predict(np.zeros((1, 12)), quality.NAMES)[0]
    assert math.isclose(p, 0.99)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_media_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 255, n).astype(np.uint8))
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(data) and set(payload[n:]) <= {255}
    assert media.decode(media.encode(payload)) == payload


def test_media_query(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "lang as digest", "n_chars as n", "lang as items", "lang as media", "lang as places")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op9_media_sequences(spark, str(tmp_path)).collect()
    want = Counter()
    for d, t, *_ in rows:
        t = t or ""
        p, png = media.padded(t.encode()), media.encode(media.padded(t.encode()))
        x = np.frombuffer(p, np.uint8).astype(float)
        hist = Counter(v // 16 for v in p)
        feature = f"576x{len(p) // 576};mean={sum(p) / len(p):.6f};sd={math.sqrt(((x - x.mean()) ** 2).mean()):.6f};hist={'.'.join(str(hist[i]) for i in range(16))}"
        lines = sum(bool(line.strip()) for line in t.split("\n"))
        want[d, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature, lines + 2, (lines // 2, lines + 1), (f"{len(t.encode())} bytes", f"after {lines} lines")] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items")
    assert Counter((*(r[k] for k in names), tuple(r["positions"]), tuple(r["captions"])) for r in got) == want
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op9_media_sequences(spark, f"{tmp_path}/none").count() == 0


def test_broken_pages_lose_nothing():
    seen = lambda page: [i["text"] or i["ref"] for i in media.parse_html(page)]
    assert seen("<html><head><title>t</title><meta x=y><body><p>a</p><img src=b>") == ["a", "b"]
    assert seen("<head><style>s</style><p>a") == ["a"]
    assert seen("<p>a<template><p>b<img src=c>") == ["a", "b", "c"] and seen("<p>a<template><p>b</template>c") == ["ac"]
    assert seen("<figure><img src=a><figcaption>never closed") == ["a"] and media.parse_html("<figure><img src=a><figcaption>never closed")[0]["caption"] == "never closed"
    long = "word " * 4_000_000  # 20 MB
    assert [i["kind"] for i in media.parse_html(media.page_of(long, "0" * 64, len(long)))] == ["media", "text", "media"]


def test_html_sequences_keep_order_and_captions(spark):
    page = "<html><head><title>t</title></head><body><p>One &amp; two<p>three <img src='sha256:" + "a" * 64 + "' alt=x><figure><img src=b><img src=c><figcaption>Both</figcaption></figure>tail<script>no()</script></body>"
    items = media.parse_html(page)
    assert [(i["kind"], i["text"] or i["ref"][:8], i["caption"]) for i in items] == [("text", "One & two", None), ("text", "three", None), ("media", "sha256:a", "x"), ("media", "b", "Both"), ("media", "c", "Both"), ("text", "tail", None)]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    refs = media.references(media.sequences(pages, "page_id"), "page_id")
    table = spark.createDataFrame([("a" * 64, b"payload")], "digest string, payload binary")
    out = {r["position"]: r["payload"] for r in media.resolve(refs, table).collect()}
    assert out == {2: bytearray(b"payload"), 3: None, 4: None}
