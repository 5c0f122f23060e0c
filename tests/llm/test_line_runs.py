"""Line dedup against brute-force repeated line runs."""

import random

from lawloom.llm import line_chunks


def test_every_repeated_run_of_lines_goes(spark):
    rng = random.Random(21)
    passages = [[f"passage {k} line {i}" for i in range(n)] for k, n in enumerate((2, 2, 3, 4, 7))] + [["over"] * 3, ["above", "", "below"]]
    docs = []
    for d in range(60):
        lines = []
        for n in range(3):
            lines += [f"own {d} {n} {rng.random()}"] + rng.choice(passages)
        docs.append([*lines, f"end {d}"])
    seen, want, n = set(), {}, 0
    for d, lines in enumerate(docs):
        gone, full, earlier = set(), [i for i, x in enumerate(lines) if x], set(seen)
        for i, j in zip(full, full[1:]):  # a run of two or more is a chain of pairs
            if tuple(lines[i : j + 1]) in earlier:
                gone |= set(range(i, j + 1))
            seen.add(tuple(lines[i : j + 1]))
        want[d], n = gone, n + len(gone)
    got = {r["doc_id"]: r for r in line_chunks.dedup_lines(spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")).collect()}
    for d, lines in enumerate(docs):
        own = [i for s in got[d]["removed"] or [] for i in range(s["start"], s["start"] + s["n"])]
        assert len(own) == len(set(own)) and want[d] <= set(own)
        again = set(own) - want[d]  # what else goes stands earlier in the same document
        assert all(lines.index(lines[i]) < i for i in again)
    assert n > 300


def test_equal_lines_do_not_overlap():
    a = [b"a"]
    assert line_chunks.chunk_spans(a * 2) == [(0, 2)]
    assert line_chunks.chunk_spans(a * 4) == [(0, 2), (2, 4)]
    assert line_chunks.chunk_spans(a * 3) == [(0, 2), (0, 3)]
    assert line_chunks.chunk_spans(a * 5) == [(0, 2), (2, 4), (2, 5)]
    assert line_chunks.chunk_spans([b"a", b"", b"b", b"b", b"c"]) == [(0, 3), (2, 4), (3, 5)]
