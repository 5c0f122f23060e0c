import random

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["über", "Élan", "niño"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empties, ties, one very long text."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    lines = "\n".join(prose(rng, 9) for _ in range(25))
    out = []
    for i in range(60):
        t = prose(rng, rng.choice([1, 3, 20, 80, 150]))
        if i % 4 == 0:
            cut = len(t) // 2
            t = f"{t[:cut]} {passage} {t[cut:]}"
        if i % 5 == 0:
            t = f"{t}\n{lines}\n{prose(rng, 5)}"
        out.append((i, t, rng.choice(["en", "de", None]), f"src{i % 7}" if i % 9 else None, len(t)))
    base = prose(rng, 200)
    for i in range(60, 75):
        w = base.split()
        w[rng.randrange(200)] = "changed"
        out.append((i, " ".join(w), "en", "src0", 1))
    out += [(80 + k, base, "en", "src0", 1) for k in range(6)]
    out += [(90, None, "en", "src1", 0), (91, "", None, None, 0), (92, "   \n\t ", "fr", "x", 3), (93, prose(rng, 9000), "en", "src2", 9), (None, base, "en", "src0", 1), (94, "same", "en", "src0", 4), (94, "same", "en", "src0", 4), (94, base + " tail", "en", "src0", 4)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "doc_id as d64", "text as t", "lang as bucket").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
