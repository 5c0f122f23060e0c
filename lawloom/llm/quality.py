"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of a text are native columns. On a bounded sample of labelled rows (``MAX_LABELLED``) the
driver grows shallow boosted trees over quantile cuts, takes every path from a root as a conjunctive
rule, fits logistic weights with an L1 penalty (FISTA) and keeps the rules whose weight isn't zero.
Scoring all documents is one projection: the statistics, then a weighted sum of rule conditions.

Inputs of a score are statistics of the text alone: never labels, lang, source or doc_id.

Edge cases: null and empty texts have zero statistics and get a score like any text; null or unknown
labels don't train; documents with several labels train with each; if the labels hold one class only
(or none), the score is that class's share (0.5 without labels); repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.common import WORD_RE, table, text_or_empty

#: Bound of the sample that reaches the driver: labelled rows, those with the smallest hashes of doc_id.
MAX_LABELLED = 20000
TREES, DEPTH, CUTS, RATE, PENALTY, THRESHOLD = 24, 3, 24, 0.3, 0.002, 0.3
#: Frequent function words of the four languages of the corpus; their share tells prose from lists.
FUNCTION_WORDS = "the of and to in is that for it de la le et les des que el los y en der die und das von zu"


def counts(text: Column) -> dict[str, Column]:
    """What is counted in a text, in double: each reads the text once."""
    stripped = lambda cs: F.length(text) - F.length(F.translate(text, cs, ""))
    tokens = F.regexp_extract_all(text, F.lit(f"({WORD_RE})"), 1)
    lines = F.split(text, "\n")
    word = rf"(?<![^\x20\x09-\x0D])(?:{'|'.join(FUNCTION_WORDS.split())})(?![^\x20\x09-\x0D,.])"
    out = {
        "chars": F.length(text), "words": F.regexp_count(text, F.lit(WORD_RE)), "upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), "symbols": stripped("#$%&*|+=<>{}[]\\^~_@"),
        "marks": stripped("!?"), "stops": stripped(".,;:"), "digits": stripped("0123456789"), "distinct": F.size(F.array_distinct(tokens)), "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)), "function": F.regexp_count(text, F.lit(word)),
    }
    return {k: c.cast("double") for k, c in out.items()}


def ratios(n) -> dict[str, Column]:
    """The statistics, from counts (n: name -> column)."""
    ratio = lambda a, b: F.when(n(b) > 0, n(a) / n(b)).otherwise(F.lit(0.0))
    return {
        "chars": n("chars"), "words": n("words"), "word_len": ratio("chars", "words"), "upper": ratio("upper", "chars"), "symbols": ratio("symbols", "words"), "marks": ratio("marks", "words"),
        "stops": ratio("stops", "words"), "digits": ratio("digits", "chars"), "distinct": ratio("distinct", "words"), "line_len": ratio("chars", "lines"), "line_distinct": ratio("distinct_lines", "lines"),
        "function": ratio("function", "words"),
    }


def statistics(text: Column) -> dict[str, Column]:
    """Name -> column of a text. Each is a count or a ratio in double."""
    return ratios(counts(text).__getitem__)


NAMES = ["chars", "words", "word_len", "upper", "symbols", "marks", "stops", "digits", "distinct", "line_len", "line_distinct", "function"]


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, above?, cut), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def column(self, stats: Column) -> Column:
        """Probability of label 1 over a struct of statistics."""
        total = F.lit(self.bias)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule.terms:
                holds = holds & ((stats[name] > cut) if above else (stats[name] <= cut))
            total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule in self.rules:
            total += rule.weight * _holds(x, names, rule.terms)
        return 1 / (1 + np.exp(-total))


def _tight(terms) -> tuple[tuple[str, bool, float], ...]:
    """The narrowest cut for each statistic and direction."""
    out: dict[tuple[str, bool], float] = {}
    for name, above, cut in terms:
        out[name, above] = (max if above else min)(cut, out.get((name, above), cut))
    return tuple(sorted((n, a, c) for (n, a), c in out.items()))


def _holds(x: np.ndarray, names: list[str], terms) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in terms:
        v = x[:, names.index(name)]
        out &= (v > cut) if above else (v <= cut)
    return out


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], names: list[str], depth: int, least: int):
    """Boosting step: greedy tree of Newton gains; returns its paths (leaves and inner nodes) and the fitted values."""
    paths, fitted = [], np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        if terms:
            paths.append(terms)
        best = (1e-6, None)
        if left:
            for j, own in enumerate(cuts):
                if not len(own):
                    continue
                bins = np.searchsorted(own, x[rows, j], side="left")
                gs = np.cumsum(np.bincount(bins, grad[rows], len(own) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins, hess[rows], len(own) + 1))[:-1]
                ns = np.cumsum(np.bincount(bins, minlength=len(own) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, float(own[k])))
        if best[1] is None:
            fitted[rows] = -g / (h + 1)
            return
        j, cut = best[1]
        below = x[rows, j] <= cut
        grow(rows[below], (*terms, (names[j], False, cut)), left - 1)
        grow(rows[~below], (*terms, (names[j], True, cut)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return paths, fitted


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Deterministic: no sampling, ties go to the first statistic and the lowest cut."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
        cuts.append(np.round(q, 6))
    # the two classes weigh alike, as junk is rare; the bias is put right afterwards
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    f, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        paths, step = _tree(x, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), cuts, names, depth, max(5, len(y) // 500))
        f += RATE * step
        for terms in paths:
            rules.setdefault(_tight(terms), None)
    terms = [t for t in rules if 0 < (m := _holds(x, names, t).mean()) < 1 and m >= 2 / len(y)]
    z = np.stack([_holds(x, names, t) for t in terms], axis=1).astype(float) if terms else np.zeros((len(y), 0))
    mean, scale = z.mean(axis=0), np.maximum(z.std(axis=0), 1e-9)
    z = (z - mean) / scale
    w, b, v, vb, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) * weight.max() + 1) if z.shape[1] else 1.0
    for _ in range(400):
        r = weight * (1 / (1 + np.exp(-(z @ v + vb))) - y) / len(y)
        nw = v - step * (z.T @ r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    out = tuple(Rule(terms[i], float(round(w[i] / scale[i], 9))) for i in kept)
    return RuleEnsemble(float(round(b - sum(w[i] / scale[i] * mean[i] for i in kept), 9)), out)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_y in (0, 1)").where(~is_held_out(F.col("_id")))
    own = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)  # a bounded sample: at most 16 bytes a row are broadcast
    stats = docs.select(F.col("doc_id").alias("_d"), text_or_empty().alias("_t")).join(F.broadcast(own), F.col("_d") == F.col("_id"))
    stats = stats.select("_id", "_y", F.xxhash64("_t").alias("_h"), *(c.alias(k) for k, c in statistics(F.col("_t")).items()))
    rows = stats.groupBy("_id", "_y").agg(F.min(F.struct("_h", *NAMES)).alias("m")).select("_id", "_y", *(F.col(f"m.{k}") for k in NAMES)).collect()  # one row for each label, whatever repeats
    rows.sort(key=lambda r: tuple(r))
    return np.array([r[2:] for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r[1] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> RuleEnsemble:
    x, y = training_sample(docs, labels, most)
    return fit_rules(x, y, NAMES)


def score_column(model: RuleEnsemble, text: Column) -> Column:
    """Counts, then statistics, are bound once by lambdas, so no ratio or rule computes them again wherever the optimizer moves the column."""
    own = F.array(F.struct(*(c.alias(k) for k, c in counts(text).items())))
    stats = F.transform(own, lambda n: F.struct(*(c.alias(k) for k, c in ratios(lambda name: n[name]).items())))
    return F.element_at(F.transform(stats, model.column), 1)


def score(docs: DataFrame, model: RuleEnsemble, *keep: str | Column) -> DataFrame:
    """keep columns and ``score``."""
    return docs.select(*keep, score_column(model, text_or_empty()).alias("score"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "doc_id").select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is at least THRESHOLD, with the columns of docs."""
    return docs.where(score_column(train(docs, labels), text_or_empty()) >= THRESHOLD)
