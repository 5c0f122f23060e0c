"""Search over candidate models: proposals, canonical identity, engines with isolated failures, budgets."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCH_CLASSES = ("exact_finite_enumeration", "bounded_heuristic", "equality_saturation_heuristic", "stochastic_heuristic")


@dataclass(frozen=True)
class Candidate:
    """A model to fit: its family, form, terms and fixed parameters. Evidence isn't part of its identity."""

    candidate_id: str
    family: str
    form: str
    terms: tuple[str, ...] = ()
    fixed: tuple[tuple[str, float], ...] = ()

    def canonical(self) -> str:
        body = asdict(self)
        del body["candidate_id"]
        body["terms"], body["fixed"] = sorted(self.terms), sorted(self.fixed)
        return json.dumps(body, sort_keys=True, separators=(",", ":"))

    def identity(self) -> str:
        return "sha256:" + hashlib.sha256(self.canonical().encode()).hexdigest()


@dataclass(frozen=True)
class SearchPlan:
    """What a search may do, frozen before it starts."""

    search_class: str = "bounded_heuristic"
    limit: int = 64
    frontier_width: int = 16
    shortlist_limit: int = 4
    seed: str = "0"
    batch: int = 8
    axes: tuple[tuple[str, str], ...] = (("total_bits", "min"), ("gain_bits", "max"), ("structure_bits", "min"))

    def __post_init__(self) -> None:
        if self.search_class not in SEARCH_CLASSES or min(self.limit, self.frontier_width, self.shortlist_limit, self.batch) < 1:
            raise ValueError("invalid search plan")


def analytic_proposals(features: list[str], season: int | None = None) -> list[Candidate]:
    """Intercept, first lag, two lags, seasonal lag with trend: those whose features exist."""
    out = [Candidate("analytic_intercept", "analytic", "constant")]
    for name, terms in (("lag1", ("lag_1",)), ("lag1_lag2", ("lag_1", "lag_2")), (f"season{season}", (f"lag_{season}", "trend"))):
        if all(t in features or t == "trend" for t in terms):
            out.append(Candidate(f"analytic_{name}", "analytic", "affine", terms))
    return out


def recursive_proposals(alphas: Iterable[float]) -> list[Candidate]:
    return [Candidate("recursive_running_mean", "recursive", "running_mean")] + [Candidate(f"recursive_level_{a:g}", "recursive", "level", (), (("alpha", a),)) for a in alphas]


def spectral_proposals(season: int) -> list[Candidate]:
    return [Candidate(f"spectral_{'_'.join(map(str, h))}", "spectral", "harmonics", tuple(f"h{x}" for x in h), (("season", float(season)),)) for h in ((1,), (2,), (1, 2))]


def algorithmic_proposals(texts: Iterable[str]) -> list[Candidate]:
    return [Candidate(f"program_{i}", "algorithmic", t) for i, t in enumerate(texts)]


def candidate_rows(spark, candidates: list[Candidate]) -> DataFrame:
    """Candidates as rows, each identity once: the axis along which fits run in parallel."""
    own = {c.identity(): c for c in sorted(candidates, key=lambda c: c.candidate_id, reverse=True)}
    rows = [(c.candidate_id, c.family, c.form, list(c.terms), dict(c.fixed), k, len(c.canonical())) for k, c in sorted(own.items())]
    return spark.createDataFrame(rows, "candidate_id string, family string, form string, terms array<string>, fixed map<string,double>, candidate_hash string, byte_length int")


@dataclass
class EngineRun:
    engine_id: str
    status: str
    candidates: list[Candidate] = field(default_factory=list)
    reason: str | None = None
    seconds: float = 0.0


def run_engines(engines: dict[str, Callable[[], list[Candidate]]], unavailable: Iterable[str] = ()) -> tuple[list[Candidate], list[EngineRun]]:
    """Run each engine; a failure is recorded and the others go on. Candidates are unique by identity, first engine first."""
    runs, found = [], {}
    for name, engine in engines.items():
        start = time.monotonic()
        try:
            own = engine()
            runs.append(EngineRun(name, "completed", own, None, time.monotonic() - start))
        except Exception as e:  # an engine is a plug-in: its failure is a result
            runs.append(EngineRun(name, "failed", [], f"{type(e).__name__}: {e}", time.monotonic() - start))
            continue
        for c in own:
            found.setdefault(c.identity(), c)
    runs += [EngineRun(name, "abstained", [], "engine_not_installed") for name in unavailable]
    return list(found.values()), runs


def neighbours(tree: tuple, assume: set[str] | None = None) -> list[tuple]:
    """The expression, its simplified form and those of its parts in place: a rewrite neighbourhood."""
    from lawloom.functions.expression import simplify

    out = {tree, simplify(tree, assume)[0]}
    for i, part in enumerate(tree[1:], 1):
        if isinstance(part, tuple) and part and isinstance(part[0], str):
            out.add((*tree[:i], simplify(part, assume)[0], *tree[i + 1 :]))
    return sorted(out, key=repr)


def budget_report(runs: list[EngineRun], wall_seconds: float) -> dict:
    """Whether the runs kept to the wall-clock budget; over it, the search degrades to an abstention."""
    spent = sum(r.seconds for r in runs)
    return {"spent_seconds": spent, "status": "within_budget" if spent <= wall_seconds else "over_budget", "decision": "continue" if spent <= wall_seconds else "abstain"}


def parallel_map(items: DataFrame, key: str, worker, schema: str) -> DataFrame:
    """One task group per item id; the result carries the id, so order is the caller's ``orderBy``."""
    return items.groupBy(key).applyInPandas(worker, schema)


def fold_state(rows: DataFrame, by: list[str], order: str, value: str, initial: float, update) -> DataFrame:
    """A user's state transition along each series (column, column -> column): a fold without a merge."""
    series = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))
    return series.select(*by, F.aggregate("_s", F.lit(initial), lambda s, x: update(s, x[value])).alias("state"))
