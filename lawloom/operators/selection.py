"""Pareto frontiers, rankings and seeded selection of candidate rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominates(axes: dict[str, str], a: str, b: str) -> Column:
    """Row a is at least as good as b on every axis (min or max) and better on one."""
    ca, cb = (lambda x: F.col(f"{a}.{x}")), (lambda x: F.col(f"{b}.{x}"))
    weak = [ca(x) <= cb(x) if d == "min" else ca(x) >= cb(x) for x, d in axes.items()]
    strict = [ca(x) < cb(x) if d == "min" else ca(x) > cb(x) for x, d in axes.items()]
    return reduce(lambda p, q: p & q, weak) & reduce(lambda p, q: p | q, strict)


def _skyline(rows: list[tuple], directions: list[str]) -> list[int]:
    """Positions of the rows that no other dominates; rows are read best first, so each meets only survivors."""
    sign = [1 if d == "min" else -1 for d in directions]
    keyed = sorted((tuple(s * v for s, v in zip(sign, r)), i) for i, r in enumerate(rows))
    front: list[tuple[tuple, int]] = []
    for k, i in keyed:
        if not any(all(x <= y for x, y in zip(f, k)) and f != k for f, _ in front):
            front.append((k, i))
    return [i for _, i in front]


def frontier(candidates: DataFrame, by: list[str], axes: dict[str, str]) -> DataFrame:
    """Non-dominated rows of each group. Each partition reduces its rows to their own frontier before groups meet."""
    names, directions = list(axes), list(axes.values())

    def local(batches):
        for batch in batches:
            parts = [g.iloc[_skyline(list(g[names].itertuples(index=False, name=None)), directions)] for _, g in (batch.groupby(by, sort=False, dropna=False) if by else [((), batch)])]
            yield pd.concat(parts) if parts else batch

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[_skyline(list(group[names].itertuples(index=False, name=None)), directions)]

    complete = candidates.where(reduce(lambda p, q: p & q, (F.col(a).isNotNull() for a in axes)))
    reduced = complete.mapInPandas(local, candidates.schema)
    return reduced.groupBy(*by).applyInPandas(whole, candidates.schema)


def frontier_by_antijoin(candidates: DataFrame, by: list[str], axes: dict[str, str]) -> DataFrame:
    """The same by a left anti join on dominance, for the few hundred candidates of a search stage."""
    same = reduce(lambda p, q: p & q, (F.col(f"a.{b}") == F.col(f"b.{b}") for b in by), F.lit(True))
    return candidates.alias("b").join(candidates.alias("a"), same & dominates(axes, "a", "b"), "left_anti")


#: Total order of candidates: fewer bits, more gain, less structure, then shorter and by id.
FREEZE_ORDER = ("total_bits", "-gain_bits", "structure_bits", "candidate_id")
PORTFOLIO_ORDER = ("total_bits", "-gain_bits", "structure_bits", "byte_length", "candidate_id")


def order_columns(keys) -> list[Column]:
    return [F.col(k[1:]).desc() if k[0] == "-" else F.col(k).asc() for k in keys]


def ranked(candidates: DataFrame, by: list[str], keys=FREEZE_ORDER) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order_columns(keys))))


def shortlist(candidates: DataFrame, by: list[str], limit: int, keys=FREEZE_ORDER) -> DataFrame:
    """The first ``limit`` of each group: the limit is the feature."""
    return ranked(candidates, by, keys).where(F.col("rank") <= limit)


def family_finalists(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best admitted candidate of each family."""
    return ranked(candidates.where("admitted"), [*(by or []), "family"]).where("rank = 1").drop("rank")


def portfolio_winner(finalists: DataFrame, comparison_key: list[str]) -> DataFrame:
    """The largest group of comparable finalists (ties: the least key), ranked; rank 1 is the winner."""
    sizes = finalists.groupBy(*comparison_key).agg(F.count("*").alias("_n"))
    best = sizes.orderBy(F.col("_n").desc(), *comparison_key).limit(1).drop("_n")
    return ranked(finalists.join(F.broadcast(best), comparison_key), [], PORTFOLIO_ORDER)


def seeded_token(seed: str, restart: Column, candidate_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), restart.cast("string"), candidate_id), 256)


def seeded_batches(candidates: DataFrame, seed: str, batch: int, limit: int) -> DataFrame:
    """Restarted hash order: restart r takes the next ``batch`` by its own tokens; one round per restart, limit is the feature."""
    left, taken, out, r = candidates, 0, None, 0
    while taken < limit:
        n = min(batch, limit - taken)
        pick = left.orderBy(seeded_token(seed, F.lit(r), F.col("candidate_id")), "candidate_id").limit(n).withColumn("restart", F.lit(r))
        out = pick if out is None else out.unionByName(pick)
        left = left.join(pick.select("candidate_id"), "candidate_id", "left_anti")
        taken, r = taken + n, r + 1
    return out


def unattempted(fallback: DataFrame, attempted: DataFrame, identity: list[str]) -> DataFrame:
    """Fallback rows whose identity wasn't attempted, each identity once."""
    return fallback.join(attempted.select(*identity).distinct(), identity, "left_anti").dropDuplicates(identity)


def law_eligibility(candidates: DataFrame) -> DataFrame:
    """Adds why a candidate isn't eligible as a law (null: eligible)."""
    return candidates.withColumn("reason", F.when(~F.col("admitted"), "not_admitted").when(F.col("gain_bits") <= 0, "no_description_gain"))
