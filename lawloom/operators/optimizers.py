"""Bounded fits of expressions: NumPy optimisers for one group, spread over groups as grouped pandas functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lawloom.functions import expression


@dataclass(frozen=True)
class Parameter:
    """A parameter to fit, or a fixed one; penalty: (l1 or l2, weight, centre)."""

    name: str
    initial: float = 0.0
    lower: float = -math.inf
    upper: float = math.inf
    fixed: bool = False
    penalty: tuple[str, float, float] | None = None

    def __post_init__(self) -> None:
        if not self.lower <= self.initial <= self.upper:
            raise ValueError(f"initial value of {self.name} lies outside its bounds")
        if self.penalty is not None and self.penalty[0] not in ("l1", "l2"):
            raise ValueError(f"unknown_fit_penalty: {self.penalty[0]}")


@dataclass(frozen=True)
class Fit:
    converged: bool
    parameters: dict[str, float]
    loss: float
    iterations: int
    bound_hits: tuple[str, ...] = ()
    reason: str | None = None


def free(parameters: Sequence[Parameter]) -> list[Parameter]:
    return [p for p in parameters if not p.fixed]


def bind(parameters: Sequence[Parameter], values: Sequence[float]) -> dict[str, float]:
    """All parameters by name, the free ones at ``values`` in their order."""
    if len(values) != len(free(parameters)):
        raise ValueError("one value for each free parameter")
    left = iter(values)
    return {p.name: p.initial if p.fixed else float(next(left)) for p in parameters}


def penalty(parameters: Sequence[Parameter], values: Mapping[str, float]) -> float:
    total = 0.0
    for p in parameters:
        if p.penalty is not None:
            kind, weight, centre = p.penalty
            d = values[p.name] - centre
            total += weight * (abs(d) if kind == "l1" else d * d)
    return total


#: Losses of residuals (predicted minus observed), summed.
OBJECTIVES: dict[str, Callable[..., float]] = {
    "squared_error": lambda r, **_: float(r @ r),
    "absolute_error": lambda r, **_: float(np.abs(r).sum()),
    "huber_loss": lambda r, delta=1.0, **_: float(np.where(np.abs(r) <= delta, 0.5 * r * r, delta * np.abs(r)).sum()),
    "gaussian_nll": lambda r, scale=1.0, **_: float((math.log(scale * math.sqrt(2 * math.pi)) + (r / scale) ** 2 / 2).sum()),
}


def objective(name: str) -> Callable[..., float]:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown_fit_objective: {name}")
    return OBJECTIVES[name]


def _finish(parameters: Sequence[Parameter], x: np.ndarray, loss: float, rounds: int, converged: bool) -> Fit:
    values = bind(parameters, x)
    hits = tuple(p.name for p in free(parameters) if values[p.name] in (p.lower, p.upper))
    return Fit(converged, values, loss, rounds, hits, None if converged else "optimizer_nonconvergence")


def _slopes(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at a bound."""
    columns = []
    for j in range(len(x)):
        h = 6e-6 * max(1.0, abs(x[j]))
        up, down = x.copy(), x.copy()
        up[j], down[j] = min(x[j] + h, hi[j]), max(x[j] - h, lo[j])
        columns.append((f(up) - f(down)) / max(up[j] - down[j], 1e-300))
    return np.stack(columns, axis=-1) if columns else np.zeros((*np.shape(f(x)), 0))


def least_squares(parameters: Sequence[Parameter], residuals: Callable[[Mapping[str, float]], np.ndarray], rounds: int = 200, tolerance: float = 1e-12) -> Fit:
    """Levenberg-Marquardt steps cut off at the bounds."""
    own = free(parameters)
    lo, hi = np.array([p.lower for p in own]), np.array([p.upper for p in own])
    x, damping = np.array([p.initial for p in own], float), 1e-3
    f = lambda v: np.asarray(residuals(bind(parameters, v)), float)
    r = f(x)
    if not np.isfinite(r).all():
        return Fit(False, bind(parameters, x), math.inf, 0, (), "optimizer_numerical_failure")
    for i in range(rounds):
        if not len(x):
            break
        j = _slopes(f, x, lo, hi)
        grad, curve = j.T @ r, j.T @ j
        held = ((x <= lo) & (grad > 0)) | ((x >= hi) & (grad < 0))  # a bound that the step would cross
        go = ~held
        if not go.any() or np.abs(grad[go]).max() <= tolerance * max(1.0, float(r @ r)):
            return _finish(parameters, x, float(r @ r), i, True)
        moved = False
        while damping < 1e16:
            a = curve[np.ix_(go, go)]
            step = np.zeros(len(x))
            step[go] = -np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), grad[go], rcond=None)[0]
            new = np.clip(x + step, lo, hi)
            with np.errstate(all="ignore"):
                again = f(new)
            if np.isfinite(again).all() and again @ again < r @ r:
                moved = True
                break
            damping *= 4
        if not moved:
            return _finish(parameters, x, float(r @ r), i, True)
        small = r @ r - again @ again <= tolerance * max(1e-300, float(r @ r))
        x, r, damping = new, again, max(damping / 10, 1e-15)
        if small:
            return _finish(parameters, x, float(r @ r), i + 1, True)
    return _finish(parameters, x, float(r @ r), rounds if len(x) else 0, not len(x))


def minimize(parameters: Sequence[Parameter], loss: Callable[[Mapping[str, float]], float], rounds: int = 500, tolerance: float = 1e-10) -> Fit:
    """Projected BFGS with backtracking."""
    own = free(parameters)
    lo, hi = np.array([p.lower for p in own]), np.array([p.upper for p in own])
    x = np.array([p.initial for p in own], float)
    f = lambda v: np.float64(loss(bind(parameters, v)))
    value = f(x)
    if not np.isfinite(value):
        return Fit(False, bind(parameters, x), math.inf, 0, (), "optimizer_numerical_failure")
    inverse, grad = np.eye(len(x)), _slopes(f, x, lo, hi) if len(x) else np.zeros(0)
    for i in range(rounds):
        go = ~(((x <= lo) & (grad > 0)) | ((x >= hi) & (grad < 0)))
        if not go.any() or np.abs(grad[go]).max() <= tolerance * max(1.0, abs(float(value))):
            return _finish(parameters, x, float(value), i, True)
        way = np.zeros(len(x))
        way[go] = -inverse[np.ix_(go, go)] @ grad[go]
        if way @ grad >= 0:
            inverse = np.eye(len(x))
            way = np.where(go, -grad, 0.0)
        size, new, found = 1.0, x, value
        while size > 1e-14:
            new = np.clip(x + size * way, lo, hi)
            with np.errstate(all="ignore"):
                found = f(new)
            if np.isfinite(found) and found <= value + 1e-4 * grad @ (new - x):
                break
            size /= 2
        else:
            return _finish(parameters, x, float(value), i, True)
        again = _slopes(f, new, lo, hi)
        s, y = new - x, again - grad
        if s @ y > 1e-12:
            rho, one = 1 / (s @ y), np.eye(len(x))
            inverse = (one - rho * np.outer(s, y)) @ inverse @ (one - rho * np.outer(y, s)) + rho * np.outer(s, s)
        small = value - found <= tolerance * 1e-2 * max(1.0, abs(float(value))) and np.abs(s).max() <= 1e-9
        x, value, grad = new, found, again
        if small:
            return _finish(parameters, x, float(value), i + 1, True)
    return _finish(parameters, x, float(value), rounds, False)


def predict(tree: tuple, rows: pd.DataFrame, parameters: Mapping[str, float]) -> np.ndarray:
    """The tree's value of each row."""
    names = [c for c in rows.columns]
    return np.array([float(expression.evaluate(tree, dict(zip(names, row)), parameters)) for row in rows.itertuples(index=False)], float)


def fit_expression(rows: DataFrame, by: list[str], target: str, tree: tuple, parameters: Sequence[Parameter], objective_id: str = "squared_error", **options) -> DataFrame:
    """One fit for each group: by, converged, loss (without penalties), n, reason, parameters (map).

    Squared error without absolute penalties is a least-squares problem; everything else is minimised as
    a whole. A group whose residuals aren't finite at the start reports that and keeps its initial values.
    """
    loss = objective(objective_id)
    used = sorted({x[1] for x in expression.walk(tree) if x[0] == "var"})
    smooth = objective_id == "squared_error" and all(p.penalty is None or p.penalty[0] == "l2" for p in parameters)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[used], group[target].to_numpy(float)

        def residuals(values):
            return predict(tree, x, values) - y

        def whole(values):
            pulls = [math.sqrt(p.penalty[1]) * (values[p.name] - p.penalty[2]) for p in parameters if p.penalty is not None]
            return np.concatenate([residuals(values), pulls])

        try:
            fit = least_squares(parameters, whole) if smooth else minimize(parameters, lambda v: loss(residuals(v), **options) + penalty(parameters, v))
            own = loss(residuals(fit.parameters), **options)
        except (ArithmeticError, ValueError):
            fit, own = Fit(False, {p.name: p.initial for p in parameters}, math.inf, 0, (), "optimizer_numerical_failure"), math.inf
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "converged": [fit.converged], "loss": [own], "n": [len(group)], "reason": [fit.reason], "parameters": [fit.parameters]})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.select(*dict.fromkeys([*by, *used, target])).groupBy(*by).applyInPandas(run, f"{keys}, converged boolean, loss double, n long, reason string, parameters map<string,double>")
