"""Scalar expression language: trees on the driver, compiled to Spark columns.

A tree is a tuple: ("lit", v), ("var", name), ("param", name), (operator, *operands), ("if", c, a, b),
("piecewise", ((c, v), ...), default). Domain errors raise, as in the interpreter of the language.
"""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Expr = tuple


def _guard(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).when(~ok, F.raise_error(F.lit(f"domain error: {what}")).cast("double"))


def _all_known(f: Callable, *xs: Column) -> Column:
    """least and greatest skip nulls; here a null operand makes a null."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, f(*xs)) if len(xs) > 1 else xs[0]


#: Operators by name: how each becomes a column.
OPERATORS: dict[str, Callable[..., Column]] = {
    "add": lambda *x: sum(x[1:], x[0]), "sub": lambda a, b: a - b, "mul": lambda *x: _product(x),
    "div": lambda a, b: _guard(b != 0, a / F.when(b != 0, b), "division by zero"),
    "protected_div": lambda a, b: F.when(F.abs(b) > 1e-12, a / F.when(F.abs(b) > 1e-12, b)).otherwise(0.0),
    "neg": lambda a: -a, "abs": F.abs, "min": lambda *x: _all_known(F.least, *x), "max": lambda *x: _all_known(F.greatest, *x),
    "pow": F.pow, "pow2": lambda a: a * a, "sqrt": lambda a: _guard(a >= 0, F.sqrt(a), "sqrt"), "exp": F.exp,
    "log": lambda a: _guard(a > 0, F.log(F.when(a > 0, a)), "log"), "protected_log": lambda a: F.log(F.greatest(a, F.lit(1e-12))),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh, "sigmoid": lambda a: 1 / (1 + F.exp(-a)),
    "logit": lambda a: _guard((a > 0) & (a < 1), F.log(a / F.when(a != 1, 1 - a)), "logit"),
    "floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"),
    "clip": lambda a, lo, hi: F.least(F.greatest(a, lo), hi), "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "seasonal_phase": lambda i, p: F.pmod(i, p) / p,
    "location_parameter": lambda a: a, "scale_parameter": lambda a: a, "rate_parameter": lambda a: a, "probability_parameter": lambda a: a, "dispersion_parameter": lambda a: a,
}
#: Operators that need the order of a series.
SEQUENCE: dict[str, Callable] = {
    "lag": lambda w, a, k=1: F.lag(a, int(k)).over(w),
    "finite_difference": lambda w, a: a - F.lag(a).over(w),
    "rolling_mean": lambda w, a, k: F.avg(a).over(w.rowsBetween(-int(k) + 1, 0)),
    "rolling_sum": lambda w, a, k: F.sum(a).over(w.rowsBetween(-int(k) + 1, 0)),
    "cumulative_sum": lambda w, a: F.sum(a).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "convolution": lambda w, a, *ks: sum((F.coalesce(F.lag(a, i).over(w), F.lit(0.0)) * k for i, k in enumerate(ks)), F.lit(0.0)),
    "derivative_estimate": lambda w, a, dt=1.0: (a - F.lag(a).over(w)) / dt,
    "integral_estimate": lambda w, a, dt=1.0: F.sum(a).over(w.rowsBetween(Window.unboundedPreceding, 0)) * dt,
}


def _product(xs) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out * x
    return out


def compile_expression(e: Expr, parameters: dict[str, float] | None = None, window=None) -> Column:
    """The column of a tree; sequence operators need a window ordered by time."""
    go = lambda x: compile_expression(x, parameters, window)
    op, *args = e
    if op == "lit":
        return F.lit(args[0])
    if op == "var":
        return F.col(args[0])
    if op == "param":
        return F.lit((parameters or {})[args[0]])
    if op == "if":
        return F.when(go(args[0]), go(args[1])).otherwise(go(args[2]))
    if op == "piecewise":
        out = None
        for c, v in args[0]:
            out = F.when(go(c), go(v)) if out is None else out.when(go(c), go(v))
        return go(args[1]) if out is None else out.otherwise(go(args[1]))
    if op in OPERATORS:
        return OPERATORS[op](*map(go, args))
    if op in SEQUENCE:
        if window is None:
            raise ValueError(f"{op} needs a window")
        return SEQUENCE[op](window, go(args[0]), *(a[1] for a in args[1:]))
    raise ValueError(f"unsupported_expression_evaluator: {op}")


def evaluate(e: Expr, values: dict[str, float], parameters: dict[str, float] | None = None):
    """The same on the driver, for one row (no sequence operators)."""
    go = lambda x: evaluate(x, values, parameters)
    op, *args = e
    if op == "lit":
        return args[0]
    if op in ("var", "param"):
        return (values if op == "var" else parameters or {})[args[0]]
    if op == "if":
        return go(args[1]) if go(args[0]) else go(args[2])
    if op == "piecewise":
        return next((go(v) for c, v in args[0] if go(c)), None) if any(go(c) for c, _ in args[0]) else go(args[1])
    x = [go(a) for a in args]
    simple = {
        "add": lambda: sum(x), "sub": lambda: x[0] - x[1], "mul": lambda: math.prod(x), "div": lambda: x[0] / x[1], "protected_div": lambda: x[0] / x[1] if abs(x[1]) > 1e-12 else 0.0,
        "neg": lambda: -x[0], "abs": lambda: abs(x[0]), "min": lambda: min(x), "max": lambda: max(x), "pow": lambda: x[0] ** x[1], "pow2": lambda: x[0] * x[0], "sqrt": lambda: math.sqrt(x[0]),
        "exp": lambda: math.exp(x[0]), "log": lambda: math.log(x[0]), "protected_log": lambda: math.log(max(x[0], 1e-12)), "sin": lambda: math.sin(x[0]), "cos": lambda: math.cos(x[0]), "tan": lambda: math.tan(x[0]),
        "tanh": lambda: math.tanh(x[0]), "sigmoid": lambda: 1 / (1 + math.exp(-x[0])), "logit": lambda: math.log(x[0] / (1 - x[0])), "floor": lambda: float(math.floor(x[0])), "ceil": lambda: float(math.ceil(x[0])),
        "clip": lambda: min(max(x[0], x[1]), x[2]), "where": lambda: x[1] if x[0] else x[2], "gt": lambda: x[0] > x[1], "lt": lambda: x[0] < x[1], "ge": lambda: x[0] >= x[1], "le": lambda: x[0] <= x[1],
        "eq": lambda: x[0] == x[1], "and": lambda: x[0] and x[1], "or": lambda: x[0] or x[1], "not": lambda: not x[0], "seasonal_phase": lambda: x[0] % x[1] / x[1],
    }
    if op not in simple:
        raise ValueError(f"unsupported_expression_evaluator: {op}")
    return simple[op]()


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for a in e[1:]:
        if isinstance(a, tuple) and a and isinstance(a[0], str):
            yield from walk(a)
        elif isinstance(a, tuple):
            for pair in a:
                for x in pair:
                    yield from walk(x)


def to_json(e: Expr) -> str:
    return json.dumps(e)


def from_json(text: str) -> Expr:
    tup = lambda x: tuple(map(tup, x)) if isinstance(x, list) else x
    return tup(json.loads(text))


def cost(e: Expr) -> int:
    """Leaves 1, unary and binary nodes 1, sequence nodes 2, branches 2."""
    op, *args = e
    if op in ("lit", "var", "param"):
        return 1
    if op == "piecewise":
        return 2 + cost(args[1]) + sum(cost(c) + cost(v) for c, v in args[0])
    own = 2 if op == "if" or op in SEQUENCE else 1
    return own + sum(cost(x) for x in args)


ZERO, ONE = ("lit", 0.0), ("lit", 1.0)


def _is(e: Expr, v: float) -> bool:
    return e[0] == "lit" and not isinstance(e[1], bool) and e[1] == v


def _rules(e: Expr, assume: set[str]) -> tuple[str, Expr] | None:
    """First rule that applies at the root. assume: facts such as "nonzero:x", "nonnegative:x", "finite"."""
    op, *a = e
    if op == "add" and len(a) == 2:
        for i in (0, 1):
            if _is(a[i], 0):
                return "additive_identity", a[1 - i]
        if all(x[0] == "pow2" for x in a) and {x[1][0] for x in a} == {"sin", "cos"} and a[0][1][1] == a[1][1][1]:
            return "trig_pythagorean_identity", ONE
    if op == "mul" and len(a) == 2:
        for i in (0, 1):
            if _is(a[i], 1):
                return "multiplicative_identity", a[1 - i]
            if _is(a[i], 0) and "finite" in assume:
                return "zero_product", ZERO
    if op == "log" and a[0][0] == "exp":
        return "log_exp_inverse", a[0][1]
    if op == "div" and a[0][0] == "mul" and len(a[0]) == 3:
        for i in (1, 2):
            if a[0][i] == a[1] and (f"nonzero:{a[1][1]}" in assume if a[1][0] == "var" else a[1][0] == "lit" and a[1][1] != 0):
                return "divide_common_factor", a[0][3 - i]
    if op == "sqrt" and a[0][0] == "pow2" and a[0][1][0] == "var" and f"nonnegative:{a[0][1][1]}" in assume:
        return "sqrt_square_nonnegative", a[0][1]
    if op == "piecewise" and all(v == a[1] for _, v in a[0]) or op == "if" and a[1] == a[2]:
        return "piecewise_same_branch", a[1]
    if op in OPERATORS and op not in ("and", "or", "not") and a and all(x[0] == "lit" and not isinstance(x[1], (bool, str)) for x in a):
        try:
            return "constant_folding", ("lit", evaluate(e, {}))
        except (ArithmeticError, ValueError):
            return None
    return None


def simplify(e: Expr, assume: set[str] | None = None) -> tuple[Expr, list[str]]:
    """Bottom-up to a fixed point, with the rules used."""
    trace: list[str] = []

    def go(x: Expr) -> Expr:
        if x[0] in ("lit", "var", "param"):
            return x
        x = (x[0], tuple((go(c), go(v)) for c, v in x[1]), go(x[2])) if x[0] == "piecewise" else (x[0], *map(go, x[1:]))
        while (hit := _rules(x, assume or set())) is not None:
            trace.append(hit[0])
            x = hit[1]
        return x

    while (new := go(e)) != e:
        e = new
    return e, trace


def _positions(e: Expr) -> Iterator[tuple[Expr, Callable[[Expr], Expr]]]:
    """Every part of a tree, with the function that puts another in its place."""
    yield e, lambda x: x
    for i, a in enumerate(e[1:], 1):
        if isinstance(a, tuple) and a and isinstance(a[0], str):
            for part, back in _positions(a):
                yield part, lambda x, i=i, back=back: (*e[:i], back(x), *e[i + 1 :])


def validate_rewrite(rule: str, before: Expr, after: Expr, assume: set[str] | None = None) -> bool:
    """Whether the named rule turns one tree into the other at its root, under the assumptions."""
    if rule == "unit_zero_identity":
        return before[0] == "add" and len(before) == 3 and any(_is(before[i], 0) and before[3 - i] == after for i in (1, 2)) and "unit_equal" in (assume or set())
    return _rules(before, assume or set()) == (rule, after)


def saturate(e: Expr, assume: set[str] | None = None, most: int = 2000) -> tuple[Expr, list[tuple[str, Expr]], bool]:
    """The cheapest tree that rewrites and commuted sums and products reach, the steps to it, and whether all forms were seen.

    Forms are looked at cheapest first; ``most`` bounds them, and a search that it ends says so.
    """
    from heapq import heappop, heappush

    seen: dict[Expr, tuple[str, Expr] | None] = {e: None}
    todo = [(cost(e), to_json(e), e)]
    while todo and len(seen) < most:
        _, _, x = heappop(todo)
        for part, back in _positions(x):
            found = [hit] if (hit := _rules(part, assume or set())) is not None else []
            if part[0] in ("add", "mul") and len(part) == 3:
                found.append(("commutativity", (part[0], part[2], part[1])))
                for op, (_, left, right) in [(part[0], part)] if part[1][0] == part[0] and len(part[1]) == 3 else []:
                    found.append(("associativity", (op, left[1], (op, left[2], right))))
            for rule, new in found:
                whole = back(new)
                if whole not in seen:
                    seen[whole] = (rule, x)
                    heappush(todo, (cost(whole), to_json(whole), whole))
    best = cheapest(list(seen))
    steps: list[tuple[str, Expr]] = []
    at = best
    while (came := seen[at]) is not None:
        steps.append((came[0], at))
        at = came[1]
    return best, steps[::-1], not todo


def cheapest(candidates: list[Expr]) -> Expr:
    """Least cost, then least text."""
    return min(candidates, key=lambda x: (cost(x), to_json(x)))


def canonical_form(e: Expr, assume: set[str] | None = None) -> Expr:
    """Simplified, with the operands of sums and products flattened and sorted."""
    e = simplify(e, assume)[0]

    def go(x: Expr) -> Expr:
        if x[0] in ("lit", "var", "param"):
            return x
        if x[0] == "piecewise":
            return (x[0], tuple((go(c), go(v)) for c, v in x[1]), go(x[2]))
        parts = [go(a) for a in x[1:]]
        if x[0] in ("add", "mul"):
            flat = [y for p in parts for y in (p[1:] if p[0] == x[0] else (p,))]
            return (x[0], *sorted(flat, key=to_json))
        return (x[0], *parts)

    return go(e)


def equivalence(a: Expr, b: Expr, names: list[str], assume: set[str] | None = None) -> str:
    """equivalent where canonical forms agree, different where a sample point tells them apart, else undecided: points alone prove nothing."""
    if canonical_form(a, assume) == canonical_form(b, assume):
        return "equivalent"
    return "undecided" if agree_on_samples(a, b, names) else "different"


def equivalent(a: Expr, b: Expr, names: list[str], assume: set[str] | None = None) -> bool:
    """Only what is shown to be equivalent."""
    return equivalence(a, b, names, assume) == "equivalent"


def agree_on_samples(a: Expr, b: Expr, names: list[str], samples: int = 64, tolerance: float = 1e-9) -> bool:
    """Agreement on fixed sample points where both are defined (at least one)."""
    import random

    rng, seen = random.Random(7), 0
    for _ in range(samples):
        at = {n: rng.uniform(0.1, 3.0) for n in names}
        try:
            x, y = evaluate(a, at), evaluate(b, at)
        except (ArithmeticError, ValueError):
            continue
        seen += 1
        if abs(x - y) > tolerance * max(1.0, abs(x)):
            return False
    return seen > 0


def derivative(e: Expr, name: str) -> Expr:
    op, *a = e
    d = lambda x: derivative(x, name)
    if op in ("lit", "param"):
        return ZERO
    if op == "var":
        return ONE if a[0] == name else ZERO
    rules = {
        "add": lambda: ("add", *map(d, a)), "sub": lambda: ("sub", d(a[0]), d(a[1])), "neg": lambda: ("neg", d(a[0])),
        "mul": lambda: ("add", ("mul", d(a[0]), a[1]), ("mul", a[0], d(a[1]))), "div": lambda: ("div", ("sub", ("mul", d(a[0]), a[1]), ("mul", a[0], d(a[1]))), ("pow2", a[1])),
        "pow2": lambda: ("mul", ("mul", ("lit", 2.0), a[0]), d(a[0])), "exp": lambda: ("mul", e, d(a[0])), "log": lambda: ("div", d(a[0]), a[0]),
        "sin": lambda: ("mul", ("cos", a[0]), d(a[0])), "cos": lambda: ("neg", ("mul", ("sin", a[0]), d(a[0]))), "sqrt": lambda: ("div", d(a[0]), ("mul", ("lit", 2.0), e)),
        "tanh": lambda: ("mul", ("sub", ONE, ("pow2", e)), d(a[0])), "sigmoid": lambda: ("mul", ("mul", e, ("sub", ONE, e)), d(a[0])),
    }
    if op not in rules:
        raise ValueError(f"no derivative of {op}")
    return simplify(rules[op](), {"finite"})[0]


_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "pow"}


def parse_text(text: str) -> Expr:
    """Tree of an arithmetic expression in Python's notation; only listed operators and names pass."""

    def go(n: ast.AST) -> Expr:
        if isinstance(n, ast.Expression):
            return go(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return ("lit", float(n.value))
        if isinstance(n, ast.Name):
            return ("var", n.id)
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return (_BINARY[type(n.op)], go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return ("neg", go(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in OPERATORS and not n.keywords:
            return (n.func.id, *map(go, n.args))
        raise ValueError(f"not allowed in an expression: {ast.dump(n)[:60]}")

    return go(ast.parse(text, mode="eval"))


def units(e: Expr, of: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    """Dimension exponents of a tree; adding unlike ones or functions of dimensioned values is an error."""
    op, *a = e
    none = tuple(0 for _ in next(iter(of.values()), ()))
    if op in ("lit", "param"):
        return of.get(a[0], none) if op == "param" else none
    if op == "var":
        return of[a[0]]
    u = [units(x, of) for x in a if isinstance(x, tuple)]
    if op in ("add", "sub", "min", "max", "gt", "lt", "ge", "le", "eq"):
        if len({*u}) > 1:
            raise ValueError(f"unit mismatch in {op}")
        return u[0] if op in ("add", "sub", "min", "max") else none
    if op == "mul":
        return tuple(map(sum, zip(*u)))
    if op in ("div", "protected_div"):
        return tuple(x - y for x, y in zip(*u))
    if op in ("neg", "abs", "lag", "floor", "ceil"):
        return u[0]
    if op == "pow2":
        return tuple(2 * x for x in u[0])
    if any(any(x) for x in u):
        raise ValueError(f"{op} needs dimensionless operands")
    return none
