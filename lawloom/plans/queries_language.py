"""Queries over the expression language: every scalar operator over lineitem, every sequence operator over a series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lawloom.functions import expression
from lawloom.plans.queries_core import R, S, daily
from lawloom.plans.registry import query
from lawloom.sources.panels import I1, table

V = lambda c: ("var", c)
L = lambda x: ("lit", x)
Q, P, D, T = V("l_quantity"), V("l_extendedprice"), V("l_discount"), V("l_tax")
#: name -> (tree, SQL) of operators with a numeric result.
NUMERIC = {
    "add": (("add", Q, D, T), "l_quantity + l_discount + l_tax"), "sub": (("sub", Q, D), "l_quantity - l_discount"), "mul": (("mul", Q, D, T), "l_quantity * l_discount * l_tax"),
    "div": (("div", P, ("add", Q, L(0.37))), "l_extendedprice / (l_quantity + 0.37)"), "protected_div": (("protected_div", T, D), "CASE WHEN abs(l_discount) > 1e-12 THEN l_tax / l_discount ELSE 0.0 END"),
    "neg": (("neg", Q), "-l_quantity"), "abs": (("abs", ("sub", D, T)), "abs(l_discount - l_tax)"), "min": (("min", D, T, L(0.03)), "least(l_discount, l_tax, 0.03)"), "max": (("max", D, T, L(0.03)), "greatest(l_discount, l_tax, 0.03)"),
    "pow": (("pow", Q, L(1.5)), "pow(l_quantity, 1.5)"), "pow2": (("pow2", Q), "l_quantity * l_quantity"), "sqrt": (("sqrt", Q), "sqrt(l_quantity)"), "exp": (("exp", D), "exp(l_discount)"),
    "log": (("log", P), "ln(l_extendedprice)"), "protected_log": (("protected_log", D), "ln(greatest(l_discount, 1e-12))"), "sin": (("sin", Q), "sin(l_quantity)"), "cos": (("cos", Q), "cos(l_quantity)"), "tan": (("tan", D), "tan(l_discount)"),
    "tanh": (("tanh", T), "tanh(l_tax)"), "sigmoid": (("sigmoid", ("neg", D)), "1 / (1 + exp(l_discount))"), "logit": (("logit", ("add", D, L(0.1))), "ln((l_discount + 0.1) / (1 - (l_discount + 0.1)))"),
    "floor": (("floor", ("div", P, L(7.0))), "floor(l_extendedprice / 7.0)"), "ceil": (("ceil", ("div", P, L(7.0))), "ceil(l_extendedprice / 7.0)"), "clip": (("clip", Q, L(10.0), L(30.0)), "least(greatest(l_quantity, 10.0), 30.0)"),
    "where": (("where", ("gt", Q, L(25.0)), D, T), "CASE WHEN l_quantity > 25 THEN l_discount ELSE l_tax END"),
    "piecewise": (("piecewise", ((("lt", Q, L(10.0)), D), (("lt", Q, L(30.0)), T)), L(0.5)), "CASE WHEN l_quantity < 10 THEN l_discount WHEN l_quantity < 30 THEN l_tax ELSE 0.5 END"),
    **{f"{k}_parameter": ((f"{k}_parameter", x), c) for k, x, c in (("location", P, "l_extendedprice"), ("scale", Q, "l_quantity"), ("rate", T, "l_tax"), ("probability", D, "l_discount"), ("dispersion", ("pow2", T), "l_tax * l_tax"))},
}
#: Operators with a truth value.
LOGICAL = {
    "gt": (("gt", D, T), "l_discount > l_tax"), "lt": (("lt", D, T), "l_discount < l_tax"), "ge": (("ge", D, T), "l_discount >= l_tax"), "le": (("le", D, T), "l_discount <= l_tax"), "eq": (("eq", D, T), "l_discount = l_tax"),
    "and": (("and", ("gt", Q, L(10.0)), ("lt", D, L(0.05))), "l_quantity > 10 AND l_discount < 0.05"), "or": (("or", ("gt", Q, L(40.0)), ("lt", D, L(0.02))), "l_quantity > 40 OR l_discount < 0.02"), "not": (("not", ("gt", Q, L(25.0))), "NOT (l_quantity > 25)"),
}
Y = V("target")
#: Operators that read the order of a series; the window w is the entity's, by position.
ORDERED = {
    "lag": (("lag", Y, L(2)), "lag(target, 2) OVER w"), "finite_difference": (("finite_difference", Y), "target - lag(target) OVER w"), "rolling_mean": (("rolling_mean", Y, L(4)), "avg(target) OVER (PARTITION BY entity ORDER BY idx ROWS 3 PRECEDING)"),
    "rolling_sum": (("rolling_sum", Y, L(5)), "sum(target) OVER (PARTITION BY entity ORDER BY idx ROWS 4 PRECEDING)"), "cumulative_sum": (("cumulative_sum", Y), "sum(target) OVER (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING)"),
    "convolution": (("convolution", Y, L(0.5), L(0.3), L(0.2)), "target * 0.5 + coalesce(lag(target) OVER w, 0) * 0.3 + coalesce(lag(target, 2) OVER w, 0) * 0.2"),
    "derivative_estimate": (("derivative_estimate", Y, L(0.5)), "(target - lag(target) OVER w) / 0.5"), "integral_estimate": (("integral_estimate", Y, L(0.5)), "0.5 * sum(target) OVER (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING)"),
    "seasonal_phase": (("seasonal_phase", V("idx"), L(7.0)), "(idx % 7) / 7.0"),
}


@query("expression_operators", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{S(sql)} AS op_{k}' for k, (_, sql) in NUMERIC.items())}, {', '.join(f'{sql} AS is_{k}' for k, (_, sql) in LOGICAL.items())} FROM lineitem")
def expression_operators(spark, d):
    go = expression.compile_expression
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *((R(go(e)) + 0.0).alias(f"op_{k}") for k, (e, _) in NUMERIC.items()), *(go(e).alias(f"is_{k}") for k, (e, _) in LOGICAL.items()),
    )


@query("expression_sequences", f"WITH {I1} SELECT entity, idx, {', '.join(f'{S(sql, 4)} AS op_{k}' for k, (_, sql) in ORDERED.items())} FROM i1 WINDOW w AS (PARTITION BY entity ORDER BY idx)")
def expression_sequences(spark, d):
    w = Window.partitionBy("entity").orderBy("idx")
    return daily(spark, d).select("entity", F.col("idx").cast("long").alias("idx"), *((R(expression.compile_expression(e, window=w), 4) + 0.0).alias(f"op_{k}") for k, (e, _) in ORDERED.items()))
