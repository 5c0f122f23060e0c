"""Observation families: densities, distribution functions, quantiles; scalar NumPy without SciPy, and pandas UDFs over them."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()
FAMILIES = ("gaussian", "student_t", "laplace", "poisson", "negative_binomial", "bernoulli", "beta", "log_normal")
DISCRETE = {"poisson", "negative_binomial", "bernoulli"}


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * lead
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - lead * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def _solve(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_ppf(p: float, df: float) -> float:
    hi = 10.0
    while t_cdf(hi, df) < max(p, 1 - p):
        hi *= 2
    return _solve(lambda x: t_cdf(x, df), p, -hi, hi)


def supports(family: str, y: float) -> bool:
    if family in ("poisson", "negative_binomial"):
        return y >= 0 and y == int(y)
    if family == "bernoulli":
        return y in (0, 1)
    if family == "beta":
        return 0 < y < 1
    return y > 0 if family == "log_normal" else math.isfinite(y)


def log_likelihood(family: str, y: float, p: dict[str, float]) -> float:
    """Log density or mass; -inf outside the support."""
    if not supports(family, y):
        return -math.inf
    if family in ("gaussian", "log_normal"):
        x = math.log(y) if family == "log_normal" else y
        z = (x - p["location"]) / p["scale"]
        return -0.5 * z * z - math.log(p["scale"] * math.sqrt(2 * math.pi)) - (x if family == "log_normal" else 0)
    if family == "student_t":
        v, z = p["df"], (y - p["location"]) / p["scale"]
        return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(p["scale"]) - (v + 1) / 2 * math.log1p(z * z / v)
    if family == "laplace":
        return -abs(y - p["location"]) / p["scale"] - math.log(2 * p["scale"])
    if family == "poisson":
        return y * math.log(p["rate"]) - p["rate"] - math.lgamma(y + 1)
    if family == "negative_binomial":
        r, q = p["dispersion"], p["dispersion"] / (p["dispersion"] + p["mean"])
        return math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) + r * math.log(q) + (y * math.log1p(-q) if y else 0.0)
    if family == "bernoulli":
        q = p["probability"] if y == 1 else 1 - p["probability"]
        return math.log(q) if q > 0 else -math.inf
    if family == "beta":
        a, b = p["alpha"], p["beta"]
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(y) + (b - 1) * math.log1p(-y)
    raise ValueError(f"unknown family: {family}")


def cdf(family: str, y: float, p: dict[str, float]) -> float:
    if family == "gaussian":
        return _N.cdf((y - p["location"]) / p["scale"])
    if family == "log_normal":
        return 0.0 if y <= 0 else _N.cdf((math.log(y) - p["location"]) / p["scale"])
    if family == "student_t":
        return t_cdf((y - p["location"]) / p["scale"], p["df"])
    if family == "laplace":
        z = (y - p["location"]) / p["scale"]
        return 0.5 * math.exp(z) if z < 0 else 1 - 0.5 * math.exp(-z)
    if family == "poisson":
        return 0.0 if y < 0 else 1 - gamma_p(math.floor(y) + 1, p["rate"])
    if family == "negative_binomial":
        return 0.0 if y < 0 else beta_i(p["dispersion"], math.floor(y) + 1, p["dispersion"] / (p["dispersion"] + p["mean"]))
    if family == "bernoulli":
        return 0.0 if y < 0 else 1.0 if y >= 1 else 1 - p["probability"]
    if family == "beta":
        return beta_i(p["alpha"], p["beta"], y)
    raise ValueError(f"unknown family: {family}")


def ppf(family: str, q: float, p: dict[str, float]) -> float:
    if family == "gaussian":
        return p["location"] + p["scale"] * _N.inv_cdf(q)
    if family == "log_normal":
        return math.exp(p["location"] + p["scale"] * _N.inv_cdf(q))
    if family == "student_t":
        return p["location"] + p["scale"] * t_ppf(q, p["df"])
    if family == "laplace":
        return p["location"] + p["scale"] * (math.log(2 * q) if q < 0.5 else -math.log(2 * (1 - q)))
    if family == "beta":
        return _solve(lambda x: cdf(family, x, p), q, 0.0, 1.0)
    lo, hi = -1, 1
    while cdf(family, hi, p) < q:
        lo, hi = hi, hi * 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if cdf(family, mid, p) < q else (lo, mid)
    return float(hi)


def survival(family: str, y: float, p: dict[str, float]) -> float:
    return 1 - cdf(family, y, p)


def interval(family: str, coverage: float, p: dict[str, float]) -> tuple[float, float]:
    tail = (1 - coverage) / 2
    return ppf(family, tail, p), ppf(family, 1 - tail, p)


def pit(family: str, y: float, p: dict[str, float], key: str | None = None, seed: str = "0") -> float:
    """Probability integral transform; for discrete families with a key, uniform between the step's ends (seeded by a hash of the key)."""
    upper = cdf(family, y, p)
    if family not in DISCRETE or key is None:
        return upper
    lower = cdf(family, y - 1, p)
    u = int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big") / 2**64
    return lower + u * (upper - lower)


def mixture_log_likelihood(y: float, parts: list[tuple[float, str, dict[str, float]]]) -> float:
    """log sum of weight x likelihood; parts: (weight, family, parameters)."""
    terms = [math.log(w) + log_likelihood(f, y, p) for w, f, p in parts if w > 0]
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def gaussian_crps(y: float, location: float, scale: float) -> float:
    z = (y - location) / scale
    return scale * (z * (2 * _N.cdf(z) - 1) + 2 * _N.pdf(z) - 1 / math.sqrt(math.pi))


def _udf(fn):
    @F.pandas_udf("double")
    def run(family: pd.Series, y: pd.Series, params: pd.Series) -> pd.Series:
        own = lambda m: {k: v for k, v in (m.items() if isinstance(m, dict) else m)}
        return pd.Series([None if pd.isna(v) else fn(f, float(v), own(m)) for f, v, m in zip(family, y, params)], dtype="float64")

    return run


def log_score(family: Column, y: Column, params: Column) -> Column:
    """Negative log likelihood of any family; params: MAP<STRING, DOUBLE>. Closed forms have columns of their own below."""
    return _udf(lambda f, v, p: -log_likelihood(f, v, p))(family, y, params)


def pit_column(family: Column, y: Column, params: Column) -> Column:
    return _udf(pit)(family, y, params)


def cdf_column(family: Column, y: Column, params: Column) -> Column:
    return _udf(cdf)(family, y, params)


def quantile_column(family: Column, level: Column, params: Column) -> Column:
    return _udf(ppf)(family, level, params)


def survival_column(family: Column, threshold: Column, params: Column) -> Column:
    return _udf(survival)(family, threshold, params)


#: Hart's rational approximation of the normal distribution function (1968, as in West 2005): numerator and denominator, highest power first.
HART_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a column, exact to 1e-14 (Spark has no error function)."""
    x = F.abs(z)

    def horner(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for v in c[1:]:
            out = out * x + v
        return out

    bell = F.exp(-x * x / 2)
    far = bell / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / math.sqrt(2 * math.pi)
    tail = F.when(x > 37, 0.0).when(x < 7.07106781186547, bell * horner(HART_ABOVE) / horner(HART_BELOW)).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def crps(y: Column, location: Column, scale: Column) -> Column:
    """Gaussian CRPS in closed form."""
    z = (y - location) / scale
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return scale * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi))


def gaussian_pit(y: Column, location: Column, scale: Column) -> Column:
    return normal_cdf((y - location) / scale)


def student_t_log_score(y: Column, location: Column, scale: Column, df: float) -> Column:
    """The degrees of freedom are one number of the model, so their gamma functions are literals."""
    z = (y - location) / scale
    constant = math.lgamma(df / 2) - math.lgamma((df + 1) / 2) + 0.5 * math.log(df * math.pi)
    return constant + F.log(scale) + (df + 1) / 2 * F.log1p(z * z / df)


def laplace_log_score(y: Column, location: Column, scale: Column) -> Column:
    return F.abs(y - location) / scale + F.log(2 * scale)


def gaussian_log_score(y: Column, location: Column, scale: Column) -> Column:
    z = (y - location) / scale
    return z * z / 2 + F.log(scale * math.sqrt(2 * math.pi))


def laplace_cdf(y: Column, location: Column, scale: Column) -> Column:
    z = (y - location) / scale
    return F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2)


def residual_scale(residuals, by: list[str], family: str, floor: float = 1e-9):
    """Location and scale of residuals: mean and population deviation, or for laplace median and mean absolute deviation."""
    if family == "laplace":
        mid = residuals.groupBy(*by).agg(F.expr("percentile(residual, 0.5)").alias("location"), F.count("*").alias("n"))
        dev = residuals.join(mid, by).groupBy(*by, "location", "n").agg(F.avg(F.abs(F.col("residual") - F.col("location"))).alias("scale"))
        return dev.withColumn("scale", F.greatest("scale", F.lit(floor)))
    m = residuals.groupBy(*by).agg(F.avg("residual").alias("location"), F.stddev_pop("residual").alias("scale"), F.count("*").alias("n"))
    return m.withColumn("scale", F.greatest("scale", F.lit(floor)))


def horizon_scale(scale: Column, horizon: Column, law: str) -> Column:
    """constant, sqrt_horizon or linear_horizon growth of a scale."""
    if law == "constant":
        return scale
    return scale * (F.sqrt(horizon.cast("double")) if law == "sqrt_horizon" else horizon)
