"""Model fits as window and group aggregates; Python only where a fit is a search.

Series are tables (entity, idx, target). Closed-form families are fitted at every origin at once by
running sums, so no fold is looped over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Season of the certified seasonal family.
SEASON = 2
FAMILIES = ("constant", "drift", "linear_trend", "seasonal_naive")


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def expanding_fits(indexed: DataFrame) -> DataFrame:
    """At every row: parameters of the four certified families fitted on rows 0..idx, in one sort per entity."""
    w = Window.partitionBy("entity").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    by = Window.partitionBy("entity").orderBy("idx")
    x, y = F.col("idx").cast("double"), F.col("target")
    n = F.col("idx") + 1
    out = indexed.select("entity", "idx", "target", F.avg(y).over(w).alias("mean"), F.first(y).over(w).alias("first"), F.sum(x * y).over(w).alias("_xy"), F.sum(y).over(w).alias("_y"), F.coalesce(F.lag(y, SEASON - 1).over(by), y).alias("seasonal_anchor"))
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    out = out.withColumn("drift_slope", F.when(n == 1, 0.0).otherwise((y - F.col("first")) / F.when(n > 1, n - 1)))
    out = out.withColumn("trend_slope", _safe_ratio(n * F.col("_xy") - sx * F.col("_y"), (n * sxx - sx * sx).cast("double")))
    out = out.withColumn("trend_intercept", (F.col("_y") - F.col("trend_slope") * sx) / n)
    return out.drop("_xy", "_y")


def family_forecasts(fits: DataFrame, steps: int = 1) -> DataFrame:
    """One row for each fit, family and step 1..steps: family, step, forecast."""
    at = lambda s: F.col("idx") + s
    family = lambda name, c: F.struct(F.lit(name).alias("family"), c.cast("double").alias("forecast"))
    one = lambda s: F.array(
        family("constant", F.col("mean")), family("drift", F.col("first") + F.col("drift_slope") * at(s)),
        family("linear_trend", F.col("trend_intercept") + F.col("trend_slope") * at(s)), family("seasonal_naive", F.col("seasonal_anchor")),
    )
    out = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_f", F.explode(one(F.col("step"))))
    return out.select("entity", F.col("idx").alias("origin_index"), "step", F.col("_f.family").alias("family"), F.col("_f.forecast").alias("forecast"))


def fitted_values(indexed: DataFrame) -> DataFrame:
    """In-sample values of the four families on whole series; the seasonal one copies its first season."""
    whole = Window.partitionBy("entity")
    by = Window.partitionBy("entity").orderBy("idx")
    x, y = F.col("idx").cast("double"), F.col("target")
    n = F.count("*").over(whole)
    first, last = F.min_by("target", "idx").over(whole), F.max_by("target", "idx").over(whole)
    out = indexed.select("entity", "idx", "target", n.alias("n"), F.avg(y).over(whole).alias("ym"), first.alias("first"), last.alias("last"), F.sum(x * y).over(whole).alias("xy"), F.coalesce(F.lag(y, SEASON).over(by), y).alias("seasonal"))
    n, sx = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    sxx = n * (n - 1) * (2 * n - 1) / 6
    slope = _safe_ratio(n * F.col("xy") - sx * F.col("ym") * n, (n * sxx - sx * sx).cast("double"))
    drift = F.when(n == 1, 0.0).otherwise((F.col("last") - F.col("first")) / F.when(n > 1, n - 1))
    xm = (n - 1) / 2
    family = lambda name, c, k: F.struct(F.lit(name).alias("family"), c.cast("double").alias("fitted"), F.lit(k).alias("n_parameters"))
    return out.select(
        "entity", "idx", "target",
        F.explode(F.array(
            family("constant", F.col("ym"), 1), family("drift", F.col("first") + drift * F.col("idx"), 2),
            family("linear_trend", F.col("ym") - slope * xm + slope * F.col("idx"), 2), family("seasonal_naive", F.col("seasonal"), 2),
        )).alias("f"),
    ).select("entity", "idx", "target", "f.family", "f.fitted", "f.n_parameters")


def affine_fit(rows: DataFrame, by: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """Weighted affine fit y = a + b x of each group from moments; without variance of x the slope is 0 and a the mean."""
    w = F.lit(1.0) if weight is None else weight
    r = rows.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), w.alias("_w"))
    m = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_x")).alias("sx"), F.sum(F.col("_w") * F.col("_y")).alias("sy"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("sxy"))
    var = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(var) <= 1e-9 * F.abs(F.col("sw") * F.col("sxx")), 0.0).otherwise((F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(var != 0, var))
    return m.withColumn("slope", slope).select(*by, "n", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"), "slope")


def ar1_pairs(indexed: DataFrame) -> DataFrame:
    """Each row with its predecessor's value as ``lag_1``."""
    return indexed.withColumn("lag_1", F.lag("target").over(Window.partitionBy("entity").orderBy("idx"))).where(F.col("lag_1").isNotNull())


def direct_pairs(indexed: DataFrame, horizons: int) -> DataFrame:
    """(entity, horizon, origin_value, realized) of every origin and step, by leads in one sort."""
    w = Window.partitionBy("entity").orderBy("idx")
    ahead = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead("target", h).over(w).alias("realized")) for h in range(1, horizons + 1)))
    out = indexed.select("entity", "idx", F.col("target").alias("origin_value"), ahead.alias("_a")).withColumn("_h", F.explode("_a"))
    return out.select("entity", "idx", "origin_value", "_h.horizon", "_h.realized").where(F.col("realized").isNotNull())


def recursive_affine(origin: Column, a: Column, b: Column, steps: Column) -> Column:
    """a + b(a + b(...origin)) after ``steps`` steps."""
    return F.aggregate(F.sequence(F.lit(1), steps), origin, lambda y, _: a + b * y)


def rectified_fit(indexed: DataFrame, horizons: int) -> DataFrame:
    """Base affine AR(1) of each entity, and by horizon the mean error of its recursion."""
    base = affine_fit(ar1_pairs(indexed), ["entity"], "lag_1", "target")
    pairs = direct_pairs(indexed, horizons).join(base, "entity")
    err = F.col("realized") - recursive_affine(F.col("origin_value"), F.col("intercept"), F.col("slope"), F.col("horizon"))
    return pairs.withColumn("_e", err).groupBy("entity", "horizon").agg(F.first("intercept").alias("intercept"), F.first("slope").alias("slope"), F.avg("_e").alias("correction"))


def running_mean(indexed: DataFrame) -> DataFrame:
    """One-step forecasts of the running mean: the mean of all earlier rows (none for the first)."""
    w = Window.partitionBy("entity").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return indexed.withColumn("forecast", F.avg("target").over(w)).where(F.col("forecast").isNotNull())


#: 0.05, 0.10, ... 0.95
ALPHAS = [i / 20 for i in range(1, 20)]


def smoothing_grid(indexed: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """Exponential smoothing at each alpha: squared one-step loss and final level; then the best alpha of each entity (ties: smaller)."""
    alphas = ALPHAS if alphas is None else alphas
    series = indexed.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("idx", "target"))).alias("_s"))
    series = series.select("entity", F.transform("_s", lambda s: s["target"]).alias("_y")).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    start = F.struct(F.element_at("_y", 1).alias("level"), F.lit(0.0).alias("loss"))
    step = lambda s, y: F.struct((s["level"] + F.col("alpha") * (y - s["level"])).alias("level"), (s["loss"] + (y - s["level"]) * (y - s["level"])).alias("loss"))
    out = series.withColumn("_r", F.aggregate(F.slice("_y", 2, F.greatest(F.size("_y") - 1, F.lit(0))), start, step))
    out = out.select("entity", "alpha", F.col("_r.level").alias("level"), F.col("_r.loss").alias("loss"))
    return out.withColumn("best", F.row_number().over(Window.partitionBy("entity").orderBy("loss", "alpha")) == 1)


def spectral_fit(indexed: DataFrame, harmonics: list[int], season: int) -> DataFrame:
    """Least squares of the target on cos and sin of each harmonic (phase by row position), by the 2x2 normal equations."""
    rows = indexed.withColumn("harmonic", F.explode(F.array(*map(F.lit, harmonics))))
    phase = F.lit(2 * np.pi) * F.col("harmonic") * F.col("idx") / season
    c, s, y = F.cos(phase), F.sin(phase), F.col("target")
    m = rows.groupBy("entity", "harmonic").agg(F.sum(c * c).alias("cc"), F.sum(c * s).alias("cs"), F.sum(s * s).alias("ss"), F.sum(c * y).alias("cy"), F.sum(s * y).alias("sy"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    ok = F.abs(det) > 1e-9
    det = F.when(ok, det)
    cosine = F.coalesce((F.col("ss") * F.col("cy") - F.col("cs") * F.col("sy")) / det, F.when(F.col("cc") > 1e-9, F.col("cy") / F.col("cc")), F.lit(0.0))
    sine = F.coalesce((F.col("cc") * F.col("sy") - F.col("cs") * F.col("cy")) / det, F.lit(0.0))
    return m.select("entity", "harmonic", cosine.alias("cosine"), sine.alias("sine"))


def fourier(indexed: DataFrame, harmonics: int) -> DataFrame:
    """Truncated real DFT of each series: coefficient of each harmonic 0..harmonics."""
    sized = indexed.withColumn("n", F.count("*").over(Window.partitionBy("entity")))
    rows = sized.withColumn("harmonic", F.explode(F.sequence(F.lit(0), F.lit(harmonics)))).where(F.col("harmonic") <= F.floor(F.col("n") / 2))
    phase = F.lit(2 * np.pi) * F.col("harmonic") * F.col("idx") / F.col("n")
    scale = F.when((F.col("harmonic") == 0) | (2 * F.col("harmonic") == F.col("n")), 1.0).otherwise(2.0) / F.col("n")
    return rows.groupBy("entity", "harmonic", "n").agg((F.sum(F.col("target") * F.cos(phase) * scale)).alias("cosine"), (F.sum(F.col("target") * F.sin(phase) * scale)).alias("sine"))


def fourier_values(indexed: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Reconstruction from Fourier coefficients; exact with all harmonics."""
    rows = indexed.join(coefficients, "entity")
    phase = F.lit(2 * np.pi) * F.col("harmonic") * F.col("idx") / F.col("n")
    return rows.groupBy("entity", "idx", "target").agg(F.sum(F.col("cosine") * F.cos(phase) + F.col("sine") * F.sin(phase)).alias("fitted"))


def piecewise_fit(indexed: DataFrame, threshold: Column) -> DataFrame:
    """Affine AR(1) of the rows whose lag lies below the threshold and of the others."""
    pairs = ar1_pairs(indexed).withColumn("branch", F.when(F.col("lag_1") < threshold, "below").otherwise("above"))
    return affine_fit(pairs, ["entity", "branch"], "lag_1", "target")


def additive_residual_fit(indexed: DataFrame) -> DataFrame:
    """Affine AR(1), then an affine fit of its residuals on the previous residual (0 before the first)."""
    pairs = ar1_pairs(indexed)
    base = affine_fit(pairs, ["entity"], "lag_1", "target").withColumnsRenamed({"intercept": "base_intercept", "slope": "base_slope"}).drop("n")
    res = pairs.join(base, "entity").withColumn("residual", F.col("target") - F.col("base_intercept") - F.col("base_slope") * F.col("lag_1"))
    res = res.withColumn("residual_lag_1", F.lag("residual", 1, 0.0).over(Window.partitionBy("entity").orderBy("idx")))
    return affine_fit(res, ["entity"], "residual_lag_1", "residual").join(base, "entity")


def regime_fit(indexed: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """Affine AR(1) of each branch under convex weights (weights are divided by their sum)."""
    total = sum(weights.values(), F.lit(0.0))
    pairs = ar1_pairs(indexed).withColumn("_b", F.explode(F.array(*(F.struct(F.lit(k).alias("branch"), (c / total).alias("weight")) for k, c in weights.items()))))
    return affine_fit(pairs.select("*", "_b.branch", "_b.weight"), ["entity", "branch"], "lag_1", "target", F.col("weight"))


def shared_local_fit(indexed: DataFrame) -> DataFrame:
    """Panel AR(1): each entity's own affine fit as the first entity's plus a local offset (a saturated joint fit)."""
    own = affine_fit(ar1_pairs(indexed), ["entity"], "lag_1", "target")
    ref = own.agg(F.min_by("intercept", "entity").alias("shared_intercept"), F.min_by("slope", "entity").alias("shared_slope"))
    out = own.crossJoin(F.broadcast(ref))
    return out.select("entity", "n", "shared_intercept", "shared_slope", (F.col("intercept") - F.col("shared_intercept")).alias("local_intercept"), (F.col("slope") - F.col("shared_slope")).alias("local_slope"))


def mean_offset_fit(indexed: DataFrame) -> DataFrame:
    """Panel mean and each entity's offset and squared error around it."""
    own = indexed.groupBy("entity").agg(F.count("*").alias("n"), F.sum("target").alias("s"), F.sum(F.col("target") * F.col("target")).alias("ss"))
    grand = own.agg((F.sum("s") / F.sum("n")).alias("grand_mean"))
    out = own.crossJoin(F.broadcast(grand))
    return out.select("entity", "n", "grand_mean", (F.col("s") / F.col("n") - F.col("grand_mean")).alias("offset"), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("sse"))


def joint_rollout_fit(indexed: DataFrame, horizons: int, rounds: int = 18) -> DataFrame:
    """Affine recursion chosen by pattern search on the mean squared error over all origins and horizons.

    3x3 neighbours; steps start at half the target range and 1; they halve when nothing improves by
    more than 1e-12.
    """

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        y = series.sort_values("idx")["target"].to_numpy()
        n = len(y) - horizons

        def loss(a: float, b: float) -> float:
            at, out = y[:n].copy(), 0.0
            for h in range(1, horizons + 1):
                at = a + b * at
                out += float(((y[h : n + h] - at) ** 2).mean())
            return out / horizons

        if n < 1:
            return pd.DataFrame({"entity": series["entity"].iloc[:1], "intercept": [float(y.mean())], "slope": [0.0], "loss": [0.0]})
        best = (loss(float(y.mean()), 0.0), float(y.mean()), 0.0)
        da, db = max(float(y.max() - y.min()) / 2, 1e-6), 1.0
        for _ in range(rounds):
            tries = [(loss(best[1] + i * da, best[2] + j * db), best[1] + i * da, best[2] + j * db) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            tries = [t for t in tries if np.isfinite(t[0])]
            found = min(tries) if tries else best
            if found[0] < best[0] - 1e-12:
                best = found
            else:
                da, db = da / 2, db / 2
        return pd.DataFrame({"entity": series["entity"].iloc[:1].to_numpy(), "intercept": [best[1]], "slope": [best[2]], "loss": [best[0]]})

    return indexed.select("entity", "idx", "target").groupBy("entity").applyInPandas(fit, "entity string, intercept double, slope double, loss double")


def least_squares_fit(rows: DataFrame, by: list[str], features: list[str], y: str, ridge: float = 0.0) -> DataFrame:
    """Ordinary least squares of any number of features: sufficient statistics by partial aggregates, a small solve per group."""
    xs = [F.lit(1.0), *(F.col(f) for f in features)]
    k = len(xs)
    moments = [F.sum(xs[i] * xs[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(xs[i] * F.col(y)).alias(f"v_{i}") for i in range(k)]
    m = rows.groupBy(*by).agg(F.count("*").alias("n"), *moments)

    @F.pandas_udf("array<double>")
    def solve(cols: pd.DataFrame) -> pd.Series:
        out = []
        for r in cols.to_dict("records"):
            a = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            a = a + ridge * np.diag([0.0] + [1.0] * (k - 1))
            out.append(np.linalg.lstsq(a, np.array([r[f"v_{i}"] for i in range(k)]), rcond=None)[0].tolist())
        return pd.Series(out)

    return m.select(*by, "n", solve(F.struct(*(c for c in m.columns if c not in {*by, "n"}))).alias("coefficients"))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float = 1e-6, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Cyclic coordinate descent of (1/2n)|y - b0 - xb|^2 + penalty |b|; returns intercept and coefficients."""
    xm, ym = x.mean(axis=0), y.mean()
    z, r = x - xm, y - ym
    b = np.zeros(x.shape[1])
    norm = (z * z).sum(axis=0) / len(y)
    for _ in range(rounds):
        moved = 0.0
        for j in range(x.shape[1]):
            if norm[j] == 0:
                continue
            old = b[j]
            rho = z[:, j] @ r / len(y) + norm[j] * old
            b[j] = np.sign(rho) * max(abs(rho) - penalty, 0.0) / norm[j]
            if b[j] != old:
                r = r - z[:, j] * (b[j] - old)
                moved = max(moved, abs(b[j] - old))
        if moved < tolerance:
            break
    return np.concatenate([[ym - xm @ b], b])


def sparse_fit(rows: DataFrame, by: list[str], features: list[str], y: str, penalty: float = 1e-6) -> DataFrame:
    """Lasso of each group."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        c = lasso(group[features].to_numpy(float), group[y].to_numpy(float), penalty)
        return pd.DataFrame({**{k: group[k].iloc[:1].to_numpy() for k in by}, "coefficients": [c.tolist()]})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.select(*by, *features, y).groupBy(*by).applyInPandas(fit, f"{keys}, coefficients array<double>")


def latent_fit(rows: DataFrame, by: list[str], features: list[str], y: str) -> DataFrame:
    """First principal component of the standardised features, then an affine fit on its score."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = group[features].to_numpy(float)
        z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        v = np.linalg.eigh(z.T @ z)[1][:, -1]
        v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
        s = z @ v
        t = group[y].to_numpy(float)
        b = 0.0 if s.var() == 0 else float(((s - s.mean()) * (t - t.mean())).mean() / s.var())
        return pd.DataFrame({**{k: group[k].iloc[:1].to_numpy() for k in by}, "loadings": [v.tolist()], "intercept": [float(t.mean() - b * s.mean())], "slope": [b]})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.select(*by, *features, y).groupBy(*by).applyInPandas(fit, f"{keys}, loadings array<double>, intercept double, slope double")
