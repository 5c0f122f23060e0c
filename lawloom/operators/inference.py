"""Statistical tests on loss differentials and series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawloom.functions.distributions import chi2_sf, t_cdf, t_ppf

#: Smallest effective sample sizes and block count of a decision.
MIN_N_EFF, REVIEW_N_EFF, MIN_BLOCKS = 25, 50, 8


def autocovariances(rows: DataFrame, by: list[str], order: str, value: str, max_lag: int) -> DataFrame:
    """Sums of (x_t - m)(x_{t-k} - m) for k = 0..max_lag of each group, by lags in one sort: by, n, lag, s."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_n", F.count("*").over(w)).withColumn("_d", F.col(value) - F.avg(value).over(w))
    lagged = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("_d") * F.lag("_d", k).over(w.orderBy(order))).alias("p")) for k in range(max_lag + 1)))
    return r.withColumn("_l", lagged).select(*by, "_n", F.explode("_l").alias("l")).groupBy(*by, F.col("_n").alias("n"), F.col("l.lag").alias("lag")).agg(F.coalesce(F.sum("l.p"), F.lit(0.0)).alias("s"))


def effective_sample_size(rows: DataFrame, by: list[str], order: str, value: str, max_lag: int) -> DataFrame:
    """n / max(1, 1 + 2 sum of autocorrelations), lags up to max(1, floor(sqrt n)) and at most max_lag; 6 places."""
    a = autocovariances(rows, by, order, value, max_lag)
    zero = F.sum(F.when(F.col("lag") == 0, F.col("s")))
    some = F.sum(F.when((F.col("lag") > 0) & (F.col("lag") <= F.greatest(F.lit(1), F.floor(F.sqrt("n")))) & (F.col("lag") < F.col("n")), F.col("s")))
    m = a.groupBy(*by, "n").agg(zero.alias("_z"), F.coalesce(some, F.lit(0.0)).alias("_s"))
    rho = F.when(F.col("_z") > 0, F.col("_s") / F.when(F.col("_z") > 0, F.col("_z"))).otherwise(0.0)
    return m.select(*by, "n", F.round(F.col("n") / F.greatest(F.lit(1.0), 1 + 2 * rho), 6).alias("n_eff"))


def pair_policy(n_eff: DataFrame, block_length: int) -> DataFrame:
    """abstain below the smallest sizes, human_review below the larger one, else run."""
    blocks = F.floor(F.col("n") / block_length)
    return n_eff.withColumn("blocks", blocks).withColumn("decision", F.when((F.col("n_eff") < MIN_N_EFF) | (blocks < MIN_BLOCKS), "abstain").when(F.col("n_eff") < REVIEW_N_EFF, "human_review").otherwise("run"))


def hac_mean_test(rows: DataFrame, by: list[str], order: str, value: str, max_lag: int) -> DataFrame:
    """Mean, Bartlett HAC error, t interval (n - 1 degrees) and two-sided p. Only one row per group reaches Python."""
    a = autocovariances(rows, by, order, value, max_lag)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (max_lag + 1)))
    v = a.groupBy(*by, "n").agg((F.sum(weight * F.col("s"))).alias("_v"))
    m = rows.groupBy(*by).agg(F.avg(value).alias("mean"))
    out = v.join(m, by).withColumn("standard_error", F.sqrt(F.greatest(F.col("_v"), F.lit(0.0))) / F.col("n"))

    @F.pandas_udf("struct<critical:double,p_value:double>")
    def tail(n: pd.Series, mean: pd.Series, se: pd.Series) -> pd.DataFrame:
        rows = []
        for k, m_, s in zip(n, mean, se):
            df = max(int(k) - 1, 1)
            rows.append((t_ppf(0.975, df), (0.0 if abs(m_) > 1e-15 else 1.0) if s <= 1e-15 else 2 * (1 - t_cdf(abs(m_ / s), df))))
        return pd.DataFrame(rows, columns=["critical", "p_value"])

    out = out.withColumn("_t", tail("n", "mean", "standard_error"))
    r = F.col("_t.critical") * F.col("standard_error")
    return out.select(*by, "n", "mean", "standard_error", (F.col("mean") - r).alias("lower"), (F.col("mean") + r).alias("upper"), F.col("_t.p_value").alias("p_value"))


def stationary_bootstrap(rows: DataFrame, by: list[str], order: str, value: str, block_length: int, count: int, seed: int, margin: float = 0.0) -> DataFrame:
    """Percentile interval of the mean from resamples of random circular blocks; p: share of means at or below the margin."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(order)[value].to_numpy(float)
        rng, n = np.random.default_rng(seed), len(x)
        means = np.empty(count)
        for b in range(count):
            jump = rng.random(n) >= 1 - 1 / max(1, block_length)
            jump[0] = True
            at = np.flatnonzero(jump)
            start = rng.integers(0, n, len(at))
            run_ = np.cumsum(jump) - 1
            means[b] = x[(start[run_] + np.arange(n) - at[run_]) % n].mean()
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({**{k: group[k].iloc[:1].to_numpy() for k in by}, "n": [n], "mean": [x.mean()], "lower": [lo], "upper": [hi], "p_value": [float((means <= margin).mean())]})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{keys}, n long, mean double, lower double, upper double, p_value double")


#: Tests by id; the last three never pass, as declared.
TESTS = {"diebold_mariano_hln": "hac", "stationary_block_bootstrap": "bootstrap", "giacomini_white_conditional_predictive_ability": "failed", "model_confidence_set": "abstained", "superior_predictive_ability": "abstained"}


def declared_test(test_id: str, rows: DataFrame, by: list[str], order: str, value: str, **options) -> DataFrame:
    """Run a declared test; ids without an implementation give their fixed status."""
    kind = TESTS.get(test_id)
    if kind == "hac":
        return hac_mean_test(rows, by, order, value, options.get("max_lag", 4))
    if kind == "bootstrap":
        return stationary_bootstrap(rows, by, order, value, options.get("block_length", 5), options.get("count", 200), options.get("seed", 0))
    if kind is None:
        raise ValueError(f"unknown test: {test_id}")
    return rows.select(*by).distinct().withColumn("status", F.lit(kind))


def ljung_box(rows: DataFrame, by: list[str], order: str, value: str, lags: int, alpha: float = 0.05) -> DataFrame:
    """Q = n(n+2) sum rho_k^2 / (n-k) and its chi-square tail."""
    a = autocovariances(rows, by, order, value, lags)
    zero = a.where("lag = 0").select(*by, F.col("s").alias("_z"))
    q = a.where("lag > 0").join(zero, by).groupBy(*by, "n").agg((F.col("n") * (F.col("n") + 2) * F.sum(F.pow(F.col("s") / F.col("_z"), 2) / (F.col("n") - F.col("lag")))).alias("q"))

    @F.pandas_udf("double")
    def tail(q: pd.Series) -> pd.Series:
        return q.map(lambda v: chi2_sf(v, lags))

    return q.withColumn("p_value", tail("q")).withColumn("white", F.col("p_value") > alpha)


def cusum(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Largest scaled partial sum of deviations from the mean, against 1.3581 (5 %)."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_d", F.col(value) - F.avg(value).over(w)).withColumn("_c", F.sum("_d").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    m = r.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs("_c")).alias("_m"), F.stddev_samp(value).alias("_s"))
    stat = F.col("_m") / (F.when(F.col("_s") > 0, F.col("_s")) * F.sqrt("n"))
    return m.select(*by, "n", stat.alias("statistic"), F.when(stat > 1.3581, "unstable").otherwise("stable").alias("status"))


def level_shifts(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Positions whose value differs from the one before."""
    p = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_p", p).where(F.col("_p").isNotNull() & (F.col(value) != F.col("_p"))).select(*by, F.col(order).alias("at"))


def change_points(rows: DataFrame, by: list[str], order: str, value: str, penalty: float | None = None, least: int = 2) -> DataFrame:
    """PELT for mean shifts: exact minimiser of squared error plus a penalty for each change, of each series.

    Without a penalty a change costs the series' own noise (half the variance of its first differences)
    times the logarithm of its length, so the unit of the values doesn't matter. A series of under two
    segments has no change.
    """

    def run(group: pd.DataFrame, penalty: float | None = penalty) -> pd.DataFrame:
        x = group.sort_values(order)[value].to_numpy(float)
        n = len(x)
        if penalty is None:
            penalty = float(np.var(np.diff(x)) / 2 * np.log(n)) if n > 1 else 0.0
        s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
        cost = np.full(n + 1, np.inf)
        cost[0], back, live = -penalty, np.zeros(n + 1, int), np.array([0])
        for t in range(least, n + 1):
            ok = live[t - live >= least]
            seg = q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (t - ok)
            total = cost[ok] + seg + penalty
            k = int(total.argmin())
            cost[t], back[t] = total[k], ok[k]
            live = np.append(np.concatenate([ok[cost[ok] + seg <= cost[t]], live[t - live < least]]), t)
        out, t = [], n
        while n and back[t] > 0:
            t = back[t]
            out.append(int(t))
        return pd.DataFrame({**{k: np.repeat(group[k].iloc[:1].to_numpy(dtype=object), len(out)) for k in by}, "at": np.array(sorted(out), np.int64)})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    return rows.select(*by, order, value).groupBy(*by).applyInPandas(lambda group: run(group), f"{keys}, at long")


def local_level(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Local-level model of each series: signal-to-noise ratio by likelihood over a grid, filtered and smoothed levels, innovations."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        y = g[value].to_numpy(float)
        n = len(y)

        def pass_(ratio: float):
            a, p = y[0], 1.0 + ratio
            level, var, innov, scale = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
            level[0], var[0], innov[0], scale[0] = y[0], 1.0, 0.0, 1.0
            for t in range(1, n):
                p = var[t - 1] + ratio
                f = p + 1
                innov[t], scale[t] = y[t] - level[t - 1], f
                level[t], var[t] = level[t - 1] + p / f * innov[t], p / f
            s2 = float((innov[1:] ** 2 / scale[1:]).mean()) if n > 1 else 1.0
            return level, var, innov, scale, max(s2, 1e-300), -0.5 * ((n - 1) * math.log(max(s2, 1e-300)) + float(np.log(scale[1:]).sum()))

        ratio = max((10 ** (k / 4) for k in range(-16, 9)), key=lambda r: pass_(r)[5])
        level, var, innov, scale, s2, _ = pass_(ratio)
        smooth = level.copy()
        for t in range(n - 2, -1, -1):
            smooth[t] += var[t] / (var[t] + ratio) * (smooth[t + 1] - level[t])
        return pd.DataFrame({**{k: g[k].to_numpy() for k in by}, order: g[order].to_numpy(), "level": level, "smoothed": smooth, "innovation": innov / np.sqrt(scale * s2), "ratio": ratio})

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*by, order])
    return rows.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{keys}, level double, smoothed double, innovation double, ratio double")


def regime_switching(rows: DataFrame, by: list[str], order: str, value: str, regimes: int = 2, rounds: int = 60) -> DataFrame:
    """Markov-switching means and variances by EM (deterministic start at quantiles): smoothed probability of each row and regime, regimes by rising mean."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        y = g[value].to_numpy(float)
        n, k = len(y), regimes
        mu = np.quantile(y, (np.arange(k) + 0.5) / k)
        var = np.full(k, max(y.var() / k, 1e-9))
        trans, start = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), np.full(k, 1 / k)
        post = np.full((n, k), 1 / k)
        for _ in range(rounds):
            like = np.exp(-0.5 * (y[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
            f, c = np.empty((n, k)), np.empty(n)
            for t in range(n):
                f[t] = (start if t == 0 else f[t - 1] @ trans) * like[t]
                c[t] = f[t].sum()
                f[t] /= c[t]
            b = np.ones((n, k))
            for t in range(n - 2, -1, -1):
                b[t] = trans @ (like[t + 1] * b[t + 1]) / c[t + 1]
            post = f * b
            post /= post.sum(axis=1, keepdims=True)
            pairs = np.zeros((k, k))
            for t in range(n - 1):
                pairs += f[t][:, None] * trans * (like[t + 1] * b[t + 1])[None, :] / c[t + 1]
            start, trans = post[0], pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1e-300)
            weight = np.maximum(post.sum(axis=0), 1e-12)
            mu = (post * y[:, None]).sum(axis=0) / weight
            var = np.maximum((post * (y[:, None] - mu) ** 2).sum(axis=0) / weight, 1e-9)
        rank = np.argsort(mu, kind="stable")
        out = [pd.DataFrame({**{c_: g[c_].to_numpy() for c_ in by}, order: g[order].to_numpy(), "regime": i, "probability": post[:, r], "regime_mean": mu[r]}) for i, r in enumerate(rank)]
        return pd.concat(out)

    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*by, order])
    return rows.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{keys}, regime int, probability double, regime_mean double")


def regime_identifiability(probabilities: DataFrame, values: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Posterior-weighted mean of each regime, smallest separation and mean confidence of each series."""
    j = probabilities.join(values.select(*by, order, value), [*by, order])
    m = j.groupBy(*by, "regime").agg((F.sum(F.col("probability") * F.col(value)) / F.sum("probability")).alias("m"))
    sep = m.withColumn("_d", F.abs(F.col("m") - F.lag("m").over(Window.partitionBy(*by).orderBy("m")))).groupBy(*by).agg(F.min("_d").alias("min_separation"))
    conf = j.groupBy(*by, order).agg(F.max("probability").alias("_p")).groupBy(*by).agg(F.avg("_p").alias("mean_confidence"))
    return sep.join(conf, by)


def posterior_calibration(probabilities: DataFrame, truth: DataFrame, by: list[str], order: str) -> DataFrame:
    """Multiclass Brier score and argmax accuracy of regime probabilities (truth: regime of each row)."""
    j = probabilities.join(truth.select(*by, order, F.col("regime").alias("_true")), [*by, order])
    hit = (F.col("regime") == F.col("_true")).cast("double")
    rows = j.groupBy(*by, order).agg(F.sum(F.pow(F.col("probability") - hit, 2)).alias("_b"), F.max_by("regime", "probability").alias("_r"), F.max("_true").alias("_t"))
    return rows.groupBy(*by).agg(F.avg("_b").alias("brier"), F.avg((F.col("_r") == F.col("_t")).cast("double")).alias("accuracy"))


def latent_recovery(levels: DataFrame, truth: DataFrame, by: list[str], order: str) -> DataFrame:
    """Root mean square and largest error of smoothed levels against a known truth."""
    e = F.col("smoothed") - F.col("latent")
    return levels.join(truth, [*by, order]).groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs_error"))


#: Conformal methods: what each assumes and guarantees. No interval is computed here.
CONFORMAL = {
    "split_conformal": {"assumptions": ["exchangeability"], "guarantee": "marginal_coverage"},
    "weighted_conformal": {"assumptions": ["known_likelihood_ratio"], "guarantee": "weighted_marginal_coverage"},
    "adaptive_conformal": {"assumptions": [], "guarantee": "long_run_coverage"},
}


def resolve_conformal_method(method_id: str, declared: list[str], split_id: str | None) -> dict:
    """Status of a declared method: blocked without its split or assumptions."""
    own = CONFORMAL.get(method_id)
    reasons = [] if own else ["unknown_conformal_method"]
    if own:
        reasons = [f"missing_assumption:{a}" for a in own["assumptions"] if a not in declared] + ([] if split_id else ["missing_calibration_split"])
    return {"method_id": method_id, "status": "blocked" if reasons else "resolved", "guarantee": own["guarantee"] if own and not reasons else None, "reason_codes": reasons}
