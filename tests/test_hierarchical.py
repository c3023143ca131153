"""The sampled model on simulated counts, its parts against plain sums, and the convergence diagnostics."""

import logging
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import diagnostics, folds, hierarchical
from tidewatch.plans import pipeline

TRUTH = {"beta[a]": 0.3, "beta[b]": -0.2, "rho": 0.8, "sigma_z": 0.3, "sigma_alpha": 0.4, "alpha_nb": 2.0}


def simulated(districts=40, times=60, seed=0):
    rng = np.random.default_rng(seed)
    z = np.zeros(times)
    z[0] = 0.35 * rng.normal()
    for t in range(1, times):
        z[t] = TRUTH["rho"] * z[t - 1] + TRUTH["sigma_z"] * rng.normal()
    alpha = 0.8 + TRUTH["sigma_alpha"] * rng.normal(size=districts)
    x = rng.normal(size=(districts, times, 2))
    mu = np.exp(alpha[:, None] + x @ [0.3, -0.2] + z)
    y = rng.negative_binomial(2.0, 2.0 / (2.0 + mu))
    frame = pd.DataFrame({"district": np.repeat([f"d{i}" for i in range(districts)], times), "date": np.tile(pd.date_range("2015-01-05", periods=times, freq="7D"), districts), "cases": y.ravel(), "a": x[:, :, 0].ravel(), "b": x[:, :, 1].ravel()})
    return frame, alpha, z


@pytest.fixture(scope="module")
def panel(spark):
    frame, alpha, z = simulated()
    return spark.createDataFrame(frame).withColumn("date", F.to_date("date")).repartition(4).persist(), alpha, z


@pytest.fixture(scope="module")
def fitted(panel):
    return hierarchical.fit(panel[0], "cases", ["a", "b"], seed=3)


def shares_within(spark, draws, truth, q=0.05):
    got = draws.groupBy("parameter").agg(F.percentile("value", F.lit(q)).alias("lo"), F.percentile("value", F.lit(1 - q)).alias("hi")).collect()
    return np.mean([r.lo <= truth[r.parameter] <= r.hi for r in got if r.parameter in truth])


def test_simulated_parameters_lie_in_their_intervals(spark, panel, fitted):
    df, alpha, z = panel
    assert fitted.common.where("parameter = 'rho'").count() == 600 and fitted.diagnostics["simplified_mode"] == 0 and not fitted.diagnostics["retried"]
    assert fitted.diagnostics["r_hat_max"] < 1.1 and fitted.diagnostics["ess_min"] > 60 and fitted.diagnostics["passes"] < 120
    assert shares_within(spark, fitted.common, TRUTH, 0.01) == 1
    dates = sorted({r[0] for r in df.select("date").distinct().collect()})
    assert shares_within(spark, fitted.common, {f"z[{d}]": v for d, v in zip(dates, z, strict=True)}) > 0.75
    effects = hierarchical.district_draws(fitted).select(F.col("district").alias("parameter"), F.col("effect").alias("value"))
    assert effects.count() == 40 * 600
    assert shares_within(spark, effects, {f"d{i}": a for i, a in enumerate(alpha)}) > 0.75


def test_likelihood_and_curvature_are_sums_over_districts(panel):
    """Against quadrature on a wide grid, district by district, and derivatives by differences."""
    df = panel[0].where("district IN ('d0', 'd1', 'd2') AND date < '2015-03-01'")
    data = hierarchical.prepare(df.withColumn("date", F.when(F.col("a") < 1.3, F.col("date"))), "cases", ["a", "b"])
    k = data.n_times
    rng = np.random.default_rng(1)
    v = 0.3 * rng.normal(size=(3, k + 2 + 3))
    rows = df.withColumn("date", F.when(F.col("a") < 1.3, F.col("date"))).toPandas()
    place = {t: i for i, t in enumerate(data.times)}
    x = np.array([(rows[c] - m) / s for c, (m, s) in zip(["a", "b"], data.scales, strict=True)]).T

    def plain(u):
        z = np.append(u[:k] - u[:k].mean(), 0.0)
        mu, sigma, r = u[-3], math.exp(u[-2]), math.exp(u[-1])
        eta = z[[place.get(t, k) for t in rows["date"]]] + x @ u[k : k + 2]
        grid, total = np.linspace(mu - 8 * sigma, mu + 8 * sigma, 4001), 0.0
        for d in ("d0", "d1", "d2"):
            at = (rows["district"] == d).to_numpy()
            y, e = rows["cases"].to_numpy(float)[at], eta[at]
            m = np.exp(grid[:, None] + e)
            const = sum(math.lgamma(a + r) - math.lgamma(r) - math.lgamma(a + 1) for a in y)
            ll = const + (r * np.log(r / (r + m)) + y * np.log(m / (r + m))).sum(1) - 0.5 * ((grid - mu) / sigma) ** 2 - math.log(sigma * math.sqrt(2 * math.pi))
            total += ll.max() + math.log(np.exp(ll - ll.max()).sum() * (grid[1] - grid[0]))
        return total

    got = hierarchical.likelihoods(data, v)
    assert np.allclose(got, [plain(u) for u in v], rtol=1e-6)
    g, a = hierarchical.curvature(data, v[0])
    h = 1e-4
    for i in (k, k + 1):  # beta; z's derivatives are those of centred effects
        e = np.eye(k + 5)[i] * h
        slope = (plain(v[0] + e) - plain(v[0] - e)) / (2 * h)
        bend = -(plain(v[0] + e) - 2 * plain(v[0]) + plain(v[0] - e)) / h**2
        assert math.isclose(slope, g[i], rel_tol=1e-3, abs_tol=1e-3) and math.isclose(bend, a[i, i], rel_tol=1e-2, abs_tol=1e-2)
    e = np.zeros(k + 5)
    e[0], e[1] = h, -h  # keeps the mean
    assert math.isclose((plain(v[0] + e) - plain(v[0] - e)) / (2 * h), g[0] - g[1], rel_tol=1e-3, abs_tol=1e-3)
    assert math.isclose(-(plain(v[0] + e) - 2 * plain(v[0]) + plain(v[0] - e)) / h**2, a[0, 0] + a[1, 1] - 2 * a[0, 1], rel_tol=1e-2, abs_tol=1e-2)
    assert np.allclose(hierarchical.log_gamma(np.array([1e-3, 0.5, 1, 7.3, 400])), [math.lgamma(q) for q in (1e-3, 0.5, 1, 7.3, 400)])


def test_poor_diagnostics_drop_the_time_effect_once(panel, caplog):
    limits = {"divergences": 20.0, "r_hat": 1.0, "ess": 1e9}
    small = panel[0].where("date < '2015-06-01'")
    with caplog.at_level(logging.WARNING):
        out = hierarchical.fit(small, "cases", ["a"], limits=limits, chains=2, tune=40, draws=40)
    assert out.diagnostics["retried"] and out.diagnostics["simplified_mode"] == 1.0 and "once more" in caplog.text
    assert {r[0] for r in out.common.select("parameter").distinct().collect()} == {"beta[a]", "mu_alpha", "sigma_alpha", "alpha_nb"}
    for stays in ({"force_full": True, "simplified": True}, {"retries": 0}):
        kept = hierarchical.fit(small, "cases", [], limits=limits, chains=1, tune=20, draws=20, **stays)
        assert kept.diagnostics["simplified_mode"] == 0.0 and not kept.diagnostics["retried"]


def test_counts_without_dates(spark):
    """More than 100,000 rows of two districts, without dates; and what nulls, negatives and one row give."""
    df = spark.range(150_000).selectExpr("IF(id % 2 = 0, 'low', 'high') AS district", "cast(IF(id % 2 = 0, id % 3, 8 + id % 9) AS double) AS y")
    fitted = hierarchical.fit(df, "y", [], date=None, tune=100, draws=100)
    mean = {r.district: math.exp(r.m) for r in hierarchical.district_draws(fitted).groupBy("district").agg(F.avg("effect").alias("m")).collect()}
    assert abs(mean["low"] - 1) < 0.05 and abs(mean["high"] - 12) < 0.2
    odd = spark.createDataFrame([(None, "2020-01-01", None, None), (None, None, -3.0, 1.0), ("a", "2020-01-08", 2.4, float("nan"))], "district string, date string, y double, c double").withColumn("c", F.nanvl("c", F.lit(None).cast("double")))
    out = hierarchical.fit(odd, "y", ["c"], chains=2, tune=20, draws=20)
    assert {r[0] for r in hierarchical.district_draws(out).select("district").distinct().collect()} == {"unknown", "a"}
    with pytest.raises(ValueError):
        hierarchical.fit(odd.limit(0), "y", ["c"])


def test_risk_of_folds_by_profile(spark, panel):
    df = panel[0].withColumn("threshold_p75", F.lit(4.0)).withColumn("outbreak_label", (F.col("cases") >= 4).cast("int"))
    plan = folds.rolling(spark, 2016, 2016, 1)
    base = {"chains": 4, "tune": 900, "draws": 900, "target_accept": 0.9}
    out, about = pipeline.hierarchical_out_of_fold(df, plan, ["a"], base, {"cv": {"chains": 1, "tune": 20, "draws": 30}}, strict=True)
    rows = out.toPandas()
    assert len(rows) == df.where("year(date) = 2016").count() and about[0]["convergence_mode"] == "warn" and "few samples" in about[0]["convergence_reason"]
    assert (rows.risk_q05 <= rows.risk_mean + 1e-9).all() and (rows.risk_mean <= rows.risk_q95 + 1e-9).all() and rows.risk_mean.between(0, 1).all()
    with pytest.raises(ValueError, match="converged"):
        pipeline.hierarchical_out_of_fold(df, plan, [], base, {"cv": {"chains": 2, "tune": 12, "draws": 60}}, strict=True)
    new = df.where("district = 'd0'").limit(5).withColumns({"district": F.lit("new"), "date": F.lit("2030-01-01").cast("date"), "a": F.lit(None).cast("double")})
    risk, _ = pipeline.hierarchical_risk(df, new, ["a"], {"chains": 1, "tune": 20, "draws": 30, "simplified": True})
    assert risk.where("risk_mean > 0 AND risk_mean < 1").count() == 5


def plain_ess(x):
    """Effective size of (chain, draw) with sums lag by lag."""
    m, n = x.shape
    c = x - x.mean(1, keepdims=True)
    acov = np.array([[(row[: n - t] * row[t:]).sum() / n for t in range(n)] for row in c]).mean(0)
    w = acov[0] * n / (n - 1)
    plus = acov[0] + x.mean(1).var(ddof=1)
    rho = [1.0] + [1 - (w - acov[t] * n / (n - 1)) / plus for t in range(1, n)]
    total, last = 0.0, math.inf
    for t in range(0, n - 1, 2):
        pair = rho[t] + rho[t + 1]
        if t and pair <= 0:
            break
        last = min(last, max(pair, 0.0))
        total += last
    return m * n / max(2 * total - 1, 1 / math.log10(m * n))


def test_rank_diagnostics_against_plain_ones(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(2)
    heavy = rng.standard_cauchy((3, 200))
    walk = np.cumsum(rng.normal(size=(3, 200)), axis=1)
    apart = rng.normal(size=(3, 200)) + np.array([[0], [0], [3]])
    ties = rng.integers(0, 3, (3, 200)).astype(float)
    arrays = {"heavy": heavy, "walk": walk, "apart": apart, "ties": ties, "flat": np.ones((3, 200))}
    rows = [(name, c, i, float(a[c, i])) for name, a in arrays.items() for c in range(3) for i in range(200)] + [("few", 0, i, 1.0) for i in range(3)] + [("gap", 0, i, None if i == 2 else 1.0 * i) for i in range(9)]
    got = {r.parameter: r for r in diagnostics.rank_diagnostics(spark.createDataFrame(rows, "parameter string, chain int, draw int, value double").repartition(5)).collect()}

    def scores(x):
        ranks = pd.Series(x.ravel()).rank().to_numpy()
        return np.array([NormalDist().inv_cdf((r - 0.375) / (x.size + 0.25)) for r in ranks]).reshape(x.shape)

    for name in ("heavy", "walk", "apart", "ties"):
        split = arrays[name].reshape(6, 100)
        z = scores(split)
        f = scores(np.abs(split - np.median(split)))
        rhat = [math.sqrt((100 * q.mean(1).var(ddof=1) / q.var(axis=1, ddof=1).mean() + 99) / 100) for q in (z, f)]
        tail = [plain_ess((split <= np.quantile(split, q)).astype(float)) for q in (0.05, 0.95)] if name != "ties" else None
        assert math.isclose(got[name].r_hat, max(rhat), rel_tol=1e-9) and math.isclose(got[name].ess_bulk, plain_ess(z), rel_tol=1e-6)
        assert tail is None or math.isclose(got[name].ess_tail, min(tail), rel_tol=1e-6)
    assert got["walk"].ess_bulk < 30 < 400 < got["heavy"].ess_bulk and got["apart"].r_hat > 1.3
    assert got["few"].r_hat is None and got["gap"].ess_bulk is None and diagnostics.summary(spark.createDataFrame([], "parameter string, chain int, draw int, value double"))["converged"] is False
