"""Hierarchical negative binomial risk with a time effect, sampled in few passes over distributed data.

Counts ``y`` of a district and date are negative binomial with mean ``exp(alpha_d + x beta + z_t)``: district
effects around ``mu_alpha`` with deviation ``sigma_alpha``, covariates, and an AR(1) effect of the dates. A
district's rows are one row with arrays, in a table that stays with Spark. For given common parameters
(the time axis, covariates and a few more) each district's effect is integrated out where its rows are,
by Gauss-Hermite quadrature around its mode; only sums over districts reach the driver.

The sampler evaluates many candidates in one pass. Newton steps first find the mode and curvature of
the common parameters. With the curvature, z and beta are nearly normal for given AR parameters, and these
have a nearly known density on a grid: together a reference that can be drawn from, however weak the data. In
each round and for each chain ``candidates`` points are drawn from the reference, one pass gives
all their likelihoods, and the chain goes ``take`` times to one of them or stays, with weights posterior
over reference, which leaves the posterior unchanged. So ``take`` draws of all chains cost one job.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import diagnostics
from tidewatch.operators.held import written

LOG = logging.getLogger(__name__)
# The priors (deviations, and the rate of the dispersion) and the bound of the linear predictor.
PRIOR = {"mu_alpha": 1.0, "sigma_alpha": 0.5, "beta": 0.4, "rho_raw": 0.8, "sigma_z": 0.35, "first_z": 0.35, "alpha_nb": 1.0}
MOST_LINEAR, MOST_RHO = 10.0, 0.95
_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(9)
#: The last three of the common parameters: mu_alpha plus the mean of z, log sigma_alpha, log alpha_nb.
HYPER = 3


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight places further."""
    x = np.asarray(x, float)
    less = np.ones_like(x)
    for k in range(8):
        less = less * (x + k)
    y = x + 8
    i2 = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / y - np.log(less)


@dataclass(frozen=True)
class Points:
    """Common parameters, a row each: time effects less their mean ``level``, with a last column of zeros, beta, and
    the rest. District effects are so much higher by ``level`` than in the model, whose sums are the same."""

    level: np.ndarray
    z: np.ndarray
    beta: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    r: np.ndarray

    def part(self, k: slice) -> Points:
        return Points(self.level[k], self.z[k], self.beta[k], self.mu[k], self.sigma[k], self.r[k])


class District:
    """A district's rows: dates' places ``t`` (-1: none), counts ``y``, how often each row occurs ``n``, covariates ``x``."""

    def __init__(self, t: np.ndarray, y: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        self.t, self.y, self.n = t, y[:, None], n[:, None]
        self.x = x.reshape(len(t), -1)
        self.distinct, self.place = np.unique(y, return_inverse=True)
        self.often = np.bincount(self.place, n, len(self.distinct))

    def offsets(self, p: Points) -> np.ndarray:
        """Linear predictor without the district's effect, by row and point."""
        return p.z[:, self.t].T + self.x @ p.beta.T

    def mode(self, p: Points, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The district effect's mode at each point, and its deviation by the curvature there."""
        total = np.exp(np.clip(eta, -MOST_LINEAR, MOST_LINEAR))
        weight = np.sum(self.n * self.y)
        a = (np.log((weight + 0.5) / (np.sum(self.n * total, axis=0) + 0.5)) * weight + p.mu / p.sigma**2) / (weight + 1 / p.sigma**2)
        for _ in range(8):
            m = np.exp(np.clip(a + eta, -MOST_LINEAR, MOST_LINEAR))
            share = m / (m + p.r)
            slope = np.sum(self.n * (self.y - (self.y + p.r) * share), axis=0) - (a - p.mu) / p.sigma**2
            bend = np.sum(self.n * (self.y + p.r) * share * (1 - share), axis=0) + 1 / p.sigma**2
            a = a + np.clip(slope / bend, -2.0, 2.0)
        return a, 1 / np.sqrt(bend)

    def constant(self, p: Points) -> np.ndarray:
        y, r = self.distinct[:, None], p.r[None, :]
        per = log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1) + r * np.log(r)
        return self.often @ per

    def log_likelihood(self, a: np.ndarray, p: Points, eta: np.ndarray) -> np.ndarray:
        """Without the constant."""
        lin = np.clip(a + eta, -MOST_LINEAR, MOST_LINEAR)
        return np.sum(self.n * (self.y * lin - (self.y + p.r) * np.log(p.r + np.exp(lin))), axis=0)

    def nodes(self, p: Points, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The quadrature's effects (node, point), and the logarithms of what they add to the integral."""
        a, s = self.mode(p, eta)
        at = a + np.sqrt(2.0) * s * _NODES[:, None]
        prior = -0.5 * ((at - p.mu) / p.sigma) ** 2 - np.log(p.sigma) - 0.9189385332046727
        like = np.array([self.log_likelihood(row, p, eta) for row in at])
        return at, like + prior + (np.log(_WEIGHTS) + _NODES**2)[:, None] + np.log(np.sqrt(2.0) * s)

    def marginal(self, p: Points) -> np.ndarray:
        _, parts = self.nodes(p, self.offsets(p))
        top = parts.max(0)
        return self.constant(p) + top + np.log(np.exp(parts - top).sum(0))

    def curvature(self, p: Points, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Adds gradient and negative second derivatives of the marginal likelihood by (z, beta) at one point."""
        n_times = len(gradient) - self.x.shape[1]
        eta = self.offsets(p)
        at, parts = self.nodes(p, eta)
        w = np.exp(parts[:, 0] - parts[:, 0].max())
        w /= w.sum()
        m = np.exp(np.clip(at[:, 0][None, :] + eta, -MOST_LINEAR, MOST_LINEAR))  # row, node
        share = m / (m + p.r[0])
        g = self.n * (self.y - (self.y + p.r[0]) * share)
        mean = g @ w
        bend = (self.n * (self.y + p.r[0]) * share * (1 - share)) @ w
        away = (g - mean[:, None]) * np.sqrt(w)
        place = np.where(self.t < 0, n_times - 1, self.t)  # the last column is that of no date
        by_time = np.zeros((n_times, len(w)))
        np.add.at(by_time, place, away)
        gradient[:n_times] += np.bincount(place, mean, n_times)
        gradient[n_times:] += self.x.T @ mean
        hessian[np.arange(n_times), np.arange(n_times)] += np.bincount(place, bend, n_times)
        across = np.zeros((n_times, self.x.shape[1]))
        np.add.at(across, place, bend[:, None] * self.x)
        hessian[:n_times, n_times:] += across
        hessian[n_times:, :n_times] += across.T
        hessian[n_times:, n_times:] += (self.x * bend[:, None]).T @ self.x
        both = np.concatenate([by_time, self.x.T @ away])
        hessian -= both @ both.T

    def effects(self, p: Points, rng: np.random.Generator) -> np.ndarray:
        """A draw of the district's effect at each point, from its distribution on a fine grid."""
        eta = self.offsets(p)
        a, s = self.mode(p, eta)
        steps = np.linspace(-6, 6, 61)
        at = a + s * steps[:, None]
        logs = np.array([self.log_likelihood(row, p, eta) for row in at]) - 0.5 * ((at - p.mu) / p.sigma) ** 2
        mass = np.exp(logs - logs.max(0))
        sums = np.concatenate([np.zeros((1, mass.shape[1])), np.cumsum((mass[1:] + mass[:-1]) / 2, axis=0)])
        u = rng.random(mass.shape[1])
        return np.array([a[k] + s[k] * np.interp(u[k] * sums[-1, k], sums[:, k], steps) for k in range(len(u))])


def _districts(batch: pa.RecordBatch) -> Iterator[tuple[str, District]]:
    names = batch.column(0).to_pylist()
    columns = [batch.column(k) for k in range(1, 5)]
    for i, name in enumerate(names):
        t, y, n, x = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
        yield name, District(t, y.astype(float), n.astype(float), x.astype(float))


@dataclass
class Data:
    """``rows`` (district, t, y, n, x), a row for each district; the dates; the covariates with mean and deviation."""

    rows: DataFrame
    times: list
    covariates: list[str]
    scales: list[tuple[float, float]]
    mean: float

    @property
    def n_times(self) -> int:
        """Time effects; one date alone has none beside the districts'."""
        return len(self.times) if len(self.times) > 1 else 0


def prepare(df: DataFrame, y: str, covariates: list[str], district: str = "district", date: str | None = "date") -> Data:
    """The rows of ``df`` by district. Counts are rounded and negative or null ones are 0; covariates are scaled to
    mean 0 and deviation 1, null ones are at the mean; a null district is ``unknown``; a row without a date has no
    time effect, and none has one if there is no column ``date``. Equal rows of a district are one with their number. A district has so many arrays' entries as
    it has different dates, covariates and counts: in a panel, one for each date. The time axis is read by the
    driver; squares of its length are held there and in each task."""
    dated = df.withColumns({"_t": F.to_date(date) if date else F.lit(None).cast("date"), "_d": F.coalesce(F.col(district).cast("string"), F.lit("unknown"))})
    count = F.greatest(F.round(F.coalesce(F.col(y).cast("double"), F.lit(0.0))), F.lit(0.0))
    times = [r[0] for r in dated.where("_t IS NOT NULL").select("_t").distinct().orderBy("_t").collect()]
    stats = df.agg(F.avg(count), *[f(F.col(c).cast("double")) for c in covariates for f in (F.avg, F.stddev_pop)]).first()
    scales = [(stats[1 + 2 * i] or 0.0, stats[2 + 2 * i] if (stats[2 + 2 * i] or 0.0) >= 1e-8 else 1.0) for i in range(len(covariates))]
    axis = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(times)], "_t date, t int")
    x = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, (m, s) in zip(covariates, scales, strict=True)]).cast("array<double>")
    placed = dated.join(F.broadcast(axis), "_t", "left").select("_d", F.coalesce("t", F.lit(-1)).alias("t"), count.alias("y"), x.alias("x"))
    cells = placed.groupBy("_d", "t", "y", "x").agg(F.count("*").cast("double").alias("n"))
    packed = cells.groupBy(F.col("_d").alias("district")).agg(F.collect_list(F.struct("t", "y", "n", "x")).alias("c"))
    sc = df.sparkSession.sparkContext  # far more work than bytes: more parts than a table of this size has by itself
    packed = packed.repartition(max(2 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "district")
    rows = packed.select("district", "c.t", "c.y", "c.n", F.flatten("c.x").alias("x"))
    return Data(written(rows, "districts"), times, list(covariates), scales, float(stats[0] or 0.0))


def _points(v: np.ndarray, data: Data) -> Points:
    """Points of vectors (z, beta, the three others)."""
    k = data.n_times
    level = v[:, :k].mean(1) if k else np.zeros(len(v))
    z = v[:, :k] - level[:, None]
    wide = np.concatenate([z, np.zeros((len(v), 1))], axis=1) if k else np.zeros((len(v), len(data.times) + 1))
    clipped = np.clip(v[:, -2:], -12, 12)
    return Points(level, wide, v[:, k:-HYPER], v[:, -HYPER], np.exp(clipped[:, 0]), np.exp(clipped[:, 1]))


#: Points times rows of a district for which arrays are held at once.
_CELLS = 1 << 20


def likelihoods(data: Data, v: np.ndarray) -> np.ndarray:
    """The log likelihood at each of the vectors ``v``: one pass, from which a number for each comes back."""
    spark: SparkSession = data.rows.sparkSession
    shared = spark.sparkContext.broadcast(_points(v, data))
    n = len(v)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for _, d in _districts(batch):
                step = max(1, _CELLS // max(1, len(d.t)))
                for a in range(0, n, step):
                    total[a : a + step] += d.marginal(shared.value.part(slice(a, a + step)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["k", "v"])

    sums = data.rows.mapInArrow(work, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(n)
    for k, value in sums:
        out[k] = value
    shared.unpersist()
    return out


def curvature(data: Data, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and negative second derivatives of the log likelihood by (z, beta) at one vector. Each task sends
    one matrix of the time axis; Spark adds them by rows."""
    shared = data.rows.sparkSession.sparkContext.broadcast(_points(v[None], data))
    width = len(data.times) + 1 + len(data.covariates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessian = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for _, d in _districts(batch):
                d.curvature(shared.value, gradient, hessian)
        values = np.concatenate([gradient[:, None], hessian], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(values), pa.list_(pa.float64()))], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[k] = held.get(k, 0.0) + row.values.to_numpy(zero_copy_only=False)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["k", "v"])

    rows = data.rows.mapInArrow(work, "k long, v array<double>").repartition("k").mapInArrow(add, "k long, v array<double>").collect()
    shared.unpersist()
    full = np.zeros((width, width + 1))
    for k, values in rows:
        full[k] = values
    keep = np.concatenate([np.arange(data.n_times), np.arange(len(data.times) + 1, width)]).astype(int)
    return full[keep, 0], full[np.ix_(keep, keep + 1)]


def ar_precision(n: int, rho: float, sigma: float) -> np.ndarray:
    """The prior precision of z: a matrix of three diagonals."""
    q = np.zeros((n, n))
    if n:
        i = np.arange(n)
        q[i[1:], i[1:]] += 1 / sigma**2
        q[i[:-1], i[:-1]] += rho**2 / sigma**2
        q[i[1:], i[:-1]] -= rho / sigma**2
        q[i[:-1], i[1:]] -= rho / sigma**2
        q[0, 0] += 1 / PRIOR["first_z"] ** 2
    return q


def log_prior(v: np.ndarray, n_times: int, rho: np.ndarray, sigma_z: np.ndarray) -> np.ndarray:
    """Of vectors ``v``, each with its AR parameters, up to a constant; with the logarithms' Jacobians."""
    z, beta, (mu, ls, lr) = v[:, :n_times], v[:, n_times:-HYPER], v[:, -HYPER:].T
    mu_alpha = mu - (z.mean(1) if n_times else 0.0)
    out = -0.5 * (beta / PRIOR["beta"]) ** 2
    out = out.sum(1) - 0.5 * (mu_alpha / PRIOR["mu_alpha"]) ** 2 - 0.5 * (np.exp(ls) / PRIOR["sigma_alpha"]) ** 2 + ls - PRIOR["alpha_nb"] * np.exp(lr) + lr
    if n_times:
        steps = z[:, 1:] - rho[:, None] * z[:, :-1]
        out = out - 0.5 * (z[:, 0] / PRIOR["first_z"]) ** 2 - 0.5 * (steps**2).sum(1) / sigma_z**2 - (n_times - 1) * np.log(sigma_z)
    return out


def _log_ar(raw: np.ndarray, log_sigma: np.ndarray) -> np.ndarray:
    """Log prior density of the AR parameters, by rho_raw and log sigma_z."""
    return -0.5 * (raw / PRIOR["rho_raw"]) ** 2 - 0.5 * (np.exp(log_sigma) / PRIOR["sigma_z"]) ** 2 + log_sigma


#: Grid of the AR parameters (rho_raw by log sigma_z); less than a hundredth of a percent of any posterior lies outside.
RAWS, LOGS = np.linspace(-3.2, 3.2, 17), np.linspace(np.log(0.002), np.log(2.0), 25)
#: By how much the normal distributions are wider than the curvature says.
WIDER = 1.05


class Reference:
    """(z, beta) given the AR parameters, by the likelihood's curvature ``a`` and linear term ``b``; the AR
    parameters on a grid; and the three other parameters around theirs."""

    def __init__(self, k: int, p: int, a: np.ndarray, b: np.ndarray, hyper: np.ndarray, hyper_cov: np.ndarray, every: int = 1) -> None:
        self.k, self.p, self.a, self.b = k, p, a, b
        self.set_hyper(hyper, hyper_cov)
        self.cells = [(float(r), float(s)) for r in RAWS[::every] for s in LOGS[::every]] if k else [(0.0, 0.0)]
        self.half = np.array([RAWS[1] - RAWS[0], LOGS[1] - LOGS[0]]) / 2
        logs = np.array([self._evidence(c) for c in range(len(self.cells))])
        self.best = int(logs.argmax())
        mass = np.exp((logs - logs.max()) * 0.8) + 1e-6  # flatter than it is, so that no tail is missed
        self.mass = mass / mass.sum()

    def set_hyper(self, mean: np.ndarray, cov: np.ndarray) -> None:
        self.hyper, self.hyper_root = mean, np.linalg.cholesky(cov)

    def _precision(self, raw: float, log_sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Precision of (z, beta), its root, and half the logarithm of its determinant."""
        precision = self.a.copy()
        if self.k:
            precision[: self.k, : self.k] += ar_precision(self.k, MOST_RHO * np.tanh(raw), float(np.exp(log_sigma)))
        root = np.linalg.cholesky(precision) if len(precision) else precision
        return precision, root, float(np.log(np.diag(root)).sum())

    def _evidence(self, cell: int) -> float:
        """Log density of the AR parameters after (z, beta) are integrated out."""
        raw, log_sigma = self.cells[cell]
        precision, _, half = self._precision(raw, log_sigma)
        mean = np.linalg.solve(precision, self.b) if len(self.b) else self.b
        return 0.5 * float(self.b @ mean) - half - (max(self.k - 1, 0)) * log_sigma + float(_log_ar(np.array(raw), np.array(log_sigma)))

    def latent(self) -> tuple[np.ndarray, np.ndarray]:
        """(z, beta) at the best AR parameters, and these."""
        cell = self.cells[self.best]
        return np.linalg.solve(self._precision(*cell)[0], self.b) if len(self.b) else self.b, np.array(cell)

    def draw(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, AR parameters and log densities of ``n`` draws."""
        cells = rng.choice(len(self.cells), n, p=self.mass)
        ar = np.array([self.cells[c] for c in cells]) + self.half * rng.uniform(-1, 1, (n, 2))
        v, density = np.empty((n, self.k + self.p + HYPER)), np.log(self.mass[cells])
        same = self._precision(0.0, 0.0) if not self.k else None
        for i, (raw, log_sigma) in enumerate(ar.tolist()):
            precision, root, half = same or self._precision(raw, log_sigma)
            xi = rng.normal(size=len(self.b))
            v[i, :-HYPER] = np.linalg.solve(precision, self.b + WIDER * root @ xi) if len(xi) else xi
            density[i] += half - 0.5 * (xi**2).sum()
        eta = rng.normal(size=(n, HYPER))
        v[:, -HYPER:] = self.hyper + eta @ self.hyper_root.T
        return v, ar, density - 0.5 * (eta**2).sum(1)


def find_mode(data: Data, steps: int = 25, tolerance: float = 0.05) -> tuple[Reference, int]:
    """The reference at the mode, and the passes that it took. Newton steps for (z, beta) use exact
    derivatives and those for the three others differences; the AR parameters are the likeliest ones with z integrated out."""
    k, p = data.n_times, len(data.covariates)
    v = np.zeros(k + p + HYPER)
    v[-HYPER:] = np.log(data.mean + 0.1), np.log(0.5), 0.0
    h, passes, ref = 0.05, 0, None
    for _ in range(steps):
        g, a = curvature(data, v)
        centre = np.eye(k + p)
        centre[:k, :k] -= 1 / k if k else 0.0
        a, g = centre @ a @ centre, centre @ g
        low, axes = np.linalg.eigh((a + a.T) / 2) if k + p else (np.zeros(0), np.zeros((0, 0)))
        a = (axes * np.maximum(low, 0.0)) @ axes.T
        b = a @ v[:-HYPER] + g
        if k:  # mu_alpha is the first of the three others less the mean of z
            a[:k, :k] += 1 / (k * PRIOR["mu_alpha"]) ** 2
            b[:k] += v[-HYPER] / (k * PRIOR["mu_alpha"] ** 2)
        a[k:, k:] += np.eye(p) / PRIOR["beta"] ** 2
        ref = Reference(k, p, a, b, v[-HYPER:], np.eye(HYPER), every=2)
        target, ar = ref.latent()
        post = lambda x: likelihoods(data, x) + log_prior(x, k, np.full(len(x), MOST_RHO * np.tanh(ar[0])), np.full(len(x), np.exp(ar[1])))  # noqa: B023, E731
        move = target - v[:-HYPER]
        unit = h * np.eye(3)
        corners = [s * unit[i] + t * unit[j] for i in range(3) for j in range(i) for s in (1, -1) for t in (1, -1)]
        at = np.repeat(v[None], 19, 0)
        at[:, -HYPER:] += np.array([np.zeros(3), *unit, *-unit, *corners])
        f = post(at)
        slope, bend = (f[1:4] - f[4:7]) / (2 * h), np.diag((2 * f[0] - f[1:4] - f[4:7]) / h**2)
        for q, (i, j) in enumerate((i, j) for i in range(3) for j in range(i)):
            c = f[7 + 4 * q : 11 + 4 * q]
            bend[i, j] = bend[j, i] = -(c[0] - c[1] - c[2] + c[3]) / (4 * h * h)
        low, axes = np.linalg.eigh(bend)
        hyper_cov = (axes / np.maximum(np.abs(low), 0.5)) @ axes.T
        hyper_move = np.clip(hyper_cov @ slope, -1, 1)
        trials = np.array([np.concatenate([v[:-HYPER] + s * move, v[-HYPER:] + t * hyper_move]) for s in (1, 0.5, 0.15, 0) for t in (1, 0.4, 0)])
        found = post(trials)
        passes += 3
        best = int(np.argmax(found))
        v = trials[best]
        if found[best] - f[0] < tolerance:
            break
    return Reference(k, p, a, b, v[-HYPER:], 1.2 * hyper_cov), passes


@dataclass
class Fit:
    """``common``: draws (parameter, chain, draw, value) of beta, rho, sigma_z, mu_alpha, sigma_alpha, alpha_nb and
    ``z[date]``; ``data`` and ``vectors`` (chain and draw, the vectors) for what is drawn by district; ``diagnostics``."""

    common: DataFrame
    data: Data
    vectors: np.ndarray
    chains: int
    diagnostics: dict[str, Any] = field(default_factory=dict)


def sample(data: Data, chains: int = 2, tune: int = 300, draws: int = 300, seed: int = 1, candidates: int = 80, take: int = 12) -> Fit:
    """``draws`` draws of ``chains`` chains after ``tune`` ones that tell the reference more of the last three parameters."""
    k, n = data.n_times, len(data.times)
    ref, passes = find_mode(data)
    rng = np.random.default_rng(seed)
    prior = lambda v, ar: log_prior(v, k, MOST_RHO * np.tanh(ar[:, 0]), np.exp(ar[:, 1])) + (_log_ar(ar[:, 0], ar[:, 1]) if k else 0.0)
    now: list[tuple[np.ndarray, np.ndarray, float] | None] = [None] * chains
    kept: list[list[np.ndarray]] = [[] for _ in range(chains)]
    kept_ar: list[list[np.ndarray]] = [[] for _ in range(chains)]
    done, poor, spreads, tuned = -tune, 0, [], []
    while done < draws:
        step = take if done >= 0 else min(-done, max(take, -(-tune // 6)))  # few rounds to find out, many to draw
        v, ar, density = ref.draw(chains * candidates, rng)
        logs = likelihoods(data, v) + prior(v, ar) - density
        passes += 1
        order = rng.permutation(chains * candidates).reshape(chains, candidates)
        for c in range(chains):
            some, some_ar, w = v[order[c]], ar[order[c]], logs[order[c]]
            if now[c] is not None:
                some, some_ar, w = np.vstack([some, now[c][0]]), np.vstack([some_ar, now[c][1]]), np.append(w, now[c][2])
            share = np.exp(w - w.max())
            share /= share.sum()
            spreads.append(1 / (share**2).sum())
            poor += int(done >= 0 and spreads[-1] < 1.5)
            chosen = rng.choice(len(w), step, p=share)
            for i in chosen[: draws - done] if done >= 0 else []:
                kept[c].append(some[i])
                kept_ar[c].append(some_ar[i])
            tuned += [some[i, -HYPER:] for i in chosen] if done < 0 else []
            now[c] = some[chosen[-1]], some_ar[chosen[-1]], float(w[chosen[-1]])
        done += step
        if not done and len(tuned) >= 50:
            # the three others' mean and spread as the draws have them; the chains' weights are taken anew
            old, moments = (ref.hyper, ref.hyper_root), np.array(tuned)
            ref.set_hyper(moments.mean(0), 1.3 * np.cov(moments.T) + 1e-6 * np.eye(HYPER))
            now = [(x, y, w + _log_normal(x[-HYPER:], *old) - _log_normal(x[-HYPER:], ref.hyper, ref.hyper_root)) for x, y, w in now]
    vectors, ars = np.array(kept), np.array(kept_ar)
    names = [f"beta[{c}]" for c in data.covariates]
    columns = {name: vectors[:, :, k + i] for i, name in enumerate(names)}
    columns |= {"mu_alpha": vectors[:, :, -3] - (vectors[:, :, :k].mean(2) if k else 0.0), "sigma_alpha": np.exp(vectors[:, :, -2]), "alpha_nb": np.exp(vectors[:, :, -1])}
    if k > 1:
        columns |= {"rho": MOST_RHO * np.tanh(ars[:, :, 0]), "sigma_z": np.exp(ars[:, :, 1])}
    columns |= {f"z[{data.times[i]}]": vectors[:, :, i] for i in range(n if k else 0)}
    index = {"chain": np.repeat(np.arange(chains), draws), "draw": np.tile(np.arange(draws), chains)}
    long = pd.concat([pd.DataFrame({"parameter": name, **index, "value": x.reshape(-1)}) for name, x in columns.items()])
    common = data.rows.sparkSession.createDataFrame(pa.Table.from_pandas(long, preserve_index=False))
    return Fit(common, data, vectors, chains, {"passes": passes, "rounds_without_choice": poor, "choice": float(np.median(spreads))})


def _log_normal(x: np.ndarray, mean: np.ndarray, root: np.ndarray) -> float:
    """Relative to the constant that ``Reference.draw`` leaves out: densities of ``draw`` have no factor for the root."""
    return -0.5 * float((np.linalg.solve(root, x - mean) ** 2).sum())


# Beyond these a fit with a time effect is tried again without one.
RETRY = {"divergences": 20.0, "r_hat": 1.05, "ess": 100.0}


def needs_simplification(found: dict[str, Any], limits: dict[str, float] = RETRY) -> bool:
    r_hat, ess = found.get("r_hat_max"), found.get("ess_min")
    return found.get("divergences", 0.0) > limits["divergences"] or (r_hat is not None and np.isfinite(r_hat) and r_hat > limits["r_hat"]) or (ess is not None and np.isfinite(ess) and ess < limits["ess"])


def fit(df: DataFrame, y: str, covariates: list[str], simplified: bool = False, force_full: bool = False, retries: int = 1, limits: dict[str, float] = RETRY, district: str = "district", date: str | None = "date", **settings: int) -> Fit:
    """Draws of the model of ``df``; ``settings`` are those of ``sample``.

    ``simplified`` leaves the time effect out; ``force_full`` wins over it. A fit with a time effect whose
    diagnostics are beyond ``limits`` is made once more without one if ``retries`` allow it and
    ``force_full`` does not forbid it. ``diagnostics`` has the worst values, whether the chains converged, and
    what was done; rounds in which a chain found no other point count as divergences. An empty table is an error."""
    full = force_full or not simplified

    def one(with_time: bool) -> Fit:
        data = prepare(df, y, covariates, district, date if with_time else None)
        if data.rows.isEmpty():
            raise ValueError("no rows to fit")
        return replace_diagnostics(sample(data, **settings), simplified_mode=float(not with_time), fallback=0.0)

    out = one(full)
    if full and not force_full and retries > 0 and needs_simplification(out.diagnostics, limits):
        LOG.warning("poor diagnostics with a time effect (%s); once more without it", out.diagnostics)
        out = one(False)
        out.diagnostics["retried"] = True
    return out


def replace_diagnostics(fitted: Fit, **more: Any) -> Fit:
    worst = diagnostics.summary(fitted.common, fitted.diagnostics["rounds_without_choice"])
    fitted.diagnostics |= worst | {"retried": False} | more
    return fitted


def district_draws(fitted: Fit, seed: int = 1) -> DataFrame:
    """(district, chain, draw, effect): a draw of each district's effect for each draw of the common parameters,
    made where the districts' rows are."""
    data, (chains, draws, _) = fitted.data, fitted.vectors.shape
    shared = data.rows.sparkSession.sparkContext.broadcast(_points(fitted.vectors.reshape(chains * draws, -1), data))
    chain, draw = np.repeat(np.arange(chains), draws), np.tile(np.arange(draws), chains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, d in _districts(batch):
                rng = np.random.default_rng([seed, *name.encode()])
                step = max(1, _CELLS // max(1, len(d.t)))
                values = np.concatenate([d.effects(shared.value.part(slice(a, a + step)), rng) for a in range(0, len(chain), step)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(chain)), pa.array(chain), pa.array(draw), pa.array(values - shared.value.level)], names=["district", "chain", "draw", "effect"])

    return data.rows.mapInArrow(work, "district string, chain long, draw long, effect double")


def linear_draws(fitted: Fit, df: DataFrame, key: list[str], district: str = "district", date: str = "date", most: int = 200, seed: int = 1) -> DataFrame:
    """(key, linear): for each row of ``df`` an array of the linear predictor at ``most`` evenly chosen draws.
    A district that was not fitted gets draws of a new one; a date that was not fitted the last one's effect."""
    data, (chains, draws, _) = fitted.data, fitted.vectors.shape
    all_draws = fitted.vectors.reshape(chains * draws, -1)
    picked = np.linspace(0, len(all_draws) - 1, min(most, len(all_draws))).round().astype(int)
    points = _points(all_draws[picked], data)
    shared = data.rows.sparkSession.sparkContext.broadcast((points, np.random.default_rng([seed, 0]).normal(size=len(picked))))

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = [], []
            for name, d in _districts(batch):
                step = max(1, _CELLS // max(1, len(d.t)))
                rng = np.random.default_rng([seed, *name.encode()])
                names.append(name)
                values.append(np.concatenate([d.effects(shared.value[0].part(slice(a, a + step)), rng) for a in range(0, len(picked), step)]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.list_(pa.float64()))], names=["_d", "_a"])

    by = data.rows.mapInArrow(effects, "_d string, _a array<double>")
    axis = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(data.times)], "_t date, _at int")
    x = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, (m, s) in zip(data.covariates, data.scales, strict=True)]).cast("array<double>")
    named = df.select(*key, F.coalesce(F.col(district).cast("string"), F.lit("unknown")).alias("_n"), F.to_date(date).alias("_t"), x.alias("_x"))
    met = named.join(by, named["_n"] == by["_d"], "left").join(F.broadcast(axis), "_t", "left")
    met = met.select(*key, "_a", F.when(F.col("_t").isNull(), -1).otherwise(F.coalesce("_at", F.lit(len(data.times) - 1))).alias("_at"), "_x")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in met.select(*key).schema)}, linear array<double>"
    n_key = len(key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, new = shared.value
        for batch in batches:
            out = []
            for a, at, xs in zip(batch.column(n_key), batch.column(n_key + 1).to_pylist(), batch.column(n_key + 2).to_pylist(), strict=True):
                effect = a.values.to_numpy(zero_copy_only=False) if a.is_valid else p.mu + p.sigma * new
                out.append(np.clip(effect + p.z[:, at] + p.beta @ np.array(xs, float), -MOST_LINEAR, MOST_LINEAR))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_key], pa.array(out, pa.list_(pa.float64()))], names=[*key, "linear"])

    return met.mapInArrow(rows, schema)
