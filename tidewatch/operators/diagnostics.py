"""Convergence of chains: rank-normalised R-hat, bulk and tail effective sample size.

A parameter's draws are one row with an array (chains times draws, as many as the sampler was asked
for); ranks, normal scores and autocorrelations are taken for all rows of a batch at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.posterior import converged

SCHEMA = "parameter string, r_hat double, ess_bulk double, ess_tail double"


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 in each row, ties with their mean."""
    order = np.argsort(x, axis=1, kind="stable")
    s = np.take_along_axis(x, order, 1)
    n = x.shape[1]
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    at = np.broadcast_to(np.arange(n), s.shape)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    ends = np.ones(s.shape, bool)
    ends[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(ends, at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(s.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


@functools.cache
def _scores(n: int) -> np.ndarray:
    """Normal scores of the ranks 1, 1.5, 2, ... n."""
    inverse = NormalDist().inv_cdf
    return np.array([inverse((1 + k / 2 - 0.375) / (n + 0.25)) for k in range(2 * n - 1)])


def _normal(x: np.ndarray) -> np.ndarray:
    """Normal scores of (parameter, chain, draw) by rank within the parameter."""
    flat = x.reshape(len(x), -1)
    return _scores(flat.shape[1])[(2 * (_ranks(flat) - 1)).round().astype(int)].reshape(x.shape)


def _halves(x: np.ndarray) -> np.ndarray:
    n = x.shape[2] // 2
    return np.concatenate([x[:, :, :n], x[:, :, -n:]], axis=1)


def _rhat(x: np.ndarray) -> np.ndarray:
    n = x.shape[2]
    within = x.var(axis=2, ddof=1).mean(1)
    between = n * x.mean(2).var(axis=1, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt((between / within + n - 1) / n)


def _ess(x: np.ndarray) -> np.ndarray:
    """Effective size by Geyer's initial monotone sequence."""
    k, m, n = x.shape
    size = 1 << (2 * n - 1).bit_length()
    centred = x - x.mean(2, keepdims=True)
    acov = np.fft.irfft(np.abs(np.fft.rfft(centred, size, axis=2)) ** 2, size, axis=2)[:, :, :n].mean(1) / n
    within = acov[:, 0] * n / (n - 1)
    plus = acov[:, 0] + (x.mean(2).var(axis=1, ddof=1) if m > 1 else 0.0)
    flat = plus <= 1e-300
    rho = 1 - (within[:, None] - acov * n / (n - 1)) / np.where(flat, 1.0, plus)[:, None]
    rho[:, 0] = 1.0
    pairs = rho[:, : n - n % 2].reshape(k, -1, 2).sum(2)
    alive = np.logical_and.accumulate(pairs > 0, axis=1)
    alive[:, 0] = True
    falling = np.minimum.accumulate(np.maximum(pairs, 0.0), axis=1)
    tau = np.maximum(2 * (falling * alive).sum(1) - 1, 1 / np.log10(m * n))
    return np.where(flat, float(m * n), m * n / tau)


def diagnose(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R-hat (the larger of that of the draws and of their distances from the median), bulk and tail
    effective size of (parameter, chain, draw). Fewer than four draws or any that is not a number give nan."""
    k, m, n = x.shape
    if n < 4:
        return (np.full(k, np.nan),) * 3
    bad = ~np.isfinite(x).all((1, 2))
    x = np.where(bad[:, None, None], 0.0, x)
    split = _halves(x)
    bulk = _normal(split)
    folded = _normal(np.abs(split - np.median(split.reshape(k, -1), axis=1)[:, None, None]))
    rhat = np.maximum(_rhat(bulk), _rhat(folded))
    tails = [_ess((split <= np.quantile(x.reshape(k, -1), q, axis=1)[:, None, None]).astype(float)) for q in (0.05, 0.95)]
    out = rhat, _ess(bulk), np.minimum(*tails)
    return tuple(np.where(bad, np.nan, v) for v in out)


def rank_diagnostics(draws: DataFrame, value: str = "value") -> DataFrame:
    """(parameter, r_hat, ess_bulk, ess_tail) of ``draws`` (parameter, chain, draw, value). Chains of unequal length
    are cut to the shortest one's; a draw that is null gives nulls; without draws there are no rows."""
    one = F.array_sort(F.collect_list(F.struct("chain", "draw", F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v"))))
    rows = draws.groupBy("parameter").agg(one.alias("d")).select("parameter", F.col("d.chain").alias("chain"), F.col("d.v").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
            for name, chains, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                c, v = np.array(chains), np.array(values, float)
                cuts = np.flatnonzero(np.diff(c)) + 1
                parts = np.split(v, cuts)
                n = min(map(len, parts))
                shapes.setdefault((len(parts), n), []).append((name, np.array([p[:n] for p in parts])))
            for group in shapes.values():
                names, arrays = zip(*group, strict=True)
                found = diagnose(np.array(arrays))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(v, pa.float64(), from_pandas=True) for v in found]], names=["parameter", "r_hat", "ess_bulk", "ess_tail"])

    return rows.mapInArrow(work, SCHEMA)


def summary(draws: DataFrame, divergences: int = 0) -> dict[str, float]:
    """The worst R-hat and bulk size over all parameters, their number, and ``converged`` by these."""
    r = rank_diagnostics(draws).agg(F.max("r_hat").alias("r_hat"), F.min("ess_bulk").alias("ess"), F.count("*").alias("n"), F.count("r_hat").alias("known")).first()
    worst = {"r_hat": r["r_hat"] if r["known"] == r["n"] else None, "ess_bulk": r["ess"] or 0.0}
    return {"divergences": float(divergences), "r_hat_max": r["r_hat"], "ess_min": r["ess"], "n_parameters": float(r["n"]), "converged": bool(r["n"]) and converged([worst], divergences)}
