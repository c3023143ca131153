"""Exact quantiles and running sums without a task that sees all rows.

Rows are counted by value first. Approximate quantiles then cut the range of values into parts, a
window runs within each part, and the sums of the parts before, a row for each, are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 200
#: Counted values that are few enough to be read at once.
FEW = 100_000


def running(t: DataFrame, key: str, columns: list[str], descending: bool = False, parts: int = PARTS, by: list[str] | None = None) -> DataFrame:
    """``t`` with ``cum_`` columns: sums over the rows up to and with this one by ``key``, for each
    value of the columns ``by`` (few values; not null) or over all rows.

    One window over all rows would be one task. So approximate quantiles cut the key's range into
    at most ``parts`` parts (any cut gives the same sums), a window runs within each, and what the
    parts before hold is added; edges and totals are a row for each value of ``by`` and part."""
    by = by or []
    steps = ", ".join(f"{k / parts}D" for k in range(1, parts))
    edges = t.groupBy(*[F.col(c).alias(f"_e_{c}") for c in by]).agg(F.array_distinct(F.coalesce(F.expr(f"percentile_approx(`{key}`, array({steps}), 2000)"), F.array().cast("array<double>"))).alias("_edges"))
    met = t.join(F.broadcast(edges), [F.col(c) == F.col(f"_e_{c}") for c in by]) if by else t.crossJoin(F.broadcast(edges))
    cut = met.withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(key)))).select(*t.columns, "_part")
    order = F.desc if descending else F.asc
    before = W.partitionBy(*[f"_p_{c}" for c in by]).orderBy(order("_p_")).rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*[F.col(c).alias(f"_p_{c}") for c in by], F.col("_part").alias("_p_")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    totals = totals.select(*[f"_p_{c}" for c in by], "_p_", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns])
    within = W.partitionBy(*by, "_part").orderBy(order(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cut.join(F.broadcast(totals), [F.col("_part") == F.col("_p_"), *[F.col(c) == F.col(f"_p_{c}") for c in by]])
    return out.select(*t.columns, *[(F.sum(c).over(within) + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in columns])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v, n): how often each value of each column occurs, nulls left out."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    return values.select("x.name", "x.v").where("v IS NOT NULL").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))


def quantiles_now(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float] | None]:
    """The quantiles as numbers, None for a column without values. ``df`` is computed once, for all columns
    together; what is held meanwhile are its counted values. Where these are few, they are read in the same
    job and ranked here; else they are ranked by parts, with equal results."""
    counts = value_counts(df, columns).persist()
    try:
        few = counts.limit(FEW + 1).toArrow()
        if few.num_rows > FEW:
            return quantiles(df, columns, at, counts).first().asDict()
    finally:
        counts.unpersist()
    names, v, n = np.array(few["name"].to_pylist(), object), few["v"].to_numpy(), few["n"].to_numpy()
    return {c: _of_counts(v[names == c], n[names == c], at) for c in columns}


def _of_counts(v: np.ndarray, n: np.ndarray, at: list[float]) -> list[float] | None:
    """Quantiles of values ``v`` that occur ``n`` times each."""
    if not len(v):
        return None
    order = np.argsort(v, kind="stable")
    v, upto = v[order], np.cumsum(n[order])
    place = (upto[-1] - 1) * np.array(at, float)
    low, high = (v[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
    return (low + (high - low) * (place - np.floor(place))).tolist()


def quantiles(df: DataFrame, columns: list[str], at: list[float], counts: DataFrame | None = None) -> DataFrame:
    """One row: for each of ``columns`` an array of its quantiles ``at`` over its values that are not null,
    with linear interpolation between ranks; nulls where there is no value."""
    counts = value_counts(df, columns) if counts is None else counts
    ranked = running(counts, "v", ["n"], by=["name"])
    total = ranked.groupBy(F.col("name").alias("_name")).agg(F.max("cum_n").alias("total"))
    ranked = ranked.join(F.broadcast(total), F.col("name") == F.col("_name"))

    def quantile(q: float):
        place = (F.col("total") - 1) * F.lit(q)
        low, high = (F.min(F.when(F.col("cum_n") > f(place), F.col("v"))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        return low + (high - low) * share

    rows = ranked.groupBy("name").agg(F.array(*[quantile(q) for q in at]).alias("q"))
    return rows.agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(c) for c in columns])
