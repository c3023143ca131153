"""Boosting against a brute-force search of splits, on several folds at once."""

import heapq
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosting, models


def table(n=600, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 40, n) / 4, rng.normal(size=n).round(1), rng.integers(0, 5, n)
    p = 1 / (1 + np.exp(-(0.5 * (a > 4) * 2 - 1 + b * (c == 2) + 0.6 * (c == 3))))
    return a.astype(float), b.astype(float), np.array([f"k{i}" for i in c]), (rng.random(n) < p).astype(int), rng.integers(0, 3, n)


def candidates(x):
    """(column, bin, mask of the left side) of all splits of columns that are numbers or names."""
    for k, col in enumerate(x):
        values = np.unique(col)
        for i, v in enumerate(values if col.dtype.kind == "U" else values[:-1]):
            yield k, i, col == v if col.dtype.kind == "U" else col <= v


def plain(x, y, s):
    """Scores of the rows by trees whose every split is the best over all values."""
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + s.ridge)  # noqa: B023, E731

        def best(rows, depth):
            top = (0.0, None)
            for k, i, mask in candidates(x) if depth < s.depth else ():
                left, right = rows & mask, rows & ~mask
                if min(left.sum(), right.sum()) < max(1, s.least_rows) or min(h[left].sum(), h[right].sum()) < s.least_hessian:  # noqa: B023
                    continue
                gain = part(left) + part(right) - part(rows)  # noqa: B023
                if gain > top[0] + 1e-9:
                    top = (gain, (k, i, left, right))
            return top

        rows = np.ones(len(y), bool)
        heap, leaves, n = [(-best(rows, 0)[0], 0, rows, 0)], [], 0
        while heap:
            _, _, rows, depth = heapq.heappop(heap)
            gain, split = best(rows, depth)
            if split is None or (s.leaves is not None and len(heap) + len(leaves) + 2 > s.leaves):
                leaves.append(rows)
                continue
            for side in split[2:]:
                n += 1
                heapq.heappush(heap, (-best(side, depth + 1)[0], n, side, depth + 1))
        for rows in leaves:
            f[rows] -= s.rate * g[rows].sum() / (h[rows].sum() + s.ridge)
    return 1 / (1 + np.exp(-f))


@pytest.mark.parametrize("settings", [replace(boosting.LEVELS, rounds=17, rate=0.3, depth=3, rows=1.0, columns=1.0), replace(boosting.LEAVES, rounds=4, rate=0.3, depth=4, leaves=7)])
def test_same_scores_as_a_search_of_all_splits(spark, settings):
    a, b, c, y, fold = table()
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), str(c[i]), int(y[i]), int(fold[i])) for i in range(len(y))], "id int, a double, b double, c string, y int, f int").repartition(4).persist()
    parts = [(k, df.where(F.col("f") == k)) for k in (0, 1)] + [(7, df.where("y = 1")), (8, df.limit(0))]
    fitted = boosting.fit(parts, ["a", "b"], "y", "c", settings)
    assert fitted[7].constant == 1.0 and fitted[8].constant == 0.0
    for k in (0, 1):
        at = fold == k
        want = dict(zip(np.flatnonzero(at).tolist(), plain([a[at], b[at], c[at]], y[at], settings), strict=True))
        got = {r.id: r.score for r in boosting.score(fitted[k], df.where(F.col("f") == k), ["a", "b"], "c", settings).collect()}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9)
    new = boosting.score(fitted[0], spark.createDataFrame([(1e9, -1e9, "unseen")], "a double, b double, c string"), ["a", "b"], "c", settings)
    assert 0 < new.first().score < 1 and boosting.score(fitted[7], df, ["a", "b"], "c").where("score = 1").count() == 600


def test_bins_of_many_values_and_samples(spark):
    """A column of more values than bins, with a share of rows and columns, learns a step that is there."""
    df = spark.range(20_000).select(F.rand(1).alias("u"), F.rand(2).alias("v")).withColumn("y", ((F.col("u") > 0.7) != (F.rand(3) < 0.1)).cast("int")).persist()
    s = replace(boosting.LEVELS, rounds=20, rate=0.3)
    fitted = boosting.fit([(1, df)], ["u", "v"], "y", None, s)
    edges = fitted[1].edges[0]
    assert 200 < len(edges) < 256 and (np.diff(edges) > 0).all()
    out = boosting.score(fitted[1], df, ["u", "v"], None, s)
    high, low = (out.where(f"u {sign} 0.7").agg(F.avg("score")).first()[0] for sign in (">", "<"))
    assert abs(high - 0.9) < 0.05 and abs(low - 0.1) < 0.05
    assert abs(boosting._chosen(np.arange(10_000, dtype=np.uint64), 0.8, 3).mean() - 0.8) < 0.02


def test_settings_through_the_models(spark):
    a, b, c, y, fold = table(200)
    df = spark.createDataFrame([(float(a[i]) if i % 9 else None, float(b[i]), None if i % 7 == 0 else str(c[i]), int(y[i])) for i in range(200)], "a double, b double, c string, y int")
    for name in ("xgb", "LightGBM"):
        out = models.fit_score(name, df, df, ["a", "b"], "y", "c", trees=3)
        assert out.columns == [*df.columns, "score"] and out.where("score BETWEEN 0 AND 1").count() == 200
        assert out.where("a IS NULL").count() == df.where("a IS NULL").count()
