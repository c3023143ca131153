"""Baseline models: a percentile rule, generalized linear models, trees, calibration.

Spark ML fits what it has; boosting is in ``boosting``; the negative binomial is fitted by reweighted least
squares, of which each step is one aggregation of a small cross-product matrix.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from dataclasses import replace

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import boosting
from tidewatch.operators import folds as fold_ops
from tidewatch.operators.ranks import quantiles

# Other names of the models.
ALIASES = {
    "threshold": "percentile_rule", "rule": "percentile_rule", "percentile": "percentile_rule", "logit": "logistic", "logistic_regression": "logistic", "lr": "logistic",
    "poisson_regression": "poisson", "glm_poisson": "poisson", "nb": "negative_binomial", "negbin": "negative_binomial", "negativebinomial": "negative_binomial",
    "rf": "random_forest", "randomforest": "random_forest", "xgb": "boosted_4", "xgboost": "boosted_4", "lgbm": "boosted_6", "lightgbm": "boosted_6",
}
BOOSTED = {"boosted_4": boosting.LEVELS, "boosted_6": boosting.LEAVES}
MODELS = ["percentile_rule", "logistic", "poisson", "negative_binomial", "random_forest", "boosted_4", "boosted_6"]


def resolve(name: str) -> str:
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = ALIASES.get(key, key)
    if key not in MODELS:
        raise ValueError(f"unknown model {name}; there are {', '.join(MODELS)}")
    return key


def safe_names(names: list[str], taken: Iterable[str] = ()) -> dict[str, str]:
    """For each name one of letters, digits and single underscores that begins with a letter (``f_`` before a digit, ``feature``
    for nothing). Names that become equal, to each other or to one of ``taken``, get ``_2``, ``_3`` and so on in their order."""
    used, out = set(taken), {}
    for name in names:
        plain = "_".join(x for x in re.split("[^0-9A-Za-z]+", name) if x) or "feature"
        plain = f"f_{plain}" if plain[0].isdigit() else plain
        free = (plain if k == 1 else f"{plain}_{k}" for k in itertools.count(1))
        out[name] = next(x for x in free if x not in used)
        used.add(out[name])
    return out


def wide_scores(oof: DataFrame, key: list[str], models: list[str]) -> DataFrame:
    """(key, a column of scores between 0 and 1 for each model); 0 where a model has none."""
    clipped = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return oof.withColumn("_s", clipped).groupBy(*key).pivot("model", models).agg(F.first("_s", ignorenulls=True)).fillna(0.0, models)


def alerts(oof: DataFrame, key: list[str], models: list[str], threshold: float = 0.5) -> DataFrame:
    """(key, 1 or 0 for each model): whether its score reaches the threshold."""
    return wide_scores(oof, key, models).select(*key, *[(F.col(m) >= threshold).cast("int").alias(m) for m in models])


def percentile_rule(train: DataFrame, valid: DataFrame, cases: str = "cases", district: str = "district", q: float = 0.75) -> DataFrame:
    """``valid`` with ``score``: 1 where cases reach the district's quantile in ``train``, or that of
    all rows for a district that is not in it."""
    by = train.groupBy(F.col(district).alias("_d")).agg(F.expr(f"percentile(`{cases}`, {q}D)").alias("_t"))
    whole = quantiles(train, [cases], [q]).select(F.get(cases, F.lit(0)).alias("_w"))
    out = valid.join(by, valid[district].eqNullSafe(by["_d"]), "left").crossJoin(F.broadcast(whole))
    return out.withColumn("score", F.coalesce((F.col(cases) >= F.coalesce("_t", "_w")).cast("double"), F.lit(0.0))).drop("_d", "_t", "_w")


def _assembled(numeric: list[str], category: str | None) -> list:
    stages: list = []
    inputs = list(numeric)
    if category:
        stages += [StringIndexer(inputCol=category, outputCol="_i", handleInvalid="keep"), OneHotEncoder(inputCols=["_i"], outputCols=["_oh"], dropLast=False)]
        inputs.append("_oh")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")]


def _weights(train: DataFrame, target: str) -> Column:
    """Balanced class weights n / (2 n_class)."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("p")).first()
    return F.when(F.col(target) == 1, r["n"] / (2 * r["p"])).otherwise(r["n"] / (2 * (r["n"] - r["p"])))


def _filled(df: DataFrame, numeric: list[str], category: str | None) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}).fillna("__missing__", [category] if category else [])


def fit_score(model: str, train: DataFrame, valid: DataFrame, numeric: list[str], target: str, category: str | None = None, seed: int = 42, trees: int | None = None) -> DataFrame:
    """``valid`` with ``score`` by a model fitted on ``train``; the target's mean with one class."""
    model = resolve(model)
    if any("." in c or "`" in c for c in numeric):  # names that expressions would read as paths
        names = safe_names(numeric, [c for c in train.columns + valid.columns if c not in numeric])
        out = fit_score(model, train.withColumnsRenamed(names), valid.withColumnsRenamed(names), list(names.values()), target, category, seed, trees)
        return out.withColumnsRenamed({v: k for k, v in names.items()})
    stats = train.agg(F.min(target).alias("a"), F.max(target).alias("b"), F.avg(target).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if stats["n"] == 0 or stats["a"] == stats["b"]:
        return valid.withColumn("score", F.lit(float(stats["m"] or 0.0)))
    if model == "percentile_rule":
        return percentile_rule(train, valid)
    t, v = (_filled(df, numeric, category) for df in (train, valid))
    if model == "negative_binomial":
        return nb_score(t, v, numeric, target)
    if model in BOOSTED:
        return boosted_scores(model, [(0, train, valid)], numeric, target, category, seed, trees)[0]
    n = stats["n"]
    t = t.withColumns({"_w": _weights(t, target), "_y": F.col(target).cast("double")})
    common = {"featuresCol": "_features", "labelCol": "_y"}
    prob: Column = vector_to_array(F.col("probability"))[1]
    if model == "logistic":
        est = LogisticRegression(**common, weightCol="_w", regParam=1.0 / n, standardization=False, maxIter=200)
    elif model == "poisson":
        est = GeneralizedLinearRegression(**common, family="poisson", link="log", regParam=1e-3, maxIter=50)
        prob = 1 - F.exp(-F.col("prediction"))
    else:
        est = RandomForestClassifier(**common, weightCol="_w", numTrees=trees or 200, maxDepth=10, minInstancesPerNode=2, seed=seed)
    fitted = Pipeline(stages=[*_assembled(numeric, category), est]).fit(t)
    return fitted.transform(v).withColumn("score", prob).select(*valid.columns, "score")


def boosted_scores(model: str, parts: list[tuple[int, DataFrame, DataFrame]], numeric: list[str], target: str, category: str | None = None, seed: int = 42, trees: int | None = None) -> dict[int, DataFrame]:
    """By fold the validation rows with ``score``, of (fold, train, valid); all folds are fitted in the same passes."""
    settings = replace(BOOSTED[model], seed=seed, **({"rounds": trees} if trees else {}))
    fitted = boosting.fit([(fold, _filled(train, numeric, category)) for fold, train, _ in parts], numeric, target, category, settings)
    out = {}
    for fold, _, valid in parts:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(numeric)] + ([F.coalesce(F.col(category).cast("string"), F.lit("__missing__")).alias("_fc")] if category else [])
        scored = boosting.score(fitted[fold], valid.select(*valid.columns, *filled), [f"_f{i}" for i in range(len(numeric))], "_fc" if category else None, settings)
        out[fold] = scored.select(*valid.columns, "score")
    return out


def _linear(x: list[Column], beta: np.ndarray) -> Column:
    out = F.lit(float(beta[0]))
    for c, b in zip(x, beta[1:], strict=True):
        out = out + c * float(b)
    return out


def nb_fit(train: DataFrame, numeric: list[str], target: str, alpha: float = 1.0, steps: int = 25, ridge: float = 1e-6) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Coefficients of a log-link negative binomial on standardized columns, by reweighted least
    squares; each step aggregates the upper half of a (k + 1)-square matrix."""
    s = train.agg(*[f(c) for c in numeric for f in (F.avg, F.stddev_pop)], F.avg(target)).first()
    scale = [(s[2 * i] or 0.0, s[2 * i + 1] or 1.0) for i in range(len(numeric))]
    x = [(F.col(c) - m) / d for c, (m, d) in zip(numeric, scale, strict=True)]
    beta = np.zeros(len(numeric) + 1)
    beta[0] = np.log(max(s[2 * len(numeric)] or 0.0, 1e-6))
    cols = [F.lit(1.0), *x]
    k = len(cols)
    for _ in range(steps):
        eta = _linear(x, beta)
        eta = F.when(eta > 20, 20.0).when(eta < -20, -20.0).otherwise(eta)
        mu = F.exp(eta)
        w = mu / (1 + alpha * mu)
        z = eta + (F.col(target) - mu) / mu
        sums = [F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * c * z) for c in cols]
        r = list(train.agg(*sums).first())
        a = np.zeros((k, k))
        at = 0
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = r[at]
                at += 1
        new = np.linalg.solve(a + ridge * np.trace(a) / k * np.eye(k), np.array(r[at:]))
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            break
    return beta, scale


def nb_score(train: DataFrame, valid: DataFrame, numeric: list[str], target: str) -> DataFrame:
    beta, scale = nb_fit(train, numeric, target)
    x = [(F.col(c) - m) / d for c, (m, d) in zip(numeric, scale, strict=True)]
    mu = F.exp(F.least(F.greatest(_linear(x, beta), F.lit(-20.0)), F.lit(20.0)))
    return valid.withColumn("score", F.least(mu, F.lit(1.0)))


def out_of_fold(df: DataFrame, folds: DataFrame, models: list[str], numeric: list[str], target: str, key: list[str], category: str | None = None, trees: int | None = None) -> DataFrame:
    """(key, fold, model, score) of all validation rows of all yielded folds."""
    out, parts = None, list(fold_ops.splits(df, folds, target))
    together = {m: boosted_scores(m, [(f["fold"], t, v) for f, t, v in parts], numeric, target, category, trees=trees) for m in dict.fromkeys(map(resolve, models)) if m in BOOSTED}
    for fold, train, valid in parts:
        for m in models:
            scored = together[resolve(m)][fold["fold"]] if resolve(m) in together else fit_score(m, train, valid, numeric, target, category, trees=trees)
            part = scored.select(*key, F.lit(fold["fold"]).alias("fold"), F.lit(resolve(m)).alias("model"), "score", target)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold can be trained")
    return out


def ensemble(oof: DataFrame, key: list[str]) -> DataFrame:
    return oof.groupBy(*key).agg(F.avg("score").alias("score"), F.count("score").alias("n_models"))


def model_means(oof: DataFrame, target: str) -> DataFrame:
    """Accuracy, Brier score and positive rate by model, means over folds."""
    y = F.col(target)
    by = oof.groupBy("model", "fold").agg(F.avg(((F.col("score") >= 0.5).cast("int") == y).cast("int")).alias("accuracy"), F.avg(F.pow(F.col("score") - y, 2)).alias("brier"), F.avg((F.col("score") >= 0.5).cast("int")).alias("positive_rate"))
    return by.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("accuracy", "brier", "positive_rate")])


def calibrate(train: DataFrame, df: DataFrame, score: str, target: str, method: str = "isotonic") -> DataFrame:
    """``df`` with ``calibrated``: isotonic, platt, or the clipped score itself."""
    clipped = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    if method == "identity":
        return df.withColumn("calibrated", clipped)
    t, v = (x.withColumn("_f", F.col(score).cast("double")) for x in (train.withColumn("_y", F.col(target).cast("double")), df))
    if method == "isotonic":
        out = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="calibrated").fit(t).transform(v)
    else:
        pipe = Pipeline(stages=[VectorAssembler(inputCols=["_f"], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="_y")])
        out = pipe.fit(t).transform(v).withColumn("calibrated", vector_to_array(F.col("probability"))[1])
    return out.select(*df.columns, F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)).alias("calibrated"))
