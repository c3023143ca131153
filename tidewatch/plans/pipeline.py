"""The whole early-warning run: clean, impute, join, label, features, folds, models, decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import clean, decision, features, folds, hierarchical, impute, labels, metrics, models, population, posterior
from tidewatch.plans import profiles

NUMERIC = ["cases", "rainfall", "temperature", "temp", "temp_kelvin", "t2m", "humidity", "lat", "lon"]


@dataclass(frozen=True)
class Config:
    start_year: int = 2009
    end_year: int = 2019
    percentile: int = 75
    train_years: int | None = 3
    train_start: int | None = None
    first_valid: int = 2012
    last_valid: int = 2019
    models: tuple[str, ...] = ("percentile_rule", "logistic")
    cost: float = 1.0
    loss: float = 5.0
    run_id: str = "run"
    memory_filter: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Adapters:
    """The five steps that a project can replace, each a function of DataFrames."""

    load: Callable[..., DataFrame] | None = None
    clean: Callable[[DataFrame, Config], DataFrame] = lambda df, c: clean.clean(df, NUMERIC, c.start_year, c.end_year)
    label: Callable[[DataFrame, Config], DataFrame] = lambda df, c: labels.choose_label(labels.add_labels(labels.global_thresholds(df)), c.percentile)
    features: Callable[[DataFrame, Config], DataFrame] = lambda df, c: features.causal(df)
    folds: Callable[..., DataFrame] = lambda spark, c: folds.rolling(spark, c.first_valid, c.last_valid, c.train_years or 3) if c.train_start is None else folds.expanding(spark, c.train_start, c.first_valid, c.last_valid)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` laid on it, mapping by mapping."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def config(**values: Any) -> Config:
    return replace(Config(), **values)


def prepare(raw: DataFrame, cfg: Config, census: DataFrame | None = None, steps: Adapters | None = None) -> DataFrame:
    """Cleaned, imputed, labelled rows with features; one lazy plan."""
    steps = steps or Adapters()
    df = impute.impute_climate(steps.clean(raw, cfg))
    if census is not None:
        df = population.merge_population(df, census, ["population"])
    df = steps.features(steps.label(df, cfg), cfg)
    return clean.memory_filter(df, **cfg.memory_filter) if cfg.memory_filter else df


@dataclass(frozen=True)
class Result:
    prepared: DataFrame
    ledger: DataFrame
    oof: DataFrame
    decisions: DataFrame
    metrics: DataFrame


def run(raw: DataFrame, cfg: Config, census: DataFrame | None = None, steps: Adapters | None = None) -> Result:
    """Out-of-fold risks of the models and of the closed-form effects, decisions and metrics. The
    prepared rows are persisted, for every fold reads them."""
    steps = steps or Adapters()
    df = prepare(raw, cfg, census, steps).persist()
    plan = steps.folds(df.sparkSession, cfg)
    numeric = [c for c in clean.drop_forbidden(df, "outbreak_label").columns if c.startswith("case_")]
    key = ["district", "date"]
    oof = models.out_of_fold(df, plan, list(cfg.models), numeric, "outbreak_label", key)
    risk = models.ensemble(oof, key).withColumnRenamed("score", "risk")
    scored = df.join(risk, key)
    decided = decision.decision_frame(scored, "risk", "outbreak_label", cfg.run_id, cfg.cost, cfg.loss)
    scores = metrics.confusion(scored, "outbreak_label", "risk").crossJoin(metrics.brier(scored, "outbreak_label", "risk")).crossJoin(metrics.roc_auc(scored, "outbreak_label", "risk")).crossJoin(metrics.average_precision(scored, "outbreak_label", "risk"))
    return Result(df, folds.ledger(df, plan, "outbreak_label"), oof, decided, scores)


def effects_out_of_fold(df: DataFrame, plan: DataFrame, target: str = "outbreak_label", y: str = "cases") -> DataFrame:
    """(district, date, fold, risk) of the closed-form effects, fitted on each fold's training years."""
    out = None
    for fold, train, valid in folds.splits(df, plan, target):
        part = posterior.linear_predictor(valid, *posterior.effects(train, y))
        part = part.select("district", "date", F.lit(fold["fold"]).alias("fold"), posterior.exceedance(F.col("linear"), posterior.resolve_threshold(valid)).alias("risk"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold can be trained")
    return out


def hierarchical_risk(train: DataFrame, valid: DataFrame, covariates: list[str], sampling: Mapping[str, Any], strict: bool = False, y: str = "cases", key: tuple[str, ...] = ("district", "date")) -> tuple[DataFrame, dict[str, Any]]:
    """(key, risk_mean, risk_q05, risk_q95) of the rows ``valid`` by the sampled model of ``train``, and its diagnostics.

    ``sampling`` has the settings of ``hierarchical.fit`` (chains, tune, draws, simplified, force_full, retries) and
    ``convergence_failure_mode``; other settings, of other samplers, count for nothing. Chains that have not converged
    are an error or a warning as ``profiles.convergence_mode`` has it."""
    known = {k: sampling[k] for k in ("chains", "tune", "draws", "simplified", "force_full", "retries", "seed") if sampling.get(k) is not None}
    fitted = hierarchical.fit(train, y, covariates, **known)
    mode, why = profiles.convergence_mode(sampling, strict)
    profiles.enforce(fitted.diagnostics["converged"], mode)
    rows = hierarchical.linear_draws(fitted, valid.withColumn("_threshold", posterior.resolve_threshold(valid)), [*key, "_threshold"])
    risks = rows.withColumn("draws", F.transform("linear", lambda x: posterior.exceedance(x, F.col("_threshold"))))
    out = posterior.draw_summary(risks).select(*key, F.col("mean").alias("risk_mean"), F.col("q05").alias("risk_q05"), F.col("q95").alias("risk_q95"))
    return out, fitted.diagnostics | {"convergence_mode": mode, "convergence_reason": why}


def hierarchical_out_of_fold(df: DataFrame, plan: DataFrame, covariates: list[str], base: Mapping[str, Any], given: Mapping[str, Any] | None = None, profile: str | None = None, strict: bool = False, target: str = "outbreak_label", y: str = "cases") -> tuple[DataFrame, list[dict[str, Any]]]:
    """(district, date, fold, risk_mean, risk_q05, risk_q95) of the sampled model, fitted on each fold's training years
    with the settings of the folds' profile (``profiles.settings``), and the diagnostics of each fold."""
    sampling, out, found = profiles.settings(base, given, profile)["cv"], None, []
    for fold, train, valid in folds.splits(df, plan, target):
        part, about = hierarchical_risk(train, valid, covariates, sampling, strict, y)
        part = part.withColumn("fold", F.lit(fold["fold"]))
        found.append(about | {"fold": fold["fold"]})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold can be trained")
    return out, found


def manifest(result: Result, cfg: Config) -> dict[str, Any]:
    """What a run made, for its record; each figure is one aggregation."""
    d = result.decisions.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("district").alias("districts")).first()
    return {"run_id": cfg.run_id, "decision_rows": d["n"], "districts": d["districts"], "decision_columns": result.decisions.columns, "ledger": [r.asDict() for r in result.ledger.orderBy("fold").collect()]}


def check_manifest(m: Mapping[str, Any], run_id: str) -> list[str]:
    """What is wrong with a manifest; empty if nothing."""
    out = [] if m.get("run_id") == run_id else ["run_id differs"]
    out += [] if m.get("decision_columns") == decision.COLUMNS else ["decision columns differ"]
    return out + [f"fold {r['fold']} leaks" for r in m.get("ledger", []) if r["status"] == "potential_leakage"]
