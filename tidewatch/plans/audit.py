"""The audit of features: quality, association with the label, a forest's weights, one score each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import held, importance, metrics, quality

# The weights of the score's parts, and under or over which a feature is weak.
QUALITY = {"uniqueness_rate": 0.20, "log_variance": 0.25}
ASSOCIATION = {"spearman": 0.20, "point_biserial": 0.20, "fisher_score": 0.20, "mutual_info": 0.20, "forest": 0.10, "importance": 0.10}
MISSING, STABLE, QUALITY_SHARE, ASSOCIATION_SHARE = 0.35, 0.20, 0.35, 0.65
MOST_MISSING, LEAST_UNIQUE, LEAST_STABLE = 0.20, 0.05, 0.40


@dataclass(frozen=True)
class Audit:
    """``scores`` has a row for each feature; ``agreement`` one row (n, agreement) on the labels that
    both tables have."""

    scores: DataFrame
    agreement: DataFrame


def measures(df: DataFrame, features: list[str], target: str, district: str = "district", date: str = "date") -> DataFrame:
    """(feature, diagnostics, univariate signals, mutual_info): for each feature some aggregations."""
    rows, out = df.withColumn("_month", F.date_format(date, "yyyy-MM")), None
    for f in features:
        one = quality.diagnostics(rows, f, district, "_month").crossJoin(metrics.univariate(df, f, target)).crossJoin(metrics.mutual_information(df, f, target))
        one = one.withColumn("feature", F.lit(f))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no features to audit")
    return out


def scored(table: DataFrame) -> DataFrame:
    """``table`` (a row for each feature, with ``forest`` and ``importance``) with ``quality``,
    ``association``, ``score`` and ``flags``, the reasons why a feature is weak."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = {c: F.abs(zero(c)) if c in ("spearman", "point_biserial") else zero(c) for c in ("uniqueness_rate", *ASSOCIATION)} | {"log_variance": F.log1p(zero("variance"))}
    sides = table.select("feature", *[v.alias(c) for c, v in parts.items()])
    scaled = metrics.min_max(sides, list(parts)).select("feature", *[f"{c}_scaled" for c in parts])
    weighted = lambda w: sum((F.lit(v) * F.col(f"{c}_scaled") for c, v in w.items()), F.lit(0.0))
    out = table.join(scaled, "feature")
    out = out.withColumns({"quality": MISSING * (1 - F.coalesce("missing_rate", F.lit(1.0))) + STABLE * zero("stability_score") + weighted(QUALITY), "association": weighted(ASSOCIATION)})
    out = out.withColumn("score", QUALITY_SHARE * F.col("quality") + ASSOCIATION_SHARE * F.col("association")).drop(*[f"{c}_scaled" for c in parts])
    middle = out.agg(F.expr("percentile(score, 0.5D)").alias("_middle"))  # of as many rows as there are features
    reasons = {
        "high missingness": F.col("missing_rate") > MOST_MISSING, "low uniqueness": F.col("uniqueness_rate") < LEAST_UNIQUE,
        "unstable": F.col("stability_score") < LEAST_STABLE, "below the median score": F.col("score") < F.col("_middle"),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()]))
    return out.crossJoin(F.broadcast(middle)).withColumn("flags", flags).drop("_middle")


def label_agreement(a: DataFrame, b: DataFrame, target: str, key: list[str]) -> DataFrame:
    """One row: ``n`` keys that both tables have, and the share of equal labels where both have one."""
    both = a.select(*key, F.col(target).cast("int").alias("_a")).join(b.select(*key, F.col(target).cast("int").alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agreement"))


def run(df: DataFrame, labelled: DataFrame, features: list[str], target: str = "outbreak_label", key: tuple[str, ...] = ("district", "date"), repeats: int = 20, trees: int = 400) -> Audit:
    """Audits those ``features`` that ``df`` has; an error if it has none."""
    here = [f for f in features if f in df.columns]
    df = held.written(df.select(*dict.fromkeys([*key, "district", "date", target, *here])), "audited")  # read once for each feature and measure
    table = measures(df, here, target)
    weights = importance.permutation_importance(df, here, target, list(key), repeats, trees)
    whole = held.written(table.join(weights, "feature", "left"), "measures")  # a row for each feature, which the scores read several times
    return Audit(scored(whole), label_agreement(df, labelled, target, list(key)))


def report(audit: Audit, most: int = 5) -> str:
    """The audit as Markdown: best and worst features, weak ones with their reasons, agreement."""
    rows = audit.scores.orderBy(F.desc("score"), "feature").select("feature", "score", "missing_rate", "stability_score", "flags").collect()  # a row for each feature
    known = audit.agreement.first()
    line = lambda r: f"- **{r['feature']}**: score {r['score']:.3f}, missing {r['missing_rate'] or 0:.1%}, stability {r['stability_score'] or 0:.3f}"
    weak = [f"- **{r['feature']}**: {', '.join(r['flags'])}" for r in rows if r["flags"]]
    said = f"- Labels agree in {known['agreement']:.2%} of {known['n']} rows" if known["agreement"] is not None else "- No rows in common to compare labels"
    parts = ["# Feature audit", "", "## Most useful", *map(line, rows[:most]), "", "## Least useful", *map(line, rows[::-1][:most]), "", "## Weak", *(weak or ["- None"]), "", "## Labels", said]
    return "\n".join(parts) + "\n"
