"""Alert levels, cost-loss thresholds and the decision table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ["NO_ACTION", "YELLOW", "ORANGE", "RED"]
#: The decision table's columns, in order.
COLUMNS = [
    "run_id", "date", "district", "risk_score", "risk_mean", "risk_q05", "risk_q95", "threshold_cases", "risk_score_basis",
    "decision_threshold_used", "decision_cost", "decision_loss", "alert_threshold_yellow", "alert_threshold_orange",
    "alert_threshold_red", "decision_policy_version", "alert_level", "recommended_action",
]


def alert_level(p: Column, yellow: float = 0.3, orange: float = 0.5, red: float = 0.7) -> Column:
    if not 0 <= yellow <= orange <= red <= 1:
        raise ValueError("alert thresholds must rise within 0 and 1")
    return F.when(p >= red, "RED").when(p >= orange, "ORANGE").when(p >= yellow, "YELLOW").otherwise("NO_ACTION")


def cost_loss_threshold(cost: float, loss: float, of_sum: bool = False) -> float:
    """``cost / loss`` in 0..1, or ``cost / (cost + loss)``."""
    whole = cost + loss if of_sum else loss
    return min(1.0, max(0.0, cost / whole))


def expected_cost(df: DataFrame, y: str, p: str, threshold: float, cost: float, loss: float) -> DataFrame:
    act = (F.col(p) >= threshold).cast("int")
    return df.agg(F.avg(act * cost + (1 - act) * F.col(y) * loss).alias("expected_cost"))


def threshold_grid(df: DataFrame, y: str, p: str, cost: float, loss: float, size: int = 101) -> DataFrame:
    """(threshold, expected_cost, n, n_pos) on an even grid.

    Rows are counted by the last grid point at or under their score first; a threshold's cost then
    needs only the running counts over the grid, not every row at every threshold."""
    rows = df.select(F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).where("y IN (0, 1) AND p IS NOT NULL")
    step = F.lit(1.0 / (size - 1))
    grid = F.array(*[F.lit(k / (size - 1)) for k in range(size)])
    at = F.floor(F.col("p") / step).cast("int")
    near = F.when(F.get(grid, at + 1) <= F.col("p"), at + 1).when(F.get(grid, at) > F.col("p"), at - 1).otherwise(at)
    counts = rows.groupBy(F.least(near, F.lit(size - 1)).alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos"))
    points = df.sparkSession.range(size).select(F.col("id").cast("int").alias("k"))
    both = F.broadcast(points).join(counts)
    acted = F.sum(F.when(F.col("cell") >= F.col("k"), F.col("c")).otherwise(0))
    missed = F.sum(F.when(F.col("cell") < F.col("k"), F.col("pos")).otherwise(0))
    total = F.sum("c")
    return both.groupBy("k").agg((acted * F.lit(float(cost)) + missed * F.lit(float(loss))).alias("s"), total.alias("n"), F.sum("pos").alias("n_pos")).select((F.col("k") / F.lit(float(size - 1))).alias("threshold"), (F.col("s") / F.col("n")).alias("expected_cost"), "n", "n_pos")


def best_threshold(df: DataFrame, y: str, p: str, cost: float, loss: float, least: int = 100, size: int = 101) -> DataFrame:
    """One row: the first cheapest threshold of the grid; cost / loss with too few rows or one class."""
    g = threshold_grid(df, y, p, cost, loss, size).agg(F.min(F.struct("expected_cost", "threshold")).alias("b"), F.max("n").alias("n"), F.max("n_pos").alias("n_pos"))
    ok = (F.coalesce("n", F.lit(0)) >= least) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    ok = F.coalesce(ok, F.lit(False))
    return g.select(
        F.when(ok, F.col("b.threshold")).otherwise(cost_loss_threshold(cost, loss)).alias("threshold"), F.when(ok, F.col("b.expected_cost")).alias("objective_cost"),
        F.coalesce("n", F.lit(0)).alias("sample_size"), ok.alias("optimized"), F.when(ok, "empirical_cost_loss_oof").otherwise("fallback_cost_loss_ratio").alias("method"),
    )


def staged_value(df: DataFrame, y: str, p: str, costs: dict[str, float], miss_loss: float) -> DataFrame:
    missing = [x for x in LEVELS if x not in costs]
    if missing or miss_loss < 0:
        raise ValueError(f"costs are missing for {missing}" if missing else "the loss must not be negative")
    level = alert_level(F.col(p))
    price = F.lit(None).cast("double")
    for name in LEVELS:
        price = F.when(level == name, F.lit(float(costs[name]))).otherwise(price)
    total = price + F.when((F.col(y) == 1) & (level == "NO_ACTION"), float(miss_loss)).otherwise(0.0)
    return df.select(level.alias("alert_level"), total.alias("t")).groupBy("alert_level").agg(F.count(F.lit(1)).alias("samples"), F.avg("t").alias("avg_total_cost"))


def decision_frame(df: DataFrame, risk: str | None, target: str, run_id: str, cost: float, loss: float, threshold: float | None = None, version: str = "v1", intervals: bool = False) -> DataFrame:
    """The 18 columns. Without a risk the target itself stands for it; mean and bounds are copies
    of the score unless ``intervals`` says that ``df`` has its own."""
    score = F.col(risk or target).cast("double")
    used = cost_loss_threshold(cost, loss) if threshold is None else threshold
    own = lambda c: F.col(c).cast("double") if intervals and c in df.columns else score
    values = {
        "run_id": F.lit(run_id), "date": F.col("date"), "district": F.col("district"), "risk_score": score,
        "risk_mean": own("risk_mean"), "risk_q05": own("risk_q05"), "risk_q95": own("risk_q95"),
        "threshold_cases": F.col("threshold_cases").cast("double") if "threshold_cases" in df.columns else F.lit(None).cast("double"),
        "risk_score_basis": F.lit("oof_risk" if risk else "target_passthrough"), "decision_threshold_used": F.lit(float(used)),
        "decision_cost": F.lit(float(cost)), "decision_loss": F.lit(float(loss)), "alert_threshold_yellow": F.lit(0.3), "alert_threshold_orange": F.lit(0.5),
        "alert_threshold_red": F.lit(0.7), "decision_policy_version": F.lit(version), "alert_level": alert_level(score), "recommended_action": F.coalesce((score >= used).cast("int"), F.lit(0)),
    }
    return df.select(*[values[c].alias(c) for c in COLUMNS])


def alert_trend(df: DataFrame, date: str = "date", level: str = "alert_level") -> DataFrame:
    return df.groupBy(date).pivot(level, LEVELS).count().fillna(0, LEVELS)


def top_districts(df: DataFrame, metric: str, k: int = 10, district: str = "district") -> DataFrame:
    return df.groupBy(district).agg(F.avg(metric).alias("mean_value")).orderBy(F.desc_nulls_last("mean_value"), district).limit(k)


# Columns that hold a risk, or else cases, in order of preference.
RISK_NAMES = ("risk_score", "bayesian_risk", "risk", "probability", "outbreak_probability")
CASE_NAMES = ("cases", "case_count")


def leading_districts(df: DataFrame, k: int = 20, district: str = "district") -> DataFrame:
    """(district, value): the ``k`` districts with the highest mean of the first risk column there is, else of the
    first case column, else with the most rows. What is no number counts as 0; ties go by name."""
    if k <= 0:
        raise ValueError("k must be positive")
    metric = next((c for c in RISK_NAMES + CASE_NAMES if c in df.columns), None)
    number = F.lit(1) if metric is None else F.coalesce(F.expr(f"try_cast(`{metric}` AS DOUBLE)"), F.lit(0.0))
    value = F.sum(number) if metric is None else F.avg(number)
    return df.groupBy(F.col(district).cast("string").alias("district")).agg(value.cast("double").alias("value")).orderBy(F.desc("value"), "district").limit(k)


def in_leading_districts(df: DataFrame, k: int = 20, district: str = "district") -> DataFrame:
    """The rows of the leading districts; at most ``k`` names are broadcast."""
    return df.join(F.broadcast(leading_districts(df, k, district).select(F.col("district").alias("_lead"))), F.col(district).cast("string") == F.col("_lead"), "left_semi")
