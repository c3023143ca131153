"""Evaluation of scores against binary labels; every metric is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.values import ratio
from tidewatch.operators.ranks import quantiles, quantiles_now, running


def _clean(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).where("y IN (0, 1) AND p IS NOT NULL")


def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1, kappa, false-alarm rate. A division by 0
    gives 0, for the false-alarm rate null."""
    a = F.col("p") >= threshold
    n = lambda yes, c: F.sum((c & (F.col("y") == yes)).cast("long"))
    c = _clean(df, y, p).agg(n(1, a).alias("tp"), n(0, a).alias("fp"), n(1, ~a).alias("fn"), n(0, ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), total * total)
    agree = ratio(tp + tn, total)
    return c.select(
        "tp", "fp", "fn", "tn", agree.alias("accuracy"), zero(ratio(tp, tp + fp)).alias("precision"), zero(ratio(tp, tp + fn)).alias("recall"),
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), zero(ratio(agree - chance, 1 - chance)).alias("kappa"), ratio(fp, fp + tn).alias("false_alarm_rate"),
    )


def score_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """(p, pos, neg) for each distinct score: rows are aggregated before any global order is needed."""
    return _clean(df, y, p).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    t = running(score_table(df, y, p), "p", ["neg"]).withColumn("below", F.col("cum_neg") - F.col("neg"))
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return t.agg(ratio(pairs, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision_by(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """(by, average_precision) for each value of the columns ``by``, which are not null and have few values, in one job."""
    rows = df.select(*by, F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p")).where("y IN (0, 1) AND p IS NOT NULL")
    table = rows.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    t = running(table, "p", ["pos", "neg"], descending=True, by=by)
    return t.groupBy(*by).agg(ratio(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), F.sum("pos").cast("double")).alias("average_precision"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    t = running(score_table(df, y, p), "p", ["pos", "neg"], descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    return t.agg(ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")).alias("average_precision"))


def curves(df: DataFrame, y: str, p: str) -> DataFrame:
    """(p, tpr, fpr, precision): a row for each distinct score, descending."""
    table = score_table(df, y, p)
    t = running(table, "p", ["pos", "neg"], descending=True).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    t = t.crossJoin(F.broadcast(table.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))))
    return t.select("p", ratio(F.col("tp").cast("double"), F.col("np").cast("double")).alias("tpr"), ratio(F.col("fp").cast("double"), F.col("nn").cast("double")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    clipped = F.when(F.col("p") < 0, 0.0).when(F.col("p") > 1, 1.0).otherwise(F.col("p"))
    return _clean(df, y, p).agg(F.avg(F.pow(clipped - F.col("y"), 2)).alias("brier"))


def _bin(df: DataFrame, edges: Column) -> DataFrame:
    """Rows with their (low, high] bin; the first bin has its low edge too. One edge is a bin of one value."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    lower = F.get(edges, F.col("_at") - 1)
    return df.withColumn("_at", F.size(F.filter(inner, lambda e: e < F.col("p"))) + 1).withColumns({"bin_lower": lower, "bin_upper": F.coalesce(F.get(edges, F.col("_at")), lower)})


def _bins(df: DataFrame) -> DataFrame:
    return df.groupBy("bin_lower", "bin_upper").agg(F.count(F.lit(1)).alias("count"), F.avg("p").alias("avg_pred"), F.avg("y").alias("obs_rate"))


def reliability_quantile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """By bins between the quantiles of the scores, which are read at once: in the plan they would repeat all that is before it."""
    rows = _clean(df, y, p)
    found = quantiles_now(rows, ["p"], [k / bins for k in range(bins + 1)])["p"]
    edges = F.array(*[F.lit(x) for x in dict.fromkeys(found)]) if found else F.lit(None).cast("array<double>")
    return _bins(_bin(rows, edges))


def reliability_uniform(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    edges = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    return _bins(_bin(_clean(df, y, p).where("p BETWEEN 0 AND 1"), edges))


def reliability_range(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from the least to the largest score."""
    rows = _clean(df, y, p)
    span = F.broadcast(rows.agg(F.min("p").alias("a"), F.max("p").alias("b")))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins)
    return _bins(_bin(rows.crossJoin(span), edges))


def lead_times(df: DataFrame, y: str, pred: str, most: int | None = 8, district: str = "district", date: str = "date") -> DataFrame:
    """(district, date, lead) of each onset: rows since the last alert before it, 0 without one or
    if it is too far back. The position and the last alert are running aggregates of one window."""
    w = W.partitionBy(F.coalesce(F.col(district), F.lit("__missing__"))).orderBy(F.col(date).asc_nulls_last())
    pos = F.row_number().over(w)
    rows = df.withColumns({"_pos": pos, "_before": F.lag(y, 1, 0).over(w)}).withColumn("_alert", F.max(F.when(F.col(pred) == 1, F.col("_pos"))).over(w.rowsBetween(W.unboundedPreceding, -1)))
    lead = F.coalesce(F.col("_pos") - F.col("_alert"), F.lit(0))
    if most is not None:
        lead = F.when(lead > most, 0).otherwise(lead)
    return rows.where((F.col(y) == 1) & (F.coalesce("_before", F.lit(0)) == 0)).select(district, date, lead.cast("long").alias("lead"))


def lead_utility(leads: DataFrame, unit: float = 1.0, cap: int = 4) -> DataFrame:
    c = F.when(F.col("lead") > cap, cap).when(F.col("lead") < 0, 0).otherwise(F.col("lead"))
    return leads.agg((F.coalesce(F.avg(c), F.lit(0.0)) * unit).alias("lead_utility"), F.coalesce(F.avg("lead"), F.lit(0.0)).alias("mean_lead"), F.count(F.lit(1)).alias("n_onsets"))


def interval_coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    inside = F.coalesce((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high)), F.lit(False))
    return df.agg(F.avg(inside.cast("int")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("mean_width"))


def average_rank(x: str, name: str, df: DataFrame) -> DataFrame:
    """``df`` with average ranks of ``x``. Values are counted first, so the global order is over
    distinct values only."""
    counts = running(df.groupBy(F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "_x", ["_n"])
    ranks = counts.select("_x", (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, df[x] == F.col("_x")).drop("_x")


def univariate(df: DataFrame, x: str, y: str, least: int = 12) -> DataFrame:
    """One row: Spearman, point-biserial correlation, Fisher score; null with too few rows or one
    class, 0 where the feature has one value."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_rank("y", "ry", average_rank("x", "rx", rows))
    one, zero = F.when(F.col("y") == 1, F.col("x")), F.when(F.col("y") == 0, F.col("x"))
    corr = lambda a, b: ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))  # noqa: E731 (F.corr divides by 0 where a side has one value)
    s = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), corr("rx", "ry").alias("rho"), corr("x", "y").alias("r"),
        F.coalesce(ratio(F.pow(F.avg(one) - F.avg(zero), 2), F.var_pop("x")), F.lit(0.0)).alias("f"),
    )
    valid = lambda c: F.when(F.col("n") < least, None).when(F.col("nx") < 2, 0.0).when(F.col("ny") < 2, None).otherwise(F.col(c))
    return s.select("n", valid("rho").alias("spearman"), valid("r").alias("point_biserial"), valid("f").alias("fisher_score"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information of a feature (in quantile bins) and a binary label, in nats."""
    rows = df.select(F.col(x).cast("double").alias("p"), F.col(y).cast("int").alias("y")).where("p IS NOT NULL AND y IS NOT NULL")
    edges = quantiles(rows, ["p"], [k / bins for k in range(bins + 1)]).select(F.array_distinct("p").alias("edges"))
    # From here on a row for each bin and label.
    cells = _bin(rows.crossJoin(F.broadcast(edges)), F.col("edges")).groupBy("_at", "y").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("c").alias("n")))).withColumns({"cx": F.sum("c").over(W.partitionBy("_at")), "cy": F.sum("c").over(W.partitionBy("y"))})
    return cells.agg(F.coalesce(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))), F.lit(0.0)).alias("mutual_info"))


def compare(a: DataFrame, b: DataFrame, on: str = "metric", value: str = "value") -> DataFrame:
    """Two metric tables side by side with difference and percentage."""
    x, y = a.select(on, F.col(value).alias("track_a")), b.select(on, F.col(value).alias("track_b"))
    delta = F.col("track_b") - F.col("track_a")
    return x.join(y, on, "full_outer").withColumns({"delta": delta, "relative_delta_pct": ratio(delta, F.abs("track_a")) * 100})


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 (0 where all are equal); null counts as 0. The bounds are one row."""
    low, high = (lambda c: F.col(f"_low_{c}")), (lambda c: F.col(f"_high_{c}"))
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    scaled = {f"{c}_scaled": F.coalesce(ratio(F.col(c) - low(c), high(c) - low(c)), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(bounds)).withColumns(scaled).select(*df.columns, *scaled)
