"""Hierarchical risk: closed-form effects, exceedance, draws and their summaries (the sampler is in ``hierarchical``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def effects(df: DataFrame, y: str, district: str = "district", date: str = "date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The overall rate (one row) and the effects of districts and dates."""
    v = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    d = F.coalesce(F.col(district), F.lit("unknown"))
    return (
        df.agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("rate")),
        df.groupBy(d.alias("district")).agg(F.log1p(F.avg(v)).alias("district_effect")),
        df.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(F.log1p(F.avg(v)).alias("time_effect")),
    )


def linear_predictor(df: DataFrame, rate: DataFrame, by_district: DataFrame, by_date: DataFrame, district: str = "district", date: str = "date") -> DataFrame:
    """District effect (of a new one log1p of the rate) and date effect (of a new date the last
    one's, of a null date 0)."""
    last = by_date.agg(F.max_by("time_effect", "date").alias("_last"))
    a, b = by_district.toDF("_d", "_de"), by_date.toDF("_t", "_te")
    out = df.join(a, F.coalesce(df[district], F.lit("unknown")) == a["_d"], "left").join(b, df[date] == b["_t"], "left").crossJoin(F.broadcast(rate.crossJoin(last)))
    time = F.when(F.col(date).isNull(), 0.0).otherwise(F.coalesce("_te", "_last", F.lit(0.0)))
    return out.withColumn("linear", F.coalesce("_de", F.log1p("rate")) + time).drop("_d", "_de", "_t", "_te", "_last", "rate")


def exceedance(linear: Column, threshold: Column) -> Column:
    """P(Y >= threshold) of a negative binomial with dispersion 1, which is geometric."""
    mu = F.exp(F.when(linear > 20, 20.0).when(linear < -20, -20.0).otherwise(linear))
    k = F.ceil(F.when(threshold < 0, 0.0).otherwise(F.coalesce(threshold, F.lit(1.0))))
    return F.pow(mu / (1 + mu), k)


def nb_exceedance(mu: float, threshold: float, alpha: float) -> float:
    """P(Y >= threshold) for any dispersion, from the sum below it."""
    k, r = max(0, math.ceil(threshold)), 1.0 / alpha
    p = r / (r + mu)
    below = sum(math.exp(math.lgamma(r + i) - math.lgamma(r) - math.lgamma(i + 1) + r * math.log(p) + i * math.log1p(-p)) for i in range(k)) if mu > 0 else float(k > 0)
    return min(1.0, max(0.0, 1.0 - below))


def resolve_threshold(df: DataFrame, given: str | None = None) -> Column:
    name = given or next((c for c in sorted(df.columns) if c.startswith("threshold_p") or c == "outbreak_threshold"), None)
    return F.coalesce(F.col(name).cast("double"), F.lit(1.0)) if name else F.lit(1.0)


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their deviation (1 if tiny)."""
    s = df.agg(*[f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(s))
    return out.withColumns({c: (F.col(c) - F.col(f"_{c}_m")) / F.when(F.col(f"_{c}_s") < 1e-8, 1.0).otherwise(F.col(f"_{c}_s")) for c in columns}).select(*df.columns)


def _quantile(values: Column, q: float) -> Column:
    """The interpolated quantile of a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    a, b = F.get(values, lo), F.coalesce(F.get(values, lo + 1), F.get(values, lo))
    return a + (b - a) * (at - lo)


def draw_summary(df: DataFrame, draws: str = "draws") -> DataFrame:
    """Mean, median, bounds and deviation of each row's draws, inside the row."""
    v = F.array_sort(F.filter(draws, lambda x: x.isNotNull()))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = df.withColumn("_v", v).withColumn("_m", total(F.col("_v")) / F.nullif(F.size("_v"), F.lit(0)))
    sq = F.aggregate(F.col("_v"), F.struct(F.lit(0.0).alias("s")), lambda s, x: F.struct((s["s"] + x * x).alias("s")))["s"]
    return out.withColumns({
        "mean": F.col("_m"), "median": _quantile(F.col("_v"), 0.5), "q05": _quantile(F.col("_v"), 0.05), "q95": _quantile(F.col("_v"), 0.95),
        "std": F.sqrt(F.greatest(sq / F.nullif(F.size("_v"), F.lit(0)) - F.col("_m") * F.col("_m"), F.lit(0.0))),
    }).drop("_v", "_m")


def draw_exceedance(df: DataFrame, threshold: Column, draws: str = "draws") -> DataFrame:
    """The share of draws over the threshold, and a flag where it is half or more."""
    share = F.size(F.filter(draws, lambda x: x > threshold)) / F.nullif(F.size(draws), F.lit(0))
    return df.withColumn("exceedance", share).withColumn("risk_flag", (F.col("exceedance") >= 0.5).cast("int"))


def posterior_risk(df: DataFrame, draws: DataFrame, threshold: Column, key: list[str], district: str = "district") -> DataFrame:
    """(key, risk_mean, risk_q05, risk_q95). ``draws`` (draw, district, linear) has a value for each
    draw and district, of bounded number; rows meet their district's draws as one array. A district
    without draws takes the mean over districts of each draw."""
    by = draws.groupBy("district").agg(F.array_sort(F.collect_list(F.struct("draw", "linear"))).alias("_l"))
    rest = draws.groupBy("draw").agg(F.avg("linear").alias("linear")).agg(F.array_sort(F.collect_list(F.struct("draw", "linear"))).alias("_r"))
    out = df.join(by.withColumnRenamed("district", "_d"), df[district] == F.col("_d"), "left").crossJoin(F.broadcast(rest))
    risks = F.array_sort(F.transform(F.coalesce("_l", "_r"), lambda x: exceedance(x["linear"], threshold)))
    s = draw_summary(out.withColumn("draws", risks))
    return s.select(*key, F.col("mean").alias("risk_mean"), F.col("q05").alias("risk_q05"), F.col("q95").alias("risk_q95"))


def split_rhat(draws: DataFrame, value: str = "value") -> DataFrame:
    """(parameter, r_hat) of (parameter, chain, draw, value): each chain in two halves."""
    w = W.partitionBy("parameter", "chain")
    half = draws.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy("draw"))})
    half = half.withColumn("_h", F.when(F.col("_r") <= F.floor(F.col("_n") / 2), 0).when(F.col("_r") > F.ceil(F.col("_n") / 2), 1)).where("_h IS NOT NULL")
    c = half.groupBy("parameter", "chain", "_h").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    g = c.groupBy("parameter").agg(F.avg("v").alias("within"), (F.avg("n") * F.var_samp("m")).alias("between"), F.avg("n").alias("n"))
    var = (F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between") / F.col("n")
    return g.select("parameter", F.sqrt(F.try_divide(var, F.col("within"))).alias("r_hat"))


def converged(diagnostics: list[dict], divergences: int = 0, depth: float = 0, r_hat: float = 1.01, ess: float = 400, most_divergences: int = 0, most_depth: float = 10) -> bool:
    return divergences <= most_divergences and depth < most_depth and all(d["r_hat"] is not None and d["r_hat"] <= r_hat and d["ess_bulk"] >= ess for d in diagnostics)


def recent_years(df: DataFrame, years: int, date: str = "date") -> DataFrame:
    last = df.agg(F.max(F.year(date)).alias("_y"))
    return df.crossJoin(F.broadcast(last)).where(F.year(date) > F.col("_y") - years).drop("_y")


def top_cases(df: DataFrame, k: int, cases: str = "cases", order: tuple[str, ...] = ("district", "date")) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(cases), *order).limit(k)


def stratified(df: DataFrame, y: str, fraction: float, key: list[str], seed: int = 7) -> DataFrame:
    """The rounded share ``fraction`` of each class, exactly: its first rows by the md5 of seed and key.

    A class is never sorted whole. Its rows are counted by the first 16 bits of the hash; bins below the
    one in which the quota ends are taken whole, and rows are ranked within single bins only. The same rows
    each time, whatever the partitions; a null class is a class; of rows with equal keys any may be taken."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    rows = df.withColumn("_h", text).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    by = W.partitionBy("_y")
    before = F.coalesce(F.sum("n").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = rows.groupBy(F.col(y).alias("_y"), F.col("_b").alias("_bin")).agg(F.count("*").alias("n")).withColumnRenamed("_bin", "_b")
    open_ = bins.select("_y", F.col("_b").alias("_bin"), (F.floor(F.lit(fraction) * F.sum("n").over(by) + 0.5) - before).alias("_left")).where("_left > 0")
    met = rows.join(open_, rows[y].eqNullSafe(open_["_y"]) & (rows["_b"] == open_["_bin"]))
    place = F.row_number().over(W.partitionBy(y, "_b").orderBy("_h", *key))
    return met.withColumn("_r", place).where("_r <= _left").select(*df.columns)
