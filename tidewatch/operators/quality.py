"""Reports and gates on columns, each from one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.features import DEGENERATE


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, missing_rate, n_infinite, variance, uniqueness_rate) for each column: one pass,
    then the single row is turned."""
    def of(c: str) -> Column:
        x = F.col(c).cast("double")
        ok = F.count(x)
        return F.struct(
            F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.avg(F.isnull(x).cast("int")).alias("missing_rate"),
            F.sum(F.coalesce((F.abs(x) == float("inf")).cast("long"), F.lit(0))).alias("n_infinite"),
            F.when(ok > 1, F.var_pop(x)).otherwise(0.0).alias("variance"), (F.countDistinct(x) / F.greatest(ok, F.lit(1))).alias("uniqueness_rate"), ok.alias("n_valid"),
        )

    return df.agg(F.array(*[of(c) for c in columns]).alias("r")).select(F.inline("r"))


def gate(df: DataFrame, columns: list[str], variance: float = 1e-10, uniqueness: float = 0.01, least: int = 24) -> DataFrame:
    """The report with ``flagged``: enough values, and hardly any variance or different values."""
    low = (F.col("variance") <= variance) | (F.col("uniqueness_rate") <= uniqueness)
    return column_report(df, columns).withColumn("flagged", (F.col("n_valid") >= least) & low)


def drop_flagged(df: DataFrame, columns: list[str], strict: bool = False, **limits: float) -> DataFrame:
    bad = [r["feature"] for r in gate(df, columns, **limits).where("flagged").select("feature").collect()]  # a row for each column
    if bad and strict:
        raise ValueError(f"quality gate failed: {', '.join(bad)}")
    return df.drop(*bad)


def validate(df: DataFrame, required: list[str], most_missing: float = 0.4) -> DataFrame:
    """The report with ``passed`` for each required column that there is, and a failed row for others."""
    here = [c for c in required if c in df.columns]
    absent = [c for c in required if c not in df.columns]
    out = column_report(df, here).withColumn("passed", (F.col("missing_rate") <= most_missing) & (F.col("n_infinite") == 0)) if here else None
    if absent:
        rows = df.sparkSession.createDataFrame([(c, False) for c in absent], "feature string, passed boolean")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def diagnostics(df: DataFrame, feature: str, district: str = "district", time: str = "date") -> DataFrame:
    """One row: missing rate, variance, uniqueness, variation between districts and times, stability."""
    x = F.col(feature).cast("double")

    def cv(key: str, name: str) -> DataFrame:
        means = df.groupBy(key).agg(F.avg(x).alias("m"))
        ok = (F.count("m") > 1) & (F.avg("m") != 0)
        return means.agg(F.when(ok, F.stddev_pop("m") / F.abs(F.avg("m"))).alias(name))

    whole = df.agg(
        F.avg(F.isnull(x).cast("int")).alias("missing_rate"), F.when(F.count(x) > 1, F.var_pop(x)).otherwise(0.0).alias("variance"),
        (F.countDistinct(x) / F.greatest(F.count(x), F.lit(1))).alias("uniqueness_rate"),
    )
    out = whole.crossJoin(F.broadcast(cv(district, "district_cv"))).crossJoin(F.broadcast(cv(time, "temporal_cv")))
    n = F.col("district_cv").isNotNull().cast("int") + F.col("temporal_cv").isNotNull().cast("int")
    mean = (F.coalesce("district_cv", F.lit(0.0)) + F.coalesce("temporal_cv", F.lit(0.0))) / F.nullif(n, F.lit(0))
    bad = (F.col("variance") <= DEGENERATE) | (F.col("uniqueness_rate") <= 0.01) | (n == 0)
    return out.withColumn("stability_score", F.when(bad, 0.0).otherwise(1 / (1 + mean)))
