"""Climate imputation: clipping, grouped medians, units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.clean import KELVIN, clip_columns, normalize_temperature
from tidewatch.operators.ranks import quantiles_now

# Bounds of plausible values.
BOUNDS = {"rainfall": (0, 2000), "temperature": (-10, 60), "temp_kelvin": (240, 340), "humidity": (0, 100)}


def cross_fill(df: DataFrame) -> DataFrame:
    return df.withColumns({"temperature": F.coalesce("temperature", F.col("temp_kelvin") - KELVIN)}).withColumns({"temp_kelvin": F.coalesce("temp_kelvin", F.col("temperature") + KELVIN)})


def units(df: DataFrame) -> DataFrame:
    if "temp_kelvin" in df.columns:
        return cross_fill(df if "temperature" in df.columns else df.withColumn("temperature", F.lit(None).cast("double")))
    return normalize_temperature(df)


def with_month(df: DataFrame, date: str = "date") -> DataFrame:
    month = F.month(date)
    return df.withColumn("month", F.coalesce("month", month) if "month" in df.columns else month)


def median_impute(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Nulls become the median of the group, else of all rows, both over the given values.

    The overall medians are ranks over counted values. A group's median is aggregated, so a group is
    a count map and not a partition of rows; the groups' table is joined (null keys are equal), the overall row is broadcast."""
    median = lambda c: F.expr(f"percentile({c}, 0.5D)")
    # One row, read at once: as a part of the plan it would repeat all that is before it several times.
    whole, out = quantiles_now(df, columns, [0.5]), df
    if keys:
        by = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[median(c).alias(f"_by_{c}") for c in columns])
        cond = [out[k].eqNullSafe(by[f"_{k}"]) for k in keys]
        out = out.join(by, cond, "left")
    fill = {c: F.coalesce(c, *([F.col(f"_by_{c}")] if keys else []), *([F.lit(whole[c][0])] if whole[c] else [])) for c in columns}
    return out.withColumns(fill).select(*df.columns)


def impute_climate(df: DataFrame, district: str = "district") -> DataFrame:
    out = with_month(units(df)).transform(clip_columns, BOUNDS)
    columns = [c for c in BOUNDS if c in out.columns]
    keys = [district, "month"] if district in out.columns else []
    out = median_impute(out, columns, keys)
    return cross_fill(out) if "temp_kelvin" in out.columns else out
