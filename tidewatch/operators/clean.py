"""Cleaning: names, dates, numbers, duplicates, temperature units, panel completion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.dates import from_parts, iso_week_start, to_anchor
from tidewatch.functions.values import clip, number, shard
from tidewatch.operators.ranks import quantiles_now

# Other names of known columns; the first one present is taken.
ALIASES = {"state_ut": "state", "preci": "rainfall", "longitute": "longitude"}
API_ALIASES = {
    "state": ["state", "uf", "estado"],
    "district": ["district", "municipio", "municipio_nome", "mun_name"],
    "municipality_id": ["municipality_id", "geocode", "municipio_geocodigo", "municipio_geocode", "id_municipio"],
    "cases": ["casos_est", "cases", "casos"],
    "date": ["date", "data_ini_se", "data_inise", "data_ini"],
    "year": ["year", "ano"],
    "week": ["week", "epiweek", "se"],
}
#: Columns that ingestion must not have, by name or start.
ENGINEERED = ("outbreak_label", "threshold_", "case_lag", "case_roll", "case_trend", "case_cum", "neighbor_", "temp_anomaly", "month", "weekofyear")
KELVIN = 273.15
# Names of temperature columns; the first one present is taken.
SOURCES = ["temp_kelvin", "temperature_kelvin", "temperature", "temp", "t2m"]


def normal_name(name: str) -> str:
    x = name.strip().lower().replace("%", "pct")
    x = re.sub(r"\s+", "_", re.sub(r"[/-]", "_", x))
    return re.sub(r"_+", "_", x)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def rename_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def synthesize_date(df: DataFrame, column: str = "date") -> DataFrame:
    if column in df.columns:
        return df.withColumn(column, F.to_date(F.col(column).try_cast("timestamp")))
    month = next((c for c in ("mon", "month") if c in df.columns), None)
    if month and {"day", "year"} <= set(df.columns):
        return df.withColumn(column, from_parts(F.col("year"), F.col(month), F.col("day")))
    return df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def filter_years(df: DataFrame, start: int = 2009, end: int = 2019, column: str = "date") -> DataFrame:
    """Rows of the years ``start`` to ``end``; as a date range, so it reaches the scan."""
    return df.where((F.col(column) >= F.lit(f"{start}-01-01").cast("date")) & (F.col(column) < F.lit(f"{end + 1}-01-01").cast("date")))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (nulls of a key are equal)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def is_kelvin(df: DataFrame, column: str) -> bool:
    """Whether the column is in kelvin, by its name or else by its quantiles, which are read at once."""
    if re.search(r"kelvin|_k$", column.lower()):
        return True
    if re.search(r"celsius|_c$", column.lower()):
        return False
    found = quantiles_now(df, [column], [0.0, 0.05, 0.5, 0.95, 1.0])[column]
    if found is None:
        return False
    low, q05, q50, q95, high = found
    return True if q05 >= 150 and q95 <= 360 else False if low >= -40 and high <= 80 else q50 > 120


def normalize_temperature(df: DataFrame) -> DataFrame:
    """``temperature`` in Celsius and ``temp_kelvin`` from the first source column there is."""
    source = next((c for c in SOURCES if c in df.columns), None)
    if source is None:
        return df
    x = F.col(source)
    kelvin, celsius = (x, x - KELVIN) if is_kelvin(df, source) else (x + KELVIN, x)
    return df.withColumns({"temp_kelvin": kelvin, "temperature": celsius})


def clean(df: DataFrame, numeric: list[str], start: int = 2009, end: int = 2019) -> DataFrame:
    """The whole cleaning chain."""
    out = rename_aliases(df.toDF(*[c.strip().lower() for c in df.columns])).transform(synthesize_date)
    out = filter_years(require(out, ["district", "date"]), start, end).dropDuplicates()
    return coerce_numbers(out, numeric).transform(normalize_temperature)


def normalize_api(df: DataFrame, state: str | None = None, anchor: int | None = None) -> DataFrame:
    """Records of a weekly API in one schema. Several names of a column are coalesced in order;
    cases are never null or negative; a missing date comes from year and week."""
    names = {c.lower(): c for c in df.columns}
    pick = lambda k: [F.col(f"`{names[a]}`") for a in API_ALIASES[k] if a in names]
    first = lambda k, kind="string": F.coalesce(*[c.try_cast(kind) for c in pick(k)], F.lit(None).cast(kind))
    cases = F.coalesce(*[number(c) for c in pick("cases")], F.lit(0.0))
    day = first("date", "date")
    week = first("week", "int")
    weekly = iso_week_start(F.coalesce(first("year", "int"), F.floor(week / 100).cast("int")), F.when(week > 100, week % 100).otherwise(week))
    day = F.coalesce(day, weekly)
    others = [F.col(f"`{names[c]}`").try_cast("double").alias(c) for c in ("rt", "p_rt1", "receptivo", "pop") if c in names]
    return df.select(
        F.coalesce(first("state"), F.lit(state)).alias("state"), F.coalesce(first("district"), first("municipality_id")).alias("district"), first("municipality_id").alias("municipality_id"),
        (day if anchor is None else to_anchor(day, anchor)).alias("date"), F.when(cases < 0, 0.0).otherwise(cases).alias("cases"), *others,
    )


def assert_minimal(columns: list[str]) -> None:
    bad = [c for c in columns if c.startswith(ENGINEERED)]
    if bad:
        raise ValueError(f"engineered columns in ingestion: {', '.join(bad)}")


def complete_panel(df: DataFrame, entity: list[str], fill: str = "cases", step: int = 7, column: str = "date") -> DataFrame:
    """Every entity at every week from the first to the last. The weeks are one row, exploded
    after a broadcast; the values come by a join that treats null keys as equal."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    weeks = span.where("a IS NOT NULL").select(F.explode(F.expr(f"sequence(a, b, interval {step} days)")).alias(column))
    grid = df.select(*entity).distinct().crossJoin(F.broadcast(weeks)).alias("g")
    right = df.alias("d")
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*entity, column]]
    rest = [c for c in df.columns if c not in (*entity, column, fill)]
    return grid.join(right, on, "left").select(*[F.col(f"g.{c}").alias(c) for c in [*entity, column]], F.coalesce(F.col(f"d.{fill}"), F.lit(0)).alias(fill), *[F.col(f"d.{c}").alias(c) for c in rest])


def anchor_report(df: DataFrame, anchor: int, keys: list[str], column: str = "date") -> DataFrame:
    """Distinct keys before and after alignment, and the modal weekday."""
    moved = df.withColumn("_to", to_anchor(F.col(column), anchor))
    return moved.agg(
        F.countDistinct(*keys, column).alias("keys_before"), F.countDistinct(*keys, "_to").alias("keys_after"),
        F.mode(F.weekday(column), True).alias("modal_weekday"),
    )


def memory_filter(df: DataFrame, start: int | None = None, end: int | None = None, shards: int = 1, at: int = 0, district: str = "district") -> DataFrame:
    out = df if start is None or end is None else filter_years(df, start, end)
    return out if shards <= 1 else out.where(shard(F.col(district), shards) == at)


def drop_forbidden(df: DataFrame, target: str | None = None) -> DataFrame:
    """Without columns that would leak the target into a model: labels, thresholds, raw cases."""
    bad = [c for c in df.columns if c != target and re.match(r"outbreak_label|threshold|label_|cases$|casos|case_count$|y_true$", c)]
    return df.drop(*bad)


def distribution_fit_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if re.search(r"zscore|z_score|minmax|min_max|standardi[sz]ed|scaled|normalized|quantile_transform", c) and re.search(r"case|rt", c)]


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items() if c in df.columns})
