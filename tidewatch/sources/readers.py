"""Reading and writing tables: by suffix, with known columns, tolerant of optional inputs."""

from __future__ import annotations

import logging
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.clean import normalize_columns

LOG = logging.getLogger(__name__)
#: What a reference population file is called, and the kinds of files, each best first.
KEYWORDS = ["population", "census", "pop"]
SUFFIXES = [".csv", ".parquet", ".xlsx", ".xls"]


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema one pass; without, all columns are strings for the cleaning to coerce."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame | None:
    """A workbook's first sheet; None where the optional reader is not installed."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError:
        LOG.warning("no reader for %s", path)
        return None
    return spark.createDataFrame(pd.read_excel(path, dtype=str))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".xlsx", ".xls"):
        return read_excel(spark, path)
    if suffix in (".json", ".jsonl"):
        return read_jsonl(spark, path)
    raise ValueError(f"no reader for {suffix or path}")


def discover_population(spark: SparkSession, folder: str) -> str | None:
    """The best file below a folder by keyword, kind and path."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath().toString()
        name = re.sub(r"[^a-z0-9]", "", PurePosixPath(path).stem.lower())
        suffix = PurePosixPath(path).suffix.lower()
        rank = next((i for i, k in enumerate(KEYWORDS) if k in name), None)
        if rank is not None and suffix in SUFFIXES:
            found.append((rank, SUFFIXES.index(suffix), path))
    return min(found)[2] if found else None


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """The case table with normal names and dates parsed."""
    out = normalize_columns(read_table(spark, path))
    dates = [c for c in ("date", "week_start", "month_start") if c in out.columns]
    return out.withColumns({c: F.to_date(F.col(c).try_cast("timestamp")) for c in dates})


def load_census(spark: SparkSession, folder: str) -> DataFrame | None:
    path = discover_population(spark, folder)
    found = read_table(spark, path) if path else None
    return None if found is None else normalize_columns(found)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lines that are objects; a broken line stops the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_panel(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned Parquet; only partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def remove_matching(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Deletes generated files of a folder whose names match a pattern; the names."""
    fs, p = _fs(spark, folder)
    gone = []
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if re.fullmatch(pattern, name):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def year_chunks(start: int, end: int, size: int) -> list[tuple[int, int]]:
    return [(y, min(end, y + size - 1)) for y in range(start, end + 1, max(1, size))]


def manifest(df: DataFrame, years: list[int], state: str = "state", date: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows by state and year, and the pairs of a state and a year that have none."""
    by = df.groupBy(state, F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    grid = df.select(state).distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return by, grid.join(by, [state, "year"], "left_anti")
