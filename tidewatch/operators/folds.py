"""Rolling-origin folds by year and their ledger."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = "fold int, train_start int, train_end int, valid_year int"


def rolling(spark, first: int, last: int, window: int = 3) -> DataFrame:
    """Trains on the ``window`` years before each year from ``first`` to ``last``."""
    rows = [(k + 1, y - window, y - 1, y) for k, y in enumerate(range(first, last + 1))]
    return spark.createDataFrame(rows, FOLD)


def expanding(spark, start: int, first: int, last: int) -> DataFrame:
    """Trains on all years from ``start`` to the one before."""
    rows = [(k + 1, start, y - 1, y) for k, y in enumerate(range(first, last + 1)) if start < y]
    return spark.createDataFrame(rows, FOLD)


def ledger(df: DataFrame, folds: DataFrame, target: str, date: str = "date", check_leakage: bool = True) -> DataFrame:
    """Counts and the status of each fold. Rows are counted by year and label first; what meets the
    folds is a row for each year."""
    by = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("low"), F.max(target).alias("high"))
    f = F.broadcast(folds)
    train, valid = F.col("year").between(F.col("train_start"), F.col("train_end")), F.col("year") == F.col("valid_year")
    met = f.join(by, train | valid, "left").groupBy(*folds.columns).agg(
        F.coalesce(F.sum(F.when(train, F.col("n"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("n_valid"),
        F.min(F.when(train, F.col("low"))).alias("low"), F.max(F.when(train, F.col("high"))).alias("high"), F.max(F.when(train, F.col("year"))).alias("last_train"),
    )
    status = F.when((F.col("n_train") == 0) | (F.col("n_valid") == 0), "empty_slice")
    if check_leakage:
        status = status.when(F.col("last_train") >= F.col("valid_year"), "potential_leakage")
    status = status.when(F.coalesce(F.col("low") == F.col("high"), F.lit(True)), "single_class_train").otherwise("yielded")
    return met.select(*folds.columns, "n_train", "n_valid", status.alias("status"))


def split(df: DataFrame, fold: dict, date: str = "date") -> tuple[DataFrame, DataFrame]:
    year = F.year(date)
    return df.where(year.between(fold["train_start"], fold["train_end"])), df.where(year == fold["valid_year"])


def splits(df: DataFrame, folds: DataFrame, target: str, date: str = "date") -> Iterator[tuple[dict, DataFrame, DataFrame]]:
    """The yielded folds, in order; the ledger has a row for each fold."""
    for r in ledger(df, folds, target, date).where("status = 'yielded'").orderBy("fold").collect():
        yield r.asDict(), *split(df, r.asDict(), date)
