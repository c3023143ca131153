"""Thresholds and labels: whole history, past only, train folds, next step."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.functions.values import is_true

PERCENTILES = (70, 75, 80)


def in_order(district: str = "district", date: str = "date") -> W:
    return W.partitionBy(district).orderBy(F.col(date).asc_nulls_last())


def quantile(c: str, q: float) -> Column:
    return F.expr(f"percentile(`{c}`, {q}D)")


def global_thresholds(df: DataFrame, cases: str = "cases", district: str = "district", percentiles=PERCENTILES) -> DataFrame:
    """``threshold_p*`` of each district over its whole history, aggregated and joined."""
    by = df.groupBy(F.col(district).alias("_d")).agg(*[quantile(cases, p / 100).alias(f"threshold_p{p}") for p in percentiles])
    return df.join(by, df[district].eqNullSafe(by["_d"]), "left").drop("_d")


def add_labels(df: DataFrame, cases: str = "cases", percentiles=PERCENTILES) -> DataFrame:
    return df.withColumns({f"outbreak_label_p{p}": is_true(F.col(cases) >= F.col(f"threshold_p{p}")) for p in percentiles})


def choose_label(df: DataFrame, percentile: int = 75) -> DataFrame:
    name = f"outbreak_label_p{percentile}"
    if name not in df.columns:
        raise ValueError(f"no {name}; there are {[c for c in df.columns if c.startswith('outbreak_label_p')]}")
    return df.withColumn("outbreak_label", F.col(name))


def fixed_label(df: DataFrame, threshold: float, cases: str = "cases") -> DataFrame:
    return df.withColumn("outbreak_label", is_true(F.col(cases) >= threshold))


class RunningQuantile:
    """The quantile ``q`` of the values so far, by linear interpolation between ranks.

    The values up to the lower rank are in one heap and the others in a second one, so a value costs the
    logarithm of their number, and the two ranks are the heaps' tops. Without values it is None."""

    def __init__(self, q: float) -> None:
        self.q, self.low, self.high = q, [], []

    def add(self, value: float) -> None:
        if self.low and value < -self.low[0]:
            heapq.heappush(self.low, -value)
        else:
            heapq.heappush(self.high, value)
        rank = math.floor((len(self.low) + len(self.high) - 1) * self.q)
        while len(self.low) > rank + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < rank + 1:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float | None:
        if not self.low:
            return None
        place = (len(self.low) + len(self.high) - 1) * self.q
        share = place - math.floor(place)
        a = -self.low[0]
        return a + (self.high[0] - a) * share if share > 0 else a


def running_quantile(df: DataFrame, q: float, name: str, by: list[str], cases: str = "cases", date: str = "date") -> DataFrame:
    """``df`` with the quantile of ``cases`` over the rows of its group up to and with this one by date, null dates last.

    One shuffle and sort; a task takes its rows as a stream, group after group, in time n log n. It holds the
    numbers of one group, whatever the other columns are. Null cases count for nothing; null keys are a group."""
    mark = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in df.columns))  # no column begins like this
    keys = [f"{mark}by_{i}" for i in range(len(by))]
    carried = [c for c in df.columns if c != name]
    schema = StructType([*df.select(*carried).schema.fields, StructField(name, DoubleType())])
    rows = df.select(*carried, *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(cases).cast("double").alias(f"{mark}value"), F.to_date(date).alias(f"{mark}date"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.col(f"{mark}date").asc_nulls_last())
    n = len(carried)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), RunningQuantile(q)
        for batch in batches:
            out = []
            for key, x in zip(zip(*[batch.column(n + i).to_pylist() for i in range(len(keys))], strict=True), batch.column(n + len(keys)).to_pylist(), strict=True):
                if key != now:
                    now, state = key, RunningQuantile(q)
                if x is not None:
                    state.add(x)
                out.append(state.value())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.float64())], schema=pa.schema([*list(batch.schema)[:n], pa.field(name, pa.float64())]))

    return dealt.mapInArrow(work, schema)


def past_thresholds(df: DataFrame, q: float, name: str, cases: str = "cases", district: str = "district", date: str = "date") -> DataFrame:
    """The quantile over a district's rows up to and with this one."""
    return running_quantile(df, q, name, [district], cases, date)


def train_windows(years: DataFrame, window: int | None = 3, start: int | None = None) -> DataFrame:
    """(valid_year, train_start, train_end) for each year; a fixed start wins over a window."""
    begin = F.lit(start) if start is not None else F.col("year") - window
    return years.select(F.col("year").alias("valid_year"), begin.cast("int").alias("train_start"), (F.col("year") - 1).cast("int").alias("train_end")).where("train_start <= train_end")


def train_thresholds(df: DataFrame, q: float, name: str, window: int | None = 3, start: int | None = None, cases: str = "cases", district: str = "district", date: str = "date") -> DataFrame:
    """The quantile over the years before a row's own. Years are few, so rows meet their folds in
    a broadcast range join; the quantiles are aggregated and joined back."""
    rows = df.withColumn("_year", F.year(date))
    folds = F.broadcast(train_windows(rows.select(F.col("_year").alias("year")).where("year IS NOT NULL").distinct(), window, start))
    by = rows.join(folds, rows["_year"].between(folds["train_start"], folds["train_end"])).groupBy("valid_year", F.col(district).alias("_d")).agg(quantile(cases, q).alias(name))
    return rows.join(by, (rows["_year"] == by["valid_year"]) & rows[district].eqNullSafe(by["_d"]), "left").drop("_year", "_d", "valid_year")


def gap_fill(df: DataFrame, q: float, name: str, cases: str = "cases", district: str = "district", date: str = "date", full_history: bool = False) -> DataFrame:
    """Missing thresholds become past-only ones, over the missing rows or over all."""
    rows = df.withColumn("_missing", F.lit(True) if full_history else F.col(name).isNull())
    filled = running_quantile(rows, q, "_past", [district, "_missing"], cases, date)
    return filled.withColumn(name, F.coalesce(name, "_past")).select(*df.columns)


def next_step_label(df: DataFrame, threshold: Column, name: str, cases: str = "cases", order: list[str] | None = None, district: str = "district") -> DataFrame:
    """1 where the district's next row is over this row's threshold."""
    w = W.partitionBy(district).orderBy(*[F.col(c).asc_nulls_last() for c in order or ["date"]])
    return df.withColumn(name, is_true(F.lead(cases).over(w) > threshold))


def scope_audit(df: DataFrame, name: str, q: float, window: int | None = 3, start: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose threshold is not that of their train years."""
    again = train_thresholds(df, q, "_again", window, start)
    bad = again.where(F.col("_again").isNotNull() & (F.abs(F.col(name) - F.col("_again")) > tolerance))
    return bad
