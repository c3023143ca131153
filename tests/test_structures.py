"""Running quantiles and nearest places against plain versions, on sizes that all pairs or growing frames would not end on."""

import math
import random
import time

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators import features, labels


def test_running_quantile_of_any_numbers():
    rng = random.Random(1)
    for q in (0.0, 0.3, 0.5, 0.75, 1.0):
        values, state = [], labels.RunningQuantile(q)
        assert state.value() is None
        for _ in range(400):
            values.append(rng.choice([rng.randint(0, 5), rng.gauss(0, 10), -3.0]))
            state.add(values[-1])
            assert math.isclose(state.value(), float(np.quantile(values, q)), abs_tol=1e-9)


def test_past_thresholds_are_those_of_a_growing_frame(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), f"2020-{rng.randint(1, 12):02d}-{d:02d}" if rng.random() < 0.95 else None, None if rng.random() < 0.1 else rng.randint(0, 9), "x", d * 1.0 if rng.random() < 0.5 else None) for d in range(1, 28) for _ in range(6)]
    df = spark.createDataFrame(rows, "district string, date string, cases int, _value string, t double").dropDuplicates(["district", "date"]).repartition(3).persist()
    frame = W.partitionBy("district").orderBy(F.col("date").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("p", F.expr("percentile(cases, 0.75D)").over(frame))
    got = labels.past_thresholds(df.withColumn("date", F.to_date("date")), 0.75, "p").withColumn("date", F.col("date").cast("string"))
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    missing = W.partitionBy("district", F.col("t").isNull()).orderBy(F.col("date").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    for full, w in ((False, missing), (True, frame)):
        want = df.withColumn("t", F.round(F.coalesce("t", F.expr("percentile(cases, 0.4D)").over(w)), 9))
        got = labels.gap_fill(df, 0.4, "t", full_history=full).withColumn("t", F.round("t", 9))
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert labels.past_thresholds(df.limit(0), 0.5, "p").isEmpty()


def test_a_district_of_a_million_rows_ends(spark):
    began = time.perf_counter()
    df = spark.range(1_000_000).select(F.lit("one").alias("district"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("cases"))
    last = labels.past_thresholds(df, 0.75, "t").orderBy(F.desc("date")).first()
    assert math.isclose(last.t, df.agg(F.percentile("cases", F.lit(0.75))).first()[0]) and time.perf_counter() - began < 120


def nearest(rows, k):
    out = {}
    points = {(n, y, x) for n, y, x in rows if n is not None and x is not None and y is not None}
    for n, y, x in points:
        near = sorted((math.hypot(y - v, x - u), m) for m, v, u in points if m != n)[:k]
        out |= {(n, i + 1): (m, d) for i, (d, m) in enumerate(near)}
    return out


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    """Clusters of very different density, equal places, places on a line with equal distances, far ones."""
    monkeypatch.setattr(features, "FEW", 5)
    monkeypatch.setattr(features, "CROWD", 4)
    rng = random.Random(3)
    rows = [(f"c{i}", rng.gauss(0, 0.001), rng.gauss(0, 0.001)) for i in range(60)] + [(f"w{i}", rng.gauss(5, 1), rng.gauss(5, 1)) for i in range(40)]
    rows += [(f"e{i:02d}", 1.0, 1.0) for i in range(9)] + [(f"l{i}", 10.0, float(i)) for i in range(12)] + [("far", 1000.0, -1000.0), ("n", None, 1.0), (None, 1.0, 2.0), ("c0", *rows[0][1:])]
    for k in (1, 3):
        got = {(r.src, r["rank"]): (r.dst, r.distance) for r in features.neighbours(spark.createDataFrame(rows, "district string, lat double, lon double"), k).collect()}
        want = nearest(rows, k)
        assert got.keys() == want.keys() and all(got[key][0] == m and math.isclose(got[key][1], d, abs_tol=1e-12) for key, (m, d) in want.items())
    two = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0)], "district string, lat double, lon double")
    assert sorted((r.src, r.dst) for r in features.neighbours(two, 3).collect()) == [("a", "b"), ("b", "a")]
    assert features.neighbours(two.limit(1), 3).isEmpty() and features.neighbours(two.limit(0), 3).isEmpty()


def test_neighbours_of_a_hundred_thousand_places(spark):
    began = time.perf_counter()
    near = F.when(F.col("id") % 3 == 0, 0.01).otherwise(10.0)
    places = spark.range(100_000).select(F.col("id").cast("string").alias("district"), (F.randn(1) * near).alias("lat"), (F.randn(2) * near).alias("lon"))
    assert features.neighbours(places, 3).count() == 300_000 and time.perf_counter() - began < 240


def test_stratified_takes_the_exact_share_of_each_class(spark):
    from tidewatch.operators import posterior

    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, 0).when(F.col("id") < 4990, 1).alias("y"), F.lit("x").alias("_h")).repartition(5)
    got = posterior.stratified(df, "y", 0.25, ["id"])
    assert {r.y: r["count"] for r in got.groupBy("y").count().collect()} == {0: 1000, 1: 248, None: 3} and got.columns == df.columns
    again = posterior.stratified(df.coalesce(1), "y", 0.25, ["id"])
    assert got.exceptAll(again).isEmpty() and posterior.stratified(df, "y", 1.0, ["id"]).count() == 5000 and posterior.stratified(df, "y", 0.0, ["id"]).isEmpty()
    assert posterior.stratified(df.limit(0), "y", 0.5, ["id"]).isEmpty()
